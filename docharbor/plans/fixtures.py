"""Small literal inputs for operators that the given tables have no data for."""

from __future__ import annotations

import json

VENDOR_URLS = [
    (1, "https://www.siemens-healthineers.com/de/mri/magnetom"),
    (2, "https://www.siemens-healthineers.com/"),
    (3, "https://www.philips.com/healthcare?x=1"),
    (4, "https://diagnostics.roche.com/global/en/products.html"),
    (5, "https://www.gehealthcare.com"),
    (6, "https://example.org/en/a#top"),
    (7, "https://diagnostics.roche.com/"),
]
FILES = [
    (1, "https://a.org/x/report.PDF", "pdf", ""),
    (2, "https://a.org/get?file=plan.docx", "", ".docx"),
    (3, "https://a.org/pic.jpeg?v=1", None, ""),
    (4, "https://a.org/none", "csv", ""),
    (5, "https://a.org/dir/.pdf", "", ""),
    (6, "https://a.org/x/report.PDF", "pdf", ""),
    (7, "https://a.org/", "", ""),
]
CONTENT_TYPES = [(1, "application/pdf"), (2, " Image/PNG ; q=1"), (3, None), (4, "text/html"), (5, "text/csv;charset=utf-8")]
NAMES = [(1, "a/b:c?.pdf"), (2, " .. "), (3, "plain.txt"), (4, '<<x>>"y"|z*'), (5, "")]

_OBJ = [
    ["baseobj", ["w", "i1"], {"_obj_class": "DownloadItem", "_path": "/products/mri/a", "link": ["link", {"obj_id": "o1"}]}],
    ["baseobj", ["w", "i2"], {"_obj_class": "DownloadItem", "_path": "/other/a", "link": ["link", {"obj_id": "o1"}]}],
    ["baseobj", ["w", "i3"], {"_obj_class": "DownloadItem", "_path": "/products/mri/b", "link": {"obj_id": "o2"}}],
    ["other", ["w", "o9"], {}],
    ["baseobj", ["w", "o1"], {"blob": ["binary", {"id": "abc/old.pdf"}]}],
    ["baseobj", ["w", "o1"], {"blob": ["binary", {"id": "abc/Spec.PDF"}]}],
    ["baseobj", ["w", "o2"], {"blob": {"id": "abc/pic.png"}}],
]
DUMPS = [(1, "https://a.org/products/mri/", "x;\nwindow.preloadDump = " + json.dumps(json.dumps({"recording": _OBJ})) + ";\n"), (2, "https://a.org/none", "var a = 1;")]


def _record(i, **attrs):
    return {"id": f"d{i}", "attributes": {"title": f"T{i}", "fileFormat": "pdf"} | attrs}


_FIRST = [_record(i) for i in range(34)] + [None, {"id": "x", "attributes": None}, _record(1), _record(90, accessible=False), _record(91, blockedNotOwner=True), {"id": "bare"}]
LISTINGS = [
    ("https://docs.example.org/documents?products=a", 1, json.dumps({"meta": {"total": 60}, "data": _FIRST})),
    ("https://docs.example.org/documents?products=a", 2, json.dumps({"meta": None, "data": [_record(i, fileFormat="zip") for i in range(100, 120)]})),
    ("https://docs.example.org/documents?products=b", 1, "not json"),
]

CARDS = [
    (1, "https://a.org/p", "Scanners", "<body><main><section><h2>Magnetom One</h2><p>A 3 T system.</p><p>Weight 450 kg</p><a href='/x'>More</a></section><div class='cookie-bar'><p>We use cookies here, read more about it</p></div><div><h2>magnetom one</h2><p>Uptake time: 60 min</p></div></main></body>"),
    (2, "https://a.org/t", "Table", "<body><table><caption>Spec</caption><tr><th>Field</th><th>Bore</th></tr><tr><td>3 T</td><td>70 cm</td></tr></table><p>Loose text about nothing</p></body>"),
    (3, "https://a.org/q", "", "<article><h1>Only <b>heading</h1><p>One<p>Two</article>"),
    (4, "https://a.org/e", "Empty page", ""),
]

_R = "https://www.prefectures-regions.gouv.fr"
_RAA = f"{_R}/bretagne/Documents-publications/Recueil-des-actes-administratifs"
SITE_LINKS = [
    (1, f"{_RAA}/2026", "Recueil 2026"),
    (2, f"{_R}/bretagne/Documents-publications", "Documents & publications"),
    (3, f"{_R}/bretagne/DRAAF", "DRAAF"),
    (4, f"{_RAA}/2026/avril.pdf", "RAA avril"),
    (5, "https://www.facebook.com/x", "Suivez-nous"),
    (6, f"{_RAA}/(offset)/10", "Page suivante"),
    (7, f"{_R}/bretagne/Documents-publications/RAA", "RAA"),
    (8, f"{_R}/contact", "Contact"),
]
SITE = [
    (1, f"{_R}/", "<a href='/bretagne'>Bretagne</a><a href='/corse'>Corse</a><a href='/contact'>Contact</a><a href='/outils'>Outils</a>"),
    (2, f"{_R}/bretagne", "<a href='/bretagne/Documents-publications'>Documents & publications</a><a href='/tags/view/x'>Documents publications</a>"),
    (3, f"{_R}/bretagne/Documents-publications", f"<a href='{_RAA}'>Recueil des actes administratifs</a><a href='mailto:a@b.fr'>Mail</a><a href='/bretagne/Documents-publications/DRAAF'>DRAAF</a>"),
    (4, _RAA, f"<h2>Recueils</h2><a href='{_RAA}/2026'>2026</a><a href='{_RAA}/2019'>2019</a>"),
    (5, f"{_RAA}/2026", f"<h2>Année 2026</h2><h3>Avril</h3><p>du 29 avril 2026</p><a href='/content/raa-12.pdf'>RAA 12</a><a href='/content/raa-12.pdf' title='RAA du 28.04.2026'>encore</a><h3>Mars</h3><li>liste</li><a href='/content/20260302_raa.pdf#x'>RAA 9</a><a href='{_RAA}/2026/fevrier'>Février</a>"),
    (6, f"{_RAA}/2026/fevrier", "<p>sans date</p><a href='/content/raa-fev.pdf'>RAA février</a><a href='/content/raa-12.pdf'>RAA 12</a>"),
    (7, f"{_RAA}/2019", "<a href='/content/raa_2019.pdf'>RAA 2019</a>"),
    (8, f"{_R}/corse", "<a href='/corse/page'>Rien</a>"),
]
