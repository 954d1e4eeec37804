"""Small literal tables and what the operators make of them, row by row: expected values are written out, not computed from the library's own lists."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as d
from ..functions import quality as ql
from ..functions import text as tx
from ..functions import urls as u
from ..operators import blocks as bl
from ..operators import entities, gazette, graph, tracker
from ..operators import links as ln
from ..operators import ordered as od
from ..sources import html, listing, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

R = "https://www.prefectures-regions.gouv.fr"
RAA = f"{R}/bretagne/Documents-publications/RAA"
AIN, VAR = "https://www.ain.gouv.fr", "https://www.var.gouv.fr"


def lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v!r}::double"
    return str(v).lower() if isinstance(v, bool) else str(v)


def values(rows: list[tuple], columns: str) -> str:
    """SQL of literal rows; columns: names and types."""
    names = [x.split()[0] for x in columns.split(", ")]
    typed = ", ".join(f"cast({n} as {x.split()[1].replace('string', 'varchar')}) as {n}" for n, x in zip(names, columns.split(", "), strict=True))
    return f"select {typed} from (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as t({', '.join(names)})"


def expect(columns: str, *rows: tuple) -> Callable[[Query], Query]:
    """Registers a query with the rows that it must give."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, values(list(rows), columns)
        return f

    return add


def table(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def c(name: str) -> Column:
    return F.col(name)


# Addresses.


@expect(
    "id int, government boolean, portal boolean, blocked boolean, page boolean, region string, is_region boolean, documents boolean",
    (1, True, True, False, True, "bretagne", True, False),
    (2, True, True, False, True, "", False, False),
    (3, True, False, False, False, "", False, False),
    (4, False, False, True, True, "", False, False),
    (5, False, False, False, True, "", False, True),
    (6, True, True, False, True, "outils", False, False),
    (7, True, True, False, True, "bretagne", False, True),
    (8, False, False, False, False, "", False, False),
    (9, True, True, False, True, "tags", False, True),
    (10, False, False, False, False, "", False, False),
    (11, False, False, True, True, "", False, False),
    (12, True, True, False, True, "", False, False),
)
def gazette_hosts(spark, sf_dir):
    rows = table(
        spark,
        "id int, url string",
        (1, f"{R}/bretagne"),
        (2, "https://prefectures-regions.gouv.fr/Corse/"),
        (3, "https://gouv.fr/a/contact-us"),
        (4, "https://www.facebook.com/x"),
        (5, "https://notgouv.fr/Documents%20publications"),
        (6, f"{R}/outils"),
        (7, f"{R}/bretagne/DOCUMENTS-PUBLICATIONS?x=1"),
        (8, "mailto:a@x.com"),
        (9, f"{R}/tags/view/Documents%2Bet%2Bpublications"),
        (10, "https://x.com.evil.org/a.PDF"),
        (11, "https://mobile.twitter.com/"),
        (12, f"{R}/"),
    )
    x = c("url")
    blocked = u.host_in(x, ["facebook.com", "twitter.com", "x.com", "linkedin.com"])
    return rows.select("id", gazette.government_host(x).alias("government"), gazette.portal_host(x).alias("portal"), blocked.alias("blocked"), gazette.html_page(x).alias("page"), gazette.region_slug(x).alias("region"), gazette.region_page(x).alias("is_region"), gazette.documents_page(x).alias("documents"))


LINK_TEXTS = [
    (1, RAA, "RAA"),
    (2, f"{R}/bretagne/DRAAF", "DRAAF"),
    (3, f"{AIN}/recueil-des-actes-administratifs-r12", ""),
    (4, f"{AIN}/a/(offset)/10", "Page Précédente"),
    (5, f"{AIN}/Ann%C3%A9e_2024", "Août"),
    (6, f"{AIN}/x?y=R.A.A", "Recueil raa."),
    (7, f"{AIN}/p", "Maison suivante"),
]


@expect(
    "id int, path_text string, combined string, context boolean, dated boolean, further boolean",
    (1, "bretagne documents publications raa", "raa bretagne documents publications raa", True, False, False),
    (2, "bretagne draaf", "draaf bretagne draaf", False, False, False),
    (3, "recueil des actes administratifs r12", "recueil des actes administratifs r12", True, False, False),
    (4, "a (offset) 10", "page precedente a (offset) 10", False, False, True),
    (5, "annee 2024", "aout annee 2024", False, True, False),
    (6, "x y=r.a.a", "recueil raa. x y=r.a.a", True, False, False),
    (7, "p", "maison suivante p", False, True, True),
)
def gazette_context(spark, sf_dir):
    """What address and text of a link say: a look-alike word, accents, encoded letters, a month inside another word."""
    rows, x, t = table(spark, "id int, url string, text string", *LINK_TEXTS), c("url"), c("text")
    return rows.select("id", gazette.path_text(x).alias("path_text"), gazette.combined(x, t).alias("combined"), gazette.has_context(x, t).alias("context"), gazette.year_or_month(x, t).alias("dated"), gazette.pagination(x, t).alias("further"))


@expect(
    "id int, same_region boolean, year_fits boolean, month_fits boolean, both_fit boolean",
    (1, True, True, True, True),
    (2, False, True, False, True),
    (3, False, False, True, False),
    (4, False, True, True, True),
    (5, True, True, False, True),
)
def gazette_scope(spark, sf_dir):
    rows = table(
        spark,
        "id int, url string, text string",
        (1, f"{R}/bretagne/a", "avril 2026"),
        (2, f"{R}/bretagne", "mars 2026"),
        (3, f"{R}/corse/bretagne/a", "avril 2025"),
        (4, f"{AIN}/x", "sans date"),
        (5, f"{R}/BRETAGNE/2026/2025", ""),
    )
    x, t = c("url"), c("text")
    return rows.select("id", gazette.same_region(x, F.lit("bretagne")).alias("same_region"), gazette.in_scope(x, t, ["2026"]).alias("year_fits"), gazette.in_scope(x, t, None, ["April"]).alias("month_fits"), gazette.in_scope(x, t, ["2026"], ["April", "March"]).alias("both_fit"))


def _roots(rows: DataFrame) -> DataFrame:
    return rows.withColumn("roots", F.filter(F.split("roots", " "), lambda r: r != ""))


@expect(
    "id int, candidate boolean, within boolean, registers boolean",
    (1, True, False, True),
    (2, False, False, False),
    (3, False, False, False),
    (4, False, True, False),
    (5, False, False, True),
    (6, False, False, False),
    (7, False, False, False),
    (8, False, False, True),
)
def gazette_trust(spark, sf_dir):
    """Which links to other government hosts are trusted: an address counts as within a branch if it lies above its root."""
    rows = _roots(
        table(
            spark,
            "id int, url string, text string, source string, branch string, roots string",
            (1, f"{AIN}/raa/recueil-des-actes-administratifs", "x", RAA, RAA, ""),
            (2, f"{AIN}/contact/raa", "RAA", RAA, RAA, ""),
            (3, "https://example.org/recueil-des-actes-administratifs", "", RAA, RAA, ""),
            (4, f"{AIN}/raa", "Recueil raa", f"{AIN}/raa/recueil", RAA, f"{AIN}/raa/recueil"),
            (5, f"{AIN}/autre", "Recueil raa", f"{AIN}/raa/recueil", RAA, f"{AIN}/raa/recueil/2024"),
            (6, f"{R}/bretagne/x", "", RAA, RAA, ""),
            (7, f"{AIN}/liste", "Liste", "https://a.gouv.fr/", "https://a.gouv.fr", ""),
            (8, f"{AIN}/liste", "Recueil RAA", "https://a.gouv.fr/", "https://a.gouv.fr", ""),
        )
    )
    x, t, s = c("url"), c("text"), c("source")
    return rows.select("id", gazette.trusted_candidate(x, t, s, F.lit(False)).alias("candidate"), gazette.above_root(x, c("roots")).alias("within"), gazette.registers_root(x, t, s, c("branch"), c("roots")).alias("registers"))


@expect(
    "id int, follow boolean",
    (1, True),
    (2, False),
    (3, False),
    (4, False),
    (5, True),
    (6, True),
    (7, False),
    (8, True),
    (9, False),
    (10, True),
    (11, True),
    (12, False),
)
def gazette_follow(spark, sf_dir):
    """Where a traversal of gazette pages goes: inside the region's branch, to trusted hosts, and along their listings."""
    root = f"{VAR}/raa/2024"
    rows = _roots(
        table(
            spark,
            "id int, url string, text string, slug string, branch string, source string, roots string",
            (1, f"{RAA}/2026", "x", "bretagne", RAA, RAA, ""),
            (2, f"{R}/bretagne/Documents-publications/Autres/2026", "2026", "bretagne", RAA, RAA, ""),
            (3, f"{R}/corse/Documents-publications/RAA", "RAA", "bretagne", RAA, RAA, ""),
            (4, f"{R}/bretagne/Documents-publications", "avril 2026", "bretagne", RAA, RAA, ""),
            (5, f"{AIN}/recueil-des-actes-administratifs", "", "bretagne", RAA, RAA, ""),
            (6, f"{AIN}/autre/2024", "Recueil raa", "", f"{AIN}/raa", f"{AIN}/raa", ""),
            (7, f"{AIN}/autre/2024", "2024", "", f"{AIN}/raa", f"{AIN}/raa", ""),
            (8, f"{AIN}/raa", "Page suivante", "", f"{AIN}/raa/liste", f"{AIN}/raa/liste", ""),
            (9, f"{AIN}/raa.pdf", "Recueil raa", "", f"{AIN}/raa", f"{AIN}/raa", ""),
            (10, f"{VAR}/raa", "2024", "bretagne", RAA, root, root),
            (11, f"{VAR}/autre", "Recueil raa", "bretagne", RAA, f"{VAR}/raa", root),
            (12, f"{VAR}/autre", "Divers", "bretagne", RAA, f"{VAR}/raa", root),
        )
    )
    return rows.select("id", gazette.follows(c("url"), c("text"), c("slug"), c("branch"), c("source"), c("roots")).alias("follow"))


@expect("id int, rank int", (1, 161), (2, 91), (3, 20), (4, 0), (5, 116))
def gazette_page_rank(spark, sf_dir):
    rows = table(spark, "id int, url string", (1, f"{RAA}/2026/avril"), (2, f"{AIN}/2026/(offset)/10"), (3, RAA), (4, f"{AIN}/x"), (5, f"{AIN}/annee-2026"))
    return rows.select("id", gazette.page_rank(c("url")).cast("int").alias("rank"))


@expect("url string, seq int", (f"{RAA}/2026", 2), (f"{RAA}/2025", 0))
def gazette_pages_chosen(spark, sf_dir):
    """More pages than may be read: the most promising ones, each once."""
    rows = table(spark, "url string, seq int", (f"{RAA}/2025", 0), (RAA, 1), (f"{RAA}/2026", 2), (f"{RAA}/2026", 3))
    return gazette.pages_to_extract(rows, 2)


@expect("id int, made string", (1, f"{R}/bretagne/Documents-publications {R}/bretagne/DOCUMENTS-PUBLICATIONS"), (2, ""))
def documents_candidates(spark, sf_dir):
    rows = table(spark, "id int, url string", (1, f"{R}/bretagne/?x=1#y"), (2, f"{R}/"))
    return rows.select("id", F.array_join(gazette.documents_candidates(c("url")), " ").alias("made"))


def _links(spark, *rows: tuple) -> DataFrame:
    return table(spark, "page_url string, pos int, url string, text string", *rows)


@expect("pos int, url string", (0, f"{R}/bretagne"), (2, f"{R}/corse"))
def region_pages(spark, sf_dir):
    links = _links(spark, (f"{R}/", 0, f"{R}/bretagne", "Bretagne"), (f"{R}/", 1, f"{R}/contact", "Contact"), (f"{R}/", 2, f"{R}/corse", "Corse"), (f"{R}/", 3, f"{R}/a/b", "B"), (f"{R}/", 4, "https://o.fr/a", "A"), (f"{R}/x", 0, f"{R}/paca", "Paca"))
    return gazette.region_pages(links)


@expect(
    "region_url string, documents_url string",
    (f"{R}/bretagne", f"{R}/bretagne/Documents-publications"),
    (f"{R}/corse", f"{R}/corse/Documents-publications"),
    (f"{R}/grand-est/documents-publications", f"{R}/grand-est/documents-publications"),
    (f"{R}/paca", f"{R}/paca/tags/view/documents-publications"),
)
def documents_pages(spark, sf_dir):
    """A region's documents page: itself, its best link (the canonical path before tag pages), or the usual address."""
    links = _links(
        spark,
        (f"{R}/bretagne", 0, f"{R}/bretagne/tags/view/documents-publications", "Documents publications"),
        (f"{R}/bretagne", 1, f"{R}/bretagne/Documents-publications", "Documents"),
        (f"{R}/bretagne", 2, f"{R}/corse/Documents-publications", "Documents publications"),
        (f"{R}/paca", 0, f"{R}/paca/tags/view/documents-publications", "x"),
        (f"{R}/paca", 1, f"{R}/paca/Documents-publications/a.pdf", "Documents publications"),
    )
    regions = table(spark, "region_url string", (f"{R}/bretagne/",), (f"{R}/corse",), (f"{R}/grand-est/documents-publications",), (f"{R}/paca",))
    return gazette.documents_pages(regions, links)


@expect("documents_url string, pos int, url string", (f"{R}/bretagne/Documents-publications", 1, f"{R}/bretagne/Documents-publications/RAA"), (f"{R}/bretagne/Documents-publications", 3, f"{AIN}/recueil-des-actes-administratifs"))
def entry_pages(spark, sf_dir):
    at = f"{R}/bretagne/Documents-publications"
    links = _links(
        spark,
        (at, 0, f"{at}/DRAAF", "DRAAF"),
        (at, 1, f"{at}/RAA", "RAA"),
        (at, 2, f"{R}/corse/Documents-publications/RAA", "RAA"),
        (at, 3, f"{AIN}/recueil-des-actes-administratifs", "Ain"),
        (at, 4, "https://example.org/recueil-des-actes-administratifs", "RAA"),
        (at, 5, f"{at}/RAA", "encore"),
        (at, 6, f"{at}/RAA/raa.pdf", "RAA"),
        (f"{R}/autre", 0, f"{at}/RAA/2026", "RAA"),
    )
    return gazette.entry_pages(table(spark, "documents_url string", (at,)), links)


@expect(
    "kind string, n int, value string",
    ("found", 0, RAA),
    ("found", 1, f"{RAA}/2026"),
    ("found", 2, f"{AIN}/recueil-des-actes-administratifs"),
    ("found", 3, f"{RAA}/2026/avril"),
    ("scanned", 0, RAA),
    ("scanned", 1, f"{RAA}/2026"),
    ("scanned", 2, f"{AIN}/recueil-des-actes-administratifs"),
    ("error", 0, f"raa_fetch_failed:{AIN}/recueil-des-actes-administratifs:not stored"),
    ("error", 1, f"raa_scan_cap_reached:{RAA}:3"),
)
def gazette_expand(spark, sf_dir):
    """A traversal with its cap on scanned pages; a page that isn't stored is reported."""
    links = _links(
        spark,
        (RAA, 0, f"{RAA}/2026", "2026"),
        (RAA, 1, f"{R}/bretagne/DRAAF", "DRAAF"),
        (RAA, 2, f"{AIN}/recueil-des-actes-administratifs", "Ain"),
        (RAA, 3, f"{RAA}/a.pdf", "RAA"),
        (f"{RAA}/2026", 0, f"{RAA}/2026/avril", "Avril"),
        (f"{RAA}/2026", 1, RAA, "retour"),
        (f"{RAA}/2026/avril", 0, f"{RAA}/2026/avril/x", "x"),
    )
    pages = table(spark, "url string", (RAA,), (f"{RAA}/2026",), (f"{RAA}/2026/avril",))
    found, scanned, errors = gazette.expand(RAA, links, pages, max_scans=3)
    return table(spark, "kind string, n int, value string", *[(k, n, v) for k, vs in (("found", found), ("scanned", scanned), ("error", errors)) for n, v in enumerate(vs)])


# Links and files.


@expect(
    "id int, non_http boolean, email boolean",
    (1, True, False),
    (2, True, False),
    (3, False, True),
    (4, False, False),
    (5, False, False),
    (6, False, False),
    (7, False, False),
    (8, True, False),
    (9, False, True),
)
def href_kinds(spark, sf_dir):
    rows = table(spark, "id int, href string", (1, " MAILTO:a@b.c"), (2, "#top"), (3, "a@b.fr"), (4, "/a@b"), (5, "https://u@h"), (6, ""), (7, None), (8, "Tel:1"), (9, " x@y "))
    return rows.select("id", u.is_non_http(c("href")).alias("non_http"), u.is_bare_email(c("href")).alias("email"))


@expect("id int, urls string", (1, "a.png|b.png"), (2, "c.png"), (3, "d.png|/e.png"))
def srcset_urls(spark, sf_dir):
    rows = table(spark, "id int, srcset string", (1, "a.png 1x, b.png 2x"), (2, " c.png"), (3, "d.png   100w,/e.png"))
    return rows.select("id", F.array_join(u.srcset(c("srcset")), "|").alias("urls"))


@expect("id int, name string", (1, "a b.pdf"), (2, "ré.pdf"), (3, None), (4, "x.txt"))
def header_filenames(spark, sf_dir):
    rows = table(spark, "id int, header string", (1, 'attachment; filename="a b.pdf"'), (2, "attachment; filename*=UTF-8''r%C3%A9.pdf"), (3, "inline"), (4, "FILENAME=x.txt; y=z"))
    return rows.select("id", u.header_filename(c("header")).alias("name"))


@expect("id int, name string", (1, "r p.pdf"), (2, "document_2.bin"), (3, "name.pdf"), (4, "a_b"), (5, "document_5.pdf"))
def url_filenames(spark, sf_dir):
    rows = table(spark, "id int, url string, ext string", (1, "https://a.org/x/r%20p.pdf", ".bin"), (2, "https://a.org/", ".bin"), (3, "https://a.org/x/name", ".pdf"), (4, "https://a.org/a:b", ""), (5, "https://a.org", ".pdf"))
    return rows.select("id", u.filename(c("url"), c("id"), c("ext")).alias("name"))


@expect(
    "id int, category string, folder string, dir string, address string",
    (1, "documents", "0001_D1_Title", "downloads/pdfs/a.org/p_q", "https://a.org/p/q/r.pdf"),
    (2, "images", "0002_0002_b", "downloads/pdfs/a.org/root", "https://c.org/z"),
    (3, "images", "0003_x_y_a", "downloads/pdfs/unknown-domain/x_y", "x/y"),
    (4, "documents", "0004_0004_p_q", "downloads/pdfs/A.org_8080/p", "https://A.org:8080/p"),
)
def document_folders(spark, sf_dir):
    rows = table(
        spark,
        "id int, url string, format string, type string, document string, title string, file string, pdf_url string",
        (1, "https://a.org/p/q/r.pdf", "PDF", "", "D1", "Title", "https://a.org/f.pdf", "u"),
        (2, "https://a.org/", "pdf", "image/PNG; q=1", None, "", "https://a.org/b.pdf", "https://c.org/z"),
        (3, "x/y", "..JPEG", None, "x/y", "a", "https://a.org/f", ""),
        (4, "https://A.org:8080/p", None, "text/csv", "", "p?q", "https://a.org/g.svg", None),
    )
    pdf = F.when(c("id") != 2, c("url"))
    return rows.select("id", u.category_folder(c("url"), c("format"), F.coalesce(c("type"), F.lit(""))).alias("category"), u.folder_name(c("id"), c("document"), c("title"), c("file")).alias("folder"), u.download_dir(c("url")).alias("dir"), u.document_url(pdf, c("pdf_url")).alias("address"))


@expect("id int, params string", (1, "products=b;search=q r"), (2, "document-types=z;sort=s"), (3, ""))
def listing_params(spark, sf_dir):
    """Parameters under their names in the interface, the last value of each; blank ones count as missing."""
    rows = table(spark, "id int, url string", (1, "https://d.org/x?search=q%20r&products=a&products=b&languages="), (2, "https://d.org/x?sortingby=s&documenttypes=z&other=1"), (3, "https://d.org/x"))
    entries = F.transform(F.map_entries(u.listing_params(c("url"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("id", F.array_join(entries, ";").alias("params"))


@expect(
    "id int, family boolean, relevant boolean",
    (1, True, True),
    (2, False, False),
    (3, True, True),
    (4, False, False),
    (5, True, True),
    (6, False, True),
    (7, False, True),
)
def discovery_pages(spark, sf_dir):
    rows = table(
        spark,
        "id int, candidate string, source string",
        (1, "https://a.org/x/y", "https://a.org/x"),
        (2, "https://a.org/xy", "https://a.org/x"),
        (3, "https://A.org/x", "https://a.org/x/"),
        (4, "https://b.org/x/document", "https://a.org/x"),
        (5, "https://a.org/z", "https://a.org"),
        (6, "https://a.org/Downloads/z", "https://a.org/x"),
        (7, "https://a.org/arr%C3%AAt%C3%A9s", "https://a.org/x"),
    )
    return rows.select("id", u.same_family(c("candidate"), c("source"), hosts=True).alias("family"), ln.relevant_page(c("candidate"), c("source")).alias("relevant"))


HREFS = [
    (1, "https://a.org/x/", 0, "b.pdf#p"),
    (1, "https://a.org/x/", 1, "b.pdf"),
    (1, "https://a.org/x/", 2, "/C.PDF"),
    (1, "https://a.org/x/", 3, "get?file=plan.docx"),
    (1, "https://a.org/x/", 4, "javascript:void(0)"),
    (1, "https://a.org/x/", 5, "mailto:a@b.c"),
    (1, "https://a.org/x/", 6, "ftp://a.org/z.pdf"),
    (1, "https://a.org/x/", 7, ""),
    (1, "https://a.org/x/", 8, "page"),
    (1, "https://a.org/x/", 9, "//o.org/i.png"),
]


@expect(
    "kind string, pos int, url string",
    ("all", 0, "https://a.org/x/b.pdf"),
    ("all", 2, "https://a.org/C.PDF"),
    ("all", 3, "https://a.org/x/get?file=plan.docx"),
    ("all", 8, "https://a.org/x/page"),
    ("all", 9, "https://o.org/i.png"),
    ("pdf", 0, "https://a.org/x/b.pdf"),
    ("pdf", 2, "https://a.org/C.PDF"),
    ("file", 0, "https://a.org/x/b.pdf"),
    ("file", 2, "https://a.org/C.PDF"),
    ("file", 3, "https://a.org/x/get?file=plan.docx"),
    ("file", 9, "https://o.org/i.png"),
)
def collected_links(spark, sf_dir):
    """Candidates made absolute, fragments off, each address once; of these the PDF and the file links."""
    links = table(spark, "page_id int, page_url string, pos int, href string", *HREFS)
    found = {"all": ln.dedupe_links(links), "pdf": ln.pdf_links(links), "file": ln.file_links(links)}
    out = None
    for kind, df in found.items():
        own = df.select(F.lit(kind).alias("kind"), "pos", "url")
        out = own if out is None else out.union(own)
    return out


@expect("pos int, title string, file_format string, source string, source_page string", (0, "b c.pdf", "PDF", "html_or_image_link", "https://a.org/x"), (1, "get", "DOCX", "html_or_image_link", "https://a.org/x"))
def document_rows(spark, sf_dir):
    links = table(spark, "page_id int, page_url string, pos int, url string", (1, "https://a.org/x", 0, "https://a.org/b%20c.pdf"), (1, "https://a.org/x", 1, "https://a.org/get?file=plan.docx"))
    return ln.document_rows(links).select("pos", "title", "file_format", "source", "source_page")


@expect("strategy int, pos int, url string", (0, 0, "https://a.org/a.pdf"), (1, 1, "https://a.org/c.png"), (2, 0, "https://a.org/d.zip"))
def link_strategies(spark, sf_dir):
    """Candidates of several strategies: earlier ones first, each address once, files only."""
    one = table(spark, "page_id int, page_url string, pos int, href string", (1, "https://a.org/", 0, "a.pdf"), (1, "https://a.org/", 1, "page"))
    two = table(spark, "page_id int, page_url string, pos int, href string", (1, "https://a.org/", 0, "a.pdf#x"), (1, "https://a.org/", 1, "c.png"))
    three = table(spark, "page_id int, page_url string, pos int, href string", (1, "https://a.org/", 0, "d.zip"))
    return ln.strategies(one, two, three).select("strategy", "pos", "url")


@expect("part string, value string", ("start", "https://a.org/mri/x?q=1"), ("modality", "mri"), ("prefix", "/mri/x"), ("include", "*/mri/x*,*/mri/x/*,*mri*,*magnetic-resonance*,*magnetic-resonance-imaging*,*magnetom*,*products*,*own*"), ("exclude_first", "*cookie*"), ("exclude_last", "*Old*"), ("root", "/ - *products*"))
def focus_plan(spark, sf_dir):
    """The constants of a focused crawl; blank patterns and those that differ in case only are left out."""
    p = ln.focus_plan("HTTPS://A.org/mri/x/?q=1#f", include=[" *own* ", "", "*PRODUCTS*"], exclude=["*Old*", "*OLD*"])
    q = ln.focus_plan("https://a.org")
    return table(spark, "part string, value string", ("start", p.start_url), ("modality", p.modality), ("prefix", p.prefix), ("include", ",".join(p.include)), ("exclude_first", p.exclude[0]), ("exclude_last", p.exclude[-1]), ("root", f"{q.prefix} {q.modality or '-'} {','.join(q.include)}"))


@expect("url string", ("https://a.org/mri/scanner",), ("https://a.org/mri",), ("https://a.org/x/ultrasound",))
def focus_filter(spark, sf_dir):
    """Links of a focused crawl without noise and without what names no focus term and isn't below the start."""
    rows = table(spark, "url string, pos int", ("https://a.org/mri/", 0), ("https://a.org/mri/scanner", 1), ("https://a.org/mri/news", 2), ("https://a.org/x/ultrasound", 3), ("https://a.org/y", 4), ("https://A.org/MRI/scanner", 5), ("https://a.org/mri/SCANNER", 6), ("", 7))
    return ln.rank_focused(rows, "https://a.org/mri", filtered=True).select("url")


@expect("id int, allowed boolean", (1, True), (2, False), (3, True), (5, True))
def robots_rules(spark, sf_dir):
    """Addresses that a site's robots file lets any agent read; sites without one allow all. Refused ones with a null verdict are left out."""
    rows = table(spark, "id int, url string", (1, "https://a.org/x"), (2, "https://a.org/private/x"), (3, "https://b.org/private"), (5, "https://c.org/"))
    robots = table(spark, "host string, robots_txt string", ("https://a.org", "User-agent: *\nDisallow: /private/"), ("https://c.org", ""))
    kept = graph.allowed(rows, robots).select("id", F.lit(True).alias("allowed"))
    return rows.select("id").join(kept, "id", "left").select("id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@expect(
    "id int, candidates string",
    (1, "https://www.siemens-healthineers.com/us/mri https://www.siemens-healthineers.com/en/mri https://www.siemens-healthineers.com/global/mri https://www.siemens-healthineers.com/"),
    (2, "https://example.org/en-us/a https://example.org/us/a https://example.org/global/a https://example.org/ https://example.org/en/products"),
    (3, "https://x.org/"),
)
def retry_pages(spark, sf_dir):
    """Other addresses to try for a page: locales, home, and links of its host that name content and no noise."""
    rows = table(spark, "id int, url string", (1, "https://www.siemens-healthineers.com/de/mri"), (2, "https://example.org/en/a"), (3, "https://x.org/long/a"))
    links = F.array(*map(F.lit, ["https://example.org/en/products", "https://example.org/login/product", "https://other.org/product", "https://example.org/zz"]))
    return rows.select("id", F.array_join(u.retry_candidates(c("url"), links), " ").alias("candidates"))


# Dates.


@expect(
    "id int, published string, year string, month string",
    (1, "2026-04-29", "2026", ""),
    (2, "2026-01-07", "2026", ""),
    (3, "2026-01-02", None, ""),
    (4, "2026-01-21", "2026", ""),
    (5, "2026-04-30", "2026", "April"),
    (6, "2025-02-01", "2025", "February"),
    (7, None, "2024", "August"),
    (8, None, "2026", ""),
    (9, None, None, ""),
    (10, "2025-12-31", "2025", "December"),
    (11, None, "2035", ""),
    (12, None, "2025", ""),
)
def date_texts(spark, sf_dir):
    """Each written form of a date, a day that doesn't exist, a year alone, and forms that aren't read."""
    rows = table(
        spark,
        "id int, value string",
        (1, "20260429_x.pdf"),
        (2, "du 07.01.2026"),
        (3, "02.01.26"),
        (4, "raa-21012026"),
        (5, "30 avril 2026"),
        (6, "1%20f%C3%A9vrier 2025"),
        (7, "août 2024"),
        (8, "30/02/2026"),
        (9, None),
        (10, "31 - 12 _ 2025, décembre"),
        (11, "2009 2035 2011"),
        (12, "2025-13-45"),
    )
    x = c("value")
    return rows.select("id", d.publication_date(x).cast("string").alias("published"), d.year_in(x).alias("year"), d.month_in(x).alias("month"))


@expect("id int, published string, source string", (1, "2026-01-07", "link_text"), (2, "2026-04-29", "filename"), (3, "", "unknown"))
def date_sources(spark, sf_dir):
    rows = table(spark, "id int, link string, file string", (1, "07.01.2026", "20260429.pdf"), (2, "x", "20260429.pdf"), (3, None, ""))
    return rows.select("id", d.date_with_source(("link_text", c("link")), ("filename", c("file"))).alias("f")).select("id", F.col("f.publication_date").alias("published"), F.col("f.date_source").alias("source"))


@expect("id int, inside boolean, unlimited boolean", (1, True, True), (2, True, True), (3, False, True), (4, False, True), (5, False, True))
def date_window(spark, sf_dir):
    """A window of three days ends today and has both bounds; without a number of days everything fits."""
    rows = table(spark, "id int, day string", (1, "2026-04-30"), (2, "2026-04-28"), (3, "2026-04-27"), (4, ""), (5, "2026-05-01"))
    return rows.select("id", d.in_window(c("day"), 3, date(2026, 4, 30)).alias("inside"), d.in_window(c("day"), 0, date(2026, 4, 30)).alias("unlimited"))


# Text and blocks.


@expect(
    "id int, low boolean, cookies int, hints int",
    (1, True, 0, 0),
    (2, True, 3, 0),
    (3, False, 1, 2),
    (4, True, 0, 0),
    (5, False, 0, 1),
    (6, True, 1, 0),
)
def markdown_quality(spark, sf_dir):
    """Empty, three notices, content beside a notice, a table without content, a table with content, a notice alone."""
    rows = table(spark, "id int, md string", (1, None), (2, "auth0 cookiebot IndexedDB"), (3, "Privacy Policy of the MRI scanner"), (4, "|a|\n| b\n |c\n|d"), (5, "|a|\n|b|\n|c|\n|mri|"), (6, "used to store"))
    x = F.coalesce(c("md"), F.lit(""))
    return rows.select("id", ql.low_quality(c("md")).alias("low"), ql.cookie_markers(x).alias("cookies"), ql.content_hints(x).alias("hints"))


@expect(
    "id int, quality string, reasons string, ratio double",
    (1, "good", "", 0.0),
    (2, "bad_source_page", "login_wall", 0.0),
    (3, "low_confidence", "mostly_noise_links", 0.6),
    (4, "low_confidence", "no_domain_content_hints", 0.0),
    (5, "low_confidence", "cookie_heavy_content", 0.0),
)
def page_quality(spark, sf_dir):
    """Verdicts on pages with titles, links and walls. Half a notice's characters beyond the first 1,500 don't make it heavy."""
    rows = table(
        spark,
        "id int, title string, md string, links array<string>, signals array<string>",
        (1, "", "An MRI product. " * 30, [], []),
        (2, "Scanner", "An MRI product. " * 30, [], ["login_wall"]),
        (3, None, "An MRI product. " * 30, ["/cookie", "/login", "/terms", "/a", "/b"], []),
        (4, "", "nothing here", [], []),
        (5, "cookiebot auth0 indexeddb", "An MRI product. " * 30, [], []),
    )
    return rows.select("id", ql.source_quality(c("title"), c("md"), c("links"), c("signals")).alias("q")).select("id", F.col("q.source_quality").alias("quality"), F.array_join("q.bad_source_reasons", ",").alias("reasons"), F.col("q.noise_link_ratio").cast("double").alias("ratio"))


@expect(
    "id int, line string, separator boolean, dropped boolean, cookieish boolean",
    (1, "a b c", False, False, False),
    (2, "x | y", False, False, False),
    (3, "|---|:---:|", True, False, False),
    (4, "| log in | x |", False, True, False),
    (5, "log in or sign up", False, True, False),
    (6, "sign up, log in: product", False, False, False),
    (7, "Our Privacy notice", False, True, True),
    (8, "1 fi", False, False, False),
)
def page_lines(spark, sf_dir):
    """Lines as the text pipeline sees them: white space, zero-width spaces, escaped pipes, compatible forms; rules of tables and what is dropped."""
    rows = table(spark, "id int, raw string", (1, " a  b​ \tc "), (2, "x \\| y"), (3, "|---|:---:|"), (4, "| log in | x |"), (5, "log in or sign up"), (6, "sign up, log in: product"), (7, "Our Privacy notice"), (8, "１ ﬁ"))
    x = c("line")
    return rows.select("id", tx.norm_line(tx.compatible(c("raw"))).alias("line")).select("id", "line", x.rlike(r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*$").alias("separator"), bl.drop_line(x).alias("dropped"), bl.cookieish(x).alias("cookieish"))


@expect(
    "id int, noise int, useful int, junk boolean, menu boolean",
    (1, 0, 3, False, False),
    (2, 2, 0, False, False),
    (3, 0, 0, True, False),
    (4, 0, 1, False, True),
    (5, 0, 4, False, False),
    (6, 0, 0, True, True),
    (7, 2, 0, True, False),
)
def block_signs(spark, sf_dir):
    """What counts for and against a block: terms, specifications, digits, notices, menus."""
    rows = table(
        spark,
        "id int, block string",
        (1, "magnetom with 3 tesla"),
        (2, "Sign Up or LOG IN"),
        (3, "tel 0123456789"),
        (4, "Home\nSearch\nContact us\nHelp"),
        (5, "order 0123456789 product, 64 slice"),
        (6, ""),
        (7, "cookie a\ncookie b\nsession c\nauth0 d"),
    )
    x = c("block")
    return rows.select("id", bl.noise(x).alias("noise"), bl.useful(F.lower(x)).alias("useful"), bl.junk(x).alias("junk"), bl.navigation(x).alias("menu"))


@expect("id int, merged string", (1, "One  a\n\ntwo\n\nthree"), (2, ""), (3, "x"))
def merged_texts(spark, sf_dir):
    """Paragraphs of several readings of a page: the first of those that differ in case and white space only."""
    rows = [(1, ["One  a\n\ntwo", "ONE a\n\n\nthree", None]), (2, [None, " \n\n "]), (3, ["x", "X"])]
    return table(spark, "id int, merged string", *[(i, html.merge_texts(c)) for i, c in rows])


@expect("id int, text string, title string", (1, "a b", "T"), (2, "", ""))
def plain_texts(spark, sf_dir):
    """Text without the signs of markdown; a page without a title has an empty one."""
    rows = table(spark, "id int, md string, title string", (1, "# a *b*", "T"), (2, "", None))
    return rows.select("id", F.trim(tx.plain_markdown(c("md"))).alias("text"), F.coalesce("title", F.lit("")).alias("title"))


@expect("id int, kept string", (1, "a B|c"), (2, ""))
def distinct_strings(spark, sf_dir):
    """Values squeezed, blanks dropped, the first of those that differ in case only."""
    rows = table(spark, "id int, vs array<string>", (1, ["a  B", "A b", " ", "c"]), (2, []))
    return rows.select("id", F.array_join(tx.distinct_ci(c("vs")), "|").alias("kept"))


PAGES = [
    (1, "https://a.org/mri", "Magnetom", "Magnetom scanner with a 3 Tesla field for routine imaging.\n\nHome\nSearch\nContact us\n\nMagnetom  SCANNER with a 3 Tesla field for routine imaging."),
    (2, "https://a.org/x", "", "Page not found\n\nThe product you want was moved elsewhere by us."),
    (3, "https://a.org/legal", "", "A workflow platform that every laboratory may use today."),
    (4, "https://a.org/e", None, None),
]


@expect(
    "id int, page_type string, score int, kept int, dropped int, clean_text string, reasons string",
    (1, "product_detail", 8, 1, 2, "Magnetom scanner with a 3 Tesla field for routine imaging.", "duplicate_block,medical_terms,navigation_block,thin_block,title_family"),
    (2, "fallback_noise", 0, 0, 2, "", "fallback_page,thin_block"),
    (3, "legal_noise", 0, 0, 1, "", "medical_terms,noise_url"),
    (4, "unknown", 0, 0, 0, "", ""),
)
def page_pipeline(spark, sf_dir):
    """Whole pages: a repeated block, a menu, an error page, a noisy address, an empty page."""
    rows = table(spark, "id int, url string, title string, markdown string", *PAGES)
    got = bl.page_results(rows, ["id"])
    return got.select("id", "page_type", F.col("relevance_score").alias("score"), F.col("useful_block_count").alias("kept"), F.col("dropped_block_count").alias("dropped"), "clean_text", F.array_join("dropped_reasons", ",").alias("reasons"))


@expect("id int, modality string, family string, candidate boolean", (1, "mri", "magnetom", True), (2, "pet_mr", "biograph", True), (3, "unknown", "", False), (4, "unknown", "", True), (5, "unknown", "", True), (6, "unknown", "", True))
def product_signs(spark, sf_dir):
    rows = table(spark, "id int, kind string, heading string, text string, links array<string>", (1, "text", "", "Magnetom MRI", []), (2, "heading", "Biograph PET/MR", "", []), (3, "text", "", "plain words", []), (4, "card", "", "plain words", []), (5, "section", "Heading", "plain", []), (6, "text", "", "weight 450 kg", []))
    both = F.concat_ws("\n", "heading", "text")
    pet = F.when(c("id") == 2, F.lit("pet_mr")).otherwise(entities.modality(both))
    return rows.select("id", pet.alias("modality"), entities.family(both).alias("family"), entities.is_candidate(c("kind"), c("heading"), c("text"), c("links")).alias("candidate"))


@expect("id bigint, pos int, block string, kind string, heading string, words string, links string", (1, 0, "card_0", "card", "Magnetom One", "Magnetom One\nA 3 T system.\nWeight 450 kg", "/x"), (1, 1, "section_1", "section", "magnetom one", "magnetom one\nUptake time: 60 min", ""), (2, 0, "table_0", "table", "Spec", "Spec\nField | Bore\nField | Bore\n3 T | 70 cm", ""), (2, 1, "text_1", "text", "", "Loose text about nothing", ""))
def block_sheet(spark, sf_dir):
    """Structured blocks as rows of a sheet: cards with links, sections, tables, loose text; notices are left out."""
    from ..operators import reports
    from .fixtures import CARDS

    rows = reports.block_rows(html.page_blocks(table(spark, "page_id long, url string, title string, html string", *CARDS)))
    return rows.select(F.col("page_id").alias("id"), "pos", F.col("Block ID").alias("block"), F.col("Type").alias("kind"), F.col("Heading").alias("heading"), F.col("Text").alias("words"), F.col("Links").alias("links"))


# Runs, inventory, downloads.


def _repository(spark: SparkSession) -> tracker.Repository:
    import uuid

    from ..operators.lineage import shared_dir

    return tracker.Repository(spark, f"{shared_dir(spark)}/repository-{uuid.uuid4().hex}")


@expect(
    "id bigint, run_type string, status string, months string, found int, fresh int, downloaded int, failed int, error string, seconds double, finished boolean, baseline boolean",
    (1, "archive_baseline", "baseline_created", "archive-all", 3, 0, 0, 0, "", 1.5, True, True),
    (2, "daily_diff", "completed", "April 2026", 5, 2, 1, 1, "", 2.25, True, True),
    (3, "daily_diff", "running", "May 2026", 0, 0, 0, 0, None, 0.0, False, True),
)
def run_lifecycle(spark, sf_dir):
    """Runs are created, finished, and get the figures of later downloads."""
    from datetime import UTC, datetime

    repo, at = _repository(spark), datetime(2026, 4, 30, tzinfo=UTC)
    if repo.has_baseline():
        raise AssertionError("an empty repository has no baseline")
    one = repo.create_run(at, "archive-all", "archive_baseline")
    repo.finish_run(one, "baseline_created", {"pdfs_discovered": 3}, {"total_seconds": 1.5})
    two = repo.create_run(at, "April 2026")
    repo.finish_run(two, "completed", {"pdfs_discovered": 5, "new_pdfs": 2}, {"total_seconds": 2.0})
    repo.add_downloads(two, 1, 1, {"download_seconds": 0.5, "total_seconds": 0.25})
    repo.create_run(at, "May 2026")
    cols = {"months": "months_scanned", "found": "pdfs_discovered", "fresh": "new_pdfs", "seconds": "total_seconds"}
    return repo.runs().select("id", "run_type", "status", *[F.col(v).alias(k) for k, v in cols.items()], "downloaded", "failed", "error", F.col("finished_at").isNotNull().alias("finished"), F.lit(repo.has_baseline()).alias("baseline"))


DOCS = "seq int, url string, title string, region string, year string, month string, publication_date string, date_source string, source_page string"


def _inventory(spark) -> tracker.Repository:
    from datetime import UTC, datetime

    repo = _repository(spark)
    one = table(spark, DOCS, (0, "HTTPS://A.org/1/#x", "t1", "bretagne", "2026", "April", "", "", "https://a.org/p"), (1, "https://a.org/2", "t2", "paca", "2025", "", "2025-01-02", "link_text", "https://a.org/p"))
    two = table(spark, DOCS, (0, "https://a.org/1", "new title", "corse", "2026", "April", "2026-04-29", "filename", "https://a.org/q"), (1, "https://a.org/3", "t3", "paca", "2026", "May", "", "", "https://a.org/q"))
    repo.upsert(one, 1, datetime(2026, 1, 1, tzinfo=UTC), ["seq"])
    repo.upsert(two, 2, datetime(2026, 1, 2, tzinfo=UTC), ["seq"])
    return repo


@expect(
    "id bigint, normalized_url string, region string, year string, title string, published string, date_source string, source_page string, first_run bigint, last_run bigint, first_day string, last_day string",
    (1, "https://a.org/1", "bretagne", "2026", "new title", "2026-04-29", "filename", "https://a.org/q", 1, 2, "2026-01-01", "2026-01-02"),
    (2, "https://a.org/2", "paca", "2025", "t2", "2025-01-02", "link_text", "https://a.org/p", 1, 1, "2026-01-01", "2026-01-01"),
    (3, "https://a.org/3", "paca", "2026", "t3", None, "", "https://a.org/q", 2, 2, "2026-01-02", "2026-01-02"),
)
def inventory_rows(spark, sf_dir):
    """Two runs into an inventory: a known address keeps where and when it was first seen, and gets a date it didn't have."""
    rows = _inventory(spark).documents()
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return rows.select("id", "normalized_url", "region", "year", "title", F.col("publication_date").cast("string").alias("published"), F.coalesce("date_source", F.lit("")).alias("date_source"), "source_page", F.col("first_run_id").alias("first_run"), F.col("last_run_id").alias("last_run"), day("first_seen_at").alias("first_day"), day("last_seen_at").alias("last_day"))


@expect("url string, region string, month string, title string", ("https://a.org/3", "paca", "May", "t3"))
def new_of_run(spark, sf_dir):
    return _inventory(spark).new_documents(2).select("url", "region", "month", "title")


@expect("id bigint, run_id bigint, document_id bigint, status string, saved_path string, error string", (1, 2, 3, "downloaded", "/d/3.pdf", ""), (2, 2, None, "failed: timeout", "", "failed: timeout"), (3, 2, 1, "skipped", "", ""))
def download_log(spark, sf_dir):
    """A row for each download beside its document, found in the inventory by its normalised address."""
    repo = _inventory(spark)
    docs = table(spark, "seq int, url string", (0, "https://A.org/3/"), (1, "https://a.org/unknown"), (2, "https://a.org/1#z"), (3, "https://a.org/2"))
    done = table(spark, "seq int, status string, file_path string", (0, "downloaded", "/d/3.pdf"), (1, "failed: timeout", ""), (2, "skipped", ""))
    repo.record_downloads(2, docs, done)
    return repo.downloads().select("id", "run_id", "document_id", "status", "saved_path", "error")


@expect("step string, run_id int, status string, found int, known int, fresh int, downloaded int, failed int", ("first", 1, "baseline_created", 2, 0, 0, None, None), ("second", 2, "completed", 2, 1, 1, None, None), ("download", 2, None, None, None, None, 0, 1))
def daily_diff(spark, sf_dir):
    """Without a baseline a daily check makes one; the next one finds what is new, which is then downloaded."""
    repo, today = _repository(spark), date(2026, 4, 30)

    def discover(years, months):
        rows = [(0, "https://a.org/1", "t1", "paca", "2026", "April", "2026-04-29", "filename", "p"), (1, "https://a.org/1#again", "t1", "paca", "2026", "April", "", "", "p"), (2, "https://a.org/old", "t", "paca", "2020", "May", "2020-05-01", "filename", "p"), (3, "https://a.org/c", "t", "Corse", "2026", "April", "", "", "p")]
        return table(spark, DOCS, *rows, *([(4, "https://a.org/2", "t2", "bretagne", "2026", "", "2026-04-01", "link_text", "p")] if years else []))

    one = tracker.daily_check(repo, discover, ["seq"], today)
    two = tracker.daily_check(repo, discover, ["seq"], today)
    three = tracker.download_new(repo, two["run_id"], lambda docs: docs.select(F.col("seq").cast("int").alias("seq"), F.lit("failed: no network").alias("status"), F.lit("").alias("file_path")))
    rows = [(k, r["run_id"], r.get("status"), r.get("pdfs_discovered"), r.get("already_known"), r.get("new_pdfs"), r.get("downloaded"), r.get("failed")) for k, r in (("first", one), ("second", two), ("download", three))]
    return table(spark, "step string, run_id int, status string, found int, known int, fresh int, downloaded int, failed int", *rows)


@expect("region string, selected bigint, downloaded bigint, failed bigint", ("paca", 2, 1, 1), ("unknown-region", 2, 1, 0))
def downloads_by_region(spark, sf_dir):
    from ..operators import reports

    chosen = table(spark, "seq int, region string", (0, "paca"), (1, ""), (2, "paca"), (3, None), (4, "bretagne"))
    done = table(spark, "seq int, status string", (0, "downloaded"), (1, "downloaded"), (2, "failed: x"), (3, "odd"))
    return reports.downloads_by_region(chosen, done)


@expect("blocked bigint", (2,))
def blocked_downloads(spark, sf_dir):
    from ..operators import reports

    message = "failed: download endpoint returned HTML instead of a downloadable file"
    return reports.blocked_downloads(table(spark, "status string", (message,), ("downloaded",), ("failed: x",), (message,), (None,)))


@expect("documents_pages_resolved bigint, raa_entry_count bigint", (2, 3))
def region_totals(spark, sf_dir):
    from ..operators import reports

    return reports.region_totals(table(spark, "region string, documents_url string, entries array<string>", ("a", "u", ["x", "y"]), ("b", "", []), ("c", None, ["z"]), ("d", "v", [])))


@expect("total_pages bigint, total_chars bigint, total_clean_chars bigint", (4, 262, 58))
def crawl_report(spark, sf_dir):
    from ..operators import reports

    rows = table(spark, "id int, url string, title string, markdown string", *PAGES).withColumns({"success": F.lit(True), "links": F.array(F.lit("a"))})
    return reports.crawl_totals(reports.page_rows(rows, ["id"]))


# Crawls of stored pages.


SITE = "https://s.org"


def _site(spark) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, "page_id int, url string, title string, success boolean", (0, f"{SITE}/", "Start", True), (1, f"{SITE}/documents", "Documents", True), (2, f"{SITE}/products/a", "A", True), (3, f"{SITE}/files/x", "X", False), (4, f"{SITE}/login", "Login", True), (5, f"{SITE}/documents/more", "More", True))
    hrefs = [(0, 0, "/products/a"), (0, 1, "/documents"), (0, 2, "/login"), (0, 3, "/files/x"), (0, 4, "https://o.org/documents"), (0, 5, "/brochure.pdf"), (1, 0, "/documents/more"), (1, 1, "/d/1.pdf"), (1, 2, "/brochure.pdf#p"), (2, 0, "/"), (5, 0, "/d/2.PNG"), (5, 1, "/d/2.docx")]
    where = {0: "/", 1: "/documents", 2: "/products/a", 5: "/documents/more"}
    links = table(spark, "page_id int, page_url string, pos int, href string", *[(p, SITE + where[p], n, h) for p, n, h in hrefs])
    return pages, links


def _hops(links: DataFrame) -> DataFrame:
    return ln.absolute(links).select(F.col("page_url").alias("src"), "pos", F.col("url").alias("dst"))


@expect("seq int, url string, depth int", (0, f"{SITE}/", 0), (1, f"{SITE}/documents", 1), (2, f"{SITE}/documents/more", 2))
def crawl_patterns(spark, sf_dir):
    """A crawl along include and exclude patterns: the hinted links first, failed pages and other hosts left out."""
    pages, links = _site(spark)
    return graph.crawl(pages, _hops(links), f"{SITE}/", max_depth=2, max_pages=10, include=["*document*", "*files*"], exclude=["*.pdf", "*.png", "*.docx"])


@expect("seq int, url string, depth int", (0, f"{SITE}/", 0), (1, f"{SITE}/products/a", 1))
def crawl_cap(spark, sf_dir):
    """The number of pages is a hard limit, also within a level."""
    pages, links = _site(spark)
    return graph.crawl(pages, _hops(links), f"{SITE}/", max_depth=3, max_pages=2, include=["*/products/*", "*documents*"])


@expect("url string", *[(f"{SITE}{p}",) for p in ("/", "/brochure.pdf", "/d/1.pdf", "/documents", "/documents/more", "/files/x", "/login", "/products/a", "/d/2.PNG", "/d/2.docx")])
def site_addresses(spark, sf_dir):
    pages, links = _site(spark)
    return graph.map_site(pages, _hops(links), f"{SITE}/")


@expect("url string", *[(f"{SITE}{p}",) for p in ("/", "/brochure.pdf", "/documents", "/files/x", "/login", "/products/a")])
def site_addresses_capped(spark, sf_dir):
    """Pages are read while fewer than four addresses are known: the start alone."""
    pages, links = _site(spark)
    return graph.map_site(pages, _hops(links), f"{SITE}/", max_pages=4)


@expect("kind string, url string, title string, detail string, n bigint", ("document", f"{SITE}/brochure.pdf", "brochure.pdf", "PDF", None), ("document", f"{SITE}/d/1.pdf", "1.pdf", "PDF", None), ("document", f"{SITE}/d/2.PNG", "2.PNG", "PNG", None), ("document", f"{SITE}/d/2.docx", "2.docx", "DOCX", None), ("page", f"{SITE}/", "Start", "1", 1), ("page", f"{SITE}/documents", "Documents", "2", 2), ("page", f"{SITE}/documents/more", "More", "2", 0), ("page", f"{SITE}/products/a", "A", "0", 0))
def file_discovery(spark, sf_dir):
    """A crawl that looks for files: each address once, and how many each scanned page gave."""
    from ..operators import reports

    pages, links = _site(spark)
    docs, scanned = reports.discover_files(pages, links, f"{SITE}/", 2, 10)
    one = docs.select(F.lit("document").alias("kind"), "url", "title", F.col("file_format").alias("detail"), F.lit(None).cast("long").alias("n"))
    return one.union(scanned.select(F.lit("page"), "url", "title", F.col("files_found").cast("string"), "pdf_links_found"))


# Listings.


@expect("id int, n int, first string", (1, 4, "https://d.org/rest/v1/documents?products=b&sort=-modified-at&page=1&pagesize=40"), (2, 1, "https://d.org/rest/v1/documents?sort=x&page=1&pagesize=40"), (3, 0, None))
def listing_requests(spark, sf_dir):
    """The requests of a listing's pages, by their number of records; newest first, unless the address says otherwise."""
    rows = table(spark, "id int, url string", (1, "https://d.org/documents?products=b"), (2, "https://d.org/documents?sortingby=x"), (3, "https://d.org/documents"))
    own = F.when(c("id") == 1, listing.page_requests(c("url"), 150)).when(c("id") == 2, listing.page_requests(c("url"), 40)).otherwise(listing.page_requests(c("url"), 0))
    return rows.select("id", F.size(own).alias("n"), F.get(own, F.lit(0)).alias("first"))


@expect("listing string, scanned bigint, documents bigint, skipped bigint, pdfs bigint", ("https://docs.example.org/documents?products=a", 45, 40, 5, 34))
def listing_totals(spark, sf_dir):
    from .fixtures import LISTINGS

    got = listing.listing_counts(listing.documents(table(spark, "listing string, page_number int, body string", *LISTINGS), 45))
    return got.select("listing", F.col("records_scanned").alias("scanned"), F.col("documents_discovered").alias("documents"), F.col("skipped_or_deduplicated_documents").alias("skipped"), "pdfs")


@expect("page_id int, pos int, url string", (1, 0, "https://a.org/js/preloadDumps/x.js"), (1, 1, "https://b.org/preloadDumps.js"))
def dump_scripts(spark, sf_dir):
    rows = table(spark, "page_id int, url string, html string", (1, "https://a.org/p/", "<script src=' /js/preloadDumps/x.js '></script><script src='//b.org/preloadDumps.js'></script><script src='/js/preloadDumps/x.js'></script><script src='/other.js'></script>"))
    return listing.dump_scripts(rows).select("page_id", F.row_number().over(od.Window.partitionBy("page_id").orderBy("pos")).alias("pos"), "url").withColumn("pos", F.col("pos") - 1)


# Fixed results of queries whose input is literal too.


def _listed() -> list[tuple]:
    at = "https://docs.example.org/documents?products=a"
    link = "https://docs.example.org/download?document-ids="
    rows = [(at, i, f"d{i}", f"T{i}", "PDF", f"{link}d{i}", "document") for i in range(34)]
    rows += [(at, 34, None, "", "", None, "skipped"), (at, 35, "x", "", "", f"{link}x", "skipped"), (at, 36, "d1", "T1", "PDF", f"{link}d1", "duplicate"), (at, 37, "d90", "T90", "PDF", f"{link}d90", "skipped"), (at, 38, "d91", "T91", "PDF", f"{link}d91", "skipped"), (at, 39, "bare", "", "", f"{link}bare", "document")]
    return rows + [(at, 40 + i, f"d{100 + i}", f"T{100 + i}", "ZIP", f"{link}d{100 + i}", "document") for i in range(5)]


_S = "https://www.siemens-healthineers.com"
_D = "https://diagnostics.roche.com"
FIXED: dict[str, str] = {
    "listing_documents": values(_listed(), "listing string, seq bigint, id string, title string, file_format string, url string, state string"),
    "dump_downloads": values([(1, 0, "https://marketing.webassets.siemens-healthineers.com/abc/Spec.PDF")], "page_id bigint, pos int, url string"),
    "download_plan": values(
        [(0, "downloads/documents", "report.PDF"), (1, "downloads/documents", "get.docx"), (2, "downloads/images", "pic.jpeg"), (3, "downloads/documents", "none.csv"), (4, "downloads/documents", "pdf.bin"), (5, "downloads/documents", "report_1.PDF"), (6, "downloads/documents", "document_7.bin")],
        "seq bigint, folder string, filename string",
    ),
    "canonical_and_retry": values(
        [
            (1, f"{_S}/en-us/mri/magnetom", f"{_S}/us/mri/magnetom {_S}/en/mri/magnetom {_S}/global/mri/magnetom {_S}/ {_S}/en-us/mri"),
            (2, f"{_S}/en-us", f"{_S}/us {_S}/en {_S}/global {_S}/ {_S}/en-us/mri"),
            (3, "https://www.usa.philips.com/healthcare?x=1", "https://www.usa.philips.com/?x=1"),
            (4, f"{_D}/us/en/en/products.html", f"{_D}/en-us/en/en/products.html {_D}/en/en/en/products.html {_D}/global/en/en/products.html {_D}/"),
            (5, "https://www.gehealthcare.com/", ""),
            (6, "https://example.org/en/a#top", "https://example.org/en-us/a https://example.org/us/a https://example.org/global/a https://example.org/"),
            (7, f"{_D}/us/en.html", f"{_D}/en-us/en.html {_D}/en/en.html {_D}/global/en.html {_D}/"),
        ],
        "id int, canonical string, retry string",
    ),
    "structured_blocks": values(
        [
            (1, 0, "card_0", "card", "Magnetom One", "Magnetom One\nA 3 T system.\nWeight 450 kg"),
            (1, 1, "section_1", "section", "magnetom one", "magnetom one\nUptake time: 60 min"),
            (2, 0, "table_0", "table", "Spec", "Spec\nField | Bore\nField | Bore\n3 T | 70 cm"),
            (2, 1, "text_1", "text", "", "Loose text about nothing"),
        ],
        "page_id bigint, pos int, block_id string, block_type string, heading string, text string",
    ),
    "product_records": values(
        [
            (1, "Magnetom One", "unknown", "magnetom", "Magnetom One\nA 3 T system. Weight 450 kg", "field_strength: 3 T; weight: 450 kg; uptake_time: 60 min", "field_strength=3 T; weight=450 kg; uptake_time=60 min", "card_0, section_1", "https://a.org/p"),
            (2, "Table", "unknown", "", "Spec\nField | Bore\nField | Bore\n3 T | 70 cm\n\nLoose text about nothing", "field_strength: 3 T", "field_strength=3 T", "page_root", "https://a.org/t"),
            (4, "Empty page", "unknown", "", "", "", "", "page_root", "https://a.org/e"),
        ],
        "page_id bigint, product_name string, modality string, product_family string, summary string, technical_specs string, clinical_parameters string, evidence_block_ids string, source_url string",
    ),
    "gazette_links": values(
        [
            (1, True, True, True, False, "bretagne", 136, True),
            (2, True, False, False, False, "bretagne", 0, True),
            (3, True, False, False, False, "bretagne", 0, False),
            (4, False, True, True, False, "bretagne", 161, True),
            (5, True, False, False, False, "", 0, False),
            (6, True, True, False, True, "bretagne", -5, True),
            (7, True, True, False, False, "bretagne", 20, True),
            (8, False, False, False, False, "contact", 0, False),
        ],
        "id int, page boolean, context boolean, dated boolean, further boolean, region string, rank int, documents boolean",
    ),
    "gazette_discovery": values(
        [
            (f"{R}/content/20260302_raa.pdf", "20260302_raa.pdf", "bretagne", "2026", "March", "2026-03-02", "filename", False, 0),
            (f"{R}/content/raa-12.pdf", "raa-12.pdf", "bretagne", "2026", "April", "2026-04-29", "heading_context", True, 1),
            (f"{R}/content/raa-fev.pdf", "raa-fev.pdf", "bretagne", "2026", "February", "", "unknown", False, 0),
            (f"{R}/content/raa_2019.pdf", "raa_2019.pdf", "bretagne", "2019", "", "", "unknown", False, 0),
        ],
        "url string, title string, region string, year string, month string, publication_date string, date_source string, is_within_date_window boolean, n_same bigint",
    ),
}
