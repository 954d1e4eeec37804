"""Scalars and predicates on small inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from docharbor import terms
from docharbor.functions import dates as d
from docharbor.functions import quality as ql
from docharbor.functions import text as tx
from docharbor.functions import urls as u
from docharbor.operators import gazette as g
from docharbor.operators import links as ln


def ask(spark, columns, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in values.items()])
    return row.select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    ("url", "expected"),
    [("HTTP://A.org/x//#f", "http://a.org/x"), ("", "/"), ("https://a.org", "https://a.org/"), ("https://a.org/?q=1", "https://a.org/?q=1"), ("https://a.org/p?", "https://a.org/p"), ("/x/", "/x")],
)
def test_normalize(spark, url, expected):
    assert ask(spark, [u.normalize(F.col("x"))], x=url)[0] == expected
    assert ln._normal(url)[0] == expected


@pytest.mark.parametrize(
    ("a", "b", "family", "hosted"),
    [("https://a.org/p/q", "https://a.org/p", True, True), ("https://a.org/pq", "https://a.org/p", False, False), ("https://b.org/p/q", "https://a.org/p/", True, False), ("https://a.org/x", "https://a.org", True, True)],
)
def test_family(spark, a, b, family, hosted):
    got = ask(spark, [u.same_family(F.col("a"), F.col("b")), u.same_family(F.col("a"), F.col("b"), hosts=True)], a=a, b=b)
    assert (got[0], got[1]) == (family, hosted)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("20260429_x.pdf", date(2026, 4, 29)),
        ("RAA du 07.01.2026", date(2026, 1, 7)),
        ("02.01.26", date(2026, 1, 2)),
        ("raa 21012026", date(2026, 1, 21)),
        ("30 avril 2026", date(2026, 4, 30)),
        ("1 février 2026", date(2026, 2, 1)),
        ("12 août 2025", date(2025, 8, 12)),
        ("31.02.2026", None),
        ("31.02.2026 puis 3 mars 2026", date(2026, 3, 3)),
        ("recueil 2026", None),
        ("1er mai 2026", None),
        ("2026-04-05 10:30", date(2010, 5, 4)),
        ("fichier%2028-04-2026", date(2026, 4, 28)),
        ("", None),
        (None, None),
    ],
)
def test_publication_date(spark, value, expected):
    assert ask(spark, [d.publication_date(F.col("x"))], x=value)[0] == expected


def test_years_and_months(spark):
    got = ask(spark, [d.year_in(F.col("a"), F.col("b")), d.month_in(F.col("a"), F.col("b")), d.year_in(F.col("c"))], a="rien", b="Février 2019 et 2021", c="2009")
    assert (got[0], got[1], got[2]) == ("2021", "February", None)


def test_windows(spark):
    today = date(2026, 4, 30)
    x = F.col("x")
    assert ask(spark, [d.in_window(x, 2, today), d.in_window(x, 1, today), d.in_window(x, None)], x="2026-04-29")[:3] == (True, False, True)
    assert ask(spark, [d.in_window(x, 2, today)], x="")[0] is False
    assert d.current_months(today) == [("April", 2026, "2026-04")]


@pytest.mark.parametrize(
    ("text", "years", "months", "fits"),
    [("mars 2026", ["2026"], ["March"], True), ("mars 2025", ["2026"], ["March"], False), ("avril 2026", ["2026"], ["March"], False), ("page", ["2026"], ["March"], True), ("2025", None, None, True), ("avril", ["2026"], None, False)],
)
def test_scope(spark, text, years, months, fits):
    assert ask(spark, [d.in_scope(F.col("x"), years, months)], x=text)[0] is fits


@pytest.mark.parametrize(
    ("url", "ext"),
    [("https://a.org/x.PDF", ".pdf"), ("https://a.org/get?f=a.docx", ".docx"), ("https://a.org/a.exe?f=b.zip", ".zip"), ("https://a.org/.pdf", ""), ("https://a.org/x.", ""), ("https://a.org/a%2Epdf", ".pdf"), ("https://a.org/x?a=1&b=p.png&a=q.csv", ".csv")],
)
def test_extension(spark, url, ext):
    assert ask(spark, [u.extension(F.col("x"))], x=url)[0] == ext


def test_names(spark):
    x = F.col("x")
    assert ask(spark, [u.header_filename(x)], x="attachment; filename*=UTF-8''r%C3%A9sum%C3%A9.pdf")[0] == "résumé.pdf"
    assert ask(spark, [u.header_filename(x)], x="inline")[0] is None
    assert ask(spark, [u.filename(x, F.lit(3), ".pdf")], x="https://a.org/")[0] == "document_3.pdf"
    assert ask(spark, [u.download_dir(x)], x="https://a.org/b/c/d")[0] == "downloads/pdfs/a.org/b_c"
    assert ask(spark, [u.srcset(x)], x="a.png 1x, b.png 2x,")[0] == ["a.png", "b.png"]
    assert ask(spark, [u.listing_params(x)], x="https://d.org/?products=a&products=b&languages=")[0] == {"products": "b"}


def test_hrefs(spark):
    rows = spark.createDataFrame([("https://a.org/x/y", h) for h in ("/r", "s", "//b.org/t", "../u", "https://c.org", None)], "page string, href string")
    got = [r[0] for r in rows.select(F.coalesce(u.root_relative(F.col("page"), F.col("href")), u.urljoin("page", "href"))).collect()]
    assert got == ["https://a.org/r", "https://a.org/x/s", "https://b.org/t", "https://a.org/u", "https://c.org", None]


def test_text(spark):
    x = F.col("x")
    assert ask(spark, [tx.norm_text(x)], x="  Arrêté  ŒUVRE n° ½ ﬁn ５² ㎏ ")[0] == "arrete uvre n 12 fin 52 kg"
    assert ask(spark, [tx.norm_text(x)], x="Arrêté du  1er FÉVRIER")[0] == "arrete du 1er fevrier"
    assert ask(spark, [tx.norm_line(x)], x=" a  b​ \\| c")[0] == "a b | c"
    assert ask(spark, [tx.occurrences(x, ["aa"])], x="aaaaa")[0] == 2
    assert ask(spark, [tx.matches_any(x, ["*/p?x*", "["])], x="https://a/p1x")[0] is True
    assert ask(spark, [tx.matches_any(x, [])], x="a")[0] is False
    assert ask(spark, [tx.distinct_ci(F.array(x, F.lit(" A  b "), F.lit("")))], x="a B")[0] == ["a B"]


def test_quality(spark):
    none = F.expr("cast(array() as array<string>)")
    s = lambda sig, md: ask(spark, [ql.source_quality(F.lit(""), F.col("m"), none, sig)["source_quality"]], m=md)[0]
    assert s(none, "scanner system " * 30) == "good"
    assert s(none, "") == "bad_source_page"
    assert s(F.array(F.lit("geo_picker")), "scanner system " * 30) == "bad_source_page"
    assert s(none, "words " * 80) == "low_confidence"
    assert ask(spark, [F.array_join(ql.block_signals(F.col("h")), ",")], h="Please verify you; Select Your Country")[0] == "captcha,geo_picker"


def test_focus(spark):
    plan = ln.focus_plan("https://a.org/mri/", exclude=["*x*", "*BLOG*"])
    assert plan.modality == "mri" and plan.include[:2] == ("*/mri*", "*/mri/*") and "*products*" in plan.include and plan.exclude.count("*blog*") == 1
    rows = spark.createDataFrame([(0, "https://a.org/news"), (1, "https://a.org/mri/magnetom"), (2, "https://a.org/MRI/magnetom"), (3, "https://b.org/mri")], "pos int, url string")
    assert [r.url for r in ln.rank_focused(rows, "https://a.org/mri").collect()] == ["https://a.org/mri/magnetom", "https://b.org/mri", "https://a.org/news"]
    assert ln.rank_focused(rows, "https://a.org/mri", filtered=True).count() == 2


def test_gazette_words(spark):
    x, t = F.col("x"), F.col("t")
    ctx = lambda a, b="": ask(spark, [g.has_context(x, t)], x=a, t=b)[0]
    assert ctx("https://a.gouv.fr/recueil-des-actes-administratifs") and ctx("https://a.gouv.fr/x", "Recueil R.A.A") is False
    assert ctx("https://a.gouv.fr/documents-publications/x", "RAA mars") and not ctx("https://a.gouv.fr/documents-publications/x", "DRAAF")
    assert ask(spark, [g.region_slug(x), g.region_page(x)], x=terms.PORTAL + "Bretagne")[:2] == ("bretagne", True)
    assert ask(spark, [g.region_page(x)], x=terms.PORTAL + "contact")[0] is False
    # an address counts as within a branch if it lies above its root
    roots = F.array(F.lit("https://b.gouv.fr/raa/2026"))
    assert ask(spark, [g.above_root(x, roots)], x="https://b.gouv.fr/raa")[0] and not ask(spark, [g.above_root(x, roots)], x="https://b.gouv.fr/raa/2026/mars")[0]
