"""Native expressions against the standard library on random inputs."""

import random
import re
import unicodedata
from pathlib import PurePosixPath
from urllib.parse import parse_qs, unquote, urljoin, urlparse

from pyspark.sql import functions as F

from docharbor import terms
from docharbor.functions import text as tx
from docharbor.functions import urls as u


def random_urls(n):
    rng = random.Random(6)
    pick = lambda *a: rng.choice(a)
    for _ in range(n):
        host = pick("a.org", "A.Org:80", "www.b-c.fr", "x")
        path = "".join(pick("/", "/a", "/B%20c", "/é", "/x.pdf", "/y.JPG", "//", "/.hid", "/z.") for _ in range(rng.randint(0, 4)))
        query = pick("", "?", "?a=1&b=2", "?f=q.docx", "?a=&b", "?k=%41&k=v+w")
        yield pick("http", "HTTPS") + "://" + host + path + query + pick("", "#", "#f?x")


def normal(url):
    p = urlparse(url)
    return p._replace(scheme=p.scheme.lower(), netloc=p.netloc.lower(), fragment="", path=p.path.rstrip("/") or "/").geturl()


def ext(url):
    p = urlparse(url)
    for name in [unquote(p.path), *(unquote(v) for vs in parse_qs(p.query, keep_blank_values=True).values() for v in vs)]:
        e = PurePosixPath(name).suffix.lower()
        if e in terms.FILE_EXTENSIONS:
            return e
    return ""


def test_urls(spark):
    urls = list(dict.fromkeys(random_urls(600)))
    rows = spark.createDataFrame([(x,) for x in urls], "url string")
    x = F.col("url")
    for r in rows.select(x, u.normalize(x).alias("n"), u.prefix(x).alias("p"), u.extension(x).alias("e"), u.netloc(x).alias("h"), u.query(x).alias("q"), u.unquote(x).alias("d"), u.without_fragment(x).alias("w"), F.transform(u.query_pairs(x), lambda p: p["key"]).alias("k")).collect():
        p = urlparse(r.url)
        assert (r.n, r.h, r.q) == (normal(r.url), p.netloc.lower(), p.query), r.url
        assert (r.p, r.e, r.d, r.w) == (p.path.rstrip("/") or "/", ext(r.url), unquote(r.url), r.url.split("#", 1)[0]), r.url
        assert list(dict.fromkeys(r.k)) == list(parse_qs(p.query, keep_blank_values=True)), r.url


def test_joins(spark):
    rng = random.Random(7)
    pairs = [(rng.choice(["https://a.org/x/y", "http://a.org"]), rng.choice(["/p", "p", "../q", "//h/p", "#f", "?q", "http://o/r", ""])) for _ in range(60)]
    got = spark.createDataFrame(pairs, "page string, href string").select("page", "href", u.urljoin("page", "href").alias("j"), u.root_relative(F.col("page"), F.col("href")).alias("n")).collect()
    assert all(r.j == urljoin(r.page, r.href) and r.n in (None, r.j) for r in got)


def test_folding(spark):
    rng = random.Random(8)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), 32])) for _ in range(30)) for _ in range(200)]
    wide = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x250, 0xD000), rng.randint(0xF900, 0xFFEF), rng.randint(0x1D400, 0x1D7FF), 32])) for _ in range(30)) for _ in range(200)]
    fold = lambda s: " ".join(unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().split())
    rows = spark.createDataFrame([(t,) for t in texts + wide], "t string")
    for r in rows.select("t", tx.norm_text(F.col("t")).alias("n"), tx.compatible(F.col("t")).alias("k"), tx.collapse(F.col("t")).alias("c")).collect():
        assert (r.n, r.k, r.c) == (fold(r.t), unicodedata.normalize("NFKC", r.t), re.sub(r"\s+", " ", r.t).strip()), r.t


def test_needles_lose_no_match(spark):
    from docharbor import terms

    patterns = [*terms.NOISE_PATTERNS, *terms.SPEC_PATTERNS, *terms.FALLBACK_PATTERNS]
    texts = ["3 Tesla 64 SLICE 70 cm bore 1,200 tests/h 8 channel 5mm", "Page was not found 404, check if the URL", "check if url, we moved the page; deleted it", " | ".join(p[2:-2].upper() for p in terms.NOISE_PATTERNS), "\u017fe\u017fsion  per\u017fistent", "nothing"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[tx.pattern_hits(F.col("t"), [p]).alias(f"p{n}") for n, p in enumerate(patterns)]).collect()
    for r in got:
        assert [r[f"p{n}"] for n in range(len(patterns))] == [int(bool(re.search(p, r.t, re.I))) for p in patterns], r.t
