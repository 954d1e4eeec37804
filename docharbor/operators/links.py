"""Links: made absolute, filtered, ordered distinct, ranked."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..functions import text as tx
from ..functions import urls as u
from .ordered import ordered_distinct

ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def native_anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, page_url, pos, href, text) of quoted links, by regular expressions in the JVM. For well-formed anchors; sources.html.links reads all."""
    tags = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("page_url"), F.posexplode(tags).alias("pos", "tag"))
    href = tx.strip(F.regexp_extract("tag", ANCHOR, 1))
    return rows.select("page_id", "page_url", "pos", href.alias("href"), tx.collapse(F.regexp_replace(F.regexp_extract("tag", ANCHOR, 2), "(?s)<[^>]*>", " ")).alias("text"))


def absolute(links: DataFrame) -> DataFrame:
    """links with url: href joined to page_url. Links that were read with a page's tree have it; of others, hrefs below the site's root are joined in the JVM and the rest by the standard library."""
    if "url" in links.columns:
        return links
    plain = F.coalesce(F.col("href").rlike("^/(?!/)") | F.col("href").rlike("(?i)^https?://[^/?#]"), F.lit(False))
    native = F.coalesce(u.root_relative(F.col("page_url"), F.col("href")), F.col("href"))
    return links.where(plain).withColumn("url", native).unionByName(links.where(~plain).withColumn("url", u.urljoin("page_url", "href")))


def page_links(links: DataFrame) -> DataFrame:
    """Navigable links of each page, normalised, the first of each address: (page_id, page_url, pos, url, text)."""
    rows = links.where(~u.is_non_http(F.col("href")) & ~u.is_bare_email(F.col("href")))
    rows = absolute(rows).withColumn("url", u.normalize(F.col("url"))).where(u.scheme(F.col("url")).isin("http", "https"))
    return ordered_distinct(rows.select("page_id", "page_url", "pos", "url", "text"), ["page_id", "url"], ["pos"])


def dedupe_links(links: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Web addresses without fragments, the first of each, case kept. order: what comes first, pos unless said otherwise."""
    rows = absolute(links.where(F.coalesce(F.col("href"), F.lit("")) != "")).where(u.scheme(F.col("url")).isin("http", "https"))
    return ordered_distinct(rows.withColumn("url", u.without_fragment(F.col("url"))), ["page_id", "url"], order or ["pos"])


def pdf_links(links: DataFrame) -> DataFrame:
    return dedupe_links(links).where(F.lower("url").contains(".pdf"))


def file_links(links: DataFrame) -> DataFrame:
    return dedupe_links(links).where(u.extension(F.col("url")) != "")


def strategies(*found: DataFrame) -> DataFrame:
    """The union of link tables, earlier ones first, the first of each address: candidates of several strategies in one."""
    out = None
    for n, df in enumerate(found):
        own = absolute(df).select("page_id", "page_url", "pos", "href", "url").withColumn("strategy", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return file_links_in_order(out)


def file_links_in_order(links: DataFrame) -> DataFrame:
    return dedupe_links(links, ["strategy", "pos"]).where(u.extension(F.col("url")) != "")


def document_rows(links: DataFrame, source: str = "html_or_image_link") -> DataFrame:
    """A document row for each file link."""
    name = F.regexp_extract(u.unquote(u.path(F.col("url"))), r"([^/]*)/*$", 1)
    ext = F.upper(F.regexp_replace(u.extension(F.col("url")), r"^\.", ""))
    return links.select("page_id", "pos", "url", name.alias("title"), ext.alias("file_format"), F.lit(source).alias("source"), F.col("page_url").alias("source_page"))


def relevant_page(candidate: Column, source: Column) -> Column:
    """Of the source's path family, or of its host with a path that speaks of documents."""
    return u.same_family(candidate, source, hosts=True) | (u.same_host(candidate, source) & tx.any_of(u.low_path(candidate), terms.DISCOVERY_TERMS))


def noise_url(url: Column) -> Column:
    return tx.any_of(F.lower(url), terms.CRAWL_NOISE)


def product_relevant(url: Column) -> Column:
    return tx.any_of(F.lower(url), terms.CRAWL_HINTS)


def should_follow(url: Column, start: Column) -> Column:
    return ~noise_url(url) & (u.same_family(url, start) | ((u.prefix(start) == "/") & product_relevant(url)))


def crawl_priority(url: Column, start: Column) -> list[Column]:
    """Sort keys: the start's path family first, then what looks relevant."""
    return [u.same_family(url, start).cast("int").desc(), product_relevant(url).cast("int").desc()]


def family_pairs(pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(above, below, verified): pages of one host, the second at or below the first's path, itself included; verified by same_family.

    An equi-join on host and path prefix: a page meets only the pages on its own path, so the work is that of the result.
    """
    p = pages.select(key, url, u.netloc(F.col(url)).alias("host"), u.prefix(F.col(url)).alias("prefix"))
    parts = F.filter(F.split("prefix", "/"), lambda s: s != "")
    ups = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(F.col("parts"), F.lit(1), n), "/")))
    below = p.withColumn("parts", parts).select(F.col(key).alias("below"), F.col(url).alias("own"), "host", F.explode(F.array_distinct(ups)).alias("prefix"))
    return p.withColumnRenamed(key, "above").join(below, ["host", "prefix"]).select("above", "below", u.same_family(F.col("own"), F.col(url), hosts=True).alias("verified"))


def modality_of(url: str) -> str | None:
    return next((m for m, hints in terms.MODALITIES.items() if any(h in url.lower() for h in hints)), None)


def modality(col: Column) -> Column:
    return tx.first_hit(F.lower(col), terms.MODALITIES)


def _distinct(items: Iterable[str]) -> tuple[str, ...]:
    found: dict[str, str] = {}
    for i in items:
        if i and i.strip():
            found.setdefault(i.strip().lower(), i.strip())
    return tuple(found.values())


@dataclass(frozen=True)
class FocusPlan:
    """Constants of a focused crawl."""

    start_url: str
    modality: str | None
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    focus: tuple[str, ...]
    prefix: str


def _normal(url: str) -> tuple[str, str]:
    import re

    s, n, p, q = re.match(u.SPLIT, url).group(1, 2, 3, 4)
    p = p.rstrip("/") or "/"
    return (f"{s.lower()}:" if s else "") + (f"//{n.lower()}" if n else "") + p + (f"?{q}" if q else ""), p


def focus_plan(start_url: str, modality: str | None = None, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> FocusPlan:
    start, prefix = _normal(start_url)
    modality = modality or modality_of(start)
    hints = terms.MODALITIES.get(modality or "", ())
    inc = [f"*{prefix}*", f"*{prefix}/*"] if prefix != "/" else []
    inc += [f"*{h}*" for h in hints] + ["*products*", *include]
    return FocusPlan(start, modality, _distinct(inc), _distinct([*(f"*{t}*" for t in terms.FOCUS_NOISE), *exclude]), _distinct([*terms.FOCUS_TERMS, *hints]), prefix)


def focus_score(url: Column, start_url: str, modality: str | None = None, extra: Iterable[str] = ()) -> Column:
    """Higher for links of the start's host and path family and for focus terms, each time one is listed; much lower for noise."""
    start, _ = _normal(start_url)
    modality = modality or modality_of(start)
    low, at = F.lower(url), F.lit(start)
    out = F.when(u.same_host(url, at), 20).otherwise(0) + F.when(u.same_family(url, at), 60).otherwise(0) - F.when(tx.any_of(low, terms.RANK_NOISE), 100).otherwise(0)
    out = out + 25 * tx.hits(low, [*terms.FOCUS_TERMS, *terms.MODALITIES.get(modality or "", ()), *extra])
    for term, weight in terms.RANK_WEIGHTS.get(modality or "", {}).items():
        out = out + F.when(low.contains(term), weight).otherwise(0)
    return out + F.when(tx.any_of(low, terms.GENERIC_TERMS), 8).otherwise(0)


def rank_focused(links: DataFrame, start_url: str, modality: str | None = None, extra: Iterable[str] = (), order: str = "pos", filtered: bool = False) -> DataFrame:
    """links (url, pos) normalised, the first of those that differ in case, with score and rank; filtered: without noise and without what neither belongs to the start's path nor names a focus term."""
    start, _ = _normal(start_url)
    hints = terms.MODALITIES.get(modality or modality_of(start) or "", ())
    rows = links.withColumn("url", tx.strip(u.normalize(F.col("url")))).where("url != ''").withColumn("_key", F.lower("url"))
    rows = ordered_distinct(rows, ["_key"], [order]).drop("_key").withColumn("score", focus_score(F.col("url"), start_url, modality, extra))
    if filtered:
        low = F.lower("url")
        rows = rows.where(~tx.any_of(low, terms.FOCUS_NOISE) & (u.same_family(F.col("url"), F.lit(start)) | tx.any_of(low, [*terms.FOCUS_TERMS, *hints, *extra])))
    return rows.orderBy(F.desc("score"), u.depth(F.col("url")), F.length("url"), "url")
