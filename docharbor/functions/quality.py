"""Verdicts on source pages: block signals, low-quality markdown, noisy links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms
from .text import any_of, let, lines, occurrences


def block_signals(html: Column, title: Column | str = "") -> Column:
    """Names of the walls that the first 3,000 characters or the title speak of, in a fixed order."""
    x = F.lower(F.concat(F.substring(F.coalesce(html, F.lit("")), 1, 3000), F.coalesce(F.lit(title) if isinstance(title, str) else title, F.lit(""))))
    return F.array_compact(F.array(*[F.when(any_of(x, words), name) for name, words in terms.BLOCK_SIGNALS.items()]))


def cookie_markers(x: Column) -> Column:
    return let(F.lower(x), lambda low: occurrences(low, terms.COOKIE_MARKERS))


def content_hints(x: Column) -> Column:
    return let(F.lower(x), lambda low: occurrences(low, terms.CONTENT_HINTS))


def table_lines(x: Column) -> Column:
    return F.when(x.contains("|"), F.size(F.filter(lines(x), lambda line: line.rlike(r"(?U)^\s*\|")))).otherwise(0)


def _low_quality(md: Column, cookies: Column, hints: Column) -> Column:
    return (md == "") | (cookies >= 3) | ((table_lines(md) >= 4) & (hints == 0)) | ((F.length(md) < 300) & (cookies > hints))


def low_quality(md: Column) -> Column:
    md = F.coalesce(md, F.lit(""))
    counts = F.struct(cookie_markers(md).alias("cookies"), content_hints(md).alias("hints"))
    return let(counts, lambda c: _low_quality(md, c["cookies"], c["hints"]))


def link_noise(links: Column) -> Column:
    """The share of links that name something noisy; 0 for no links."""
    noisy = F.size(F.filter(links, lambda x: any_of(F.lower(x), terms.LINK_NOISE)))
    return F.when(F.size(links) > 0, noisy / F.size(links)).otherwise(F.lit(0.0))


def source_quality(title: Column, markdown: Column, links: Column, signals: Column) -> Column:
    """struct<source_quality, bad_source_reasons, noise_link_ratio>: good, low_confidence (one mild reason) or bad_source_page."""
    title, markdown = F.coalesce(title, F.lit("")), F.coalesce(markdown, F.lit(""))
    ratio = link_noise(F.slice(links, 1, 20))
    # no hint has a line break in it, so those of title and text add up
    counts = F.struct(
        cookie_markers(markdown).alias("cookies"),
        content_hints(markdown).alias("hints"),
        content_hints(title).alias("in_title"),
        cookie_markers(F.concat_ws("\n", title, F.substring(markdown, 1, 1500))).alias("first"),
        ratio.alias("ratio"),
    )

    def judged(c: Column) -> Column:
        tests = [
            ("geo_redirect", F.array_contains(signals, "geo_redirect")),
            ("geo_picker", F.array_contains(signals, "geo_picker")),
            ("login_wall", F.array_contains(signals, "login_wall")),
            ("low_quality_markdown", _low_quality(markdown, c["cookies"], c["hints"])),
            ("mostly_noise_links", (F.size(links) >= 5) & (c["ratio"] >= 0.45)),
            ("cookie_heavy_content", c["first"] >= 3),
            ("no_domain_content_hints", c["hints"] + c["in_title"] == 0),
        ]
        reasons = F.array_compact(F.array(*[F.when(t, name) for name, t in tests]))
        return let(reasons, lambda r: F.struct(_status(r).alias("source_quality"), r.alias("bad_source_reasons"), F.bround(c["ratio"], 2).alias("noise_link_ratio")))

    return let(counts, judged)


def _status(reasons: Column) -> Column:
    walls = F.arrays_overlap(reasons, F.array(F.lit("geo_redirect"), F.lit("geo_picker"), F.lit("login_wall")))
    return F.when(walls | (F.size(reasons) >= 2), "bad_source_page").when(F.size(reasons) == 1, "low_confidence").otherwise("good")
