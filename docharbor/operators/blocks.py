"""Blocks of page text: cut, scored, kept once, and pages classified by what is left.

A page is a row from its text to its result: blocks are arrays within it, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..functions import text as tx
from .lineage import spread


def noise(x: Column) -> Column:
    return tx.pattern_hits(x, terms.NOISE_PATTERNS)


def useful(x: Column) -> Column:
    return tx.hits(x, terms.USEFUL_TERMS) + tx.hits(x, terms.FAMILIES) + tx.pattern_hits(x, terms.SPEC_PATTERNS)


def cookieish(line: Column) -> Column:
    return tx.any_of(F.lower(line), terms.COOKIE_WORDS)


def drop_line(line: Column) -> Column:
    """A cookie notice, a table row with a noise term, or two noise terms and nothing useful."""

    def judged(low: Column) -> Column:
        by_noise = tx.let(noise(low), lambda n: (line.startswith("|") & (n >= 1)) | ((n >= 2) & (useful(low) == 0)))
        return tx.any_of(low, terms.COOKIE_WORDS) | by_noise

    return tx.let(F.lower(line), judged)


def _lines(block: Column) -> Column:
    return F.filter(F.transform(tx.lines(block), tx.strip), lambda x: x != "")


def sanitize(block: Column) -> Column:
    lines = F.filter(F.transform(tx.lines(block), tx.norm_line), lambda x: (x != "") & ~drop_line(x))
    return F.array_join(lines, "\n")


def junk(block: Column, lines: Column | None = None) -> Column:
    """Nothing but notices, or a fifth of digits. lines: those of the block, if they are at hand."""
    far = tx.wide(block) & block.rlike("[^\\x00-\u024f]")
    rest = F.when(far, F.regexp_replace(block, r"(?U)\d", "")).otherwise(F.regexp_replace(block, "[0-9]", ""))
    notices = tx.let(_lines(block) if lines is None else lines, lambda ls: (F.size(ls) == 0) | ((F.size(ls) >= 4) & F.forall(ls, cookieish)))
    return notices | ((F.length(block) - F.length(rest) > F.length(block) * 0.2) & ~F.lower(block).contains("product"))


def navigation(block: Column, lines: Column | None = None) -> Column:
    """Short lines of a menu, with as many menu words as useful terms."""

    def judged(ls: Column) -> Column:
        n = F.size(ls)
        short = F.size(F.filter(ls, lambda x: F.length(x) <= 35))
        menu = tx.let(F.size(F.filter(ls, lambda x: tx.any_of(F.lower(x), terms.NAVIGATION))), lambda nav: (nav >= 2) & (useful(F.lower(block)) <= nav))
        return (n == 0) | ((n >= 3) & (short / F.greatest(n, F.lit(1)) >= 0.8) & menu)

    return tx.let(_lines(block) if lines is None else lines, judged)


#: White space that a normalised text hasn't, and other characters that aren't surely none.
UNEVEN, UNEVEN_WIDE = "[^\n -~]", f"[^\n {tx.PLAIN}]"


def block_list(text: Column) -> Column:
    """The blocks of a text in compatible form: runs of lines between blank ones, lines normalised, table rules left out. A text whose lines are normal as they are is only cut."""

    def cut(x: Column) -> Column:
        return F.filter(F.transform(F.split(x, "\n{2,}"), lambda b: F.trim(b, F.lit("\n"))), lambda b: b != "")

    def of(x: Column) -> Column:
        uneven = F.when(tx.wide(x), x.rlike(UNEVEN_WIDE)).otherwise(x.rlike(UNEVEN)) | tx.any_of(x, ["  ", " \n", "\n ", "--"]) | x.startswith(" ") | x.endswith(" ")
        lines = F.filter(F.transform(tx.lines(x), tx.norm_line), lambda line: ~line.rlike(terms.TABLE_RULE))
        return cut(F.when(uneven, F.array_join(lines, "\n")).otherwise(F.replace(x, F.lit("\\|"), F.lit("|"))))

    return tx.let(text, of)


def split_blocks(pages: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """(keys, pos, block): the blocks of each page, in order. Null text: no blocks."""
    return spread(pages.select(*keys, text)).select(*keys, tx.compatible(F.coalesce(F.col(text), F.lit(""))).alias("_text")).select(*keys, F.posexplode(block_list(F.col("_text"))).alias("pos", "block"))


def _least(words) -> list[str]:
    """The words that hold no other one: where none of these occurs, none of the words does."""
    words = set(words)
    return sorted(w for w in words if not any(v != w and v in w for v in words))


#: Where none of these occurs, no line is dropped and no noise pattern matches.
DIRT = _least([*terms.COOKIE_WORDS, *(n for p in terms.NOISE_PATTERNS for n in tx.needles(p)), *tx.ODD_CASES])


def page_parts(url: Column, title: Column) -> Column:
    """struct of what a page's address and title add to the score of each of its blocks."""

    def of(x: Column) -> Column:
        t = x["title"]
        return F.struct(
            tx.any_of(x["url"], terms.URL_NOISE).cast("int").alias("noise_url"),
            F.least(tx.hits(t, terms.USEFUL_TERMS), F.lit(2)).alias("title_context"),
            tx.hits(t, terms.FAMILIES).alias("title_family"),
        )

    return tx.let(F.struct(F.lower(url).alias("url"), F.lower(title).alias("title")), of)


def cleaned(block: Column) -> Column:
    """struct of a block of block_list sanitised (clean), in lower case (low), and whether it holds what noise patterns need (dirty), an odd case or a digit."""

    def of(x: Column) -> Column:
        def rest(clean: Column) -> Column:
            low = F.when(x["dirty"], F.lower(clean)).otherwise(x["low"])
            return F.struct(clean.alias("clean"), low.alias("low"), x["dirty"].alias("dirty"), tx.any_of(x["low"], tx.ODD_CASES).alias("odd"), clean.rlike("[0-9]").alias("digit"))

        return tx.let(F.when(x["dirty"], sanitize(x["own"])).otherwise(x["own"]), rest)

    def judged(x: Column) -> Column:
        return tx.let(F.struct(x["own"].alias("own"), x["low"].alias("low"), tx.any_of(x["low"], DIRT).alias("dirty")), of)

    def lowered(own: Column) -> Column:
        return tx.let(F.struct(own.alias("own"), F.lower(own).alias("low")), judged)

    return tx.let(F.replace(block, F.lit("\\|"), F.lit("|")), lowered)


def score(block: Column, own: Column, page: Column) -> Column:
    """struct of score, reasons and kept of a block; own: cleaned(block), page: page_parts of its page. All are read often: bind them."""
    clean, low, odd, dirty = own["clean"], own["low"], own["odd"], own["dirty"]

    def judged(lines: Column) -> Column:
        pipes = F.size(F.filter(lines, lambda line: line.startswith("|")))
        digits = F.when(own["digit"] | tx.wide(clean), junk(clean, lines)).otherwise((F.size(lines) >= 4) & F.forall(lines, cookieish))
        parts = [
            ("noise_url", page["noise_url"], -2),
            ("table_like", F.when(clean.contains("|"), (pipes >= 3).cast("int")).otherwise(0), -2),
            ("noise_terms", F.when(dirty, tx.pattern_hits(clean, terms.NOISE_PATTERNS, low, odd)).otherwise(0), -2),
            ("fallback_page", tx.pattern_hits(clean, terms.FALLBACK_PATTERNS, low, odd), -4),
            ("medical_terms", F.least(tx.hits(low, terms.USEFUL_TERMS), F.lit(4)), 1),
            ("product_family", tx.hits(low, terms.FAMILIES), 2),
            ("title_context", page["title_context"], 1),
            ("title_family", page["title_family"], 2),
            ("spec_pattern", F.when(own["digit"], tx.pattern_hits(clean, terms.SPEC_PATTERNS, low, odd)).otherwise(0), 2),
            ("thin_block", (F.length(clean) < 40).cast("int"), -1),
            ("cookie_heavy", F.when(dirty, ((tx.occurrences(low, ["cookie"]) >= 2) | (tx.occurrences(low, ["session"]) >= 2)).cast("int")).otherwise(0), -3),
            ("junk_structure", digits.cast("int"), -3),
            ("navigation_block", navigation(clean, lines).cast("int"), -4),
            ("sanitized", (F.length(clean) < F.length(block)).cast("int"), 0),
        ]
        names, weights = [name for name, _, _ in parts], [w for _, _, w in parts]

        def summed(counts: Column) -> Column:
            total = F.lit(0)
            for i, w in enumerate(weights):
                total = total + F.get(counts, F.lit(i)) * w
            found = F.array_compact(F.array(*[F.when(F.get(counts, F.lit(i)) > 0, name) for i, name in enumerate(names)]))
            return F.struct(total.cast("int").alias("score"), found.alias("reasons"), (total > 0).alias("kept"))

        return tx.let(F.array(*[n for _, n, _ in parts]), summed)

    nothing = F.struct(F.lit(-5).alias("score"), F.array(F.lit("fully_sanitized")).alias("reasons"), F.lit(False).alias("kept"))
    return F.when(clean == "", nothing).otherwise(tx.let(F.split(clean, "\n"), judged))


def scored_list(blocks: Column, url: Column, title: Column) -> Column:
    """array of struct<pos, text, kept, score, reasons> of the blocks of a page; a kept block that repeats an earlier kept one is dropped as duplicate_block. blocks: those of block_list, whose lines are normal."""

    def once(all_: Column) -> Column:
        again = F.struct(F.lit(False).alias("kept"), F.lit(0).alias("score"), F.array(F.lit("duplicate_block")).alias("reasons"))

        def marked(ks: Column) -> Column:
            def first(b: Column, i: Column) -> Column:
                own = F.struct(b["kept"].alias("kept"), b["score"].alias("score"), b["reasons"].alias("reasons"))
                verdict = F.when(b["kept"] & (F.array_position(ks, F.get(ks, i)) <= i), again).otherwise(own)
                return tx.let(verdict, lambda v: F.struct(b["pos"].alias("pos"), b["text"].alias("text"), v["kept"].alias("kept"), v["score"].alias("score"), v["reasons"].alias("reasons")))

            return F.transform(all_, first)

        return tx.let(F.transform(all_, lambda b: b["key"]), marked)

    def of_page(page: Column) -> Column:
        def one(block: Column, pos: Column) -> Column:
            def of(own: Column) -> Column:
                # lines are normal, so a line break is all the white space that a key has to collapse
                return tx.let(score(block, own, page), lambda s: F.struct(pos.alias("pos"), own["clean"].alias("text"), F.when(s["kept"], F.replace(own["low"], F.lit("\n"), F.lit(" "))).alias("key"), s["kept"].alias("kept"), s["score"].alias("score"), s["reasons"].alias("reasons")))

            return tx.let(cleaned(block), of)

        return tx.let(F.transform(blocks, one), once)

    return tx.let(page_parts(url, title), of_page)


def score_blocks(pages: DataFrame, keys: list[str], text: str = "markdown", url: str = "url", title: str = "title") -> DataFrame:
    """(keys, pos, text, kept, score, reasons) of each block of each page."""
    rows = spread(pages.select(*keys, text, url, title)).select(*keys, tx.compatible(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(title), F.lit("")).alias("_title"))
    return rows.select(*keys, F.explode(scored_list(block_list(F.col("_text")), F.col("_url"), F.col("_title"))).alias("b")).select(*keys, "b.*")


def page_type(url: Column, title: Column, clean: Column, n_dropped: Column) -> Column:
    u, label = F.lower(url), F.lower(F.concat_ws("\n", url, title))

    def of(hay: Column) -> Column:
        product = F.when(tx.any_of(hay, terms.FAMILIES), "product_detail").otherwise("product_category")
        return (
            F.when(tx.any_of(u, terms.LEGAL_URL), "legal_noise")
            .when(tx.any_of(label, ("support", "documentation")), "support_noise")
            .when(tx.pattern_hits(hay, terms.FALLBACK_PATTERNS) > 0, "fallback_noise")
            .when(tx.any_of(hay, ("product", "system", "scanner")), product)
            .when((clean != "") & (F.length(clean) < 160) & (n_dropped > 0), "mixed_low_quality")
            .otherwise("unknown")
        )

    return tx.let(F.lower(F.concat_ws("\n", url, title, clean)), of)


def spec_values(clean: Column, most: int = 12) -> Column:
    none = F.expr("cast(array() as array<string>)")
    found = F.when(clean.rlike("[0-9]"), F.concat(*[F.regexp_extract_all(clean, F.lit(f"(?iu){p}"), F.lit(0)) for p in terms.SPEC_PATTERNS])).otherwise(none)
    return F.slice(tx.distinct_ci(found), 1, most)


def signals(clean: Column) -> Column:
    return tx.let(F.lower(clean), lambda low: F.create_map(F.lit("medical_terms"), tx.found_terms(low, terms.USEFUL_TERMS, 12), F.lit("product_families"), tx.found_terms(low, terms.FAMILIES, 10), F.lit("spec_values"), spec_values(clean)))


def page_results(pages: DataFrame, keys: list[str], text: str = "markdown", url: str = "url", title: str = "title") -> DataFrame:
    """One row a page: its type, relevance, counts, clean text, kept and dropped blocks, reasons and signals. Null columns count as empty.

    A page whose raw text reads like an error page, and whose clean text is short or mere navigation, loses all blocks and is fallback_noise.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = spread(pages.select(*keys, text, url, title)).select(*keys, F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(title), F.lit("")).alias("title"), raw.alias("_raw"), tx.compatible(raw).alias("_text"))

    def judged(all_: Column) -> Column:
        kept, out = F.filter(all_, lambda b: b["kept"]), F.filter(all_, lambda b: ~b["kept"])
        moved = F.transform(kept, lambda b: F.struct(b["pos"].alias("pos"), b["text"].alias("text"), F.lit(False).alias("kept"), F.lit(0).alias("score"), F.array(F.lit("fallback_page")).alias("reasons")))

        def of(clean: Column) -> Column:
            fallback = (tx.pattern_hits(F.col("_raw"), terms.FALLBACK_PATTERNS) > 0) & ((F.length(clean) < 500) | navigation(clean))
            lost = F.struct(F.lit(True).alias("fallback"), F.slice(kept, 1, 0).alias("kept"), F.concat(out, moved).alias("dropped"), F.lit("").alias("clean"))
            whole = F.struct(F.lit(False).alias("fallback"), kept.alias("kept"), out.alias("dropped"), clean.alias("clean"))
            return F.when(fallback, lost).otherwise(whole)

        return tx.let(F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n"), of)

    def result(p: Column) -> Column:
        kind = F.when(p["fallback"], "fallback_noise").otherwise(page_type(F.col("url"), F.col("title"), p["clean"], F.size(p["dropped"])))
        return F.struct(
            kind.alias("page_type"),
            F.aggregate(p["kept"], F.lit(0), lambda a, b: a + b["score"]).alias("relevance_score"),
            F.size(p["kept"]).alias("useful_block_count"),
            F.size(p["dropped"]).alias("dropped_block_count"),
            p["clean"].alias("clean_text"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(p["dropped"], lambda b: b["reasons"])))).alias("dropped_reasons"),
            p["kept"].alias("kept_blocks"),
            p["dropped"].alias("dropped_blocks"),
            signals(p["clean"]).alias("signals"),
        )

    page = tx.let(tx.let(scored_list(block_list(F.col("_text")), F.col("url"), F.col("title")), judged), result)
    # a generator keeps the whole of it one value: a projection would repeat it for each column
    return rows.select(*keys, "url", "title", F.explode(F.array(page)).alias("p")).select(*keys, "url", "title", "p.*")
