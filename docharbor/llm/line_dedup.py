"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is its words, lower-cased; blank lines are no lines. The unit of an edit is a word. Lines of at least MIN_WORDS words are
copies of one another if at most one word was replaced, inserted or deleted; shorter lines, of which an edit would change more than a
fifth, only if they are equal. Of equal lines the earliest (smallest doc_id, then line number) is kept. Of lines that differ by an
edit, a line goes if any earlier line is within the bound, whether or not that line itself stays.

The variants of a line are what is left when one word is deleted, as hashed keys. A word is hashed with its place and a line is the XOR of
its words' hashes, so a variant costs one operation however long the line is. Lines that differ by a replacement share the key
(length, place, variant); all lines under such a key are within one edit of each other, so the earliest is the keeper of the
rest and no pairs are made. A deletion's variant, its later words moved up, equals the shorter line itself. Both kinds of match are
verified on the words. Only lines that share their first or last half with another line emit variants, and only of the other half:
of two lines within one edit, one half is untouched (halves are those of the longer line), so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import Written

#: One edit in five words leaves a similarity of 0.8.
MIN_WORDS = 5
#: White space besides the space and the line feed, which ends a line.
SPACES = "\t\v\f\r"
#: What a line may emit: replacements and deletions behind the first half and before the last, and itself as the shorter line.
SWAP_TAIL, SWAP_HEAD, DROP_TAIL, DROP_HEAD, WHOLE = 1, 2, 4, 8, 16


def _plain(text: Column) -> Column:
    """Lower-cased, with no white space but spaces and line feeds."""
    low = F.lower(text)
    spaced = low
    for c in SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    odd = low.contains(SPACES[0])
    for c in SPACES[1:]:
        odd = odd | low.contains(c)
    return F.when(odd, spaced).otherwise(low)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), _plain(F.col(text).cast("string")).alias("text")).where("doc_id is not null")


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _running(values: Column) -> Column:
    """Element i is the XOR of the first i values, in blocks of the root of their number."""

    def blocks(c, m):
        totals = F.transform(F.sequence(F.lit(0), m - 1), lambda b: _xor(F.slice(c, b * m + 1, m)))
        before = let(totals, lambda t: F.transform(t, lambda _, b: _xor(F.slice(t, F.lit(1), b))))
        return let(before, lambda p: F.transform(c, lambda _, i: F.get(p, F.floor(i / m).cast("int")).bitwiseXOR(_xor(F.slice(c, i - i % m + 1, i % m + 1)))))

    return let(values, lambda c: let(F.ceil(F.sqrt(F.size(c))).cast("int"), lambda m: blocks(c, m)))


class Places:
    """Places of lines as one ordered value: a long, if ids and line numbers fit into one together, else a struct of both."""

    def __init__(self, table: DataFrame):
        at = table.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("line_no").alias("line")).first()
        self.lo, self.width = at.lo or 0, (at.line or 0) + 1
        self.packed = ((at.hi or 0) - self.lo + 1) * self.width < 1 << 63
        self.of = (F.col("doc_id") - self.lo) * F.lit(self.width).cast("long") + F.col("line_no") if self.packed else F.struct("doc_id", "line_no")

    def doc(self, place: Column) -> Column:
        return F.call_function("div", place, F.lit(self.width).cast("long")) + self.lo if self.packed else place["doc_id"]

    def line(self, place: Column) -> Column:
        return (place % F.lit(self.width).cast("long")).cast("int") if self.packed else place["line_no"]


def _wanted(firsts: DataFrame) -> DataFrame:
    """(id, flags): what the first lines of firsts (id, k0 to k3) emit, if anything.

    A half of h words belongs to lines of 2h - 1 (kind 0), 2h (1) and 2h + 1 words (2): k0 and k1 are a line's first and last half, and
    where its length is odd, k2 and k3 its halves seen from a line longer by a word.
    """
    even = F.col("k2").isNull()
    side = [F.struct(F.col(f"k{n}").alias("k"), F.lit(n % 2 == 1).alias("last"), (F.when(even, 1).otherwise(2) if n < 2 else F.lit(0)).alias("kind")) for n in range(4)]
    keyed = firsts.where("k0 is not null").select("id", F.explode(F.array(*side)).alias("s")).select("id", "s.*").where("k is not null")
    shared = keyed.groupBy("k").agg(*[F.count_if(F.col("kind") == n).alias(f"n{n}") for n in range(3)])
    shared = shared.where("n1 > 1 or n2 > 1 or (n1 > 0 and n0 + n2 > 0)").hint("merge")  # grows with the input: one plan for all sizes
    swap = F.when(F.col("kind") == 1, F.col("n1") > 1).when(F.col("kind") == 2, F.col("n2") > 1).otherwise(False)
    drop = F.when(F.col("kind") == 1, F.col("n0") > 0).when(F.col("kind") == 2, F.col("n1") > 0).otherwise(False)
    whole = F.when(F.col("kind") == 1, F.col("n2") > 0).when(F.col("kind") == 0, F.col("n1") > 0).otherwise(False)
    last = F.col("last")
    flags = F.when(swap, F.when(last, SWAP_HEAD).otherwise(SWAP_TAIL)).otherwise(0) + F.when(drop, F.when(last, DROP_HEAD).otherwise(DROP_TAIL)).otherwise(0) + F.when(whole, WHOLE).otherwise(0)
    return keyed.join(shared, "k").select("id", flags.alias("flags")).groupBy("id").agg(F.bit_or("flags").alias("flags")).where("flags != 0")


def line_decisions(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each line that isn't blank: doc_id, line_no (from 0), keeper_doc, keeper_line, kind.

    kind: kept (keeper columns null), exact (an earlier equal line is the keeper) or near (an earlier line within one edit is, or
    is one of the first equal line). Null and blank texts give no rows. Documents without an id have no place in the order: no rows,
    and no line is a copy of theirs. Rows that repeat a doc_id: lines at the same place of equal ids count as one place.
    """
    # a row without words is found by its line: a filter on the words would be pushed down and split every line twice
    lines = _texts(docs, text, key).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    lines = lines.select("doc_id", "line_no", _words(F.col("line")).alias("words"))
    n = F.size("words")
    half, up = F.shiftright(n, 1), F.shiftright(n + 1, 1)

    def ends(size):
        return [F.xxhash64(F.lit(0), F.slice("words", F.lit(1), size)), F.xxhash64(F.lit(1), F.slice("words", n - size + 1, size))]

    keys = [F.when(n >= min_words - 1, k) for k in ends(half)] + [F.when((n >= min_words - 1) & (n % 2 == 1), k) for k in ends(up)]
    table = Written(lines.select("doc_id", "line_no", F.xxhash64("words").alias("h1"), F.hash("words").alias("h2"), *[k.alias(f"k{i}") for i, k in enumerate(keys)]), "lines").df
    places = Places(table)
    firsts = Written(table.withColumn("id", places.of).groupBy("h1", "h2").agg(F.min("id").alias("id"), *[F.first(f"k{i}").alias(f"k{i}") for i in range(4)]), "line-firsts").df
    wanted = _wanted(firsts).select(places.doc(F.col("id")).alias("doc_id"), F.struct(places.line(F.col("id")).alias("line_no"), "flags", "id").alias("w"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    own = _texts(docs, text, key).join(wanted, "doc_id")
    found = let(F.split("text", "\n"), lambda ls: F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), w["flags"].alias("flags"), F.get(ls, w["line_no"]).alias("line"))))
    near = own.select(F.explode(found).alias("f")).where("f.line is not null").select("f.id", "f.flags", _words(F.col("f.line")).alias("words"))
    total = _xor(F.transform("words", lambda w, i: F.xxhash64(w, i + 1)))
    held = Written(near.select("id", "flags", F.size("words").alias("n"), "words", total.alias("total")), "line-near")
    near = held.df
    i, n, flags = F.col("i"), F.col("n"), F.col("flags")

    def within(rows, tail, head):
        """The places in those halves that are to be emitted."""
        longer = rows.where(n >= min_words)
        return longer.where(((flags.bitwiseAND(tail) != 0) & (i > F.shiftright(n, 1))) | ((flags.bitwiseAND(head) != 0) & (i <= n - F.shiftright(n, 1))))

    words = near.where(flags.bitwiseAND(SWAP_TAIL | SWAP_HEAD) != 0).select("id", "flags", "n", "total", F.posexplode("words").alias("i", "word")).withColumn("i", i + 1)
    swaps = within(words, SWAP_TAIL, SWAP_HEAD).select("id", "i", F.xxhash64(F.lit(0), n, i, F.col("total").bitwiseXOR(F.xxhash64("word", i))).alias("k"))
    same = swaps.groupBy("k").agg(F.min("id").alias("keeper"), F.max("id").alias("latest")).where("keeper != latest").drop("latest")
    swaps = swaps.join(same.hint("merge"), "k").where("id != keeper").select("id", "keeper", "i", F.lit(0).alias("longer"))
    # without its first word all later ones move up; from then on a word comes back and the next one goes
    moved = F.transform("words", lambda w, j: F.when(j == 0, _xor(F.transform(F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, m: F.xxhash64(x, m + 1)))).otherwise(F.xxhash64(F.get("words", j - 1), j).bitwiseXOR(F.xxhash64(w, j))))
    cut = near.where(flags.bitwiseAND(DROP_TAIL | DROP_HEAD) != 0).select("id", "flags", "n", F.posexplode(_running(moved)).alias("i", "variant")).withColumn("i", i + 1)
    cut = within(cut, DROP_TAIL, DROP_HEAD).select(F.col("id").alias("long"), "i", F.xxhash64(n - 1, "variant").alias("k"))
    short = near.where(flags.bitwiseAND(WHOLE) != 0).select(F.col("id").alias("short"), F.xxhash64(n, "total").alias("k"))
    drops = short.join(cut, "k").where("short != long")
    drops = drops.select(F.greatest("short", "long").alias("id"), F.least("short", "long").alias("keeper"), "i", F.when(F.col("long") > F.col("short"), 1).otherwise(-1).alias("longer"))
    pairs = Written(swaps.union(drops), "line-pairs").df
    text_of = near.select("id", "words")
    both = pairs.join(text_of, "id").join(text_of.toDF("keeper", "kept"), "keeper")

    def rest(col, skip):
        return F.slice(col, i + skip, F.greatest(F.size(col), F.lit(1)))

    equal = (F.slice("words", F.lit(1), i - 1) == F.slice("kept", F.lit(1), i - 1)) & F.when(F.col("longer") == 0, rest("words", 1) == rest("kept", 1)).when(F.col("longer") == 1, rest("words", 1) == rest("kept", 0)).otherwise(rest("words", 0) == rest("kept", 1))
    best = Written(both.where(equal).groupBy("id").agg(F.min("keeper").alias("keeper")), "line-keepers").df
    held.drop()
    decided = firsts.select("h1", "h2", F.col("id").alias("first")).join(best.withColumnRenamed("id", "first"), "first", "left")
    out = table.select("doc_id", "line_no", "h1", "h2", places.of.alias("at")).join(decided, ["h1", "h2"])
    later = F.col("at") != F.col("first")
    kind = F.when(later, "exact").when(F.col("keeper").isNotNull(), "near").otherwise("kept")
    by = F.when(later, F.col("first")).otherwise(F.col("keeper"))
    return out.select("doc_id", "line_no", kind.alias("kind"), by.alias("by")).select("doc_id", "line_no", places.doc(F.col("by")).alias("keeper_doc"), places.line(F.col("by")).alias("keeper_line"), "kind")


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document that has lines: doc_id, n_lines, n_exact, n_near, dropped (their line numbers, ascending).

    Of rows that repeat a doc_id with different texts, a place is dropped only if the lines of all of them go.
    """
    d = line_decisions(docs, min_words, text, key)
    out = F.col("kind") != "kept"
    gone, stays = F.collect_set(F.when(out, F.col("line_no"))), F.collect_list(F.when(~out, F.col("line_no")))
    d = d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "exact").alias("n_exact"), F.count_if(F.col("kind") == "near").alias("n_near"), gone.alias("gone"), stays.alias("stays"))
    return d.select("doc_id", "n_lines", "n_exact", "n_near", F.array_sort(F.array_except("gone", "stays")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, each text without the lines that repeat an earlier one. Blank lines, null texts, texts without an id and all other columns stay."""
    cols = docs.columns
    gone = dropped_lines(docs, min_words, text, key).where(F.size("dropped") > 0).select(F.col("doc_id").alias("_gone_of"), F.col("dropped").alias("_gone"))
    whole = docs.join(gone, F.col(key).cast("long") == F.col("_gone_of"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return whole.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).select(*[F.col(f"`{c}`") for c in cols])
