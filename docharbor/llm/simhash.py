"""SimHash fingerprints linked by Golay-code fuzzy hashing, and near-duplicate groups from them.

Linking: a 64-bit fingerprint is cut into three segments, each padded to the 23 bits of the perfect binary Golay code. Of
two fingerprints that differ in at most two bits, one segment is equal and another differs in at most one bit
(pigeonhole). A 23-bit word is within distance 3 of exactly one codeword; so of two words that differ in one bit, both are
within distance 4 of the codeword of either. Each fingerprint therefore emits, for every ordered pair of segments, the first segment
together with the index of each codeword within distance 4 of the second (5.3 of them on average). Equal keys are joined and
the distance verified: no pair within two bits is missed, and keys are some 33 bits sharp.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, small_batches, written
from .components import connected_components

#: A generator polynomial of the (23, 12) Golay code, and the width of a code word.
GENERATOR, WIDTH = 0b110001110101, 23
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 4
SEED = 42
#: For near_groups: bands and rows of the min-wise signature; its values that go into a sketch, a byte each, seven to a long; and how many of
#: them must agree before sets are compared. At the similarity asked for, 84 agree on average, with a deviation of 4.
BANDS, ROWS, SKETCH, AGREE = 22, 5, 105, 67
#: Members of a large bucket that are compared with as many others in one cell of a join.
CELL = 2000


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator: zero for codewords."""
    v = v.copy()
    for bit in range(WIDTH - 1, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def golay_table(radius: int = RADIUS) -> np.ndarray:
    """For each syndrome, the error patterns of at most so many bits that have it, padded with -1."""
    patterns = [0]
    last = [(0, 0)]
    for _ in range(radius):
        last = [(p | 1 << b, b + 1) for p, at in last for b in range(at, WIDTH)]
        patterns += [p for p, _ in last]
    patterns = np.array(patterns, np.int64)
    of = _syndrome(patterns)
    order = np.argsort(of, kind="stable")
    of, patterns = of[order], patterns[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    table = np.full((1 << 11, int(rank.max()) + 1), -1, np.int64)
    table[of, rank] = patterns
    return table


_table: list[np.ndarray] = []


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each key of unsigned 64-bit fingerprints."""
    if not _table:
        _table.append(golay_table())
    parts = [(fps >> np.uint64(lo)).astype(np.int64) & ((1 << width) - 1) for lo, width in SEGMENTS]
    rows, keys = [], []
    for b in range(3):
        errors = _table[0][_syndrome(parts[b])]
        row, col = np.nonzero(errors >= 0)
        index = (parts[b][row] ^ errors[row, col]) >> 11
        for a in range(3):
            if a != b:
                rows.append(row)
                keys.append(((a * 3 + b) << 22 | parts[a][row]) << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, repeats included; of all words, where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes. No hashes: 0."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, by: np.ndarray, rows: int) -> tuple[list[int], list[int]]:
    """A key for each band, the hash of its minima; and a sketch of them."""
    low = np.full(len(by), ~np.uint64(0), np.uint64)
    for lo in range(0, len(hashes), 512):
        np.minimum(low, (hashes[lo : lo + 512, None] * by).min(axis=0), out=low)
    sketch = np.zeros((SKETCH // 7, 8), np.uint8)
    sketch[:, :7] = (low[:SKETCH] & np.uint64(255)).astype(np.uint8).reshape(-1, 7)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(low.reshape(-1, rows))], sketch.view(np.int64).ravel().tolist()


def agreement(a, b):
    """How many bytes two sketches have in common."""
    seven, high = 0x7F7F7F7F7F7F7F, 0x80808080808080

    def differing(x, y):
        d = x.bitwiseXOR(y)
        return F.bit_count((d.bitwiseAND(F.lit(seven)) + F.lit(seven)).bitwiseOR(d).bitwiseAND(F.lit(high)))

    return F.lit(SKETCH) - sum(differing(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(SKETCH // 7))


def across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (bucket, doc_id, sketch, component) that share a bucket but no component, if their sketches agree.

    Members outside the bucket's largest component are compared with all others, in cells of CELL by CELL, so that no task holds a large bucket.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("k")).where("k > 1")
    whole = Written(whole.select("bucket", F.col("most.component").alias("most"), F.ceil(F.col("n") / CELL).alias("rows"), F.ceil((F.col("n") - F.col("most.n")) / CELL).alias("cols")), "near-mixed").df
    held = members.join(whole, "bucket")

    def part(n):
        return F.pmod(F.xxhash64("doc_id"), F.col(n))

    def each(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    x = held.select("bucket", part("rows").alias("i"), each("cols").alias("j"), "doc_id", "sketch", "component", "most")
    y = held.where("component != most").select("bucket", each("rows").alias("i"), part("cols").alias("j"), F.col("doc_id").alias("o"), F.col("sketch").alias("os"), F.col("component").alias("oc"))
    other = (F.col("component") != F.col("oc")) & ((F.col("component") == F.col("most")) | (F.col("doc_id") < F.col("o")))
    near = (x["bucket"] == y["bucket"]) & (x["i"] == y["i"]) & (x["j"] == y["j"]) & other & (agreement(F.col("sketch"), F.col("os")) >= AGREE)
    return x.join(y, near).select(F.least("doc_id", "o").alias("a"), F.greatest("doc_id", "o").alias("b"))


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id", bands: bool = False) -> DataFrame:
    """(doc_id, fp) and, if asked for, class_key (equal for equal sets of shingles), bands and sketch. A null text counts as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    n_bands, n_rows = BANDS, ROWS
    schema = "doc_id long, fp long" + ", class_key string, bands array<long>, sketch array<long>" * bands

    def run(batches):
        by = _multipliers(n_bands * n_rows)
        for batch in batches:
            fps, same, keys, sketches = [], [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py() or b"", shingle)
                fps.append(fingerprint(h))
                if bands:
                    h = np.unique(h)
                    same.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                    own = band_keys(h, by, n_rows) if len(h) else ([], [])
                    keys.append(own[0])
                    sketches.append(own[1])
            cols = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
            if bands:
                cols += [pa.array(same, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "class_key", "bands", "sketch"][: len(cols)])

    return rows.mapInArrow(run, schema)


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in column fp that differ in at most so many bits (2 at most)."""
    if bits > 2:
        raise ValueError("three segments find two differing bits at most")

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                row, key = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    keys = written(fps.select("fp").distinct().mapInArrow(run, "key long, fp long"), "simhash-keys")
    a, b = keys.select("key", F.col("fp").alias("a")), keys.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id that links of at most so many bits reach).

    Texts that are null, empty or without words have the fingerprint zero and are linked like any other. Copies are
    collapsed to their fingerprint before linking, so that a large group of them costs one row. Null ids are kept as
    rows of their own fingerprint. No rows: no rows.
    """
    fps = written(fingerprints(docs, shingle, text, key), "simhash")
    heads = fps.groupBy("fp").agg(F.min("doc_id").alias("head"))
    groups = connected_components(links(fps, bits).select(F.col("a").alias("src"), F.col("b").alias("dst")), "simhash-groups")
    heads = written(heads.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-heads")
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    of = heads.join(least, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, group_id: the smallest doc_id of the near-duplicate group).

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Candidates
    are pairs whose SimHash fingerprints link by Golay keys, and, as at that similarity fingerprints may differ in more
    bits than two, pairs that share a band of a min-wise signature of the same shingles. Every candidate is
    verified on the whole shingle sets; pairs of a band whose sketches say that they are far below the threshold are no candidates. Documents with equal sets are one class from the start. In a band's bucket
    members are compared with a few leaders, the smallest ids; those that link to none are compared with more leaders, round by
    round, until nobody is left: large groups of copies cost about a comparison each. Then all members of a bucket, and all
    documents of equal or linked fingerprints, that are in different groups so far are compared with each other: no bucket is cut
    short, and no chain of links. Texts without words form one group. Null ids are no documents.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("doc_id is not null")
    sig = Written(fingerprints(rows, shingle, bands=True), "near-signatures").df
    reps = Written(sig.groupBy("class_key").agg(F.min(F.struct("doc_id", "fp", "bands", "sketch")).alias("m")).select("class_key", "m.*"), "near-classes").df
    heads = reps.groupBy("fp").agg(F.min("doc_id").alias("head"))
    same = reps.join(heads, "fp").where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    fp_links = Written(links(reps), "near-fp-links").df
    by_fp = fp_links.join(heads.toDF("a", "ha"), "a").join(heads.toDF("b", "hb"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    by_fp = Written(same.union(by_fp), "near-pairs").df

    def leaders_of(active: DataFrame, n: int) -> DataFrame:
        """The smallest id of each bucket with several members, and of each of n shares of its ids."""
        shares = [F.min(F.when(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == i, F.col("doc_id"))) for i in range(n)]
        low = active.groupBy("bucket").agg(F.count("*").alias("n"), F.array_distinct(F.array_compact(F.array(F.min("doc_id"), *shares))).alias("leaders"))
        return Written(low.where("n > 1").drop("n"), "near-leaders").df

    bucket = F.explode(F.transform("bands", lambda b, i: F.xxhash64(i, b))).alias("bucket")
    active = Written(reps.select("doc_id", bucket), "near-active").df
    n = 2
    low = leaders_of(active, n)
    # all that can ever be compared: members of shared buckets, and documents of shared or linked fingerprints
    active = active.join(low.select("bucket"), "bucket", "left_semi").join(reps.select("doc_id", "sketch"), "doc_id")
    active = members = Written(active.select("bucket", "doc_id", "sketch"), "near-active").df
    shared = fp_links.select("a").union(fp_links.select("b")).union(reps.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")).distinct().toDF("fp")
    by_both = Written(reps.join(shared, "fp", "left_semi").select("fp", "doc_id", "sketch"), "near-fp-members").df
    involved = active.select("doc_id").union(by_both.select("doc_id")).distinct()

    def shingled(batches):
        for batch in batches:
            own = [np.unique(shingle_hashes(t.as_py() or b"", shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["id", "set"])

    sets = written(rows.join(involved, "doc_id", "left_semi").mapInArrow(shingled, "id long, set array<long>"), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        both = both.withColumn("n", F.size(F.array_intersect("sa", "sb")))
        return Written(both.where(F.col("n") >= similarity * (F.size("sa") + F.size("sb") - F.col("n")) - 1e-9).select("a", "b").distinct(), "near-links").df

    edges = verified(by_fp)
    while not low.isEmpty():
        heads = low.select("bucket", F.explode("leaders").alias("l")).join(active.toDF("bucket", "l", "ls"), ["bucket", "l"])
        near = (active["bucket"] == heads["bucket"]) & (active["doc_id"] != F.col("l")) & (agreement(F.col("sketch"), F.col("ls")) >= AGREE)
        pair = active.join(heads, near).select(active["bucket"], "doc_id", F.least("l", "doc_id").alias("a"), F.greatest("l", "doc_id").alias("b"))
        tried = Written(pair, "near-trials").df
        good = verified(tried.select("a", "b").distinct())
        edges = edges.union(good)
        linked = tried.join(good, ["a", "b"], "left_semi").select("bucket", "doc_id").distinct()
        # leaders were compared with everyone, so each round leaves a bucket smaller
        left = active.join(low, "bucket").where(~F.array_contains("leaders", F.col("doc_id"))).select("bucket", "doc_id", "sketch")
        active = Written(left.join(linked, ["bucket", "doc_id"], "left_anti"), "near-active").df
        n = min(64, n * 8)
        low = leaders_of(active, n)
    groups = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), "near-groups")

    def placed(of: DataFrame) -> DataFrame:
        return of.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    # who left a bucket with a leader wasn't compared with those who stayed: what is still apart is compared now
    by_both = Written(placed(by_both.where(F.size("sketch") > 0)).select("fp", "doc_id", "sketch", "component"), "near-fp-members").df
    apart = by_both.groupBy("fp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = fp_links.join(apart.toDF("a", "la", "ha"), "a").join(apart.toDF("b", "lb", "hb"), "b").where("least(la, lb) != greatest(ha, hb)").select("a", "b")
    ends = mixed.join(by_both.toDF("a", "x", "xs", "xc"), "a").join(by_both.toDF("b", "y", "ys", "yc"), "b").where((F.col("xc") != F.col("yc")) & (agreement(F.col("xs"), F.col("ys")) >= AGREE))
    pairs = across(placed(members)).union(across(by_both.withColumnRenamed("fp", "bucket"))).union(ends.select(F.least("x", "y"), F.greatest("x", "y")))
    late = verified(Written(pairs.distinct(), "near-trials").df)
    if not late.isEmpty():
        groups = connected_components(groups.toDF("src", "dst").union(late), "near-groups")
    of = reps.select("class_key", "doc_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("class_key", F.coalesce("component", "doc_id").alias("group_id"))
    return sig.select("doc_id", "class_key").join(of, "class_key").select("doc_id", "group_id")
