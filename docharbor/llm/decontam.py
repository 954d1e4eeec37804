"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are an item's word trigrams. Every text is scanned for the seeds of all items; per document and item, hits that lie within
an item's length of one another form a cluster. Each cluster is aligned that has as many seeds as an edited copy must keep. How
many other documents hold a seed doesn't matter: copies elsewhere, intact or edited, can't hide one.
The words around the cluster are aligned with the item (match 1, mismatch -1, gap -1); the score is a share of the item's length.

The benchmark is read in blocks of a fixed number of items, each sent to the workers and held against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

GRAM = 3
#: The share of an item's length that an alignment must score: a quarter of the words may be edited.
THRESHOLD = 0.5
#: Items in a block of the benchmark.
BLOCK = 20_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def needed(n_words: int) -> int:
    """Seeds that a copy keeps at the least if a quarter of the words are edited, halved for copies of a part."""
    return max(1, -(-(n_words - GRAM + 1 - GRAM * int(n_words * 0.25)) // 2))


class Seeds:
    """The trigrams of a block of items: first word -> the rest -> (item, number of the trigram)."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = dict(items)
        self.by_first: dict = defaultdict(lambda: defaultdict(list))
        for item, words in items:
            n = min(GRAM, len(words))
            for i in range(len(words) - n + 1):
                self.by_first[words[i]][tuple(words[i + 1 : i + n])].append((item, i))
        self.by_first = {k: dict(v) for k, v in self.by_first.items()}
        self.lengths = sorted({min(GRAM, len(w)) for _, w in items})

    def clusters(self, words: list[str]) -> list[tuple[int, int, list[str]]]:
        """(item, number of its seeds, the words around) of each cluster of hits with as many seeds as an edited copy must keep."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, first in enumerate(words):
            rest = self.by_first.get(first)
            if rest is not None:
                for n in self.lengths:
                    for item, seed in rest.get(tuple(words[at + 1 : at + n]), ()):
                        hits[item].append((at, seed))
        out = []
        for item, found in hits.items():
            size = len(self.items[item])
            lo = 0
            for hi in range(1, len(found) + 1):
                if hi == len(found) or found[hi][0] - found[hi - 1][0] > size:
                    n = len({s for _, s in found[lo:hi]})
                    if n >= needed(size):
                        out.append((item, n, words[max(0, found[lo][0] - size) : found[hi - 1][0] + size]))
                    lo = hi
        return out


def smith_waterman(a: list[str], b: list[str]) -> int:
    """The best local alignment score: match 1, mismatch -1, gap -1."""
    if not a or not b:
        return 0
    ids: dict[str, int] = {}
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    at = np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for w in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(y == ids.get(w, -1), 1, -1), row[1:] - 1))
        row = np.maximum.accumulate(new + at) - at  # a gap costs one a word
        np.maximum(row, 0, out=row)
        best = max(best, int(row.max()))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, n_seeds) of each document that holds a copy, edited or not, of an item.

    score: the alignment's share of the item's length, the best cluster's if several pass. Documents without such a copy
    give no row; nor do null, empty or wordless texts and items. Rows that repeat a doc_id count as one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where("id is not null and t is not null").distinct()
    blocks = max(1, -(-items.count() // BLOCK))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # a block of the benchmark: bounded by BLOCK, on average
        found = _block(docs, [(r.id, words_of(r.t)) for r in sorted(rows, key=lambda r: (r.id, r.t)) if words_of(r.t)], threshold, text, key)
        out = found if out is None else out.union(found)
    return out


def _block(docs: DataFrame, items: list[tuple[int, list[str]]], threshold: float, text: str, key: str) -> DataFrame:
    # an id may stand for several texts: each has its own number here
    owner = [i for i, _ in items]
    numbered = [(n, w) for n, (_, w) in enumerate(items)]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")

    def scan(batches):
        seeds = Seeds(numbered)
        for batch in batches:
            ids, who, got, around = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for item, found, near in seeds.clusters(words_of(t.as_py())):
                    ids.append(i)
                    who.append(item)
                    got.append(found)
                    around.append(" ".join(near))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(who, pa.int64()), pa.array(got, pa.int32()), pa.array(around, pa.string())], names=["doc_id", "item", "n_seeds", "around"])

    near = rows.mapInArrow(scan, "doc_id long, item long, n_seeds int, around string")

    def align(batches):
        texts = dict(numbered)
        for batch in batches:
            score = [smith_waterman(w.split(" "), texts[i]) / len(texts[i]) for i, w in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            of = [owner[i] for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int64()), pa.array(score, pa.float64()), batch.column(2)], names=["doc_id", "item_id", "score", "n_seeds"])

    scored = near.repartition(F.xxhash64("doc_id", "item")).mapInArrow(align, "doc_id long, item_id long, score double, n_seeds int")
    return scored.where(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"))
