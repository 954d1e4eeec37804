"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public (the pieces of a SentencePiece model that hold letters, of any length). Each language has a probability for every piece; the likelihood of a
word is the sum over all ways to cut it into pieces, by a forward pass over its characters. Probabilities are
fitted by expectation maximisation (forward and backward passes) on the words of a bounded sample of labelled documents. All
distinct words of a batch go through the passes together, and workers remember words from batch to batch.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_groups, release, small_batches, smallest_hashes
from .sp_codec import MARK, NORMAL, parse

#: Letters only, lower-cased; a word begins with the marker, as pieces do.
WORD = re.compile(r"[^\W\d_]+")
#: Documents and distinct words of each language that the fit takes at the most.
SAMPLE_DOCS, SAMPLE_WORDS = 1500, 10_000
ROUNDS = 3
REMEMBER = 150_000
#: The probability of a character outside the vocabulary, and what is added to each expected count.
UNKNOWN, SMOOTH = 1e-6, 0.05


class Lattice:
    """All ways to cut words into pieces of a vocabulary; characters that no piece holds are pieces of their own, of one class."""

    def __init__(self, pieces: list[str]):
        nodes, ends, edges = {"": 0}, [-1], {}
        for n, p in enumerate(pieces):
            for i in range(1, len(p) + 1):
                if p[:i] not in nodes:
                    nodes[p[:i]] = len(nodes)
                    ends.append(-1)
                    edges[nodes[p[: i - 1]] << 21 | ord(p[i - 1])] = nodes[p[:i]]
            ends[nodes[p]] = n
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[int(k)] for k in self.keys], np.int64)
        self.ends = np.array(ends, np.int64)

    def arcs(self, words: list[str]):
        """sizes, and (start, row, length, piece) of all arcs, by start. Piece n stands for characters outside the vocabulary."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        top = int(sizes.max(initial=0))
        text = np.zeros((len(words), top), np.int64)
        inside = np.arange(top) < sizes[:, None]
        text[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        row, start = np.nonzero(inside)
        node = np.zeros(len(row), np.int64)
        single = np.zeros((len(words), top), bool)
        found = []
        depth = 0
        while len(row):
            key = node << 21 | text[row, start + depth]
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[j] == key
            row, start, node = row[hit], start[hit], self.to[j[hit]]
            depth += 1
            end = self.ends[node]
            done = end >= 0
            found.append((start[done], row[done], np.full(int(done.sum()), depth), end[done]))
            if depth == 1:
                single[row[done], start[done]] = True
            more = start + depth < sizes[row]
            row, start, node = row[more], start[more], node[more]
        row, start = np.nonzero(inside & ~single)
        found.append((start, row, np.ones(len(row), np.int64), np.full(len(row), self.n)))
        start, row, length, piece = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return sizes, start[order], row[order], length[order], piece[order]


def blocks(words: list[str], cells: int = 150_000):
    """Positions of words of similar length, in blocks of bounded size."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    lo = 0
    while lo < len(order):
        size = max(8, len(words[order[lo]]))
        hi = lo
        while hi < len(order) and len(words[order[hi]]) <= 1.5 * size and (hi == lo or (hi - lo) * size < cells):
            hi += 1
        yield order[lo:hi]
        lo = hi


BIG = 1e120


class LanguageModel:
    """Piece probabilities of each language: p has a row for each piece (the last: characters outside) and a column for each language."""

    def __init__(self, lattice: Lattice, langs: list[str], p: np.ndarray, prior: np.ndarray):
        self.lattice, self.langs, self.p, self.prior = lattice, langs, p, prior
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def _pass(self, n: int, top: int, start, row, length, piece):
        """Forward sums and their log scales: a[r, i, l] * exp(s[r, i, l]) is the probability of the first i characters in language l."""
        a = np.zeros((n, top + 1, self.p.shape[1]))
        a[:, 0] = 1
        scale = np.zeros_like(a)
        now = np.zeros((n, self.p.shape[1]))
        bounds = np.searchsorted(start, np.arange(top + 1))
        for i in range(top + 1):
            self._rescale(a, now, i, i, i + self.lattice.longest + 1)
            scale[:, i] = now
            if i < top:
                at = slice(bounds[i], bounds[i + 1])
                r, to = row[at], i + length[at]
                # arcs of one start and row end at different places: no two of a length are the same cell
                for d in np.unique(length[at]):
                    own = length[at] == d
                    a[r[own], to[own]] += a[r[own], i] * self.p[piece[at][own]]
        return a, scale

    @staticmethod
    def _rescale(x: np.ndarray, now: np.ndarray, i: int, lo: int, hi: int) -> None:
        """Sums that are small at place i are made larger at the places from lo to hi, and their log scale smaller."""
        low = (x[:, i] < 1 / BIG) & (x[:, i] > 0)
        rows = np.nonzero(low.any(axis=1))[0]
        if len(rows):
            x[rows, lo:hi] *= np.where(low[rows], BIG, 1.0)[:, None]
            now[rows] -= np.log(BIG) * low[rows]

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for each word and language, all segmentations summed."""
        out = np.zeros((len(words), len(self.langs)))
        for at in blocks(words):
            own = [words[i] for i in at]
            sizes, start, row, length, piece = self.lattice.arcs(own)
            a, scale = self._pass(len(own), int(sizes.max()), start, row, length, piece)
            rows = np.arange(len(own))
            out[at] = np.log(np.maximum(a[rows, sizes], 1e-300)) + scale[rows, sizes]
        return out

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces, by forward and backward passes. weight: counts of each word in each language."""
        out = np.zeros_like(self.p)
        for at in blocks(words):
            own, w = [words[i] for i in at], weight[at]
            sizes, start, row, length, piece = self.lattice.arcs(own)
            n, top = len(own), int(sizes.max())
            a, ahead = self._pass(n, top, start, row, length, piece)
            end = start + length
            order = np.argsort(end, kind="stable")
            start, row, piece, end = start[order], row[order], piece[order], end[order]
            bounds = np.searchsorted(end, np.arange(top + 2))
            b = np.zeros_like(a)
            b[np.arange(n), sizes] = 1
            now = np.zeros((n, self.p.shape[1]))
            total, whole = np.maximum(a[np.arange(n), sizes], 1e-300), ahead[np.arange(n), sizes]
            for i in range(top, 0, -1):
                self._rescale(b, now, i, max(0, i - self.lattice.longest), i + 1)
                s = slice(bounds[i], bounds[i + 1])
                r, pc, at_start = row[s], piece[s], start[s]
                right = self.p[pc] * b[r, i]
                scale = np.exp(ahead[r, at_start] + now[r] - whole[r])
                np.add.at(out, pc, a[r, at_start] / total[r] * scale * right * w[r])
                np.add.at(b, (r, at_start), right)
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior; und and 0 where a text has no letter."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        found = [WORD.findall((t or "").lower()) for t in texts]
        new = list({w for ws in found for w in ws if w not in self.known})
        if len(self.known) + len(new) > REMEMBER:
            self.known, self.rows = {}, self.rows[:0]
            new = list({w for ws in found for w in ws})
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, self.log_likelihood([MARK + w for w in new])]) if new else self.rows
        look = self.known.__getitem__
        langs, scores = [], []
        for ws in found:
            if not ws:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.rows[np.fromiter(map(look, ws), np.int64, len(ws))].sum(axis=0) + self.prior
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores


def vocabulary(model: str) -> list[str]:
    """The pieces of a SentencePiece model that words can hold, lower-cased, without repeats, in the model's order."""
    found = (p.lower() for p, _, kind in parse(model).pieces if kind == NORMAL)
    return list(dict.fromkeys(p for p in found if p == MARK or WORD.fullmatch(p.removeprefix(MARK))))


def fit(labelled: DataFrame, model: str, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> LanguageModel:
    """Learns from the rows of labelled whose language isn't null.

    The sample is bounded: of each language the documents with the smallest hashes of id and text, and of their
    whole texts its most frequent words, so that rare languages are learnt as well. Languages are equally likely beforehand. Rows
    that repeat count as often as they occur. No labelled rows: a model that says und.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    own = smallest_hashes(rows, "lang", docs).select("lang", "text")

    def run(batches):
        for b in batches:
            count: Counter = Counter()
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count.update((name, w) for w in WORD.findall(t.lower()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array([-n for n in count.values()], pa.int64())], names=["lang", "word", "n"])
        release()

    counts = own.mapInArrow(run, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    top = sorted((r.lang, r.word, -r.n) for r in first_of_groups(counts, "lang", words, "n", "word").collect())  # bounded by words, a language
    langs, vocab = sorted({name for name, _, _ in top}), sorted({w for _, w, _ in top})
    weight = np.zeros((len(vocab), len(langs)))
    place, column = {w: i for i, w in enumerate(vocab)}, {name: i for i, name in enumerate(langs)}
    for name, w, n in top:
        weight[place[w], column[name]] += n
    lattice = Lattice(vocabulary(model))
    p = np.full((lattice.n + 1, len(langs)), 1.0 / max(1, lattice.n))
    m = LanguageModel(lattice, langs, p, np.zeros(len(langs)))
    marked = [MARK + w for w in vocab]
    for _ in range(ROUNDS if langs else 0):
        m.p[-1] = UNKNOWN
        got = m.expected(marked, weight) + SMOOTH
        m.p = got / got[:-1].sum(axis=0)
    m.p[-1:] = UNKNOWN
    return m


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). A null, empty or letterless text is und with score 0. Columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = keep.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = spark.sparkContext.broadcast((model.langs, model.p, model.prior, model.lattice))

    def run(batches):
        langs, p, prior, lattice = shared.value
        own = LanguageModel(lattice, langs, p, prior)
        for b in batches:
            names, scores = own.score(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])
        release()

    return keep.mapInArrow(run, schema)
