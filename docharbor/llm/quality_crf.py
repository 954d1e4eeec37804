"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are taken from its own characters and words and from the lines before and after it; neighbouring
labels are tied by transition weights. Marginals of each line come from forward and backward passes, are averaged with
the lines' lengths as weights, and a logistic curve turns the average, and that of the worst tenth, into a probability of the document label.
Features of a batch are computed over one byte array; passes run over all documents at once, line by line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, smallest_hashes

#: Labelled documents of each class that the fit takes at the most, and lines of a stretch of them.
SAMPLE_DOCS, STRETCH = 2000, 64
STEPS, RATE, PENALTY = 250, 0.05, 1e-4
THRESHOLD = 0.7

SPACE, UPPER, LOWER, DIGIT, MARKS, ODD, BAR, HIGH = range(8)


def _classes() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[list(b" \t\v\f\r\n")] = SPACE
    kind[list(range(65, 91))] = UPPER
    kind[list(range(97, 123))] = LOWER
    kind[list(range(48, 58))] = DIGIT
    kind[list(b".,;:?'\"-()")] = MARKS
    kind[list(b"|")] = BAR
    kind[list(range(128, 256))] = HIGH
    return kind


KIND = _classes()
N_OWN = 11


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, document) of each line that isn't blank, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = KIND[data]
    brk = np.nonzero(data == 10)[0]
    starts = np.concatenate([[0], brk[:-1] + 1])
    size = brk - starts
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.searchsorted(sizes.cumsum(), starts, side="right")
    space = kind == SPACE
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    at = np.nonzero(first)[0]  # words begin here
    bounds = np.searchsorted(at, np.concatenate([starts, [len(data)]]))
    n_words = np.diff(bounds)
    keep = n_words > 0
    if not keep.any():
        return np.zeros((0, N_OWN)), np.zeros(0), np.zeros(0, np.int64)

    def per_line(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[np.concatenate([starts, [len(data)]])])

    chars = np.maximum(1, per_line(solid))
    letters = per_line(kind == UPPER), per_line(kind == LOWER), per_line(kind == HIGH)
    odd, digits, bars, marks = (per_line(kind == k) for k in (ODD, DIGIT, BAR, MARKS))
    # words as numbers: the sum of their bytes, each scrambled by its place
    last = np.zeros(len(at), np.int64)
    last[:-1] = at[1:]
    last[-1:] = len(data)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(data)]])))
    code = np.where(solid, (data.astype(np.int64) + 1) * ((place * 0x9E3779B1 + 0x7F4A7C15) & 0x7FFFFFFF), 0)
    word = np.add.reduceat(code, at)
    same = np.zeros(len(at), bool)
    same[1:] = word[1:] == word[:-1]
    same2 = np.zeros(len(at), bool)
    same2[2:] = word[2:] == word[:-2]
    run = np.concatenate([[0], same.cumsum()])
    repeats = run[bounds[1:]] - run[bounds[:-1]]
    run = np.concatenate([[0], same2.cumsum()])
    repeats2 = run[bounds[1:]] - run[bounds[:-1]]
    # words that occur earlier in their line
    line = np.repeat(np.arange(len(starts)), n_words)
    order = np.lexsort((word, line))
    again = np.zeros(len(at), bool)
    again[1:] = (word[order][1:] == word[order][:-1]) & (line[order][1:] == line[order][:-1])
    seen = np.bincount(line[order], weights=again, minlength=len(starts))
    n = np.maximum(1, n_words)
    f = np.stack([np.ones(len(starts)), np.sqrt(odd / chars), letters[0] / np.maximum(1, sum(letters)), digits / chars, np.sqrt(bars / chars), repeats / n, repeats2 / n, (seen / n) * (n_words >= 8), marks / chars, np.log1p(n_words) / 5, chars / n / 10], axis=1)
    return f[keep], size[keep].astype(float), doc[keep]


def features(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of many texts, a MB at once: the byte arrays take a hundred times as much as the text."""
    found, lo = [line_features([b""])], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= most):
            size += len(texts[hi])
            hi += 1
        f, n, doc = line_features(texts[lo:hi])
        found.append((f, n, doc + lo))
        lo = hi
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def with_neighbours(f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and of the line after in its document (zeros where there is none)."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    if len(f) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:] = f[:-1] * same
        after[:-1] = f[1:] * same
    return np.concatenate([f, before, after], axis=1)


class Chain:
    """The model: emission weights of the label good against bad, and transitions[a, b] from label a to b."""

    def __init__(self, w: np.ndarray, transitions: np.ndarray, curve: np.ndarray):
        self.w, self.transitions, self.curve = w, transitions, curve

    def messages(self, emission: np.ndarray, first: np.ndarray, count: np.ndarray):
        """(log forward, log backward) of all lines; emission: (line, label), documents as first line and number of lines."""
        fwd, bwd = emission.copy(), np.zeros_like(emission)
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        live = np.searchsorted(-count, -np.arange(1, int(count.max(initial=1)) + 1), side="right")  # documents of more than t lines
        for t in range(1, int(count.max(initial=1))):
            at = first[: live[t]] + t
            prev = fwd[at - 1]
            fwd[at] = emission[at] + np.logaddexp(prev[:, :1] + self.transitions[0], prev[:, 1:] + self.transitions[1])
        for t in range(int(count.max(initial=1)) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            nxt = emission[at + 1] + bwd[at + 1]
            bwd[at] = np.logaddexp(self.transitions[:, 0] + nxt[:, :1], self.transitions[:, 1] + nxt[:, 1:])
        return fwd, bwd

    def emission(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.w
        return np.stack([-s / 2, s / 2], axis=1)

    def marginals(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        if not len(x):
            return np.zeros(0)
        first = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1])
        count = np.diff(np.concatenate([first, [len(doc)]]))
        fwd, bwd = self.messages(self.emission(x), first, count)
        both = fwd + bwd
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """What the curve reads of each text: the mean good share by length, the mean of the log odds, the mean good share of the worst tenth by length, and whether there are lines."""
        f, size, doc = features(texts)
        good = self.marginals(with_neighbours(f, doc), doc)
        weight = np.bincount(doc, weights=size, minlength=len(texts))
        has = weight > 0
        weight = np.maximum(weight, 1e-9)
        share = np.bincount(doc, weights=size * good, minlength=len(texts)) / weight
        odds = np.bincount(doc, weights=size * np.clip(np.log((good + 1e-4) / (1.0001 - good)), -6, 6), minlength=len(texts)) / weight
        # lines from worst to best within each text, each up to what is left of the tenth
        order = np.lexsort((good, doc))
        by_doc, length = doc[order], size[order].astype(float)
        before = np.cumsum(length) - length - (np.cumsum(weight * has) - weight * has)[by_doc]
        taken = np.clip(weight[by_doc] / 10 - before, 0, length)
        worst = np.bincount(by_doc, weights=taken * good[order], minlength=len(texts)) / (weight / 10)
        return np.stack([np.where(has, share, 0.0), np.where(has, odds, 0.0), np.where(has, worst, 0.0), has.astype(float), np.ones(len(texts))], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.documents(texts) @ self.curve, -30, 30)))


def _adam(w: np.ndarray, gradient, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(texts: list[bytes], good: np.ndarray) -> Chain:
    """Fits the chain on lines that inherit their document's label, classes weighted alike, then the curve on the documents."""
    f, _, doc = features(texts)
    dim = 3 * N_OWN
    if not len(f) or len(set(good.tolist())) < 2:
        base = np.log((good.sum() + 1) / (len(good) - good.sum() + 1)) if len(good) else 0.0
        return Chain(np.zeros(dim), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, 0.0, base]))
    x = with_neighbours(f, doc)
    where = np.arange(len(doc)) - np.searchsorted(doc, doc)
    part = doc * (1 << 32) + where // STRETCH
    first = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1])
    count = np.diff(np.concatenate([first, [len(doc)]]))
    y = good[doc].astype(int)
    per_class = np.array([max(1, (good[doc[first]] == c).sum()) for c in (0, 1)])
    weight = 0.5 / per_class[y] * (1 / np.repeat(count, count))
    link = np.nonzero(part[1:] == part[:-1])[0]

    def gradient(theta):
        chain = Chain(theta[:dim], theta[dim:].reshape(2, 2), np.zeros(5))
        em = chain.emission(x)
        fwd, bwd = chain.messages(em, first, count)
        both = fwd + bwd
        good_now = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        g = x.T @ (weight * (good_now - y))
        z = np.logaddexp(both[:, 0], both[:, 1])
        pair = fwd[link][:, :, None] + chain.transitions + (em + bwd)[link + 1][:, None, :] - z[link][:, None, None]
        want = np.zeros((2, 2))
        np.add.at(want, (y[link], y[link + 1]), weight[link])
        gt = (np.exp(np.minimum(pair, 0)) * weight[link][:, None, None]).sum(axis=0) - want
        return np.concatenate([g, gt.ravel()]) + PENALTY * theta

    theta = _adam(np.zeros(dim + 4), gradient)
    chain = Chain(theta[:dim], theta[dim:].reshape(2, 2), np.zeros(5))
    d = chain.documents(texts)
    return Chain(chain.w, chain.transitions, _adam(np.zeros(5), lambda c: d.T @ (1 / (1 + np.exp(-np.clip(d @ c, -30, 30))) - good) / len(good) + PENALTY * c, 600, 0.1))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", n: int = SAMPLE_DOCS) -> Chain:
    """Learns from the labels (key, label) of 0 or 1; of each class the documents with the smallest hashes of their ids, n at the most. Labels that repeat count once.

    The curve is set to the share of the classes among all labels. No labelled texts: a model that says one half.
    """
    small_batches(docs.sparkSession)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).distinct().withColumn("h", F.xxhash64("id"))
    ids = smallest_hashes(rows, "y", n)  # 2 n rows at the most: small enough to send
    shares = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(ids), "id")
    sample = own.orderBy("h", "y", "t").limit(2 * n).select("t", "y").toPandas()  # bounded by n
    good = sample["y"].to_numpy(float)
    chain = train([bytes(t) for t in sample["t"]], good)
    if len(shares) == 2 and 0 < good.sum() < len(good):
        taken = good.sum() / (len(good) - good.sum())
        chain.curve = chain.curve + np.array([0, 0, 0, 0, np.log(shares[1] / shares[0] / taken)])
    return chain


def quality(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, the probability of label 1) and predicted (1 from the threshold up). Null texts count as empty; texts without lines have the score of an average such document. Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    keep = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    schema = keep.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chain.score(texts))], names=[f.name for f in schema.fields])
        release()

    return keep.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
