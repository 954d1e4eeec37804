"""Neighbours, language-model scores, language, quality, SentencePiece and WARC: brute force, held-out rows, exact round trips, edge cases."""

import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docharbor.llm import ann, langid, lm_score, quality_crf, sp_codec, warc

# Neighbours.


def brute_nearest(rows, every, k=10):
    out = {}
    for i, q in rows:
        if i % every == 0:
            best = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v, strict=True))), j) for j, v in rows if j != i)[:k]
            out[i] = [(j, d) for d, j in best]
    return out


def test_recall(spark, small):
    d = spark.read.parquet(small.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    exact = brute_nearest(rows, 100)
    found = {}
    for r in ann.nearest(d).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(exact) and all(sorted(v) == list(range(1, 11)) for v in found.values())
    hits = [len({j for j, _ in exact[q]} & {j for j, _ in found[q].values()}) / 10 for q in exact]
    assert np.mean(hits) >= 0.9
    at = dict(rows)
    assert all(abs(s - math.dist(at[q], at[j])) < 1e-12 for q, v in found.items() for j, s in v.values())


def test_few_rows_are_read_where_vectors_have_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16)) * 4
    x = centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16)) * 0.3
    x[:700] = x[0]  # a hot vector
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "CELL", 64)
    index = ann.Index(ann.valid(d), 16)
    assert index.forest.depth == int(np.log2(6000 / ann.LEAF))
    queries = index.table.where("id % 100 = 0").select("id", "v")
    read = index.leaf_rows().select("tree", "leaf", "id").join(ann.routed(index, queries.withColumnRenamed("id", "q"), 10, ann.SEARCH), ["tree", "leaf"]).select("q", "id").distinct().count()
    assert read < 0.2 * 60 * 6000
    exact = brute_nearest([(i, v) for i, v in enumerate(x.tolist())], 100)
    found = {}
    for r in ann.nearest(d).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert np.mean([len(set(found[q]) & {j for j, _ in exact[q]}) / 10 for q in exact if q >= 700]) >= 0.9
    assert sorted(found[0]) == list(range(1, 11)) and sorted(found[300]) == list(range(10))


def test_neighbour_edges(spark):
    same = [(i, [1.0, 0.0]) for i in range(0, 400)]
    odd = [(1000, None), (1001, [0.0, 0.0]), (1002, [float("nan"), 1.0]), (1003, [1.0, None]), (1004, [float("inf"), 1.0]), (1005, [1.0, 2.0, 3.0]), (1100, [2.0, 0.0])]
    d = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 1100}
    assert [v for v, _ in got[0]] == list(range(1, 11)) and [v for v, _ in got[100]] == list(range(10)) and got[1100] == [(i, 1.0) for i in range(10)]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (100, [4.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert ann.nearest(d.limit(0)).count() == 0


# Language-model scores.


def test_scores(spark, small):
    from docharbor.llm.queries import QUERIES

    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in train for w in docs[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = QUERIES["op5_lm_score"](spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        w = docs[r.doc_id]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
    known = [r for r in got if not r.held_out]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


@pytest.fixture(scope="module")
def tiny_model():
    sub = lm_score.subwords(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    texts = [[rng.choice([b"the", b"of", b"cat", b"sat,", b"mat."]) for _ in range(80)] for _ in range(20)]
    return sub, lm_score.train(sub.size, [sub.words(t) for t in texts])


def test_model_is_causal_and_scores_each_token_once(tiny_model):
    sub, m = tiny_model
    words = [b"the", b"of", b"cat", b"sat,", b"mat.", b"zebra-17"]
    flat, starts = sub(words)
    vec = np.concatenate([m.vectors(flat, starts), m.p["emb"][m.size : m.size + 2]])
    cls, _ = m.chains(flat, starts)
    cls = np.append(cls, m.first_class[m.size])
    rng = np.random.default_rng(0)
    a = rng.integers(0, 7, 150)
    b = a.copy()
    b[100:] = 1
    x, y = lm_score.score_tokens(m, np.concatenate([a, b]), np.array([150, 150]), vec, cls).reshape(2, 150)
    assert np.allclose(lm_score.score_tokens(m, a[:3], np.array([3]), vec, cls), x[:3], atol=1e-4)
    assert np.allclose(x[:100], y[:100], atol=1e-4) and (x < 0).all()
    for n in (1, 2, 31, 32, 33, 48, 49, 150):
        start, first = lm_score.window_places(n)
        places = [s + p for s, f in zip(start, first, strict=True) for p in range(f, lm_score.WIDTH) if s + p < n]
        assert places == list(range(n))
    logits = m.logits(m.forward(rng.standard_normal((2, 8, lm_score.DIM)).astype(np.float32)))
    assert logits.shape == (2, 8, m.n_first)


def test_gradient(tiny_model):
    _, m = tiny_model
    rng = np.random.default_rng(3)
    x, target, weight = rng.standard_normal((2, 5, lm_score.DIM)), rng.integers(0, m.n_first, (2, 5)), np.ones((2, 5))
    g, dx, loss = m.gradient(x, target, weight)
    for name in ("q", "k", "v", "o", "out", "pos"):
        p, at, e = m.p[name].astype(np.float64), (1, 2), 1e-5
        old = m.p[name]
        m.p[name] = p.copy()
        m.p[name][at] += e
        up = m.gradient(x, target, weight)[2]
        m.p[name][at] -= 2 * e
        down = m.gradient(x, target, weight)[2]
        m.p[name] = old
        assert (up - down) / (2 * e) == pytest.approx(g[name][at], rel=0.02, abs=1e-5)
    assert loss > 0 and dx.shape == x.shape


def test_score_against_direct_evaluation(spark, monkeypatch):
    """Every token by itself: its window's attention in plain loops, counts by Counter, anchors by slices."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40, 90]))) for _ in range(60)]
    texts += texts[:40] + [texts[9] + " tail " + texts[12]]
    kept = {}
    monkeypatch.setattr(lm_score, "_share", lambda model, *a: kept.setdefault("model", model) and 0.4)
    d = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, train string, block boolean")
    got = {r.doc_id: r for r in lm_score.score(d, P.path("byte_bpe_50k.tiktoken"), F.col("doc_id") % 5 != 0).collect()}
    m, sub = kept["model"], lm_score.subwords(P.path("byte_bpe_50k.tiktoken"))
    split = [t.encode().split() for t in texts]
    learnt = [i for i in range(len(texts)) if i % 5]
    count = Counter(w for i in learnt for w in split[i])
    n = sum(count.values()) + len(learnt)
    mix = min(0.98, max(0.02, 1 - sum(c == 1 for c in count.values()) / n))
    pieces = {w: sub.words([w])[0] for ws in split for w in ws}
    cls = lambda w: m.first_class[m.size if w is None else pieces[w][0]]
    in_class = np.zeros(m.n_first)
    for w, c in [*count.items(), (None, len(learnt))]:
        in_class[cls(w)] += c

    def chain(w):
        if w is None:
            return m.log_first[m.size]
        ids, end = pieces[w], m.later_class[m.size + 2]
        out, state = m.log_first[ids[0]], m.first_class[ids[0]]
        for i in ids[1:]:
            out += m.log_pair[state, m.later_class[i]] + m.log_later[i]
            state = m.n_first + m.later_class[i]
        return out + m.log_pair[state, end]

    def attention(tokens, t):
        start, first = lm_score.window_places(len(tokens))
        s = max(a for a, f in zip(start, first, strict=True) if a + f <= t)
        vec = []
        for k in range(s, t + 1):
            ids = (m.size + 1,) if k == 0 else pieces[tokens[k - 1]]
            vec.append(np.mean([m.p["emb"][i] for i in ids], axis=0) + m.p["pos"][k - s])
        q = vec[-1] @ m.p["q"]
        a = np.exp([q @ (v @ m.p["k"]) / math.sqrt(lm_score.DIM) for v in vec])
        h = vec[-1] + sum(x * (v @ m.p["v"]) for x, v in zip(a / a.sum(), vec, strict=True)) @ m.p["o"]
        z = np.exp(h @ m.p["out"] + m.p["b"])
        return (z / z.sum())[cls(tokens[t])]

    def places(tokens):
        w = lm_score.Words([tokens[:-1]])
        return list(zip(*(x.tolist() for x in lm_score.anchors(w)[1:3]), strict=True))

    runs = {i: [*split[i], None] for i in range(len(texts))}
    ctx, span = Counter(), Counter()
    for i in learnt:
        for a, b in places(runs[i]):
            ctx[tuple(runs[i][a - lm_score.CONTEXT : a])] += 1
            span[tuple(runs[i][a - lm_score.CONTEXT : b])] += 1
    once = lambda c: sum(x == 1 for x in c.values())
    fresh = (once(span) - once(ctx) + 1) / (sum(ctx.values()) - once(ctx) + 2)
    shares = (in_class + 0.5) / (in_class + 0.5).sum()
    helped = 0
    for i, tokens in runs.items():
        p = [(0.4 * attention(tokens, t) + 0.6 * shares[cls(w)]) * (mix * (len(learnt) if w is None else count[w]) / max(1, in_class[cls(w)]) + (1 - mix) * 10 ** chain(w)) for t, w in enumerate(tokens)]
        want, last = sum(map(math.log10, p)), 0
        own = Counter(tuple(tokens[a - lm_score.CONTEXT : x]) for a, b in places(tokens) for x in (a, b)) if i in learnt else Counter()
        for a, b in places(tokens):
            head, whole = tuple(tokens[a - lm_score.CONTEXT : a]), tuple(tokens[a - lm_score.CONTEXT : b])
            if a >= last and ctx[head] > own[head]:
                last, plain = b, math.prod(p[a:b])
                new = (1 - fresh) * (span[whole] - own[whole]) / (ctx[head] - own[head]) + fresh * plain
                want += math.log10(new) - math.log10(plain)
                helped += span[whole] > own[whole]
        assert got[i].score == pytest.approx(want, abs=2e-3 * len(tokens) ** 0.5 + 1e-3), i
    assert helped >= 3  # the table has passages that are remembered


def test_words_are_cut_as_bytes_are():
    rng = random.Random(4)
    texts = [b"", b" ", b"\n\tA", b"Z z\x0b", "É\u00a0é \u2003x\x1cy".encode(), b"\xff\xfe A", *(bytes(rng.choice(b"aAzZ[@ \t\n\x0b\x0c\r\x1f\xc3") for _ in range(rng.randint(0, 40))) for _ in range(300))]
    for own in (pa.array(texts, pa.binary()), pa.array([b"q r", *texts, b"s"], pa.binary())[1:-1], pa.array([], pa.binary())):
        names, numbers, counts = lm_score.split(own)
        words = [names[i] for i in numbers]
        want = [t.as_py().lower().split() for t in own]
        assert counts.tolist() == [len(w) for w in want] and words == [x for w in want for x in w] and len(set(names)) == len(names)


def test_every_training_text_trains_the_model(spark, monkeypatch):
    """Each text has words of its own, early and late; the vectors of all that training texts hold are learnt, by the first shard or by the others, and no others are."""
    sub = lm_score.subwords(P.path("byte_bpe_50k.tiktoken"))
    own = [t.decode() for t in sorted(sub.enc.token_byte_values()) if re.fullmatch(rb" [a-z]{5,7}", t)][: 3 * 40 * 7 : 7]
    own = [w.strip() for w in own]
    texts = [" ".join([*["the", "of"] * 5, own[3 * i], *["the", "of"] * 400, own[3 * i + 1], *["of"] * 30, own[3 * i + 2]]) for i in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for start in (400_000, 4_000):
        kept = {}
        monkeypatch.setattr(lm_score, "START_TOKENS", start, raising=False)
        monkeypatch.setattr(lm_score, "_share", lambda model, *a, kept=kept: kept.update(model=model, rest=a) or 0.4)
        got = lm_score.score(d, P.path("byte_bpe_50k.tiktoken"), F.col("doc_id") % 4 != 0).collect()
        m = kept["model"]
        plain = lm_score.Model(m.size, m.first_class, m.later_class, m.n_first, m.n_later)
        learnt = set(np.nonzero((m.p["emb"] != plain.p["emb"]).any(axis=1))[0].tolist()) - {m.size, m.size + 1}
        assert learnt == {x for i, t in enumerate(texts) if i % 4 for w in sub.words(t.encode().split()) for x in w}
        assert kept["rest"][0].sum() == got[0].train_tokens == sum(len(t.split()) + 1 for i, t in enumerate(texts) if i % 4)


def test_held_out_texts_beat_the_base_and_repeats_are_told_apart(spark, small):
    from docharbor.llm.common import crc_mod

    for sf, least in (("0.01", 0.0), ("0.1", 0.05)):
        d = spark.read.parquet(f"{small.replace('0.001', sf)}/documents.parquet").select("doc_id", "text")
        rng = random.Random(8)
        words = sorted({w for r in d.limit(300).collect() for w in (r.text or "").split()})
        new = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(40)]
        extra = [(10**9 + i, t) for i, t in enumerate(new)] + [(2 * 10**9 + i, t) for i, t in enumerate(new[:20])]
        d = d.union(spark.createDataFrame(extra, d.schema))
        got = lm_score.score(d, P.path("byte_bpe_50k.tiktoken"), crc_mod(F.col("doc_id"), 7) != 2).collect()
        held = [r for r in got if r.held_out and r.doc_id < 10**9]
        assert sum(r.score for r in held) > (1 - least) * sum(r.base_score for r in held)
        per = {r.doc_id - 10**9: r.score / r.n_tokens for r in got if 10**9 <= r.doc_id < 2 * 10**9}
        learnt = lambda i: zlib.crc32(str(i).encode()) % 7 != 2  # noqa: E731  a text whose copy is held out occurs once
        twice, once = [per[i] for i in range(20) if learnt(2 * 10**9 + i)], [per[i] for i in range(20, 40)]
        assert np.mean([x > max(once) for x in twice]) > 0.8


def test_score_edges(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "A a b", "c"), (3, "A a b", "c"), (None, "x " * 5000, "d")], "doc_id long, text string, score string")
    got = lm_score.score(d, P.path("byte_bpe_50k.tiktoken"), F.col("doc_id") == 3).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].n_tokens == by[2].n_tokens == 1 and by[3].n_known == 4 and by[3].train_tokens == 8 and by[None].n_known == 1
    assert by[3].base_score == pytest.approx(2 * math.log10(5 / 12) + 2 * math.log10(3 / 12))
    none = lm_score.score(d, P.path("byte_bpe_50k.tiktoken"), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert lm_score.score(d.limit(0), P.path("byte_bpe_50k.tiktoken"), F.lit(True)).count() == 0


def test_blocks_ask_for_their_words_in_few_rows(spark, monkeypatch):
    """Many blocks, each with words of its own and words of others: counts are right, and neither asking nor answering takes a row a word."""
    rng = random.Random(12)
    texts = [" ".join([*(f"own{i}x{j}" for j in range(150)), *(f"of{rng.randrange(60)}" for _ in range(60)), *["The"] * (i % 5)]) for i in range(60)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tables = {}

    class Kept(lm_score.Written):
        def __init__(self, df, tag, **options):
            super().__init__(df, tag, **options)
            tables[tag] = self.df

    monkeypatch.setattr(lm_score, "Written", Kept)
    monkeypatch.setattr(lm_score, "CHUNK", 6000)
    got = lm_score.score(d, P.path("byte_bpe_50k.tiktoken"), F.col("doc_id") % 6 != 0).collect()
    tokens = [(t or "").lower().split() for t in texts]
    learnt = [i for i in range(len(texts)) if i % 6]
    c = Counter(w for i in learnt for w in tokens[i])
    n, v = sum(c.values()) + len(learnt), len(c) + 1
    for r in got:
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id]) + math.log10((len(learnt) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(want, abs=1e-6) and r.train_tokens == n and math.isfinite(r.score)
        assert r.n_known == sum(c[w] > 0 for w in tokens[r.doc_id]) + 1
    blocks = tables["lm-texts"].count()
    assert len(got) == len(texts) and blocks > 10
    assert tables["lm-counts"].count() < blocks * blocks + 200 < len({w for t in tokens for w in t})


def test_replies_are_totals_of_each_list_over_all_blocks():
    rng = np.random.default_rng(6)
    blocks = []
    for i in range(9):
        # the lists share keys, which are counted apart; anchors are multiples of EVERY; a block may have none of a list, or nothing
        keys = [np.unique(rng.integers(0, 40, n) * ((1 << 62) // 40 // lm_score.EVERY * lm_score.EVERY) - (1 << 61)) for n in ((0, 0, 0), (30, 0, 5), (25, 40, 8))[i % 3]]
        blocks.append((keys, [rng.choice([0, 1, 2, 300, 70_000], len(k)) for k in keys]))
    want = [Counter() for _ in range(3)]
    for keys, counts in blocks:
        for w, k, n in zip(want, keys, counts, strict=True):
            w.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    for buckets in (1, 4, 300):
        asked = [(bucket, i, x) for i, (keys, counts) in enumerate(blocks) for bucket, x in lm_score.requests(keys, counts, buckets)]
        answers, sums = [], np.zeros((3, 3), int)
        for bucket in sorted({a[0] for a in asked}):
            own = [a for a in asked if a[0] == bucket]
            values, some = lm_score.replies([a[2] for a in own])
            answers += [(i, x) for (_, i, _), x in zip(own, values, strict=True)]
            sums += np.array(some)
        for i, (keys, _) in enumerate(blocks):
            got = lm_score.answered(keys, buckets, [x for j, x in answers if j == i])
            assert [g.tolist() for g in got] == [[w[k] for k in own.tolist()] for w, own in zip(want, keys, strict=True)]
        assert sums.tolist() == [[sum(w.values()), sum(n > 0 for n in w.values()), sum(n == 1 for n in w.values())] for w in want]


# Language.


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "bb"]
    lattice = langid.Lattice(pieces)
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 1, 3)) / 5
    m = langid.LanguageModel(lattice, ["x", "y", "z"], p, np.zeros(3))

    def cuts(w):
        if not w:
            yield []
        for i in range(1, len(w) + 1):
            if w[:i] in pieces or i == 1 and w[0] not in pieces:
                for rest in cuts(w[i:]):
                    yield [pieces.index(w[:i]) if w[:i] in pieces else len(pieces), *rest]

    words = ["".join(c) for n in range(1, 7) for c in itertools.islice(itertools.product("abé", repeat=n), 60)]
    brute = np.log([sum(np.prod(p[c], axis=0) for c in cuts(w)) for w in words])
    assert np.allclose(m.log_likelihood(words), brute)
    long = "ab" * 3000
    assert np.isfinite(m.log_likelihood([long])).all() and m.log_likelihood([long])[0, 0] == pytest.approx(6000 * (m.log_likelihood(["ab" * 200])[0, 0] - m.log_likelihood(["ab" * 100])[0, 0]) / 200, rel=0.01)
    counts = m.expected(["aba"], np.ones((1, 3)))
    seg = list(cuts("aba"))
    weight = np.array([np.prod(p[c], axis=0) for c in seg])
    want = sum(weight[i] * c.count(2) for i, c in enumerate(seg)) / weight.sum(axis=0)
    assert np.allclose(counts[2], want)
    # words far beyond the range of doubles: the pieces of each cover it
    tiny = langid.LanguageModel(lattice, ["x", "y", "z"], p / 1e5, np.zeros(3))
    counts = tiny.expected([long, "aba"], np.ones((2, 3)))
    size = np.array([*map(len, pieces), 1])
    assert np.allclose(size @ counts, 6003) and np.isfinite(counts).all()


def test_language_held_out(spark, small):
    from docharbor.llm.queries import QUERIES

    sf = small.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in QUERIES["op8_langid"](spark, sf).collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) >= 0.98


def test_language_edges(spark):
    d = spark.createDataFrame([(1, "the cat and the dog", "en", "z"), (2, "der Hund und die Katze", "de", "z"), (3, None, "en", "z"), (4, "123 !?", None, "z"), (5, "", "fr", "z"), (6, "the the", None, "z")], "doc_id long, text string, lang string, score string")
    m = langid.fit(d, P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, m).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[6][0] == "en" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.fit(d.limit(0), P.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.identify(d, none).collect()} == {"und"} and langid.identify(d.limit(0), m).count() == 0


def test_smallest_hashes(spark):
    """Exactly n of each group, whatever repeats: ids, hashes, whole rows."""
    from docharbor.llm.common import smallest_hashes

    def cut(rows, n):
        out = smallest_hashes(rows, "g", n).collect()
        return {g: sorted(r.h & (1 << 64) - 1 for r in out if r.g == g) for g in {r.g for r in out}}

    d = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("g"), F.xxhash64("id").alias("h"))
    d = d.union(spark.range(20_000).select(F.lit("same"), F.xxhash64(F.lit(7)))).union(spark.range(3).select(F.lit("few"), F.xxhash64("id")))
    got = cut(d, 100)
    every = {g: sorted(r.h & (1 << 64) - 1 for r in d.where(F.col("g") == g).collect())[:100] for g in ("a", "b", "same", "few")}
    assert got == every and cut(d.limit(0), 100) == {}


def test_rare_languages_are_learnt(spark):
    rows = [(1, "zwei Hunde und eine Katze", "de")] + [(i, " ".join(f"word{chr(97 + i % 26)}{chr(97 + j)} the of" for j in range(26)), "en") for i in range(2, 60)]
    rows += [(5, f"the other {chr(97 + i)} text", "en") for i in range(26)]  # an id may repeat
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), P.path("piece_bpe_32k.model"), words=20)
    assert m.langs == ["de", "en"] and m.score(["Hunde", "the word"])[0] == ["de", "en"]


# Quality.


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    dim = 3 * quality_crf.N_OWN
    chain = quality_crf.Chain(rng.standard_normal(dim), rng.standard_normal((2, 2)), np.zeros(4))
    doc = np.array([0, 0, 0, 0, 2, 3, 3])
    x = rng.standard_normal((7, dim))
    em, got = chain.emission(x), chain.marginals(x, doc)
    for d in (0, 2, 3):
        at = np.nonzero(doc == d)[0]
        total, good = 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            s = math.exp(sum(em[i, k] for i, k in zip(at, y, strict=True)) + sum(chain.transitions[a, b] for a, b in itertools.pairwise(y)))
            total += s
            good += s * np.array(y)
        assert np.allclose(got[at], good / total)


def test_quality_held_out(spark, small):
    from docharbor.llm.queries import QUERIES

    sf = small.replace("0.001", "0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op9_quality_crf"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good = [r.predicted for r in got if labels[r.doc_id] == 1]
    bad = [r.predicted for r in got if labels[r.doc_id] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, "A fine line of words.\nAnd one more, quite good.", "c"), (2, "$$$ ### %%% &&& ***\n!!! $$$", "c"), (3, None, "c"), (4, "", "c"), (5, "\n \n", "c"), (6, "x " * 60_000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (9, 1)], "doc_id long, quality int")
    for chain in (quality_crf.fit(d, labels), quality_crf.fit(d, labels.limit(0)), quality_crf.fit(d, labels.where("quality = 1"))):
        got = {r.doc_id: r for r in quality_crf.quality(d, chain).collect()}
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
        assert got[3].score == got[4].score == got[5].score
    assert quality_crf.quality(d.limit(0), chain).count() == 0
    assert {r.doc_id: r.score for r in quality_crf.quality(d, quality_crf.fit(d, labels)).collect()}[1] > {r.doc_id: r.score for r in quality_crf.quality(d, quality_crf.fit(d, labels)).collect()}[2]


# SentencePiece.


def sp_texts():
    rng = random.Random(3)
    fixed = ["", " ", "  a  b ", "x" * 3000, "日本語🤣 é\n\n \t x", "a\u0000b", "<s> </s> <unk> <0x41>", "▁ ▁▁a"]
    return fixed + ["".join(chr(rng.choice([rng.randint(32, 126), 32, 32, rng.randint(0, 0x2FFF), rng.randint(0x4E00, 0x9000)])) for _ in range(40)) for _ in range(100)] + ["".join(rng.choice("abt heing  \n") for _ in range(60)) for _ in range(100)]


def test_parity(spark, small):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.Codec(path)
    texts = sp_texts() + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert c.encode(texts) == sp.encode(texts)
    back = sp_codec.FastDecoder(c.model)
    ids = c.encode(texts)
    assert [back.decode(i) for i in ids] == c.decode(ids)
    assert [back.decode(i) for i in ids][8:] == [t for t in texts][8:]


def proto(number, value):
    kind, body = (5, value) if isinstance(value, tuple) else (0, value) if isinstance(value, int) else (2, value)

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    head = varint(number << 3 | kind)
    return head + (body[0] if kind == 5 else varint(body) if kind == 0 else varint(len(body)) + body)


def test_unigram_model(tmp_path):
    import struct

    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -9.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("▁a", -2.5, 1), ("a", -3.0, 1), ("b", -3.2, 1), ("ab", -3.9, 1), ("ba", -5.0, 1), ("▁ab", -4.1, 1), ("c", -4.0, 1), ("abc", -6.0, 1)]
    data = b"".join(proto(1, proto(1, p.encode()) + proto(2, (struct.pack("<f", s),)) + proto(3, k)) for p, s, k in pieces)
    data += proto(2, proto(3, 1) + proto(35, 1) + proto(40, 0) + proto(41, 1) + proto(42, 2)) + proto(3, proto(1, b"identity") + proto(3, 1) + proto(4, 1) + proto(5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=str(path)), sp_codec.Codec(str(path))
    rng = random.Random(1)
    texts = ["", "  ab  a ", "é"] + ["".join(rng.choice("abc é") for _ in range(20)) for _ in range(200)]
    assert c.encode(texts) == sp.encode(texts) and c.model.kind == sp_codec.UNIGRAM


def test_encode_edges(spark):
    path = P.path("piece_bpe_32k.model")
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  wörld 🤣", "x"), (3, "Hello  wörld 🤣", "x")], "doc_id long, text string, ids string")
    got = sp_codec.encode(d, path)
    rows = got.orderBy("doc_id").collect()
    assert [r.n_pieces for r in rows[:2]] == [0, 0] and all(r.round_trip for r in rows) and rows[2].ids == rows[3].ids
    assert [r.text for r in sp_codec.decode(got.select("doc_id", "ids"), path).orderBy("doc_id").collect()] == ["", "", "Hello  wörld 🤣", "Hello  wörld 🤣"]
    assert sp_codec.encode(d.limit(0), path).count() == 0


# WARC.


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 300_000
    rows = [(5, "http://a/5", "same"), (2, "http://a/2 x\r\n", "same"), (3, None, None), (4, "u", ""), (7, "u", big), (8, "v", big), (8, "v", big), (9, "w", "WARC/1.1\r\n\r\n")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(d, f"file://{tmp_path}/w")
    got = {}
    for r in warc.read_archives(spark, manifest, payloads=True).collect():
        got.setdefault(r.page_id, []).append(r)
    assert {i: [(r.record_type, r.refers_to) for r in v] for i, v in got.items()} == {2: [("response", None)], 5: [("revisit", 2)], 3: [("response", None)], 4: [("revisit", 3)], 7: [("response", None)], 8: [("revisit", 7)] * 2, 9: [("response", None)]}
    for i, _, t in rows:
        for r in got[i]:
            body = (t or "").encode()
            assert r.payload_bytes == len(body) and r.payload_digest == warc.digest(body) and (r.payload is None or bytes(r.payload) == body)
    assert got[2][0].url == "http://a/2%20x%0D%0A" and got[3][0].url is None
    assert warc.round_trip(d.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(d, min_bytes=10**9).collect()} == {"response"}


def test_reader_notices_damage():
    good = warc.record_bytes(1, "u", b"payload" * 1000) + warc.record_bytes(2, "v", b"")
    assert [r.headers["warc-record-id"] for r in warc.read_records(io.BytesIO(good))] == [f"<{warc.NAME}1>", f"<{warc.NAME}2>"]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(good[:-5])))
    raw = zlib.decompress(warc.record_bytes(1, "u", b"payload"), 31)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(z.compress(raw.replace(b"payload\r\n", b"paYload\r\n")) + z.flush())))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    assert len(list(warc.read_records(Slow(good)))) == 2




def test_curve_reads_the_worst_tenth():
    chain = quality_crf.Chain(np.random.default_rng(2).standard_normal(3 * quality_crf.N_OWN), np.array([[0.3, -0.2], [-0.1, 0.4]]), np.zeros(5))
    texts = [b"", b"one good line of words\n$$$ 99 ||| 12\nanother plain line, a bit longer than that\nx\nSHOUT NOW!!!", b"  \n", b"single"]
    d = chain.documents(texts)
    f, size, doc = quality_crf.features(texts)
    good = chain.marginals(quality_crf.with_neighbours(f, doc), doc)
    for i in range(len(texts)):
        left = total = size[doc == i].sum() / 10
        got = 0.0
        for g, n in sorted(zip(good[doc == i], size[doc == i], strict=True)):
            got, left = got + g * min(n, left), left - min(n, left)
        assert abs(d[i, 2] - (got / total if total else 0.0)) < 1e-9
    assert d.shape == (4, 5)
