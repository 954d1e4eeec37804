"""Line dedup, token counts, SimHash and decontamination against brute force, and their edge cases."""

import collections
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from docharbor.llm import decontam, line_dedup, simhash, token_counts
from docharbor.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, score double, keeper string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", 0.5, "x") for i, t in enumerate(texts)], DOCS)


# Line dedup.


def near(a, b, least=5):
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < least:
        return False
    if len(a) < len(b):
        a, b = b, a
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def brute_lines(texts):
    out, firsts = {}, {}
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if w:
                key = tuple(w)
                if key in firsts:
                    out[i, n] = ("exact", firsts[key])
                else:
                    keeper = next((at for k, at in firsts.items() if near(w, list(k))), None)
                    out[i, n] = ("near", keeper) if keeper else ("kept", None)
                    firsts[key] = (i, n)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([3, 4, 5, 6, 9, 10, 11, 12, 13]))] for _ in range(16)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                rng.choice([lambda w=w, at=at: w.pop(at), lambda w=w, at=at: w.insert(at, "z"), lambda w=w, at=at: w.__setitem__(at, "y")])()
            lines.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        texts.append("\n".join([*lines, rng.choice(["", " \t", "short", "Short "])]))
    got = {(r.doc_id, r.line_no): (r.kind, None if r.keeper_doc is None else (r.keeper_doc, r.keeper_line)) for r in line_dedup.line_decisions(docs(spark, *texts)).collect()}
    assert got == brute_lines(texts)


def test_lines_edges(spark):
    long = " ".join(map(str, range(100_000)))
    d = docs(spark, None, "", "a b", "A  b\n\na c", long, long.replace(" 1500 ", " x "), "é x")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert out[0].text is None and out[1].text == "" and out[2].text == "a b" and out[3].text == "\na c" and out[5].text == "" and out[4].text == long
    assert line_dedup.dedup_lines(d).columns == d.columns
    assert line_dedup.line_decisions(d.limit(0)).count() == 0 and line_dedup.dedup_lines(d.limit(0)).count() == 0
    twice = line_dedup.dedup_lines(d.where("doc_id = 2").union(d.where("doc_id = 2")))
    assert twice.count() == 2


def test_lines_without_an_id_and_of_far_ids(spark):
    texts = ["a b c d e", "a b c d x", "A b c d e", "a b c d", None]
    none = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert line_dedup.line_decisions(none).count() == 0 and [r.text for r in line_dedup.dedup_lines(none).collect()] == texts
    for ids in ([-(1 << 63), -5, 0, (1 << 63) - 1], [7, 8, 9, 10]):
        far = spark.createDataFrame([*zip(ids, texts, strict=False), (None, texts[0])], "doc_id long, text string")
        got = {r.doc_id: (r.kind, r.keeper_doc, r.keeper_line) for r in line_dedup.line_decisions(far).collect()}
        assert got == {ids[0]: ("kept", None, None), ids[1]: ("near", ids[0], 0), ids[2]: ("exact", ids[0], 0), ids[3]: ("near", ids[0], 0)}


def test_lines_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, "one\ntwo"), (2, "one\nthree"), (2, "four\nthree")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(d.withColumn("_gone", F.lit(0)).withColumn("_gone_of", F.lit(0)).withColumn("dropped", F.lit(1)).drop("_gone", "_gone_of")).collect()) == ["four\nthree", "one\nthree", "one\ntwo"]


def test_many_lines_under_one_key(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight nine ten "), F.col("id").cast("string"), F.lit(" end")).alias("text"))
    got = line_dedup.line_decisions(d).groupBy("kind", "keeper_doc").count().collect()
    assert sorted((r.kind, r.keeper_doc, r["count"]) for r in got) == [("kept", None, 1), ("near", 0, 2999)]


# Token counts.


@pytest.fixture(scope="module")
def tables():
    return token_counts.bpe(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(3)
    fixed = ["", "a  b", "'re I've", "\n\n x", "aaaaaaaaaaaaaaaaaaa", "hello<|endoftext|>there  <|endoftext|>", "日本語🤣  é 12345 '''ll 'l", "I'll\t\tgo  \n  now", "<|endoftext|>", "  x"]
    return fixed + ["".join(rng.choice(" ab'rel\n<|endoftext|>1é") for _ in range(30)) for _ in range(60)] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF), rng.randint(0x4E00, 0x9000)])) for _ in range(25)) for _ in range(60)]


def test_totals_and_prefixes(tables, library):
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = odd_texts()
    assert tables.count_many(texts) == [count(t) for t in texts]
    for t in texts:
        assert tables.prefix_counts(t).tolist() == [count(t[:k]) for k in range(len(t) + 1)]
    runs = tables.prefix_counts("one two three four")
    assert "one two three four"[: token_counts.fits(runs, 2)] == "one two"


def test_token_counts_query(spark, small, library):
    from docharbor.llm.queries import QUERIES

    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op2_token_counts"](spark, small).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(library.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 1024)


def test_token_counts_edges(spark):
    d = docs(spark, None, "", "x " * 2000).withColumn("n_tokens", F.lit("clash"))
    got = token_counts.token_counts(d, P.path("byte_bpe_50k.json"), prefixes=True).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_bytes, r.over_limit) for r in got] == [(0, 0, False), (0, 0, False), (2001, 4000, True)]
    assert got[0].prefix_tokens == [0] and got[2].prefix_tokens[-1] == 2001 and got[0].keeper == "x"
    assert token_counts.token_counts(d.limit(0), P.path("byte_bpe_50k.json")).count() == 0


# SimHash.


def test_golay_keys_miss_nothing():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64)
    y = x.copy()
    for i in range(500):
        for b in rng.choice(64, i % 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for z in (x, y):
        row, key = simhash.fuzzy_keys(z)
        own = [set() for _ in z]
        for r, k in zip(row, key, strict=True):
            own[r].add(int(k))
        keys.append(own)
    assert all(a & b for a, b in zip(*keys, strict=True))
    table = simhash.golay_table(3)
    assert (table >= 0).sum() == 1 << 11 and table.shape[1] == 1  # the code is perfect: each syndrome has one pattern of at most three bits


def union(pairs, nodes):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        at[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_simhash_against_brute_force(spark, small):
    rows = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows |= {1000: "", 1001: " \n", 1002: "One two", 1003: "one  TWO", 1004: "a b c"}
    d = spark.createDataFrame([*rows.items(), (1005, None)], "doc_id long, text string")
    fps = {i: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3)) for i, t in [*rows.items(), (1005, "")]}
    ids = sorted(fps)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    of = union(pairs, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(d).collect()}
    assert got == {i: (f"{fps[i]:016x}", of[i]) for i in ids}
    assert got[1005] == ("0" * 16, got[1000][1]) and got[1003][1] == 1002


def test_fingerprint_of_one_shingle():
    import xxhash

    assert simhash.fingerprint(simhash.shingle_hashes(b"One two", 3)) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(simhash.shingle_hashes(b"", 3)) == 0


def test_near_groups(spark, small):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(150)] for _ in range(6)]
    texts = {}
    for b in base:
        for k in range(8):
            w = list(b)
            for at in rng.sample(range(150), k):
                w[at] = word()
            texts[len(texts)] = " ".join(w)
    texts |= {100: "", 101: "", 102: "tiny text", 103: "tiny  TEXT", 104: texts[0]}
    d = spark.createDataFrame([*texts.items(), (105, None)], "doc_id long, text string")
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in [*texts.items(), (105, None)]}
    ids = sorted(sets)
    sim = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    of = union([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sim(sets[a], sets[b]) >= 0.8], ids)
    assert {r.doc_id: r.group_id for r in simhash.near_groups(d).collect()} == of
    assert simhash.near_groups(d.limit(0)).count() == 0 and simhash.simhash_components(d.limit(0)).count() == 0


def test_near_groups_link_through_members(spark):
    """Groups of siblings, one edit each, around a centre; a document of three edits is near the centre alone, which is no leader."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for _ in range(4):
        centre = [word() for _ in range(150)]

        def edited(*at, centre=centre):
            return " ".join(word() if i in at else w for i, w in enumerate(centre))

        for text in (*(edited(10 + i) for i in range(80)), " ".join(centre), edited(100, 115, 130)):
            texts[len(texts)] = text
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts.items()}
    sim = lambda a, b: len(a & b) / len(a | b)
    of = union([(a, b) for a in sets for b in sets if a < b and sim(sets[a], sets[b]) >= 0.8], list(texts))
    assert set(of.values()) == {0, 82, 164, 246}
    assert {r.doc_id: r.group_id for r in simhash.near_groups(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()} == of


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(500, x) for x in range(501, 900)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)]
    nodes = {n for p in pairs for n in p}
    of = union(pairs, nodes)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (7, None)], "src long, dst long")).collect()}
    assert got == {n: c for n, c in of.items() if n in got} and all(n in got or of[n] == n for n in nodes)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# Decontamination.


def slow_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert decontam.smith_waterman(a, b) == slow_alignment(a, b)


def test_contaminated(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklm") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    items = {i: text(rng.randint(15, 50)) for i in range(20)}
    rows, expected = {}, set()
    for i in range(300):
        body = text(200)
        if i < 60:
            item = i % 20
            copy = list(items[item])
            for at in rng.sample(range(len(copy)), int(len(copy) * (0, 0.08, 0.15)[i // 20])):
                copy[at] = word()
            body[50:50] = copy
            expected.add((i, item))
        rows[i] = " ".join(body)
    leak = " ".join(items[3])
    rows |= {i: leak.upper() for i in range(1000, 1200)}  # a leak that most copies of an item's seeds come from
    expected |= {(i, 3) for i in range(1000, 1200)}
    d = spark.createDataFrame([*rows.items(), (5000, None), (5001, "")], "doc_id long, text string")
    b = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (90, None), (91, "..."), (None, "x y z")], "item_id long, text string")
    got = decontam.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(0.5 <= r.score <= 1 for r in got)
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0
    assert collections.Counter(r.item_id for r in got)[3] == 203


def test_intact_copies_hide_no_edited_one(spark):
    rng = random.Random(6)
    text = lambda n: ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(n)]
    cases = [(edits, intact) for edits in (7, 8, 9, 10) for intact in (0, 1, 3, 60)]  # 17 to 25 % of the words, spread
    items, rows, expected = {}, {}, set()
    for i, (edits, intact) in enumerate(cases):
        items[i] = text(40)
        copy = list(items[i])
        for n in range(edits):
            copy[n * 40 // edits + 1] = text(1)[0]
        for w in (copy, *[items[i]] * intact):
            expected.add((len(rows), i))
            rows[len(rows)] = " ".join(text(60) + w + text(60))
    got = decontam.contaminated(spark.createDataFrame([*rows.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected
