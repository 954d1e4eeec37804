"""Token counts of byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary entry can end its encoding: the entry t whose left neighbour, the
last entry of the shorter prefix, forms a pair with t that BPE would never have merged across. So the count at a prefix
is one more than the count at the prefix before t, and one pass stores the exact count at every prefix. All distinct
pre-tokens of a batch go through that pass together, one byte position at a time, as numpy arrays.

Counts at prefixes of whole texts follow, so "how many tokens are the first k characters" and "how much text fits n
tokens" are look-ups: nothing is encoded again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The pattern by which byte-level BPE cuts a text into pre-tokens.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Distinct pre-tokens that a worker remembers from batch to batch.
REMEMBER = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixBpe:
    """The tables of one byte-level BPE vocabulary (a tokenizers .json file), and the dynamic programme over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        raw = {s: bytes(alphabet[c] for c in s) for s in model["vocab"] if s not in set(self.special)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # an entry's number: its byte, or 256 + the rank of the merge that makes it
        number = {bytes([b]): b for b in range(256)}
        left, right = list(range(256)), list(range(256))
        pairs = {}
        for a, b in merges:
            x, y = number[raw[a]], number[raw[b]]
            made = raw[a] + raw[b]
            if made not in number:
                number[made] = len(left)
                left.append(x)
                right.append(y)
            pairs[x << 20 | y] = number[made]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_made = keys, np.array([pairs[int(k)] for k in keys], np.int64)
        self._trie(number)
        self.memo_key, self.memo_val = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.known: dict[str, int] = {}

    def _trie(self, number: dict[bytes, int]) -> None:
        nodes, ends, edges = {b"": 0}, [-1], {}
        for word in sorted(number, key=len):
            for i in range(1, len(word) + 1):
                if word[:i] not in nodes:
                    nodes[word[:i]] = len(nodes)
                    ends.append(-1)
                    edges[nodes[word[: i - 1]] << 8 | word[i - 1]] = nodes[word[:i]]
            ends[nodes[word]] = number[word]
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[int(k)] for k in self.edge_keys], np.int64)
        self.ends = np.array(ends, np.int64)

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the entries a and b, side by side, stay apart: BPE makes no merge across them before both are whole."""
        a, b = a.copy(), b.copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(live):
            x, y = a[live], b[live]
            key = x << 20 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_made[at] < limit[live])
            ok[live[clash]] = False
            # undo the later of the two last merges; of equal ones the right one, as BPE merges from the left
            undo_a = x > y
            atom = np.where(undo_a, x, y) < 256
            limit[live] = np.where(undo_a, x, y + 1)
            a[live] = np.where(undo_a, self.right[x], x)
            b[live] = np.where(undo_a, y, self.left[y])
            live = live[~clash & ~atom]
        return ok

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stable with a memory of the latest pairs."""
        key = a << 20 | b
        slot = (key * 0x9E3779B97F4A7C1 >> 17) & ((1 << 20) - 1)
        known = self.memo_key[slot] == key
        out = self.memo_val[slot]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            got = self._stable(new >> 20, new & ((1 << 20) - 1))
            out[~known] = got[back]
            at = (new * 0x9E3779B97F4A7C1 >> 17) & ((1 << 20) - 1)
            # one writer for each slot
            at, first = np.unique(at, return_index=True)
            self.memo_key[at], self.memo_val[at] = new[first], got[first]
        return out

    def _block(self, words: list[bytes]) -> np.ndarray:
        """Counts at every prefix (0 bytes included) of words of similar length: an array of (word, bytes)."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        top = int(sizes.max(initial=0))
        text = np.zeros((n, top), np.uint8)
        text[np.arange(top) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        row, at = np.nonzero(np.arange(top) < sizes[:, None])
        node = np.zeros(len(row), np.int64)
        starts, rows, lens, entries = [], [], [], []
        start = at
        depth = 0
        while len(row):
            key = node << 8 | text[row, start + depth]
            j = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[j] == key
            row, start, node = row[hit], start[hit], self.edge_to[j[hit]]
            depth += 1
            end = self.ends[node]
            done = end >= 0
            starts.append(start[done])
            rows.append(row[done])
            lens.append(np.full(int(done.sum()), depth, np.int64))
            entries.append(end[done])
            more = start + depth < sizes[row]
            row, start, node = row[more], start[more], node[more]
        starts, rows, lens, entries = map(np.concatenate, (starts, rows, lens, entries))
        order = np.argsort(starts, kind="stable")
        starts, rows, lens, entries = starts[order], rows[order], lens[order], entries[order]
        bounds = np.searchsorted(starts, np.arange(top + 1))
        last, count = np.full((n, top + 1), -1, np.int32), np.zeros((n, top + 1), np.int32)
        for i in range(top):
            lo, hi = bounds[i], bounds[i + 1]
            r, t, to = rows[lo:hi], entries[lo:hi], i + lens[lo:hi]
            if i:
                keep = self.stable(last[r, i].astype(np.int64), t)
                r, t, to = r[keep], t[keep], to[keep]
            last[r, to] = t
            count[r, to] = count[r, i] + 1
        return count

    def prefixes(self, words: list[str]) -> list[np.ndarray]:
        """For each word, the counts at its prefixes of 0, 1, 2 ... bytes."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        lo = 0
        while lo < len(order):
            size = max(8, len(raw[order[lo]]))
            hi = lo
            while hi < len(order) and len(raw[order[hi]]) <= 1.5 * size and (hi - lo) * size < 4_000_000:
                hi += 1
            part = [raw[i] for i in order[lo:hi]]
            for i, c, w in zip(order[lo:hi], self._block(part), part, strict=True):
                out[i] = c[: len(w) + 1]
            lo = hi
        return out

    def totals(self, words: list[str]) -> np.ndarray:
        """The counts of whole words: the last prefix of each."""
        return np.array([c[-1] for c in self.prefixes(words)], np.int64)

    def segments(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and the number of those."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text], 0
        parts = self.cut.split(text)
        return parts, len(parts) - 1

    def count_many(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        pieces, extra = [], []
        for t in texts:
            parts, n = self.segments(t)
            pieces.append([p for s in parts for p in PATTERN.findall(s)])
            extra.append(n)
        new = list({p for own in pieces for p in own if p not in self.known})
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = list({p for own in pieces for p in own})
        self.known.update(zip(new, self.totals(new).tolist(), strict=True))
        look = self.known.__getitem__
        return [sum(map(look, own)) + n for own, n in zip(pieces, extra, strict=True)]

    def prefix_counts(self, text: str) -> np.ndarray:
        """The exact number of tokens of text[:k], for k from 0 to len(text).

        A prefix is cut into pre-tokens as the library would cut it, were it the whole text: white space at its end forms
        one pre-token with the white space before it, an apostrophe that begins a contraction stands alone until the
        contraction is whole, and the first characters of a special string are ordinary text until it is whole.
        """
        parts, _ = self.segments(text)
        marks = self.cut.findall(text) if len(parts) > 1 else []
        out, base = [np.zeros(1, np.int64)], 0
        for k, part in enumerate(parts):
            mark = marks[k] if k < len(marks) else ""
            own = self._plain(part + mark[:-1])
            out.append(base + own[1:])
            if mark:
                base += int(own[len(part)]) + 1
                out.append(np.array([base], np.int64))
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        cuts = [m.span() for m in PATTERN.finditer(text)]
        runs = [m.span() for m in regex.finditer(r"\s+", text)]
        counts = self.prefixes([text[a:b] for a, b in cuts] + [text[a:b] for a, b in runs])
        for (a, b), c in zip(cuts, counts, strict=False):
            width = np.fromiter((len(ch.encode()) for ch in text[a:b]), np.int64, b - a).cumsum()
            out[a + 1 : b + 1] = out[a] + c[width]
            word = text[a:b]
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction: whole or not at all
                out[a + 1 : b] = out[a] + np.arange(1, b - a)
        final = out.copy()  # at the end of white space, a prefix's last pre-token is the whole run
        for (a, b), c in zip(runs, counts[len(cuts) :], strict=True):
            width = np.fromiter((len(ch.encode()) for ch in text[a:b]), np.int64, b - a).cumsum()
            final[a + 1 : b + 1] = final[a] + c[width]
        return final


_loaded: dict[str, PrefixBpe] = {}


def bpe(path: str) -> PrefixBpe:
    """One set of tables for each worker process."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def fits(counts, budget: int) -> int:
    """The length of the longest prefix of at most so many tokens, from its prefix counts."""
    return int(np.nonzero(np.asarray(counts) <= budget)[0][-1])


def token_counts(docs: DataFrame, vocab: str, text: str = "text", limit: int = 1024, prefixes: bool = False) -> DataFrame:
    """docs with n_bytes, n_tokens, over_limit (and prefix_tokens, the counts at all prefixes, if asked for).

    A null text counts as empty: 0 bytes, 0 tokens. Columns of docs with these names are replaced. Special strings
    inside a text are one token each. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    added = {"n_bytes", "n_tokens", "over_limit", "prefix_tokens"}
    keep = docs.select(*[c for c in docs.columns if c not in added])
    schema = keep.withColumn("n_tokens", F.lit(0).cast("long"))
    schema = schema.withColumn("prefix_tokens", F.lit(None).cast("array<int>")).schema if prefixes else schema.schema

    def run(batches):
        tables = bpe(vocab)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            if not texts:
                continue
            cols = [*batch.columns]
            if prefixes:
                runs = [tables.prefix_counts(t) for t in texts]
                cols += [pa.array([int(r[-1]) for r in runs], pa.int64()), pa.array([r.tolist() for r in runs], pa.list_(pa.int32()))]
            else:
                cols.append(pa.array(tables.count_many(texts), pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    out = keep.mapInArrow(run, schema)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return out.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})
