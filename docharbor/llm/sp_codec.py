"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here, field by field, and rebuilt as a tokenizers pipeline: normaliser (character map, extra white
space, dummy prefix), the metaspace marker, the pieces with their scores (unigram) or with the merges that
their scores imply (BPE), and bytes for characters that no piece holds. Batches are encoded by several threads.

Where no piece has the marker after another character, a text can be cut before each marker without changing its encoding, so words are encoded
each on its own and remembered.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

MARK = "▁"
#: Fixed values of the format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that are encoded at once: the library keeps some hundred bytes for each token.
CHUNK = 1 << 18
THREADS = 2
#: Words whose encoding a worker remembers.
REMEMBER = 150_000


def wire(data: bytes):
    """(field number, value) of a protobuf message: integers, 4 or 8 raw bytes, or the bytes of a nested field."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class Model:
    """What a SentencePiece model file holds."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def parse(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    m = Model()
    for number, value in wire(data):
        if number == 1:
            own = dict(wire(value))
            m.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(wire(value))
            m.kind, m.byte_fallback, m.unk_id = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
        elif number == 3:
            own = dict(wire(value))
            m.charsmap = own.get(2, b"")
            m.dummy_prefix, m.trim_spaces, m.escape_spaces = (bool(own.get(i, 1)) for i in (3, 4, 5))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model: every split of a piece into two pieces, the better scores first."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    found = []
    for p, score, kind in m.pieces:
        if kind == NORMAL and len(p) > 1:
            for i in range(1, len(p)):
                if p[:i] in ids and p[i:] in ids:
                    found.append((-score, ids[p], ids[p[:i]], ids[p[i:]], p[:i], p[i:]))
    return [(x[4], x[5]) for x in sorted(found)]


def build(m: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if any(kind == USER for _, _, kind in m.pieces) or not m.escape_spaces:
        raise NotImplementedError("user-defined pieces and bare white space are not rebuilt")
    unk = m.pieces[m.unk_id][0]
    if m.kind == BPE:
        model = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    else:
        raise NotImplementedError(f"model kind {m.kind}")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind == NORMAL):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tok


def normalised(tok, m: Model, text: str) -> str:
    """The text that decoding gives back: normalised, without the dummy prefix."""
    out = tok.normalizer.normalize_str(text).replace(MARK, " ")
    return out.removeprefix(" ") if m.dummy_prefix else out


SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Encodes and decodes batches of texts with a model file."""

    def __init__(self, path: str, threads: int = THREADS):
        from tokenizers import normalizers

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = m = parse(path)
        self.tok = build(m)
        self.bare = build(m)
        self.bare.normalizer = normalizers.Sequence([])
        self.by_word = self.tok.pre_tokenizer is not None
        self.opens = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def normalise(self, text: str) -> str:
        if not self.model.charsmap and not self.model.trim_spaces:
            text = text.replace(" ", MARK)
            return MARK + text if text and self.model.dummy_prefix else text
        return self.tok.normalizer.normalize_str(text)

    def _learn(self, words: list[str]) -> None:
        """Encodes words and remembers them. Those with one marker, at their beginning, go side by side: each beginning of a piece with it begins a word."""
        easy = [w for w in words if w[0] == MARK and w[1:2] != MARK]
        hard = [w for w in words if not (w[0] == MARK and w[1:2] != MARK)]
        groups, lo, size = [], 0, 0
        for hi, w in enumerate(easy, 1):
            size += len(w)
            if size >= 1 << 14 or hi == len(easy):
                groups.append(easy[lo:hi])
                lo, size = hi, 0
        parts, sizes = [self.flat], [self.sizes]
        per = max(1, CHUNK >> 14)
        for g in range(0, len(groups), per):
            for own, e in zip(groups[g : g + per], self.bare.encode_batch_fast(["".join(x) for x in groups[g : g + per]], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                at = np.nonzero(self.opens[ids])[0]
                if len(at) == len(own):
                    self.known.update(zip(own, range(len(self.known), len(self.known) + len(own)), strict=True))
                    parts.append(ids)
                    sizes.append(np.diff(np.append(at, len(ids))))
                else:
                    hard += own
        for g in range(0, len(hard), 10_000):
            own = hard[g : g + 10_000]
            ids = [e.ids for e in self.bare.encode_batch_fast(own, add_special_tokens=False)]
            self.known.update(zip(own, range(len(self.known), len(self.known) + len(own)), strict=True))
            parts.append(np.fromiter((x for i in ids for x in i), np.int32))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.flat, self.sizes = np.concatenate(parts), np.concatenate(sizes)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if not self.by_word:
            ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum())), sizes
        words = [SEGMENT.findall(self.normalise(t)) for t in texts]
        new = list({w for own in words for w in own if w not in self.known})
        if len(self.known) + len(new) > REMEMBER:
            self._forget()
            new = list({w for own in words for w in own})
        if new:
            self._learn(new)
        n = np.fromiter(map(len, words), np.int64, len(words))
        look = self.known.__getitem__
        at = np.fromiter((look(w) for own in words for w in own), np.int64, int(n.sum()))
        starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[at]
        done = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts[at] - (done - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.diff(np.concatenate([[0], done])[np.concatenate([[0], n.cumsum()])])

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, sizes = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, sizes.cumsum()[:-1])] if len(texts) else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


class FastDecoder:
    """Decodes by joining the bytes of pieces: the same as the library's decoder, without a string for each token."""

    def __init__(self, m: Model):
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        self.raw, self.prefix = raw, m.dummy_prefix

    def decode(self, ids) -> str:
        out = b"".join(map(self.raw.__getitem__, ids))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>), n_pieces, and round_trip: whether decoding the ids gives the normalised text back.

    A null text counts as empty: no ids. Characters that no piece holds become bytes, or the unknown piece where the model has none;
    then round_trip is false. Columns of docs with these names are replaced.
    """
    small_batches(docs.sparkSession)
    keep = docs.select(*[c for c in docs.columns if c not in ("ids", "n_pieces", "round_trip")])
    schema = keep.withColumns({"ids": F.lit(None).cast("array<int>"), "n_pieces": F.lit(0).cast("long"), "round_trip": F.lit(True)}).schema

    def run(batches):
        c = codec(model)
        back = FastDecoder(c.model)
        plain = not c.model.charsmap and not c.model.trim_spaces  # then normalising changes nothing that decoding doesn't undo
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            flat, sizes, same, lo = [], [], [], 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= CHUNK):
                    n += len(texts[hi])
                    hi += 1
                ids, own = c.encode_flat(texts[lo:hi])
                at = np.concatenate([[0], own.cumsum()])
                for k, t in enumerate(texts[lo:hi]):
                    same.append(back.decode(ids[at[k] : at[k + 1]].tolist()) == (t if plain else normalised(c.tok, c.model, t)))
                flat.append(ids)
                sizes.append(own)
                lo = hi
            own = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], own.cumsum()]), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(own), pa.array(same, pa.bool_())], names=[f.name for f in schema.fields])
        release()

    return keep.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the texts of its ids. Null ids: null."""
    small_batches(encoded.sparkSession)
    keep = encoded.select(*[c for c in encoded.columns if c != out or c == ids])
    schema = keep.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches):
        back = FastDecoder(codec(model).model)
        for batch in batches:
            texts = [None if i is None else back.decode(i) for i in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return keep.mapInArrow(run, schema)
