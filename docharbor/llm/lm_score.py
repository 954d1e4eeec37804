"""Scoring texts with a causal self-attention language model, beside corpus counts.

Tokens are words (A-Z lower-cased) and one end for each text. A word is read as its subword ids: its vector is the mean of theirs. One layer
of causal self-attention over the vectors before a token gives the probability of the class of its first subword; the classes
of later subwords follow from the class before them, and a subword from its class. The model's probability of a token is
(a * P_attention(class) + (1 - a) * C / N) * (m * c / C + (1 - m) * P_subwords(token | class)): c is the token's count in the training texts, C that
of all tokens of its class, N that of all; 1 - m is the share of training tokens that occur once, which is how often a new word is to
be expected, and a explains best what the attention gave to texts that it hadn't learnt from yet.

Beside it the model remembers passages of the corpus. Contexts of CONTEXT words whose hash is a multiple of EVERY are anchors; the SPAN tokens
after an anchor are copied from the training texts with the probability 1 - l, s / c of the times (s: how often they follow the context
there, c: how often it occurs), else they come token by token. l is the share of anchors met before that went on in a new way. A training text is
scored as the rest of the corpus predicts it: its own passages aren't remembered from itself. So a text that occurs twice is told from one that occurs once.

All of it is learnt from every training text. Counts (of words, of anchors and what follows them, of subwords, and of the company they
keep, from which the classes come) are one pass. Attention and vectors are trained on every window of every training text: first those of some
START_TOKENS tokens, dealt by hash, in one shard; then all the others, one shard a task, each from the parameters of the first; what the shards change is averaged,
weighted by what each has read. A window is scored before it is learnt from; from these scores of all tokens comes a. The same pass counts class pairs.

Texts are scored in windows of WIDTH tokens, each STRIDE after the last, all windows of a block in one masked batch. A
token is scored once, in the first window that holds it, with at least WIDTH - STRIDE tokens before it, or all there are.

Words and anchors are looked up without a broadcast vocabulary: texts are written once, a row a block (CHUNK bytes, or one longer text), packed;
each block asks for the counts of its distinct words and anchors, as 64-bit hashes. Requests are dealt by hash to buckets, one for BLOCKS blocks, a row for each
block and bucket; a bucket is sorted and counted at once, and answers with a count for each request, in the order in which they were asked. Answers meet
their block's texts in a cogroup, so that a worker holds one block and its words. A frequent word costs one request a block.
"""

from __future__ import annotations

import base64
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, release, small_batches

#: The pattern by which the subword vocabulary cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIM, WIDTH, STRIDE = 16, 32, 16
#: Classes: frequent subwords of their own (first ones, later ones), and groups of the rest by company and frequency.
OWN, OWN_LATER, COMPANY, BINS = 64, 256, 8, 4
#: The first shard: tokens about, passes over them, the fewest steps, windows a step, rate.
START_TOKENS, PASSES, STEPS, BATCH, RATE = 400_000, 3, 300, 48, 0.01
#: The shards of all other texts: windows a step, rate, and the steps after which it begins to fall.
ALL_BATCH, ALL_RATE, FALL = 256, RATE / 4, 100
#: Numbers that describe the company of a subword, subwords of a piece of what is summed, bins of scores.
SKETCH, PIECE, RATIOS = 8, 1024, 4000
#: Anchors: words of context, one context in so many, tokens that are remembered.
CONTEXT, EVERY, SPAN = 3, 24, 12
#: Lists of keys that a block asks for: words, contexts, contexts with their spans.
KINDS = 3
#: The most partitions that blocks are dealt out to.
PARTITIONS = 20_000
#: Bytes of text in a block, and blocks whose requests make a bucket, on the average.
CHUNK, BLOCKS = 8 << 20, 2
END_HASH = -1


class Subwords:
    """Subword ids of words, from a rank file of a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.enc = tiktoken.Encoding("docharbor", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(self.size, bool)  # subwords that begin with the space before a word
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word begins).

        Words are encoded side by side, each after a space; where that doesn't give one beginning a word, one by one.
        """
        flat, starts, n = [], [], 0
        for lo in range(0, len(words), 20_000):
            own = words[lo : lo + 20_000]
            ids = np.array(self.enc.encode_ordinary(" " + b" ".join(own).decode("utf-8", "replace")), np.int64)
            at = np.nonzero(self.opens[ids])[0]
            if len(at) != len(own):
                single = [self.enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in own]
                sizes = np.fromiter(map(len, single), np.int64, len(single))
                ids, at = np.fromiter((x for s in single for x in s), np.int64, int(sizes.sum())), sizes.cumsum() - sizes
            flat.append(ids)
            starts.append(at + n)
            n += len(ids)
        return (np.concatenate(flat), np.concatenate(starts)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        flat, starts = self(words)
        return [tuple(x.tolist()) for x in np.split(flat, starts[1:])] if len(starts) else []


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


class Model:
    """Parameters, and the passes over windows. Subword ids from self.size on: end (size), start (size + 1), end of word (size + 2)."""

    def __init__(self, size: int, first_class: np.ndarray, later_class: np.ndarray, n_first: int, n_later: int, seed: int = 5):
        self.size, self.first_class, self.later_class, self.n_first, self.n_later = size, first_class, later_class, n_first, n_later
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": (rng.standard_normal((size + 3, DIM)) * 0.3).astype(np.float32), "pos": r(WIDTH, DIM), "q": r(DIM, DIM), "k": r(DIM, DIM), "v": r(DIM, DIM), "o": r(DIM, DIM), "out": r(DIM, n_first), "b": np.zeros(n_first, np.float32)}
        self.tables()

    def tables(self, first: np.ndarray | None = None, later: np.ndarray | None = None, pairs: np.ndarray | None = None) -> None:
        """Probabilities within classes and of class pairs, from counts over the corpus."""
        first = np.zeros(self.size + 3) if first is None else first
        later = np.zeros(self.size + 3) if later is None else later
        pairs = np.zeros((self.n_first + self.n_later, self.n_later)) if pairs is None else pairs

        def within(count, cls, n):
            c = count + 0.1
            return np.log10(c / np.bincount(cls, weights=c, minlength=n)[cls])

        self.log_first, self.log_later = within(first, self.first_class, self.n_first), within(later, self.later_class, self.n_later)
        p = pairs + 0.5
        self.log_pair = np.log10(p / p.sum(axis=1, keepdims=True))

    def copy(self) -> Model:
        own = Model.__new__(Model)
        own.__dict__.update(self.__dict__)
        own.p = {k: v.copy() for k, v in self.p.items()}
        return own

    def vectors(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The vector of each word: the mean of its subwords'."""
        if not len(starts):
            return np.zeros((0, DIM), np.float32)
        sizes = np.diff(np.append(starts, len(flat)))
        out = np.empty((len(starts), DIM), np.float32)
        for lo in range(0, len(starts), 50_000):
            hi = min(lo + 50_000, len(starts))
            a, b = starts[lo], starts[hi] if hi < len(starts) else len(flat)
            out[lo:hi] = np.add.reduceat(self.p["emb"][flat[a:b]], starts[lo:hi] - a, axis=0)
        return out / sizes[:, None].astype(np.float32)

    def chains(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class of the first subword, log10 P of the word within its class) of each word."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0)
        is_first = np.zeros(len(flat), bool)
        is_first[starts] = True
        state = self.states(flat, is_first)
        total = self.log_pair[state, self.nexts(flat, is_first)] + np.where(is_first, self.log_first[flat], self.log_later[flat])
        return self.first_class[flat[starts]], np.add.reduceat(total, starts)

    def states(self, flat: np.ndarray, is_first: np.ndarray) -> np.ndarray:
        return np.where(is_first, self.first_class[flat], self.n_first + self.later_class[flat])

    def nexts(self, flat: np.ndarray, is_first: np.ndarray) -> np.ndarray:
        """The class that follows each subword: of the next one, or of the word's end."""
        end = self.later_class[self.size + 2]
        nxt = np.full(len(flat), end)
        nxt[:-1] = np.where(is_first[1:], end, self.later_class[flat[1:]])
        return nxt

    def logits(self, h: np.ndarray) -> np.ndarray:
        out = h @ self.p["out"]
        out += self.p["b"]
        return np.clip(out, -60, 60, out=out)

    def forward(self, x: np.ndarray, keep: bool = False, skip: int = 0):
        """The state at each place from skip on of windows x (window, place, DIM), each place seeing itself and those before; for training what led to it as well."""
        p, shape = self.p, x.shape
        x = x + p["pos"][: shape[1]]
        qkv = x.reshape(-1, DIM) @ np.concatenate([p["q"], p["k"], p["v"]], axis=1)
        q, k, v = (qkv.reshape(*shape[:2], 3, DIM)[:, :, i] for i in range(3))
        a = np.matmul(q[:, skip:], k.transpose(0, 2, 1))
        a *= np.float32(DIM**-0.5)
        seen = np.tri(shape[1], dtype=np.float32)[skip:]
        if max(a.max(initial=0), -a.min(initial=0)) > 40:  # beyond what can be summed as it is
            a -= np.where(seen > 0, a, -np.inf).max(axis=2, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= seen
        a /= np.matmul(a, np.ones((shape[1], 1), a.dtype))  # row sums, by a product as that is faster
        c = np.matmul(a, v)
        h = x[:, skip:] + (c.reshape(-1, DIM) @ p["o"]).reshape(c.shape)
        return (h, (x, q, k, v, a, c)) if keep else h

    def gradient(self, x, target, weight):
        """Gradients of the mean loss for each parameter but emb, and for x; then that loss."""
        g, dx, logp = self.learnt(x, target, weight > 0)
        return g, dx, float(-logp.mean())

    def learnt(self, x, target, use):
        """Gradients of the mean loss over the places use (a mask) for each parameter but emb, and for x; then ln P of the class at each of these places."""
        p = self.p
        h, (x, q, k, v, a, c) = self.forward(x, keep=True)
        places = np.flatnonzero(use)
        rows, target = h.reshape(-1, DIM).take(places, axis=0), target.ravel().take(places)
        d = self.logits(rows)
        np.exp(d, out=d)
        total = d @ np.ones(d.shape[1], d.dtype)
        at = np.arange(len(d))
        logp = np.log(d[at, target] / total)
        one = d.dtype.type(1 / max(1, len(d)))
        d *= (one / total)[:, None]
        d[at, target] -= one
        flat = lambda y: y.reshape(-1, DIM)
        g = {"out": rows.T @ d, "b": np.ones(len(d), d.dtype) @ d}
        dh = np.zeros_like(h)
        flat(dh)[places] = d @ p["out"].T
        g["o"] = flat(c).T @ flat(dh)
        dc = (flat(dh) @ p["o"].T).reshape(h.shape)
        ds = np.matmul(dc, v.transpose(0, 2, 1))
        ds -= (flat(dc * c) @ np.ones((DIM, 1), c.dtype)).reshape(*h.shape[:2], 1)
        ds *= a
        ds *= np.float32(DIM**-0.5)
        back = np.empty((*h.shape[:2], 3, DIM), h.dtype)
        back[:, :, 0], back[:, :, 1], back[:, :, 2] = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dc)
        back = back.reshape(-1, 3 * DIM)
        g["q"], g["k"], g["v"] = np.split(flat(x).T @ back, 3, axis=1)
        dx = dh + (back @ np.concatenate([p["q"], p["k"], p["v"]], axis=1).T).reshape(h.shape)
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][: dx.shape[1]] = dx.sum(axis=0)
        return g, dx, logp


def window_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window of a text of n tokens, first place in it that is scored)."""
    starts = np.arange(0, max(1, n - WIDTH + STRIDE), STRIDE)
    return starts, np.where(starts == 0, 0, WIDTH - STRIDE)


def score_tokens(model: Model, flat: np.ndarray, sizes: np.ndarray, vec: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 P(class of its first subword | tokens before) of each token; flat: texts one after the other as word numbers, the end's included."""
    ends = sizes.cumsum()
    base = ends - sizes
    # the input of a token is the one before it; start is the last row of vec
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[base[sizes > 0]] = len(vec) - 1
    windows = 1 + np.maximum(0, -(-(sizes - WIDTH) // STRIDE))
    of = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(of)) - np.repeat(windows.cumsum() - windows, windows)
    lo, hi = base[of] + place * STRIDE, ends[of]
    out = np.zeros(len(flat))
    places = np.arange(WIDTH)
    target = cls[flat]
    for skip, some in ((0, place == 0), (WIDTH - STRIDE, place > 0)):  # the first window of a text is scored whole
        first, last = lo[some, None], hi[some, None]
        for n in range(0, len(first), 256):
            start = first[n : n + 256]
            at = start + places
            inside = at < last[n : n + 256]
            h = model.forward(vec.take(before.take(np.where(inside, at, start)), axis=0), skip=skip)
            use = np.flatnonzero(inside[:, skip:])
            logits = model.logits(h.reshape(-1, DIM).take(use, axis=0))
            scored = at[:, skip:].ravel().take(use)
            got = logits[np.arange(len(scored)), target.take(scored)]
            np.exp(logits, out=logits)
            out[scored] = (got - np.log(logits @ np.ones(logits.shape[1], logits.dtype))) / np.log(10)
    return out


def classes(size: int, first: np.ndarray, later: np.ndarray, profile: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Classes of subwords as first and as later ones, from counts of the corpus: the most frequent alone, the rest by the company they keep, and by frequency."""
    top = np.argsort(-first[:size], kind="stable")[:OWN]
    fc = np.full(size + 3, -1)
    fc[top] = np.arange(OWN)
    fc[size] = OWN
    total = profile.sum(axis=1, keepdims=True)
    seen = np.nonzero(total[:, 0] > 0)[0]
    unit = profile[seen] / total[seen]
    if len(seen):
        unit = unit - profile.sum(axis=0) / profile.sum()
    unit = unit / np.maximum(1e-9, np.linalg.norm(unit, axis=1, keepdims=True))
    rng = np.random.default_rng(3)
    centre = unit[rng.choice(len(seen), COMPANY)] if len(seen) else np.zeros((COMPANY, SKETCH))
    near = np.zeros(len(seen), int)
    for _ in range(12):
        near = (unit @ centre.T).argmax(axis=1) if len(seen) else near
        for c in range(COMPANY):
            if (near == c).any():
                m = unit[near == c].sum(axis=0)
                centre[c] = m / max(1e-9, np.linalg.norm(m))
    group = np.zeros(size + 3, int)
    group[seen] = near

    def binned(count, taken, base):
        cls = np.where(taken >= 0, taken, 0)
        for c in range(COMPANY):
            own = np.nonzero((group == c) & (taken < 0))[0]
            own = own[np.argsort(-count[own], kind="stable")]
            mass = count[own].cumsum()
            cls[own] = base + c * BINS + np.minimum(BINS - 1, (mass / max(1.0, mass[-1] if len(mass) else 1.0) * BINS).astype(int))
        return cls

    top = np.argsort(-later[:size], kind="stable")[:OWN_LATER]
    lc = np.full(size + 3, -1)
    lc[top] = np.arange(OWN_LATER)
    lc[size + 2] = OWN_LATER
    rest = 1 + COMPANY * BINS
    return binned(first, fc, OWN + 1), binned(later, lc, OWN_LATER + 1), OWN + rest, OWN_LATER + rest


def train(size: int, texts: list[list[tuple[int, ...]]]) -> Model:
    """Fits classes and attention on texts given as words of subword ids."""
    names = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    flat = np.array([i for t in texts for i in (*map(names.__getitem__, t), len(names))], np.int64)
    lens = np.array([*map(len, names), 1])
    ids, starts = np.array([x for w in names for x in w], np.int64), lens[:-1].cumsum() - lens[:-1]
    sizes = np.array([len(t) + 1 for t in texts])
    first, later, profile = np.zeros(size + 3), np.zeros(size + 3), np.zeros((size + 3, SKETCH))
    tally(size, flat, sizes, ids, starts, first, later, profile)
    model = Model(size, *classes(size, first, later, profile))
    Learner(model, BATCH, np.ones(model.n_first)).passes(flat, sizes, ids, starts)
    return model


def tally(size, flat, sizes, ids, starts, first, later, profile) -> None:
    """Adds the subwords of texts to first, later and profile. flat, sizes: texts as word numbers, the end (len(starts)) included; ids, starts: subwords of the words."""
    times = np.bincount(flat, minlength=len(starts) + 1)
    first[size] += times[-1]
    if not len(starts):
        return
    lens = np.diff(np.append(starts, len(ids)))
    is_first = np.zeros(len(ids), bool)
    is_first[starts] = True
    c = np.repeat(times[:-1], lens).astype(float)
    first += np.bincount(ids[is_first], weights=c[is_first], minlength=len(first))
    later += np.bincount(ids[~is_first], weights=c[~is_first], minlength=len(later))
    # the company of a subword: for each of its places, the shares of SKETCH groups of first subwords in the text
    text = np.repeat(np.arange(len(sizes)), sizes)
    group = np.append(ids[starts] % SKETCH, SKETCH)[flat]
    mark = np.bincount(text * (SKETCH + 1) + group, minlength=len(sizes) * (SKETCH + 1)).reshape(-1, SKETCH + 1)[:, :SKETCH]
    mark = mark / np.maximum(1, mark.sum(axis=1, keepdims=True))
    for i in range(SKETCH):
        word = np.bincount(flat, weights=np.repeat(mark[:, i], sizes), minlength=len(starts) + 1)[:-1]
        profile[:, i] += np.bincount(ids, weights=np.repeat(word, lens), minlength=len(profile))


def _gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places starts, starts + 1, ..., as many as lens says, of each run."""
    return np.repeat(starts - (lens.cumsum() - lens), lens) + np.arange(int(lens.sum()))


def _summed(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of x for each value of of, from 0 to n - 1."""
    return np.stack([np.bincount(of, weights=w, minlength=n) for w in np.ascontiguousarray(x.T, np.float64)], axis=1).astype(np.float32)


class Learner:
    """Trains a model by gradient descent (Adam, of emb only the rows in use), and keeps how it scored windows that it hadn't learnt from."""

    def __init__(self, model: Model, batch: int, shares: np.ndarray):
        self.model, self.batch, self.log_share = model, batch, np.log(shares)
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.rng = np.random.default_rng(11)
        self.step = self.tokens = 0
        self.used = np.zeros(model.size + 3)  # how often each row of emb was trained
        self.ratios = np.zeros(RATIOS)

    def passes(self, flat, sizes, ids, starts) -> None:
        """Passes over few texts, the rate falling to zero in the second half."""
        steps = int((-(-sizes // WIDTH)).sum()) // self.batch + 1 if len(sizes) else 0
        n = max(PASSES, -(-STEPS // steps)) if steps else 0
        for i in range(n):
            self.learn(flat, sizes, ids, starts, lambda step: RATE * min(1.0, 2 * (1 - step / (n * steps + 1))), i == 0)

    def learn(self, flat, sizes, ids, starts, rate, fresh: bool = True) -> None:
        """One pass over all windows of texts, in any order. flat, sizes: texts as word numbers, the end (len(starts)) included; ids, starts: subwords of the words; fresh: not learnt from before."""
        model, end = self.model, len(starts)
        lens = np.append(np.diff(np.append(starts, len(ids))), [1, 1])
        starts = np.append(starts, [len(ids), len(ids) + 1])
        ids = np.append(ids, [model.size, model.size + 1])
        cls = model.first_class[ids[starts]]
        seen = np.zeros(model.size + 3, bool)
        seen[ids] = True
        held = np.nonzero(seen)[0]  # the subwords of these texts, and the number of each
        number = (seen.cumsum() - 1)[ids]
        ends = sizes.cumsum()
        before = np.append(end + 1, flat[:-1])
        before[ends - sizes] = end + 1
        windows = -(-sizes // WIDTH)
        of = np.repeat(np.arange(len(sizes)), windows)
        lo = (ends - sizes)[of] + (np.arange(len(of)) - np.repeat(windows.cumsum() - windows, windows)) * WIDTH
        order = self.rng.permutation(len(lo))
        lo, hi, places = lo[order], ends[of[order]], np.arange(WIDTH)
        for n in range(0, len(lo), self.batch):
            at = lo[n : n + self.batch, None] + places
            use = at < hi[n : n + self.batch, None]
            at = np.where(use, at, lo[n : n + self.batch, None])
            words, inverse = np.unique(before.take(at), return_inverse=True)
            begin, length = starts.take(words), lens.take(words)
            place = _gather(begin, length)
            size = length[:, None].astype(np.float32)
            vec = model.p["emb"].take(ids.take(begin), axis=0)
            late, i = np.flatnonzero(length > 1), 1
            while len(late):  # the second subwords of all words, the third, ...
                vec[late] += model.p["emb"].take(ids.take(begin.take(late) + i), axis=0)
                i += 1
                late = late[length.take(late) > i]
            vec /= size
            target = cls.take(flat.take(at))
            inverse = inverse.reshape(at.shape)
            g, dx, logp = model.learnt(vec.take(inverse, axis=0), target, use)
            if fresh:
                ratio = (logp - self.log_share[target[use]]) * 100 + RATIOS / 2
                self.ratios += np.bincount(np.clip(ratio, 0, RATIOS - 1).astype(np.int64), minlength=RATIOS)
            dvec = _summed(inverse.ravel(), dx.reshape(-1, DIM), len(words)) / size
            own = number.take(place)
            now_held = np.bincount(own, minlength=len(held)) > 0
            rows = held[now_held]
            demb = _summed((now_held.cumsum() - 1).take(own), np.repeat(dvec, length, axis=0), len(rows))
            self.used[rows] += 1
            self.tokens += int(use.sum())
            self.step += 1
            now = rate(self.step)
            for name, d in g.items():
                self._move(name, slice(None), d, now)
            self._move("emb", rows, demb, now)

    def _move(self, name: str, at, g: np.ndarray, rate: float) -> None:
        m = self.m[name][at] * np.float32(0.9) + np.float32(0.1) * g
        v = self.v[name][at] * np.float32(0.99) + np.float32(0.01) * g**2
        self.m[name][at], self.v[name][at] = m, v
        n = min(self.step, 2000)
        self.model.p[name][at] -= (rate / (1 - 0.9**n)) * m / (np.sqrt(v / np.float32(1 - 0.99**n)) + np.float32(1e-6))


#: Arrays that are summed over tasks: their number, the piece of them, its values packed.
SUMS = "name int, piece int, value binary"


def _sums(arrays: dict[int, np.ndarray]):
    """Rows (name, piece, values) of arrays, in pieces of PIECE rows; pieces that are all zero are left out."""
    for name, x in arrays.items():
        for n in range(0, len(x), PIECE):
            part = x[n : n + PIECE]
            if part.any():
                yield name, n // PIECE, _packed(part)


def _packed(x: np.ndarray) -> bytes:
    return np.array([x.nbytes, x.itemsize], np.int64).tobytes() + pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _values(data: bytes) -> np.ndarray:
    n, item = np.frombuffer(data[:16], np.int64).tolist()
    return np.frombuffer(pa.decompress(data[16:], decompressed_size=n, codec="zstd", asbytes=True), np.float32 if item == 4 else np.float64)


def _batch(rows) -> pa.RecordBatch:
    name, piece, value = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(piece, pa.int32()), pa.array(value, pa.binary())], names=["name", "piece", "value"])


def _total(rows: DataFrame, shapes: dict[int, tuple]) -> dict[int, np.ndarray]:
    """The arrays of rows (SUMS), summed over tasks; of so many and such shapes, whatever the input."""

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([_values(v.as_py()) for v in part.column("value")], axis=0, dtype=np.float64)
        return pa.Table.from_batches([_batch([(part.column("name")[0].as_py(), part.column("piece")[0].as_py(), _packed(total))])])

    out = {name: np.zeros(shape) for name, shape in shapes.items()}
    for r in rows.groupBy("name", "piece").applyInArrow(add, SUMS).collect():
        x = out[r.name][r.piece * PIECE : (r.piece + 1) * PIECE]
        x[:] = _values(bytes(r.value)).reshape(x.shape)
    return out


def _starts(block: int, n: int, every: int) -> np.ndarray:
    """Which of the n texts of a block are of the first shard: one in every."""
    key = np.full(n, block, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64)
    return _mixed(key) % np.uint64(every) == 0


def fit(marked: DataFrame, model: Model, vocab: str, tokens: int, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trains model on every training text of marked (block, docs); gives how its classes follow each other, and how it scored texts before it learnt from them.

    tokens: how many there are; shares: of the classes among them.
    """
    spark = marked.sparkSession
    every = max(1, tokens // START_TOKENS)
    names = sorted(model.p)
    ratios, pairs = len(names), len(names) + 1
    shapes = {n: model.p[name].shape for n, name in enumerate(names)} | {ratios: (RATIOS,), pairs: (model.n_first + model.n_later, model.n_later)}

    def blocks(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Block(data.as_py(), scoring=False)
                yield own, _starts(block, len(own.train), every)

    def chosen(batches):
        for own, starts in blocks(batches):
            words, ends = own.words, own.words.sizes.cumsum()
            texts = [b" ".join([words.names[j] for j in words.flat[ends[i] - words.sizes[i] : ends[i] - 1].tolist()]) for i in np.nonzero(starts & own.train)[0].tolist()]
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])

    def begin(batches):
        texts = [b.column(0) for b in batches if len(b)]
        if texts:
            m = shared.value.copy()
            words = Words(pa.concat_arrays(texts))
            learner = Learner(m, BATCH, shares)
            learner.passes(words.flat, words.sizes, *subwords(vocab)(words.names))
            yield _batch(list(_sums({n: m.p[name] for n, name in enumerate(names)} | {ratios: learner.ratios})))
        release()

    def go_on(batches):
        m = shared.value.copy()
        learner = Learner(m, ALL_BATCH, shares)
        pair = np.zeros(shapes[pairs])
        for own, starts in blocks(batches):
            words, ids = own.words, own.ids
            if len(ids):
                is_first = np.zeros(len(ids), bool)
                is_first[own.starts] = True
                cell = m.states(ids, is_first) * m.n_later + m.nexts(ids, is_first)
                times = np.bincount(words.flat[own.trains], minlength=len(own.starts) + 1)[:-1]
                pair += np.bincount(cell, weights=np.repeat(times, np.diff(np.append(own.starts, len(ids)))), minlength=pair.size).reshape(pair.shape)
            other = own.train & ~starts
            if other.any():
                learner.learn(words.flat[np.repeat(other, words.sizes)], words.sizes[other], ids, own.starts, lambda step: ALL_RATE / (1 + max(0, step - FALL) / FALL) ** 0.5)
        old = shared.value.p
        change = {n: (m.p[name] - old[name]) * np.float64(learner.tokens) for n, name in enumerate(names) if name != "emb"}
        emb = np.concatenate([(m.p["emb"] - old["emb"]) * learner.used[:, None], learner.used[:, None]], axis=1).astype(np.float32)
        yield _batch([*_sums(change | {names.index("emb"): emb, ratios: learner.ratios, pairs: pair}), (pairs + 1, 0, _packed(np.array([float(learner.tokens)])))])
        release()

    shared = spark.sparkContext.broadcast(model)
    first = _total(marked.mapInArrow(chosen, "text binary").repartition(1).mapInArrow(begin, SUMS), shapes)
    if first[ratios].any():
        model.p = {name: first[n].astype(np.float32) for n, name in enumerate(names)}
    shared = spark.sparkContext.broadcast(model)
    rest = _total(marked.mapInArrow(go_on, SUMS), shapes | {names.index("emb"): (model.size + 3, DIM + 1), pairs + 1: (1,)})
    for n, name in enumerate(names):
        if name == "emb":
            model.p[name] += (rest[n][:, :DIM] / np.maximum(1, rest[n][:, DIM:])).astype(np.float32)
        elif rest[pairs + 1][0] >= 1:
            model.p[name] += (rest[n] / rest[pairs + 1][0]).astype(np.float32)
    return rest[pairs], first[ratios] + rest[ratios]


def _hash(words) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words)).view(np.int64)


_LOWER = bytes(range(256)).lower()
_SPACE = bytes([*range(9, 14), 32])
_REAL = bytes(i not in _SPACE for i in range(256))


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word, words of each text) of texts (binary): A-Z in lower case, cut at ASCII white space."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    data = data.tobytes()
    real = np.frombuffer(data.translate(_REAL), bool)
    begins = real.copy()
    begins[1:] &= ~real[:-1]
    opens = ends[:-1][ends[:-1] < len(data)]
    begins[opens] = real[opens]
    at = np.nonzero(begins)[0]
    counts = np.diff(np.searchsorted(at, ends))
    kept = np.frombuffer(data.translate(_LOWER, _SPACE), np.uint8)
    offsets = np.append(np.nonzero(begins[real])[0], len(kept))
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


class Words:
    """Texts as numbers of words: names are the distinct words, flat has all texts one after the other, each with its end (number len(names)); sizes counts ends."""

    def __init__(self, texts: list[list[bytes]] | pa.Array):
        self.names, numbers, counts = split(texts if isinstance(texts, pa.Array) else pa.array(map(b" ".join, texts), pa.binary()))
        self.sizes = counts.astype(np.int64) + 1
        self.flat = np.full(int(self.sizes.sum()), len(self.names), np.int64)
        inside = np.ones(len(self.flat), bool)
        inside[self.sizes.cumsum() - 1] = False
        self.flat[inside] = numbers
        self.hashes = np.append(_hash(self.names), np.int64(END_HASH))


class Block:
    """Texts of a block, split into words and subwords once: doc_id and train of each, words, and ids and starts, the subwords of the words' names."""

    @staticmethod
    def pack(doc_id: pa.Array, train: pa.Array, texts: pa.Array, sub: Subwords) -> bytes:
        words = Words(texts)
        ids, starts = sub(words.names)
        lists = {"doc_id": doc_id, "train": train, "names": np.frombuffer(b" ".join(words.names), np.uint8)}
        lists |= {"sizes": _small(words.sizes), "low": (words.flat & 0xFFFF).astype(np.uint16), "high": _small(words.flat >> 16), "ids": _small(ids), "lens": _small(np.diff(np.append(starts, len(ids))))}
        lists = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in lists.items()}
        batch = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays([0, len(v)], v) for v in lists.values()], names=list(lists))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def __init__(self, data: bytes, scoring: bool = True):
        batch = pa.ipc.open_stream(data).read_next_batch()
        get = lambda name: batch.column(name).values.to_numpy(zero_copy_only=False)
        self.doc_id, self.train = batch.column("doc_id").values, get("train").astype(bool)
        self.words = words = Words.__new__(Words)
        words.sizes, words.flat = get("sizes").astype(np.int64), get("low") + (get("high").astype(np.int64) << 16)
        words.names = get("names").tobytes().split()
        words.hashes = np.append(_hash(words.names), np.int64(END_HASH)) if scoring else None
        lens = get("lens").astype(np.int64)
        self.ids, self.starts = get("ids").astype(np.int64), lens.cumsum() - lens
        self.trains = np.repeat(self.train, words.sizes)  # of each place in flat


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in flat, end of the span, key of the context, key of the context and its span) of each anchor, in order."""
    by = np.uint64(0x9E3779B97F4A7C15)
    h = words.hashes.view(np.uint64)[words.flat]
    ends = words.sizes.cumsum()
    key = np.zeros(max(0, len(h) - CONTEXT), np.uint64)
    for i in range(CONTEXT):
        key = key * by + h[i : i + len(key)]
    key = _mixed(key)
    at = np.nonzero(key % np.uint64(EVERY) == 0)[0] + CONTEXT
    text = np.searchsorted(ends, at, side="right")
    inside = at - (ends - words.sizes)[text] >= CONTEXT
    at, text = at[inside], text[inside]
    context = key[at - CONTEXT]
    stop = np.minimum(at + SPAN, ends[text])
    span = context.copy()
    for i in range(SPAN):
        span = span * by + np.where(at + i < stop, h[np.minimum(at + i, len(h) - 1)], np.uint64(0))
    return text, at, stop, context.view(np.int64), _mixed(span).view(np.int64)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often each occurs where train is true)."""
    names, of = np.unique(keys, return_inverse=True)
    return names, np.bincount(of, weights=train, minlength=len(names)).astype(np.int64)


def elsewhere(keys: np.ndarray, text: np.ndarray, train: np.ndarray, names: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often each key occurs in training texts other than its own; names: the distinct keys, sorted; total: how often each occurs in all training texts."""
    order = np.lexsort((keys, text))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1])
    group = new.cumsum() - 1
    mine = np.empty(len(keys), np.int64)
    mine[order] = np.bincount(group, minlength=1)[group] if len(keys) else 0
    return total[np.searchsorted(names, keys)] - mine * train[text]


def dealt(keys: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(the places of all keys, one list after the other, by bucket and in order within it; how many keys of each list are in each bucket)."""
    of = (np.concatenate(keys).view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)  # not by the last bits: those of anchors aren't free
    of = of.astype(np.min_scalar_type(buckets))
    kind = np.repeat(np.arange(len(keys)), [*map(len, keys)])
    sizes = np.bincount(of.astype(np.int64) * len(keys) + kind, minlength=buckets * len(keys))
    return np.argsort(of, kind="stable"), sizes.reshape(buckets, len(keys))


def requests(keys: list[np.ndarray], counts: list[np.ndarray], buckets: int):
    """(bucket, its requests) of a block, for each bucket that has any: how many keys of each list, the bytes of a count, the keys, the counts."""
    order, sizes = dealt(keys, buckets)
    h, n = np.concatenate(keys)[order], _small(np.concatenate(counts)[order])
    ends = sizes.sum(axis=1).cumsum().tolist()
    for bucket, (lo, hi) in enumerate(itertools.pairwise([0, *ends])):
        if lo < hi:
            yield bucket, np.array([*sizes[bucket], n.itemsize], np.int64).tobytes() + h[lo:hi].tobytes() + n[lo:hi].tobytes()


def replies(asked: list[bytes]) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Counts of a bucket. For the requests of each block: the total of each key in all of them; then for each list of keys: (all counts, keys that are counted, keys that are counted once)."""
    heads = [np.frombuffer(x, np.int64, KINDS + 1).tolist() for x in asked]
    sizes = [sum(x[:KINDS]) for x in heads]
    at = 8 * (KINDS + 1)
    h = [np.frombuffer(x, np.int64, n, at) for x, n in zip(asked, sizes, strict=True)]
    c = [np.frombuffer(x, f"u{head[KINDS]}", n, at + 8 * n) for x, n, head in zip(asked, sizes, heads, strict=True)]
    out, sums = [np.empty(n, np.int64) for n in sizes], []
    done = [0] * len(asked)
    for kind in range(KINDS):
        parts = [slice(a, a + x[kind]) for a, x in zip(done, heads, strict=True)]
        key, n = (np.concatenate([x[p] for x, p in zip(y, parts, strict=True)]) for y in (h, c))
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begins = np.nonzero(new)[0]
        total = np.add.reduceat(n[order].astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
        sums.append((int(total.sum()), int((total > 0).sum()), int((total == 1).sum())))
        each = np.empty(len(key), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(begins, len(key))))
        done = [p.stop for p in parts]
        for x, p, own in zip(out, parts, np.split(each, np.cumsum([p.stop - p.start for p in parts])[:-1]), strict=True):
            x[p] = own
    return [bytes([(x := _small(y)).itemsize]) + x.tobytes() for y in out], sums


def answered(keys: list[np.ndarray], buckets: int, answers: list[bytes]) -> list[np.ndarray]:
    """The total of each key of each list, from the answers of the buckets that were asked, in their order."""
    order, _ = dealt(keys, buckets)
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, f"u{x[0]}", offset=1) for x in answers)])
    return np.split(out, np.cumsum([*map(len, keys)])[:-1])


def remembered(texts: int, text, at, stop, context: np.ndarray, span: np.ndarray, fresh: float, log_p: np.ndarray) -> np.ndarray:
    """What memory adds to the log10 score of each text. context, span: counts elsewhere; log_p: of each token without memory. Spans don't overlap: the earlier anchor goes first."""
    out = np.zeros(texts)
    total = np.concatenate([[0.0], log_p.cumsum()])
    last = 0
    for i in np.nonzero(context > 0)[0].tolist():
        if at[i] >= last:
            last = stop[i]
            plain = total[stop[i]] - total[at[i]]
            copy = (1 - fresh) * span[i] / context[i]
            out[text[i]] += np.logaddexp(np.log(copy) if copy else -np.inf, np.log(fresh) + plain * np.log(10)) / np.log(10) - plain
    return out


def score(docs: DataFrame, vocab: str, training, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each text; training: a boolean column, true where a text is learnt from.

    A null text counts as empty: one token, its end. n_known counts tokens that training texts have; base_score is the sum of log10((c + 1) /
    (N + V + 1)); score the model's log10 probability. Rows that repeat are texts of their own, copies of each other. Without any training
    text all words are unknown and the model is the untrained one. Other columns of docs don't come along.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"), data.alias("text"))

    def numbered(batches):
        """The rows by blocks of CHUNK bytes: the number of the block, of the task and within it, and its rows packed."""
        part, held, block, own, sub = TaskContext.get().partitionId(), 0, 0, [], subwords(vocab)

        def made():
            docs = Block.pack(*(pa.concat_arrays([b.column(i) for b in own]) for i in range(3)), sub)
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | block], pa.int64()), pa.array([docs], pa.binary())], names=["block", "docs"])

        for b in batches:
            sizes = pa.compute.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > CHUNK:
                    own.append(b.slice(lo, i - lo))
                    yield made()
                    held, lo, block, own = 0, i, block + 1, []
                held += n + 16
            own.append(b.slice(lo))
        if held:
            yield made()
        release()

    marked = Written(rows.mapInArrow(numbered, "block long, docs binary"), "lm-texts", compression="none").df
    size = subwords(vocab).size

    blocks = marked.count()
    buckets = blocks // BLOCKS + 1

    def count(batches):
        """Rows (name, piece, block, value): what each block asks of each bucket (name 0, piece: the bucket); and the counts of subwords and of the company they keep (names 1 to 3)."""
        first, later, profile = np.zeros(size + 3), np.zeros(size + 3), np.zeros((size + 3, SKETCH))

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["name", "piece", "block", "value"])

        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Block(data.as_py())
                words, is_train = own.words, own.train
                times = np.bincount(words.flat, weights=own.trains, minlength=len(words.names) + 1).astype(np.int64)
                tally(size, words.flat[own.trains], words.sizes[is_train], own.ids, own.starts, first, later, profile)
                of, _, _, context, span = anchors(words)
                keys, counts = zip((words.hashes[:-1], times[:-1]), counted(context, is_train[of]), counted(span, is_train[of]), strict=True)
                rows = [(0, bucket, block, x) for bucket, x in requests(keys, counts, buckets)]
                if rows:
                    yield made(rows)
        rows = [(name, piece, -1, value) for name, piece, value in _sums({1: first, 2: later, 3: profile.astype(np.float32)})]
        if rows:
            yield made(rows)
        release()

    def reply(part: pa.Table) -> pa.Table:
        """The answers of a bucket, and its totals by list of keys (names 4 to 6); what isn't a request stays as it is."""
        names, totals = part.column("name").to_pylist(), [(None,) * 3] * len(part)
        pieces, of, values = (part.column(x).to_pylist() for x in ("piece", "block", "value"))
        if not names[0]:
            values, sums = replies(values)
            names, pieces, of, values, totals = names + [4, 5, 6], pieces + pieces[:1] * KINDS, of + [-1] * KINDS, values + [None] * KINDS, totals + sums
        out = (names, pieces, of, values, *zip(*totals, strict=True))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({k: pa.array(x, t) for k, x, t in zip(("name", "piece", "block", "value", "n", "v", "once"), out, types, strict=True)})

    # one pass asks, and the buckets answer; more partitions than buckets, as these are dealt out by hash
    asked = marked.mapInArrow(count, "name int, piece int, block long, value binary").repartition(min(PARTITIONS, 2 * buckets + 1), "name", "piece")
    each = asked.groupBy("name", "piece").applyInArrow(reply, "name int, piece int, block long, value binary, n long, v long, once long")
    table = Written(each, "lm-counts", compression="zstd").df
    # subwords and their company: at most the vocabulary
    sums = table.where("name between 1 and 3").select("name", "piece", "value")
    first, later, profile = _total(sums, {1: (size + 3,), 2: (size + 3,), 3: (size + 3, SKETCH)}).values()
    model = Model(size, *classes(size, first, later, profile))
    in_class = np.bincount(model.first_class, weights=first, minlength=model.n_first)
    n_train = int(first[model.size])
    pairs, ratios = fit(marked, model, vocab, int(first.sum()), _class_share(in_class))
    model.tables(first, later, pairs)
    zero = {"n": 0, "v": 0, "once": 0}
    totals = {r.name: r.asDict() for r in table.where("name > 3").groupBy("name").agg(*(F.sum(x).alias(x) for x in zero)).collect()}
    word, context, span = (totals.get(k, zero) for k in (4, 5, 6))
    n_all, v_all = word["n"] + n_train, word["v"] + (n_train > 0)
    mix = min(0.98, max(0.02, 1 - word["once"] / n_all)) if n_all else 0.0
    # of anchors whose context occurs again, those whose span doesn't
    fresh = (span["once"] - context["once"] + 1) / (context["n"] - context["once"] + 2)
    share = _share(model, ratios)
    ready = spark.sparkContext.broadcast((model, n_train, n_all, v_all, mix, fresh, share, in_class))
    answers = table.where("name = 0").select("block", "piece", "value")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        m, n_train, n_all, v_all, mix, fresh, share, in_class = ready.value
        own = Block(left.column("docs")[0].as_py())
        train, words, flat, starts = own.train, own.words, own.ids, own.starts
        of, at, stop, context, span = anchors(words)
        keys = [words.hashes[:-1], np.unique(context), np.unique(span)]
        replied = [right.column("value")[i].as_py() for i in np.argsort(right.column("piece").to_numpy()).tolist()]
        word_total, context_total, span_total = answered(keys, buckets, replied)
        times = np.append(word_total, n_train)
        vec = np.concatenate([m.vectors(flat, starts), m.p["emb"][m.size : m.size + 2]])  # then the end, then the start
        cls, chain = m.chains(flat, starts)
        cls, chain = np.append(cls, m.first_class[m.size]), np.append(chain, m.log_first[m.size])
        base = np.log10((times + 1) / (n_all + v_all + 1))
        inner = np.log10(mix * times / np.maximum(1, in_class[cls]) + (1 - mix) * 10 ** np.maximum(chain, -300))
        log_p = np.log10(share * 10 ** score_tokens(m, words.flat, words.sizes, vec, cls) + (1 - share) * _class_share(in_class)[cls[words.flat]]) + inner[words.flat]
        extra = remembered(len(train), of, at, stop, elsewhere(context, of, train, keys[1], context_total), elsewhere(span, of, train, keys[2], span_total), fresh, log_p)
        text = np.repeat(np.arange(len(train)), words.sizes)

        def per_text(x):
            return np.bincount(text, weights=x, minlength=len(train))

        out = {"n_tokens": words.sizes, "n_known": per_text(times[words.flat] > 0).astype(np.int64), "train_tokens": np.full(len(train), n_all, np.int64), "base_score": per_text(base[words.flat]), "score": per_text(log_p) + extra}
        release()
        return pa.table({"doc_id": own.doc_id, "held_out": pa.array(~train)} | {k: pa.array(v) for k, v in out.items()})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # more partitions than blocks, as these are dealt out by hash, up to a fixed number; the blocks of a partition are scored one after the other
    n = min(PARTITIONS, 2 * blocks + 1)
    marked, answers = marked.repartition(n, "block"), answers.repartition(n, "block")
    return marked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def _class_share(in_class: np.ndarray) -> np.ndarray:
    """The share of each class among the training tokens, none of them zero."""
    c = in_class + 0.5
    return c / c.sum()


def _share(model: Model, ratios: np.ndarray) -> float:
    """The weight of attention against the shares of the classes that explains all training texts best, by expectation maximisation. ratios: tokens by ln of what each gave to their class, in bins."""
    if not ratios.any():
        return 0.5
    ratio = np.exp((np.arange(RATIOS) + 0.5 - RATIOS / 2) / 100)
    share = 0.5
    for _ in range(50):
        share = float((ratios * share * ratio / (share * ratio + 1 - share)).sum() / ratios.sum())
    return min(0.98, max(0.02, share))
