"""Language-model scoring: causal self-attention over subword ids, trained in numpy, beside a smoothed unigram base.

Words are the runs of bytes between white space, A-Z lower-cased; a text is its words and one end. The base counts words:
over all learning rows, each task sums its own words before they are shuffled. Words of the highest counts, at most
``TOP_WORDS``, are broadcast; the other words of each text are looked up by a join.

The model reads the words, each with a space before it, as subword ids of a given byte-level vocabulary. It predicts the next
id in two softmax layers, its class and its slot in the class. The frequent ids have a slot each, in classes of ids that
follow alike contexts; the other ids share the slots of a last class by count and by whether they begin a word, and their
counts over all learning rows, each at least one, tell them apart. So the model is a distribution over all texts.

Training has two parts. A start is made on a bounded sample on the driver; then every task takes the windows of all its
learning rows from there, once, and the tasks' weights are averaged by their numbers of windows, in fixed point, so that reruns
agree. The words, ids, windows and weights that go into the model grow with the corpus.

A text is scored in windows of ``WINDOW`` ids that overlap by ``CONTEXT``: each id is scored once, and all but the
first ``CONTEXT`` of a text see at least ``CONTEXT`` ids before them.

Defined results: null text is empty: its one token is the end; a null id is not held out and not learned from; repeated
rows count each; without a learning row every count is 0 and V and N are 0; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, fold, materialize, raw_texts

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 1 << 20
#: Words whose counts are broadcast, at most (about 30 bytes each); and a task's words before it hands on their counts.
TOP_WORDS, TASK_WORDS = 200_000, 600_000
#: Words whose ids a worker remembers; beyond, it forgets all of them.
REMEMBERED = 400_000
VOCABULARY = 50_257
END, BEGIN = 50_256, -1

#: Ids with a symbol of their own (the others are hashed), classes of theirs and slots of a class, sizes of the network.
OWN_SYMBOLS, HASHED_SYMBOLS = 1024, 256
CLASSES, SLOTS = 33, 32
WIDTH, HIDDEN = 32, 32
WINDOW, CONTEXT = 32, 8
#: Learning rows of the start and bytes of their text, at most; its steps and passes over these rows, at most; windows a step.
SAMPLE, SAMPLE_BYTES, STEPS, PASSES, BATCH, RATE = 2000, 64 << 20, 4000, 7, 64, 1e-2
#: Windows a step, and rate, of the pass over all learning rows.
TASK_BATCH, TASK_RATE = 256, 1e-3
FIXED = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODERS: dict = {}
_BEGINS: dict = {}


def encoder(path: str | None = None):
    path = path or default_path()
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = (tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks)
    return _ENCODERS[path][0]


def begins_word(path: str | None = None) -> np.ndarray:
    """Of each id, whether it starts with the space that precedes a word."""
    path = path or default_path()
    if path not in _BEGINS:
        encoder(path)
        out = np.zeros(VOCABULARY, bool)
        for token, i in _ENCODERS[path][1].items():
            out[i] = token[:1] == b" "
        _BEGINS[path] = out
    return _BEGINS[path]


#: White space of other kinds than a plain space: the pattern that cuts texts before the merges would join neighbours there.
_OTHER_SPACE = re.compile(r"[^\S ]")


def spelled_words(path: str | None, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, each with a space before it; how many each has). No word's ids depend on its neighbours."""
    text = (b" " + b" ".join(words)).decode("utf-8", "replace")
    enc = encoder(path)
    if not _OTHER_SPACE.search(text):
        # All together is faster; the ids that begin with a space part the words again, as no id has one inside here.
        ids = np.asarray(enc.encode_ordinary(text), np.int32)
        each = np.diff(np.append(np.flatnonzero(begins_word(path)[ids]), len(ids)))
        if len(each) == len(words):
            return ids, each
    made = [enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
    return np.fromiter(chain.from_iterable(made), np.int32), np.fromiter(map(len, made), np.int64, len(made))


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``values`` written from ``at`` on, into a larger copy where there is no room."""
    if at + len(values) > len(array):
        array = np.concatenate([array, np.zeros(at + 2 * len(values), array.dtype)])
    array[at : at + len(values)] = values
    return array


class Lexicon:
    """Numbers of words and their subword ids. A word's ids do not depend on its neighbours, so they are made once.

    The words it starts with keep their numbers; the others are forgotten when there are ``REMEMBERED`` of them.
    """

    def __init__(self, path: str | None, first: list[bytes] = ()):
        self.path = path
        self.first = len(first)
        self.number: dict[bytes, int] = {}
        self.names: list[bytes] = []
        # Arrays with room to grow: the ids of word k are ids[begin[k]:begin[k + 1]].
        self.ids, self.begin, self.n_ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0
        self.add(list(first))

    def add(self, words: list[bytes]) -> None:
        if not words:
            return
        ids, each = spelled_words(self.path, words)
        n = len(self.names)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        self.names += words
        self.begin = _put(self.begin, n, np.concatenate([[0], np.cumsum(each)]) + self.n_ids)
        self.ids = _put(self.ids, self.n_ids, ids)
        self.n_ids += len(ids)

    def forget(self) -> None:
        for w in self.names[self.first :]:
            del self.number[w]
        del self.names[self.first :]
        self.n_ids = int(self.begin[self.first])

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, words of each text)."""
        flat = list(chain.from_iterable(texts))
        found = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys(flat[k] for k in missing))
            if len(self.names) - self.first + len(new) > REMEMBERED:
                self.forget()
                return self._fresh(flat), np.fromiter(map(len, texts), np.int64, len(texts))
            self.add(new)
            found[missing] = [self.number[flat[k]] for k in missing]
        return found, np.fromiter(map(len, texts), np.int64, len(texts))

    def _fresh(self, flat: list[bytes]) -> np.ndarray:
        self.add([w for w in dict.fromkeys(flat) if w not in self.number])
        return np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))

    def spelled(self, numbers: np.ndarray, per_text: np.ndarray) -> list[np.ndarray]:
        """The ids of each text's words and one end."""
        size = self.begin[numbers + 1] - self.begin[numbers]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = total[np.cumsum(per_text)]
        text = np.repeat(np.arange(len(per_text)), np.diff(np.concatenate([[0], ends])))
        out = np.full(total[-1] + len(per_text), END, np.int32)
        at = np.arange(total[-1])
        out[at + text] = self.ids[np.repeat(self.begin[numbers] - total[:-1], size) + at]
        return np.split(out, (ends + np.arange(1, len(per_text) + 1))[:-1])

    def __call__(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        return self.spelled(*self.numbers(texts))


_LEXICONS: dict = {}


def lexicon(path: str | None, first: list[bytes], name) -> Lexicon:
    """The worker's lexicon, kept between tasks."""
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(path, first)
    return _LEXICONS[name]


class Coding:
    """Symbols, classes, slots and log probabilities in shared slots, from the counts of ids over the learning rows and a sample's pairs of ids."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, sample: list[np.ndarray]):
        by = np.lexsort((np.arange(VOCABULARY), -counts))
        own = np.array([END, *[i for i in by.tolist() if i != END][: OWN_SYMBOLS - 1]])
        self.symbol = (OWN_SYMBOLS + (np.arange(VOCABULARY) * 2654435761 % (1 << 32) >> 16) % HASHED_SYMBOLS).astype(np.int32)
        self.symbol[own] = np.arange(OWN_SYMBOLS)
        self.begin = OWN_SYMBOLS + HASHED_SYMBOLS
        self.klass, self.slot = np.full(VOCABULARY, CLASSES - 1, np.int16), np.zeros(VOCABULARY, np.int32)
        self.klass[own], self.slot[own] = _classes(self.symbol, sample)
        bands = SLOTS // 2
        for k, side in enumerate((False, True)):
            mine = np.array([i for i in by.tolist() if self.klass[i] == CLASSES - 1 and starts[i] == side])
            mass = np.cumsum(counts[mine] + 1.0)
            self.slot[mine] = k * bands + np.minimum((mass - counts[mine] - 1.0) / mass[-1] * bands, bands - 1).astype(int)
        self.inside = np.zeros(VOCABULARY)
        rest = np.flatnonzero(self.klass == CLASSES - 1)
        total = np.bincount(self.slot[rest], counts[rest] + 1.0, SLOTS)
        self.inside[rest] = np.log((counts[rest] + 1.0) / total[self.slot[rest]])


def _classes(symbol: np.ndarray, sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(class, slot) of the own symbols: halved again and again by the leading direction of what precedes them."""
    pairs = np.zeros((OWN_SYMBOLS, OWN_SYMBOLS))
    for x in sample:
        sym = symbol[x]
        inside = (sym[:-1] < OWN_SYMBOLS) & (sym[1:] < OWN_SYMBOLS)
        np.add.at(pairs, (sym[1:][inside], sym[:-1][inside]), 1)
    rows = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    groups = [np.arange(OWN_SYMBOLS)]
    while len(groups) < CLASSES - 1:
        halves = []
        for g in groups:
            z = rows[g] - rows[g].mean(0)
            v = np.ones(z.shape[1])
            for _ in range(20):
                v = z.T @ (z @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = g[np.argsort(z @ v, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    klass, slot = np.empty(OWN_SYMBOLS, np.int16), np.empty(OWN_SYMBOLS, np.int32)
    for c, g in enumerate(groups):
        klass[g], slot[g] = c, np.arange(len(g))
    return klass, slot


def init() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    e = (rng.standard_normal((OWN_SYMBOLS + HASHED_SYMBOLS + 1, WIDTH)) * 0.3).astype(np.float32)
    z = lambda *s: np.zeros(s, np.float32)
    return {"e": e, "q": r(WIDTH, WIDTH), "k": r(WIDTH, WIDTH), "v": r(WIDTH, WIDTH), "near": z(WINDOW), "w1": r(WIDTH, HIDDEN), "b1": z(HIDDEN), "w2": r(HIDDEN, WIDTH) * 0.3, "c": r(WIDTH, CLASSES), "cb": z(CLASSES), "s": r(WIDTH, CLASSES, SLOTS).transpose(1, 0, 2).copy(), "sb": z(CLASSES, SLOTS)}


_BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_CAUSAL = _BACK >= 0


#: Scores of the network are cut off here, so their exponentials need no shift; sums stay finite.
MOST = np.float32(40)


def _exp(z: np.ndarray) -> np.ndarray:
    np.clip(z, -MOST, MOST, out=z)
    return np.exp(z, out=z)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place, over the last axis."""
    _exp(z)
    z /= z @ np.ones((z.shape[-1], 1), z.dtype)
    return z


def _near(p: dict) -> np.ndarray:
    """The factor of each position on each other one."""
    return np.where(_CAUSAL, np.exp(p["near"][np.abs(_BACK)]), 0).astype(p["near"].dtype)


#: From so many rows on a symbol's rows are summed by themselves.
OFTEN = 8
#: Windows, and rows of neighbouring classes, that are worked on at a time: few enough to stay in a core's cache.
PART, GROUP = 64, 2048


def _sums(rows: np.ndarray, sym: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each symbol below ``n``."""
    order = np.argsort(sym.astype(np.int16) if n < 1 << 15 else sym, kind="stable")  # short numbers are sorted by radix
    sym, rows = sym[order], rows.take(order, 0)
    head = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
    count = np.diff(np.append(head, len(sym)))
    out, ones = np.zeros((n, rows.shape[1]), rows.dtype), np.ones(len(sym), rows.dtype)
    big = count >= OFTEN
    for i, h, c in zip(sym[head[big]].tolist(), head[big].tolist(), count[big].tolist(), strict=True):
        np.matmul(ones[:c], rows[h : h + c], out=out[i])
    # Of the others the most frequent come first, so that those with a further row are a slice.
    few = np.flatnonzero(~big)
    few = few[np.argsort(-count[few], kind="stable")]
    head, count = head[few], count[few]
    total = rows.take(head, 0)
    for k in range(1, OFTEN):
        more = np.searchsorted(-count, -k)
        if more:
            total[:more] += rows.take(head[:more] + k, 0)
    out[sym[head]] = total
    return out


def _grouped(begin: list[int]) -> Iterator[tuple[int, int, list[tuple[int, slice]]]]:
    """(from, to, classes with their rows therein): rows sorted by class, in groups of whole classes of about ``GROUP`` rows."""
    c = 0
    while c < CLASSES:
        first = c
        c += 1
        while c < CLASSES and begin[c + 1] - begin[first] <= GROUP:
            c += 1
        lo, hi = begin[first], begin[c]
        if lo < hi:
            yield lo, hi, [(k, slice(begin[k] - lo, begin[k + 1] - lo)) for k in range(first, c) if begin[k] < begin[k + 1]]


def _missed(z: np.ndarray, at: np.ndarray) -> float:
    """Softmax in place, less one at the flat places ``at``; the cross-entropy there."""
    _softmax(z)
    flat = z.reshape(-1)
    got = flat.take(at)
    flat[at] = got - z.dtype.type(1)
    return -float(np.log(got + z.dtype.type(1e-30)).sum())


def _tiles(p: dict, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The biases of hidden layer and classes, and zeros, as ``rows`` rows: operations on whole arrays do not stop at each row."""
    return np.tile(p["b1"], (rows, 1)), np.tile(p["cb"], (rows, 1)), np.zeros((rows, HIDDEN), p["b1"].dtype)


def gradient(p: dict, sym: np.ndarray, cls: np.ndarray, slot: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of class (-1: no target) and slot after each position of the windows, and its gradient."""
    e, (n, w) = p["e"], sym.shape
    kind = e.dtype.type
    scale = kind(1 / np.sqrt(WIDTH))
    # Everything before the attention depends on the symbol only.
    eq, ek, ev = e @ p["q"] * scale, e @ p["k"], e @ p["v"]
    near, one = _near(p), np.ones((w, 1), e.dtype)
    s, y, rows = sym.ravel().astype(np.intp), cls.ravel(), n * w
    ones = np.ones(rows, e.dtype)
    b1, cb, none = _tiles(p, PART * w)
    h, f, g, dg = (np.empty((rows, k), e.dtype) for k in (WIDTH, HIDDEN, WIDTH, WIDTH))
    a = np.empty((n, w, w), e.dtype)
    d = {k: np.zeros_like(v) for k, v in p.items() if k not in ("e", "q", "k", "v", "near")}
    loss = 0.0
    turned = {k: np.ascontiguousarray(p[k].T) for k in ("c", "w1", "w2")}
    parts = [(slice(b, min(b + PART, n)), slice(b * w, min(b + PART, n) * w)) for b in range(0, n, PART)]
    taken = lambda i: (t.take(s[i], 0).reshape(-1, w, WIDTH) for t in (eq, ek, ev))
    for b, i in parts:
        q, k, v = taken(i)
        ab, hb, fb, gb = a[b], h[i], f[i], g[i]
        np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)), out=ab)
        _exp(ab)
        ab *= near
        ab /= ab @ one
        np.matmul(ab, v, out=hb.reshape(-1, w, WIDTH))
        hb += e.take(s[i], 0)
        np.matmul(hb, p["w1"], out=fb)
        fb += b1[: len(fb)]
        np.maximum(fb, none[: len(fb)], out=fb)
        np.matmul(fb, p["w2"], out=gb)
        gb += hb
        dc = gb @ p["c"]
        dc += cb[: len(dc)]
        has = np.flatnonzero(y[i] >= 0)
        loss += _missed(dc, has * CLASSES + y[i][has])
        if len(has) < len(dc):
            dc[y[i] < 0] = 0
        d["c"] += gb.T @ dc
        d["cb"] += ones[: len(dc)] @ dc
        np.matmul(dc, turned["c"], out=dg[i])
    # Targets sorted by class, so that each class's slots are one product.
    order = np.argsort(y, kind="stable")
    u, kinds = slot.ravel()[order], y[order]
    begin = np.searchsorted(kinds, np.arange(CLASSES + 1)).tolist()
    back = np.empty_like(g)
    back[: begin[0]] = 0
    for lo, hi, some in _grouped(begin):
        gs, ds = g.take(order[lo:hi], 0), np.empty((hi - lo, SLOTS), g.dtype)
        for c, i in some:
            np.matmul(gs[i], p["s"][c], out=ds[i])
        ds += p["sb"].take(kinds[lo:hi], 0)
        loss += _missed(ds, np.arange(hi - lo) * SLOTS + u[lo:hi])
        for c, i in some:
            np.matmul(gs[i].T, ds[i], out=d["s"][c])
            np.matmul(ones[: i.stop - i.start], ds[i], out=d["sb"][c])
            np.matmul(ds[i], p["s"][c].T, out=back[lo:hi][i])
    place = np.empty_like(order)
    place[order] = np.arange(rows)
    by = np.empty((n, w, 4 * WIDTH), e.dtype)
    near = np.zeros((w, w), e.dtype)
    for b, i in parts:
        q, k, v = taken(i)
        ab, hb, fb, gb, to = a[b], h[i], f[i], dg[i], by[b]
        gb += back.take(place[i], 0)
        d["w2"] += fb.T @ gb
        df = gb @ turned["w2"]
        df *= fb > 0
        d["w1"] += hb.T @ df
        d["b1"] += ones[: len(df)] @ df
        gb += df @ turned["w1"]
        dh = gb.reshape(-1, w, WIDTH)
        da = dh @ np.ascontiguousarray(v.transpose(0, 2, 1))
        da -= np.einsum("nij,nij->ni", da, ab)[..., None]
        da *= ab
        near += da.sum(0)
        to[..., :WIDTH] = dh
        np.matmul(da, k, out=to[..., WIDTH : 2 * WIDTH])
        np.matmul(da.transpose(0, 2, 1), q, out=to[..., 2 * WIDTH : 3 * WIDTH])
        np.matmul(ab.transpose(0, 2, 1), dh, out=to[..., 3 * WIDTH :])
    d["near"] = np.bincount(_BACK[_CAUSAL], near[_CAUSAL], WINDOW).astype(e.dtype)
    dx, dq, dk, dv = np.split(_sums(by.reshape(-1, 4 * WIDTH), s, len(e)), 4, axis=1)
    dq = dq * scale
    d["q"], d["k"], d["v"] = e.T @ dq, e.T @ dk, e.T @ dv
    d["e"] = dx + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
    m = max(rows - begin[0], 1)
    for v in d.values():
        v /= kind(m)
    return loss / m, d


class Adam:
    def __init__(self, p: dict):
        self.p, self.t = p, 0
        self.m, self.s, self.x = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(3))

    def step(self, d: dict, rate: float) -> None:
        self.t += 1
        c = rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in d.items():
            m, s, x = self.m[k], self.s[k], self.x[k]
            m *= 0.9
            m += np.multiply(g, 0.1, out=x)
            s *= 0.99
            np.multiply(g, g, out=x)
            x *= 0.01
            s += x
            np.sqrt(s, out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= c
            self.p[k] -= x


def windows(ids: list[np.ndarray], coding: Coding, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, targets, texts): windows over the texts' ids that overlap by ``context``. Targets are ids, -1 where the window before has scored it or the text is over."""
    stride = WINDOW - context
    n = np.array([len(x) for x in ids])
    count = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
    text = np.repeat(np.arange(len(n)), count)
    w = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    base = np.cumsum(n) - n
    pos = w[:, None] * stride + np.arange(WINDOW)[None, :]
    inside = pos < n[text][:, None]
    at = np.where(inside, base[text][:, None] + pos, 0)
    target = np.where(inside & ((w == 0)[:, None] | (np.arange(WINDOW) >= context)[None, :]), flat[at], -1)
    sym = np.where(inside & (pos > 0), coding.symbol[flat[np.maximum(at - 1, 0)]], coding.begin)
    return sym, target, text


def coded(target: np.ndarray, coding: Coding) -> tuple[np.ndarray, np.ndarray]:
    ids = np.maximum(target, 0)
    return np.where(target >= 0, coding.klass[ids], np.int16(-1)), coding.slot[ids]


def train(p: dict, sym: np.ndarray, target: np.ndarray, coding: Coding, steps: int, rate: float, seed: int) -> float:
    cls, slot = coded(target, coding)
    rng, adam, loss = np.random.default_rng(seed), Adam(p), 0.0
    for t in range(steps):
        some = rng.integers(0, len(sym), BATCH)
        loss, d = gradient(p, sym[some], cls[some], slot[some])
        adam.step(d, rate * min(1.0, 2 * (1 - t / steps)))
    return loss


#: Windows that are scored at a time.
CHUNK = 256


def _chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax at one flat place of each row."""
    np.clip(z, -MOST, MOST, out=z)
    got = z.reshape(-1).take(at)
    np.exp(z, out=z)
    return got - np.log(z @ np.ones(z.shape[1], np.float32))


def score(p: dict, coding: Coding, ids: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's ids."""
    scale = np.float32(1 / np.sqrt(WIDTH))
    e = p["e"]
    eq, ek, ev = e @ p["q"] * scale, e @ p["k"], e @ p["v"]
    one = np.ones((WINDOW, 1), np.float32)
    sym, target, text = windows(ids, coding)
    out = np.zeros(len(ids))
    begins = target[:, 0] >= 0
    # Only a text's first window asks for its first positions; in the others they are seen, but not scored.
    for skip, which in ((0, np.flatnonzero(begins)), (CONTEXT, np.flatnonzero(~begins))):
        near, w = _near(p)[skip:], WINDOW - skip
        b1, cb, none = _tiles(p, PART * w)
        for at in range(0, len(which), CHUNK):
            some = which[at : at + CHUNK]
            s, y = sym[some].astype(np.intp), target[some, skip:].ravel()
            cls = np.where(y >= 0, coding.klass[y], np.int16(-1))
            g, logp = np.empty((len(y), WIDTH), np.float32), np.empty(len(y), np.float32)
            for b in range(0, len(some), PART):
                seen, i = s[b : b + PART], slice(b * w, (b + PART) * w)
                asks, gb = seen[:, skip:], g[i]
                a = _exp(eq.take(asks, 0) @ np.ascontiguousarray(ek.take(seen, 0).transpose(0, 2, 1)))
                a *= near
                h = a @ ev.take(seen, 0)
                h /= a @ one
                h += e.take(asks, 0)
                h = h.reshape(-1, WIDTH)
                f = h @ p["w1"]
                f += b1[: len(f)]
                np.maximum(f, none[: len(f)], out=f)
                np.matmul(f, p["w2"], out=gb)
                gb += h
                z = gb @ p["c"]
                z += cb[: len(z)]
                logp[i] = _chosen(z, np.arange(len(z)) * CLASSES + np.maximum(cls[i], 0))
            # Sorted by class, so that each class's slots are one product.
            order = np.argsort(cls, kind="stable")
            order = order[np.count_nonzero(cls < 0) :]
            cls = cls[order]
            begin = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
            y = y[order]
            logp = logp[order] + coding.inside[y]
            for lo, hi, parts in _grouped(begin):
                gs, z = g.take(order[lo:hi], 0), np.empty((hi - lo, SLOTS), np.float32)
                for c, i in parts:
                    np.matmul(gs[i], p["s"][c], out=z[i])
                z += p["sb"].take(cls[lo:hi], 0)
                logp[lo:hi] += _chosen(z, np.arange(hi - lo) * SLOTS + coding.slot[y[lo:hi]])
            out += np.bincount(text[some][order // w], logp, len(ids))
    return out / np.log(10)


def _learned(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of learning rows; the end is the null word."""
    seen: Counter = Counter()
    ends = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([*seen.keys(), None], pa.binary()), pa.array([*seen.values(), ends], pa.int64())], names=["word", "n"])

    for b in blocks(batches, "text", BLOCK_BYTES):
        for i, t in zip(b.column("doc_id").to_pylist(), raw_texts(b), strict=True):
            if _learned(i):
                seen.update(t.lower().split())
                ends += 1
        if len(seen) > TASK_WORDS:
            yield out()
            seen.clear()
            ends = 0
    if seen or ends:
        yield out()


def _id_counts(path):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            ids, each = spelled_words(path, b.column("word").to_pylist())
            np.add.at(total, ids, np.repeat(b.column("n").to_numpy(), each))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return run


class Model:
    """What scoring needs: coding, weights, N, V and the frequent words with the base's log10."""

    def __init__(self, coding: Coding, weights: dict, total: int, types: int, ends: int, top: dict[bytes, int], path: str | None, name: str):
        self.coding, self.weights, self.total, self.types, self.ends, self.path = coding, weights, total, types, ends, path
        self.words, self.name = list(top), name
        self.logs = self.base(np.fromiter(top.values(), np.int64, len(top)))

    def base(self, count):
        return np.log10((count + 1) / (self.total + self.types + 1))


def learn(spark: SparkSession, docs: DataFrame, path: str | None = None) -> tuple[Model, DataFrame]:
    """(model, counts): counts has word and n of all learning rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = materialize(spark, rows.mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "lm-words")
    # Classes of equal magnitude, eight for each doubling: a few hundred rows.
    sizes = counts.groupBy(F.floor(F.log2("n") * 8).alias("m"), F.col("word").isNull().alias("end")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect()
    total, types = sum(r["n"] for r in sizes), sum(r["types"] for r in sizes)
    ends = sum(r["n"] for r in sizes if r["end"])
    least, room = 1 << 62, TOP_WORDS
    for r in sorted((r for r in sizes if not r["end"]), key=lambda r: -r["m"]):
        if r["types"] > room:
            break
        room -= r["types"]
        least = r["m"]
    top = {bytes(r["word"]): r["n"] for r in counts.where(F.col("word").isNotNull() & (F.floor(F.log2("n") * 8) >= least)).collect()} if least < 1 << 62 else {}
    tally = np.zeros(VOCABULARY)
    for r in counts.where("word is not null").mapInArrow(_id_counts(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        tally[r["id"]] = r["n"]
    tally[END] = ends
    name = uuid.uuid4().hex
    learning = rows.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    texts = [(r["text"] or "").encode() for r in bounded_sample(spark, learning, SAMPLE, SAMPLE_BYTES)]
    sample = Lexicon(path)([t.lower().split() for t in texts])
    coding, weights = Coding(tally, begins_word(path), sample), init()
    if texts:
        sym, target, _ = windows(sample, coding)
        train(weights, sym, target, coding, min(STEPS, -(-PASSES * len(sym) // BATCH)), RATE, 5)
        weights = _average(spark, learning, weights, coding, path, list(top), name)
    return Model(coding, weights, total, types, ends, top, path, name), counts


def _average(spark: SparkSession, learning: DataFrame, weights: dict, coding: Coding, path: str | None, words: list[bytes] = (), name: str = "") -> dict:
    """One pass of every task over its learning rows from the same start, and the mean of what they reach."""
    start = spark.sparkContext.broadcast((weights, coding, words))
    name = name or uuid.uuid4().hex
    names = list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, code, frequent = start.value
        own = {k: v.copy() for k, v in first.items()}
        ids, n, adam = lexicon(path, frequent, name), 0, None  # scoring goes on with it
        for b in blocks(batches, "text", BLOCK_BYTES):
            # Every id is a target once; no overlap is needed to learn from.
            sym, target, _ = windows(ids([t.lower().split() for t in raw_texts(b)]), code, 0)
            cls, slot = coded(target, code)
            order = np.random.default_rng(TaskContext.get().partitionId() + n).permutation(len(sym))
            adam = adam or Adam(own)
            for at in range(0, len(order), TASK_BATCH):
                some = order[at : at + TASK_BATCH]
                adam.step(gradient(own, sym[some], cls[some], slot[some])[1], TASK_RATE)
            n += len(sym)
        if n:
            moved = np.concatenate([(own[k] - first[k]).ravel() for k in names])
            whole = np.round(moved.astype(np.float64) * FIXED).astype(np.int64) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(whole)), -1)), pa.array(np.append(whole, n))], names=["k", "x"])

    found = learning.mapInArrow(run, "k long, x long").groupBy("k").agg(F.sum("x").cast("long").alias("x")).toPandas()
    if not len(found):
        return weights
    by = dict(zip(found["k"].tolist(), found["x"].tolist(), strict=True))
    n, out, at = by.pop(-1), {}, 0
    moved = np.zeros(sum(v.size for v in weights.values()))
    moved[list(by)] = list(by.values())
    for k in names:
        size = weights[k].size
        out[k] = (weights[k] + (moved[at : at + size] / n / FIXED).reshape(weights[k].shape)).astype(np.float32)
        at += size
    return out


def scored(spark: SparkSession, docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = spark.sparkContext.broadcast(model)  # weights, codes and TOP_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lex, base, n = lexicon(m.path, m.words, m.name), TaskContext.get().partitionId() << 40, 0
        frequent, end = len(m.words), m.base(m.ends)
        logs = np.append(m.logs, 0.0)
        for b in blocks(batches, "text", BLOCK_BYTES):
            numbers, per = lex.numbers([t.lower().split() for t in raw_texts(b)])
            text = np.repeat(np.arange(len(per)), per)
            often = numbers < frequent
            known = np.bincount(text[often], minlength=len(per)) + (m.ends > 0)
            sums = np.bincount(text, logs[np.minimum(numbers, frequent)], len(per)) + end
            pair, times = np.unique(text[~often] << 32 | numbers[~often], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pair >> 32, minlength=len(per)))]).astype(np.int32)
            rare = pa.array([lex.names[k] for k in (pair & 0xFFFFFFFF).tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(range(base + n, base + n + len(per)), pa.int64()), b.column("doc_id"), pa.array(per + 1), pa.array(known), pa.array(sums), pa.array(score(m.weights, m.coding, lex.spelled(numbers, per))),
                pa.ListArray.from_arrays(pa.array(ends), rare), pa.ListArray.from_arrays(pa.array(ends), pa.array(times)),
            ], names=["rid", "doc_id", "n_tokens", "known", "base", "score", "rare", "times"])
            n += len(per)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = materialize(spark, rows.mapInArrow(run, "rid long, doc_id long, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"), "lm-scored")
    rare = out.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("t"))
    c = F.coalesce("n", F.lit(0))
    each = rare.join(counts.where("word is not null"), "word", "left").select("rid", F.when(c > 0, F.col("t")).otherwise(0).alias("k"), (F.col("t") * F.log10((c + 1) / F.lit(float(model.total + model.types + 1)))).alias("s"))
    more = each.groupBy("rid").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.drop("rare", "times").join(more, "rid", "left").select("doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("base_score"), "score")
