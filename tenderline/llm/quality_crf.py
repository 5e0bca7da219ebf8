"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's features are shares of kinds of characters, its length, its mean word length, words that repeat the one before, and
whether it repeats an earlier line; each line also sees those of its neighbours. Forward-backward gives P(good) of every
line; their mean by length is the text's quality, which a logistic curve fitted on the same learning rows turns into
a probability. Lines learn the label of their text.

The field learns from at most ``SAMPLE`` labelled texts of either kind, those with the least hash of their id, together at
most ``SAMPLE_BYTES``; of them whole texts are used. Labels, languages, sources and ids are no features.

Defined results: null text is empty; an empty text is one empty line, and scored as such; texts with equal bytes have
equal scores; a null id is never learned from and not held out; ids with both labels count as bad; without learnable labels of
both kinds every score is the share of good labels (0.5 without any); an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import IS_POINT, IS_SPACE, blocks, bounded_sample, fold, lookup, mix, raw_texts, word_hashes

#: Labelled texts of either kind to learn from, at most, and bytes of all.
SAMPLE, SAMPLE_BYTES = 1500, 64 << 20
FOLDS, HELD_OUT = 3, 1
BLOCK_BYTES = 2 << 20
EPOCHS, BATCH, RATE, DECAY = 25, 64, 0.2, 1e-5

_KINDS = np.stack([lookup(x) for x in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#*$%&<>@^~=_+{}[]\\", b"|", b"!", b".,;:?'\"()-/", bytes(range(128, 256)))], 1)
#: (feature, level): a line at or above the level also sets a flag; shares of capitals, symbols, bars, exclamation marks, repeats.
LEVELS = ((0, 0.4), (3, 0.05), (3, 0.15), (4, 0.03), (5, 0.03), (_KINDS.shape[1] + 2, 0.1), (_KINDS.shape[1] + 2, 0.4))
OWN = _KINDS.shape[1] + 6 + len(LEVELS)
FEATURES = 3 * OWN + 1


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, lines of each text); every text ends with a line end."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    per = np.diff(np.concatenate([[-1], np.searchsorted(ends, stops)]))
    return buf, starts, ends, per


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its weight, lines of each text)."""
    buf, starts, ends, per = lines_of(texts)
    length = np.maximum(ends - starts, 1)
    part = []
    for k in range(_KINDS.shape[1]):
        total = np.concatenate([[0], np.cumsum(_KINDS[:, k][buf], dtype=np.int32)])
        part.append((total[ends] - total[starts]) / length)
    space = IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space, [1]]).astype(np.int8)))
    w0, w1 = edge[::2], edge[1::2]
    first, stop = np.searchsorted(w0, starts), np.searchsorted(w0, ends)
    n_words = stop - first
    h = word_hashes(buf, w0, w1)
    same = np.zeros(len(h) + 1, np.int32)
    if len(h):
        same[1:-1] = h[1:] == h[:-1]
        inner = first[n_words > 0]
        same[inner] = 0  # a line's first word has none before it
    total = np.concatenate([[0], np.cumsum(same)])
    points = np.concatenate([[0], np.cumsum(IS_POINT[buf], dtype=np.int32)])
    chars = points[ends] - points[starts]
    line = word_hashes(buf, starts, ends)
    text = np.repeat(np.arange(len(texts)), per)
    key = line + mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    again &= n_words > 0
    own = np.stack([*part, np.log1p(chars) / 8, chars / np.maximum(n_words, 1) / 10, (total[stop] - total[first]) / np.maximum(n_words, 1), again, n_words == 0, np.minimum(n_words, 3) / 3], 1)
    own = np.concatenate([own, np.stack([own[:, k] >= at for k, at in LEVELS], 1)], 1)
    prev, after = np.zeros_like(own), np.zeros_like(own)
    prev[1:], after[:-1] = own[:-1], own[1:]
    head = np.cumsum(per) - per
    prev[head] = 0
    after[head + per - 1] = 0
    return np.concatenate([own, prev, after, np.ones((len(own), 1))], 1), np.maximum(chars, 1), per


@dataclass
class Model:
    """weights: (features) score of good against bad; trans: 2 x 2; curve: slope and shift of the logistic curve."""

    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None

    def raw(self, x: np.ndarray, weight: np.ndarray, per: np.ndarray) -> np.ndarray:
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weights
        p = crf.marginals(emit, per, self.trans)[0][:, 1]
        head = np.cumsum(per) - per
        return np.add.reduceat(p * weight, head) / np.add.reduceat(weight, head) if len(head) else np.zeros(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        mean = np.clip(self.raw(*features(texts)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(mean / (1 - mean)) + self.curve[1])))


def fit(texts: list[bytes], labels: list[int], good: float = 0.5) -> Model:
    """Stochastic gradient (Adagrad) on the field's log-likelihood, each kind of text with the same total weight; ``good`` is the share of
    good texts that the curve assumes."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), (1.0, 0.0), float(y.mean()) if len(y) else 0.5)
    kind = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    rng = np.random.default_rng(7)
    made = [features([t]) for t in texts]
    w, tr = np.zeros(FEATURES), np.zeros((2, 2))
    gw, gt = np.full(FEATURES, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = np.concatenate([made[i][0] for i in some])
            per = np.array([len(made[i][0]) for i in some])
            # A text counts once, however many lines it has.
            share = np.repeat(kind[some] / per, per) / len(some)
            emit = np.zeros((len(x), 2))
            emit[:, 1] = x @ w
            p, _, pairs = crf.marginals(emit, per, tr, expected=True)
            gold = np.repeat(y[some], per)
            grad = x.T @ (share * (gold - p[:, 1])) - DECAY * w
            step = (crf.transitions(gold, per, 2) - pairs) / max(per.sum(), 1) - DECAY * tr
            gw, gt = gw + grad**2, gt + step**2
            w, tr = w + RATE * grad / np.sqrt(gw), tr + RATE * step / np.sqrt(gt)
    model = Model(w, tr, (1.0, 0.0))
    mean = np.clip([model.raw(*m)[0] for m in made], 1e-6, 1 - 1e-6)
    z = np.log(mean / (1 - mean))
    a, b = 1.0, 0.0
    for _ in range(300):  # the curve, by gradient steps of shrinking size
        p = 1 / (1 + np.exp(-(a * z + b)))
        d = kind * np.where(y == 1, 2 * good, 2 * (1 - good)) * (y - p)
        a, b = a + 0.02 * np.mean(d * z) - 1e-4 * (a - 1), b + 0.1 * np.mean(d)
    return Model(w, tr, (max(a, 0.05), b))


def learnable(labels: DataFrame, most: int = SAMPLE) -> dict[int, int]:
    """doc_id -> label of the rows to learn from."""
    one = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return {r["doc_id"]: q for q in (0, 1) for r in one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()}


def learnable_share(labels: DataFrame) -> float:
    """The share of good labels among all rows that may be learned from."""
    row = labels.where("quality is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).agg(F.avg("quality").alias("a")).first()
    return min(max(row["a"], 0.02), 0.98) if row["a"] is not None else 0.5


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    ids = spark.createDataFrame(list(learnable(labels).items()), "doc_id long, quality int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    found = bounded_sample(spark, rows, 2 * SAMPLE, SAMPLE_BYTES, "quality", SAMPLE)
    return fit([(r["text"] or "").encode() for r in found], [r["quality"] for r in found], learnable_share(labels))


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(raw_texts(b)))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
