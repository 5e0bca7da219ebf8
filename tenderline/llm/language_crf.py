"""Language identification: a linear-chain conditional random field labels every word, so texts may switch languages.

Words are runs of letters (ASCII letters and all bytes beyond ASCII), lower-cased A-Z. A word's features are its affixes
(first and last one, two and three bytes, with its length up to four), its inner byte trigrams and pairs, and its entry in a
hashed lexicon; all are hashed into one table of weights for each language. Transitions are learned, with sequences
spliced from several texts among the learning sequences so that switches occur. Forward-backward gives each word's
distribution; their mean by word length is the text's, its largest share the score.

The field learns from at most ``SAMPLE`` whole texts with a language, together at most ``SAMPLE_BYTES``: the languages take
turns, each with the texts of the least hash of their id, so a rare language is learned too.
Languages, sources and ids are no features.

Defined results: null texts and texts without a letter get ``und`` with score 0; without a row to learn from every other
text gets ``und`` too; texts with equal bytes have equal results; a null id is never learned from and not held out; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import blocks, bounded_sample, fold, lookup, word_hashes

SAMPLE, SAMPLE_BYTES = 1500, 64 << 20
FOLDS, HELD_OUT = 3, 1
BLOCK_BYTES = 2 << 20
#: Rows of the table of weights, a power of two.
TABLE = 1 << 17
EPOCHS, BATCH, RATE = 3, 24, 0.25
#: Spliced sequences a text, and words of each of their pieces.
SPLICED, PIECE = 0.5, (4, 40)

_LETTER = lookup(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_HAS_LETTER = regex.compile(r"\p{L}")


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    h = (x.astype(np.uint32) + np.uint32(kind * 0x01000193)) * np.uint32(2654435761)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(TABLE - 1)).astype(np.int32)


@dataclass
class Words:
    """Words of some texts: their spans, per-word slots (words x kinds), slots of the n-grams and where each word's begin."""

    size: np.ndarray
    slots: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    per_text: np.ndarray


def words(texts: list[bytes]) -> Words:
    buf = np.frombuffer(b"\n".join([*texts, b"\n\n\n\n"]), np.uint8)
    letter = _LETTER[buf]
    buf = _LOWER[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter, [0]]).astype(np.int8)))
    w0, w1 = edge[::2], edge[1::2]
    size = w1 - w0
    stops = np.cumsum([len(t) + 1 for t in texts])
    per = np.diff(np.concatenate([[0], np.searchsorted(w0, stops)]))
    wide = buf.astype(np.uint32)
    cols = []
    for k in (1, 2, 3):
        head, tail = np.zeros(len(w0), np.uint32), np.zeros(len(w0), np.uint32)
        for j in range(k):
            head = head << np.uint32(8) | np.where(j < size, wide[np.minimum(w0 + j, len(buf) - 1)], 0)
            tail = tail << np.uint32(8) | np.where(j < size, wide[np.maximum(w1 - 1 - j, 0)], 0)
        cols += [_slot(head, 2 * k), _slot(tail, 2 * k + 1)]
    cols.append(_slot(wide[w0] << np.uint32(16) | wide[np.maximum(w1 - 1, 0)] << np.uint32(8) | np.minimum(size, 4).astype(np.uint32), 9))
    cols.append(_slot((word_hashes(buf, w0, w1) >> np.uint64(32)).astype(np.uint32), 11))
    # Pairs and trigrams that lie inside a word.
    two = letter[:-1] & letter[1:]
    three = two[:-1] & letter[2:]
    at = np.flatnonzero(three)
    g3 = _slot(wide[at] << np.uint32(16) | wide[at + 1] << np.uint32(8) | wide[at + 2], 13)
    first = np.searchsorted(at, w0)
    return Words(size, np.stack(cols, 1) if len(w0) else np.zeros((0, 8), np.int32), g3, first, per)


def emissions(w: Words, table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w.size), table.shape[1]), np.float32)
    for k in range(w.slots.shape[1]):
        out += table[w.slots[:, k]]
    n = np.diff(np.append(w.first, len(w.grams)))
    some = np.flatnonzero(n > 0)
    if len(some):
        out[some] += np.add.reduceat(table[w.grams], w.first[some], axis=0)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    trans: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score, out = np.zeros(len(texts)), ["und"] * len(texts)
        real = [k for k, t in enumerate(texts) if t and _HAS_LETTER.search(t)]
        if not real or not self.langs:
            return out, score
        w = words([texts[k].encode() for k in real])
        share = crf.marginals(emissions(w, self.table).astype(np.float64), w.per_text, self.trans)[0] * w.size[:, None]
        head = np.cumsum(w.per_text) - w.per_text
        total = np.add.reduceat(share, head, axis=0)
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        for k, b, p in zip(real, best, total[np.arange(len(best)), best], strict=True):
            out[k], score[k] = self.langs[b], min(max(p, 0.0), 1.0)
        return out, score


def fit(texts: list[str], langs: list[str]) -> Model:
    """Stochastic gradient (Adagrad) on the field's log-likelihood."""
    names = sorted(set(langs))
    some = [(t, names.index(x)) for t, x in zip(texts, langs, strict=True) if t and _HAS_LETTER.search(t)]
    if not some:
        return Model([], np.zeros((TABLE, 1), np.float32), np.zeros((1, 1)))
    n = len(names)
    w = words([t.encode() for t, _ in some])
    gold = np.repeat(np.array([x for _, x in some]), w.per_text)
    begin = np.cumsum(w.per_text) - w.per_text
    grams = np.append(w.first, len(w.grams))
    rng = np.random.default_rng(11)
    # Long texts are learned from in pieces, so a step's cost is bounded; every word of theirs takes part.
    sequences = [np.arange(b + at, b + min(at + 400, m)) for b, m in zip(begin, w.per_text, strict=True) for at in range(0, m, 400)]
    for _ in range(int(len(some) * SPLICED)):
        parts = []
        for i in rng.integers(0, len(some), 3):
            m = int(min(rng.integers(*PIECE), w.per_text[i]))
            at = begin[i] + rng.integers(0, w.per_text[i] - m + 1)
            parts.append(np.arange(at, at + m))
        sequences.append(np.concatenate(parts))
    table, sq = np.zeros((TABLE, n), np.float32), np.full((TABLE, n), 1e-2, np.float32)
    tr, sq_t = np.zeros((n, n)), np.full((n, n), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for k in range(0, len(order), BATCH):
            mine = [sequences[i] for i in order[k : k + BATCH]]
            at, per = np.concatenate(mine), np.array([len(x) for x in mine])
            count = grams[at + 1] - grams[at]
            first = np.cumsum(count) - count
            pick = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(grams[at], count)
            batch = Words(w.size[at], w.slots[at], w.grams[pick], first, per)
            p, _, pairs = crf.marginals(emissions(batch, table).astype(np.float64), per, tr, expected=True)
            y = np.zeros_like(p)
            y[np.arange(len(at)), gold[at]] = 1
            d = ((y - p) / len(mine)).astype(np.float32)
            where = np.concatenate([batch.slots.T.ravel(), batch.grams])
            what = np.concatenate([np.tile(d, (batch.slots.shape[1], 1)), np.repeat(d, count, axis=0)])
            used, place = np.unique(where, return_inverse=True)
            grad = np.stack([np.bincount(place, what[:, j], len(used)) for j in range(n)], 1).astype(np.float32)
            sq[used] += grad**2
            table[used] += RATE * grad / np.sqrt(sq[used])
            step = (crf.transitions(gold[at], per, n) - pairs) / len(mine)
            sq_t += step**2
            tr += RATE * step / np.sqrt(sq_t)
    return Model(names, table, tr)


def learn(spark: SparkSession, docs: DataFrame, most: int = SAMPLE) -> Model:
    can = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    can = can.where("doc_id is not null and lang is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = bounded_sample(spark, can, most, SAMPLE_BYTES, "lang")
    return fit([r["text"] or "" for r in rows], [r["lang"] for r in rows])


def identify(spark: SparkSession, docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = spark.sparkContext.broadcast(model)  # TABLE x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            langs, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
