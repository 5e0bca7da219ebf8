"""Quality rules: counted rules first, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over the whole raw corpus, one over trusted texts. A document's
score is the mean over its n-grams of log P(trusted) - log P(raw), so it does not depend on length. Trusted texts are
all documents that the labels call good. The threshold is the score that best tells all labelled texts of the two kinds apart,
and every document is held against it. Labels meet documents by a join on their ids: a short list of labels is broadcast, a long
one shuffled with the labelled texts.

Zero bytes count as ordinary characters. Defined results: null text is empty and has no word, so the rules reject it;
null or repeated ids do not matter to a row's result (labels join by id only to pick trusted texts); without labels of
both kinds the threshold is minus infinity and only the counted rules reject; an empty table gives an empty result.
Other columns are not read, and ``keep`` passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, IS_POINT, IS_SPACE, SPACES, among, blocks, col, lookup, materialize, pack, raw_texts, release, run_hashes, spans_sum, word_hashes, word_spans

#: Buckets of the hashed n-grams (their counts come to the driver: at most this many rows) and bytes of an n-gram.
BUCKETS, NGRAM = 1 << 16, 4
#: Added to every bucket's count.
SMOOTH = 0.5
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
BLOCK_BYTES = 2 << 20

def buckets(buf: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; ``buf`` ends with NGRAM - 1 zeros at least."""
    v = buf[: len(buf) - NGRAM + 1].astype(np.uint32)
    for k in range(1, NGRAM):
        v |= buf[k : len(buf) - NGRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    return ((v * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def repeated_words(texts: list[bytes], buf, starts, ends, w0, w1) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in repeated windows) of each text. A 64-bit hash finds candidates; the words themselves decide."""
    first = np.searchsorted(w0, starts)
    count = np.searchsorted(w0, ends) - first
    n_rep = np.zeros(len(texts), np.int64)
    if len(w0) < WINDOW:
        return count, n_rep
    word = word_hashes(buf, w0, w1)
    at = np.arange(len(w0) - WINDOW + 1)
    text = np.repeat(np.arange(len(texts)), count)
    at = at[text[at] == text[at + WINDOW - 1]]
    key = run_hashes(word, at, WINDOW) + text[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = at[hit]
    for t in np.unique(text[at]):
        mine = at[text[at] == t] if len(at) < 1000 else at[np.searchsorted(text[at], t) : np.searchsorted(text[at], t, side="right")]
        words = texts[t].split()
        seen: dict[tuple, list[int]] = {}
        for k in (mine - first[t]).tolist():
            seen.setdefault(tuple(words[k : k + WINDOW]), []).append(k)
        covered = np.zeros(count[t] + 1, np.int64)
        for ks in seen.values():
            if len(ks) > 1:
                for k in ks:
                    covered[k] += 1
                    covered[k + WINDOW] -= 1
        n_rep[t] = int((np.cumsum(covered)[:-1] > 0).sum())
    return count, n_rep


_IS_SYMBOL = lookup(SYMBOLS)
_IS_WORD_POINT = IS_POINT * (1 - IS_SPACE)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double"


def measure(texts: list[bytes], weights: np.ndarray | None) -> list[pa.Array]:
    """The five counts of each text, and the mean weight of its n-grams (0 without any)."""
    buf, starts, ends = pack(texts, NGRAM)
    w0, w1 = word_spans(buf, starts, ends)
    n_words, n_rep = repeated_words(texts, buf, starts, ends, w0, w1)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)] if b"\n" in t else ()
        dup.append(len(lines) - len(set(lines)))
    ratio = np.zeros(len(texts))
    if weights is not None and len(buf) >= NGRAM:
        total = spans_sum(weights[buckets(buf)], starts, ends)
        ratio = total / np.maximum(ends - starts, 1)
    chars, symbols = (spans_sum(t[buf], starts, ends) for t in (_IS_WORD_POINT, _IS_SYMBOL))
    return [pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(dup, pa.int64()), pa.array(n_rep, pa.int64()), pa.array(ratio, pa.float64())]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """b, n: how many n-grams of a task's texts fall into each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for b in blocks(batches, "text", BLOCK_BYTES):
        buf, starts, ends = pack(raw_texts(b), NGRAM)
        if len(buf) >= NGRAM:
            inside = np.zeros(len(buf) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            g = buckets(buf)
            total += np.bincount(g[np.cumsum(inside[: len(g)]) > 0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["b", "n"])


def counted(texts: DataFrame) -> np.ndarray:
    """n-grams of all texts in each bucket."""
    out = np.zeros(BUCKETS)
    for r in texts.select("text").mapInArrow(_count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def _measured(weights: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK_BYTES):
            rest = [b.column(k) for k, n in enumerate(b.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, *measure(raw_texts(b, "_text"), weights)], names=names)

    return run


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, quality of every document whose id has a label; ids with both labels count as bad."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    one = materialize(spark, one.where("quality in (0, 1)"), "rules-labels")
    if one.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(one), "doc_id").select("text", "quality")
    known = materialize(spark, among(spark, docs, one, "doc_id").join(one, "doc_id").select("text", "quality"), "rules-labelled")
    release(spark)
    return known


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of each bucket, threshold)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled(spark, texts, labels)
    raw, good = counted(texts), counted(known.where("quality = 1"))
    # Buckets that the corpus never uses take no part, so the ratio does not drift with their number.
    used = raw > 0
    weights = np.zeros(BUCKETS)
    if good.sum():
        weights[used] = np.log((good[used] + SMOOTH) / (good.sum() + SMOOTH * used.sum())) - np.log((raw[used] + SMOOTH) / (raw.sum() + SMOOTH * used.sum()))

    def scores(batches):
        for b in blocks(batches, "text", BLOCK_BYTES):
            m = measure(raw_texts(b), weights)
            ok = [x >= LEAST_WORDS and 100 * r <= MOST_REPEATED * x for x, r in zip(m[0].to_pylist(), m[4].to_pylist(), strict=True)]
            steps = np.round(m[5].to_numpy() / STEP).astype(np.int64)
            some = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("quality").filter(some), pa.array(steps).filter(some)], names=["q", "s"])

    held = known.mapInArrow(scores, "q int, s long").groupBy("q", "s").count().collect()
    return weights, _threshold(held) * STEP


#: Scores are held against each other in steps of this.
STEP = 0.001


def _threshold(held: list) -> float:
    """The middle of the best cut: most good above plus most bad below. The distinct steps are bounded by the scores' range, however many texts there are."""
    by = {q: np.array(sorted((r["s"], r["count"]) for r in held if r["q"] == q)).reshape(-1, 2) for q in (0, 1)}
    if not len(by[0]) or not len(by[1]):
        return -float("inf")
    cuts = np.unique(np.concatenate([by[0][:, 0], by[1][:, 0]]))
    share = {q: np.concatenate([[0], np.cumsum(x[:, 1])])[np.searchsorted(x[:, 0], cuts)] / x[:, 1].sum() for q, x in by.items()}  # below the cut
    # A good text lost counts ten times a bad text kept.
    gain = share[0] - 10 * share[1]
    k = int(np.argmax(gain))
    return (cuts[k] + cuts[max(k - 1, 0)]) / 2


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (doc_id), the counts, ratio, threshold, base_failed and kept."""
    weights, threshold = fit(spark, docs, labels)
    carry = ["doc_id"] if carry is None else carry
    own = [f"_{k}" for k in range(len(carry))]
    rows = docs.select(*(col(c).alias(o) for c, o in zip(carry, own, strict=True)), F.col("text").cast("string").alias("_text"))
    names = [*own, *(x.split()[0] for x in MEASURES.split(", "))]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), MEASURES])
    out = rows.mapInArrow(_measured(weights, names), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("threshold", F.lit(threshold)).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.col("threshold")))
    return out.select(*(F.col(o).alias(c) for c, o in zip(carry, own, strict=True)), *out.columns[len(own) :])


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    names = docs.columns
    verdicts = judge(spark, docs, labels, carry=names)
    # The verdict is the last column and names may clash, so columns are taken by position.
    renamed = verdicts.toDF(*(f"_{k}" for k in range(len(verdicts.columns))))
    return renamed.where(F.col(f"_{len(verdicts.columns) - 1}")).select(*(F.col(f"_{k}").alias(n) for k, n in enumerate(names)))
