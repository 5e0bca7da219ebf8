"""What the corpus operators share: tables, written intermediate results, bounded blocks of rows."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space and TAB to CR.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session (tests) may go without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tenderline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of rows that go to a Python worker at a time; long texts make large batches.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches between the JVM and Python workers small, so that memory does not grow with the rows' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_RECORDING: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``materialize`` writes meanwhile."""
    _RECORDING.append([])
    try:
        yield _RECORDING[-1]
    finally:
        _RECORDING.pop()


def unread(paths: list[str], *frames: DataFrame) -> list[str]:
    """Those of the written paths that the DataFrames do not read."""
    read = "\n".join(f for df in frames for f in df.inputFiles())
    return [p for p in paths if p.rsplit("/", 1)[1] not in read]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written intermediate results that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in _RECORDING:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Numbers of rows up to which a list of them is broadcast (8 bytes each).
BROADCAST_ROWS = 500_000


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's JVM finds nothing that names them; here it looks now, not when its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_PLACE = "cast(`{0}` & 63 as int)"


def marks(spark: SparkSession, numbers: DataFrame, key: str) -> DataFrame:
    """A written table: one row for each 64 neighbouring numbers of which some occur, with their bits."""
    word, bits = F.expr(f"shiftright(`{key}`, 6)").alias("_word"), F.expr(f"bit_or(shiftleft(1L, {_PLACE.format(key)}))").alias("_bits")
    return materialize(spark, numbers.groupBy(word).agg(bits), "marks")


def among(spark: SparkSession, rows: DataFrame, numbers: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """The rows whose key, a row number, is in ``numbers``, or not.

    A short list is broadcast. Of a longer one the bits are, as neighbouring rows have neighbouring numbers: so the rows are not shuffled
    either. Only where there are too many bits, they are joined by a shuffle.
    """
    how = "left_semi" if inside else "left_anti"
    if numbers.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(numbers.select(key)), key, how)
    bits = marks(spark, numbers, key)
    if bits.count() > BROADCAST_ROWS:
        return rows.join(numbers.select(key), key, how)
    found = rows.join(F.broadcast(bits), F.expr(f"shiftright(`{key}`, 6)") == F.col("_word"), "left")
    return found.where(F.expr(f"coalesce(getbit(_bits, {_PLACE.format(key)}), 0) = {int(inside)}")).drop("_word", "_bits")


def without(spark: SparkSession, rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``dropped``."""
    return among(spark, rows, dropped, key, inside=False)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; null ids get null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def py_fold(doc_id: int | None, parts: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def bounded_sample(spark: SparkSession, rows: DataFrame, most: int, most_bytes: int, kind: str | None = None, each: int | None = None) -> list[Row]:
    """At most ``most`` rows of ``rows`` (doc_id, text and perhaps a column ``kind``), those with the least hash of their id.

    With ``kind`` its values take turns, so a rare one is not crowded out, and none gets more than ``each``. Rows whose text no
    longer fits into ``most_bytes`` are passed over. Equal rows come to the driver once and are repeated there; their order is by id
    and text.
    """
    keys = ["doc_id", "_h", *([kind] if kind else [])]
    hashed = rows.withColumn("_h", F.xxhash64("text"))
    meta = hashed.select(*keys, F.coalesce(F.octet_length("text"), F.lit(0)).alias("_n"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_h")]
    if kind:  # a task hands on its first rows of each kind only
        turn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
        meta = meta.withColumn("_k", turn).where(F.col("_k") <= (each or most))
        order = [F.col("_k"), *order, F.col(kind)]
    wanted, room = Counter(), most_bytes
    for r in meta.orderBy(*order).limit(most).collect():
        if r["_n"] <= room:
            room -= r["_n"]
            wanted[tuple(r[k] for k in keys)] += 1
    if not wanted:
        return []
    listed = spark.createDataFrame(list(wanted), rows.select("doc_id", F.lit(0).cast("long").alias("_h"), *keys[2:]).schema)
    found = hashed.join(F.broadcast(listed), keys, "left_semi").dropDuplicates(keys).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"] or "", str(r[kind]) if kind else ""))
    return [r for r in found for _ in range(wanted[tuple(r[k] for k in keys)])]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold at most ``most_bytes`` of ``column`` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right"))), start + most_rows)
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def pack(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the texts, one after the other with ``gap`` zero bytes after each."""
    ends = np.cumsum(np.fromiter((len(t) + gap for t in texts), np.int64, len(texts))) - gap
    buf = np.frombuffer((b"\0" * gap).join([*texts, b""]) if gap else b"".join(texts), np.uint8)
    starts = np.concatenate([[0], ends[:-1] + gap]) if len(texts) else ends
    return buf, starts, ends


def spans_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end], empty spans included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ends] - total[starts]


def lookup(chars: bytes) -> np.ndarray:
    """A table over byte values: 1 for those in ``chars``."""
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


IS_SPACE = lookup(SPACES)
#: Bytes that begin a code point.
IS_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)], np.uint8)


def word_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of packed texts, where zero bytes inside a text are word characters."""
    out = IS_SPACE[buf]
    gap = np.zeros(len(buf) + 1, np.int8)
    np.add.at(gap, ends, 1)
    np.add.at(gap, np.append(starts[1:], len(buf)), -1)
    out = out | (np.cumsum(gap[:-1]) > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[1], out, [1]]).astype(np.int8)))
    return edge[::2], edge[1::2]


_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(8)
def _powers_upto(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; tables of a power of two entries are kept."""
    return _powers_upto(base, 1 << max(n - 1, 0).bit_length())[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose words are hashed at a time: some 50 bytes of memory for each.
HASHED_BYTES = 1 << 19


def word_hashes(buf: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """64 bits for each word, equal for equal words in any text; words in order of their places."""
    out = np.empty(len(w0), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(w0, np.arange(0, len(buf), HASHED_BYTES)), len(w0))).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = w0[a]
        part = buf[first : w1[b - 1]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(part)), dtype=np.uint64)]) if len(part) else np.zeros(1, np.uint64)
        out[a:b] = (sums[w1[a:b] - first] - sums[w0[a:b] - first]) * _powers(_inverse(_P), len(part) + 1)[w0[a:b] - first]
    return mix(out)


def run_hashes(word: np.ndarray, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """64 bits for the ``n`` words from each position in ``at`` on."""
    q = _powers(_Q, len(word) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * q[:-1], dtype=np.uint64)])
    return mix((sums[at + n] - sums[at]) * _powers(_inverse(_Q), len(word) + 1)[at])
