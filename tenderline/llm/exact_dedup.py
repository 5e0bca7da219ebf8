"""Exact dedup by distributed MSD radix partitioning.

Texts without their white space are split by successive digits (runs of bytes, most significant first) until a group has
one member or its texts have ended; two texts are equal when they end in the same group, so no digest decides.

1. Each task splits blocks of bounded size of its own rows this way and keeps one representative of equal texts. A text
   that a third of all rows hold leaves one row a block, so no key stays hot.
2. The representatives are split by their first ``DIGIT`` bytes, the groups above ``GROUP_BYTES`` by eight times as many, and
   so on until each group is small enough or its texts have ended. These rounds only sum lengths, by a number for each
   digit that the first step has made beside the text, so no group meets in one task for them, and a hot prefix is split before a text
   moves. Then every text moves once, to the task of its group, which splits the group by all following bytes.
   (A number that two digits share joins two groups, which the splitting parts again.)
3. Representatives get their group's keeper; rows get it through their representative.

Defined results: null text is empty; all texts without a visible character form one group; a null id is greater than any
other id; of rows that share id and text the group counts each, and one of them stays (the others are marked dropped); an empty table
gives an empty result. Other columns are carried by position, so clashing names are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, blocks, col, materialize, parallelism, without

#: Bytes of text that a task splits at a time.
BLOCK_BYTES = 24 << 20
#: Width of the first digit; each later one has eight times the width.
DIGIT = 64
#: Bytes of a group from which it is split further before its texts move.
GROUP_BYTES = 64 << 20
NO_ID = (1 << 63) - 1


def radix_groups(texts: list[bytes], start: int = 0) -> list[list[int]]:
    """Positions of equal texts, by splitting on successive digits from byte ``start`` on; digits double in width."""
    out, todo = [], [(list(range(len(texts))), start, 8)]
    while todo:
        rows, at, width = todo.pop()
        if len(rows) == 1:
            out.append(rows)
            continue
        split: dict[bytes, list[int]] = {}
        for r in rows:
            split.setdefault(texts[r][at : at + width], []).append(r)
        for digit, members in split.items():
            if len(digit) < width:  # ended
                out.append(members)
            else:
                todo.append((members, at + width, min(2 * width, 1 << 16)))
    return out


def _digits(text: bytes) -> list[int]:
    """A number for each digit: for the bytes up to its end, from the text's start."""
    out, width = [], DIGIT
    while True:
        out.append(xxhash.xxh3_64_intdigest(text[:width]) - (1 << 63))
        if width >= len(text):
            return out
        width *= 8


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and carried columns -> a row each, with its representative's number; the representative carries the best row's."""
    base, n = TaskContext.get().partitionId() << 40, 0
    for b in blocks(batches, "text", BLOCK_BYTES):
        ids, originals = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        lengths = [len(t) if t else 0 for t in originals]
        texts = [t.encode().translate(None, SPACES) if t else b"" for t in originals]
        rep, best, count = [0] * len(ids), [None] * len(ids), [0] * len(ids)
        for members in radix_groups(texts):
            first = members[0]
            top = min(members, key=lambda r: (-lengths[r], NO_ID if ids[r] is None else ids[r]))
            best[first], count[first] = top, len(members)
            for r in members:
                rep[r] = first
        own = [r == x for r, x in enumerate(rep)]
        yield pa.RecordBatch.from_arrays([
            pa.array([base + n + r for r in range(len(ids))], pa.int64()), pa.array([base + n + x for x in rep], pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([count[r] if own[r] else None for r in range(len(ids))], pa.int64()),
            pa.array([base + n + best[r] if own[r] else None for r in range(len(ids))], pa.int64()), pa.array([lengths[best[r]] if own[r] else None for r in range(len(ids))], pa.int64()),
            pa.array([ids[best[r]] if own[r] else None for r in range(len(ids))], pa.int64()), pa.array([_digits(texts[r]) if own[r] else None for r in range(len(ids))], pa.list_(pa.int64())), *b.columns[1:],
        ], names=[*_LOCAL_NAMES, *b.schema.names[1:]])
        n += len(ids)


_LOCAL = "rid long, rep long, doc_id long, chars long, sha string, n long, best_rid long, best_chars long, best_id long, digits array<long>"
_LOCAL_NAMES = [x.split()[0] for x in _LOCAL.split(", ")]
_MERGED = "rid long, root long, n long, best_rid long, best_chars long, best_id long"
_MERGED_NAMES = [x.split()[0] for x in _MERGED.split(", ")]
#: Rows that a task holds or hands on at a time.
ROWS = 1 << 16


class _Group:
    """What is known of one group so far: a root and its text for each distinct text, and rows that are not yet told apart."""

    def __init__(self):
        self.roots, self.texts, self.rows, self.size = [], [], [], 0

    def add(self, row: tuple, text: bytes) -> None:
        self.rows.append((row, text))
        self.size += len(text)

    def reduce(self) -> list[tuple]:
        """The rows with their roots; one of equal texts stays."""
        known, out = len(self.texts), []
        texts = [*self.texts, *(t for _, t in self.rows)]
        for members in radix_groups(texts):
            first = min(members)
            if first >= known:
                self.roots.append(self.rows[first - known][0][0])
                self.texts.append(texts[first])
            root = self.roots[first] if first < known else self.roots[-1]
            out += [(self.rows[r - known][0][0], root, *self.rows[r - known][0][1:]) for r in members if r >= known]
        self.rows, self.size = [], 0
        return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> each with its root."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(len(_MERGED_NAMES))], names=_MERGED_NAMES)

    group, last, out = _Group(), None, []
    for b in blocks(batches, "norm", BLOCK_BYTES):
        for *row, grp, norm in zip(*(b.column(c).to_pylist() for c in ("rid", "n", "best_rid", "best_chars", "best_id", "grp", "norm")), strict=True):
            if grp != last:
                out += group.reduce()
                group, last = _Group(), grp
            elif group.size > GROUP_BYTES or len(group.rows) >= ROWS:  # more than GROUP_BYTES only where the texts have ended, so that few are distinct
                out += group.reduce()
            group.add(tuple(row), norm)
        if len(out) >= ROWS:
            yield batch(out)
            out = []
    out += group.reduce()
    if out:
        yield batch(out)


def locally(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The written result of the first step: _LOCAL, text and _0, _1, ... (the columns in ``carry``)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(col(c).alias(f"_{k}") for k, c in enumerate(carry or [])))
    schema = ", ".join([_LOCAL, *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "doc_id")])
    return materialize(spark, rows.mapInArrow(_local, schema), "exact")


def groups(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and chars, one row for each row of ``docs``."""
    rows = resolved(spark, locally(spark, docs, doc_id, text))
    return rows.select("doc_id", F.col("id").alias("keep_id"), "group_size", (F.col("rid") == F.col("r")).alias("kept"), F.col("sha").alias("text_sha256"), "chars")


def resolved(spark: SparkSession, local: DataFrame) -> DataFrame:
    """rid, doc_id, chars, sha and the group's id and r (the keeper's id and number) and group_size."""
    todo = local.where("n is not null").select("rid", "n", "best_rid", "best_chars", "best_id", "digits", F.translate(F.coalesce("text", F.lit("")), SPACES.decode(), "").cast("binary").alias("norm"))
    dealt = _routed(spark, local, todo).repartition(parallelism(spark), "grp").sortWithinPartitions("grp")
    links = materialize(spark, dealt.mapInArrow(_merge, _MERGED), "exact-merged")
    first = F.struct((-F.col("best_chars")).alias("c"), F.coalesce("best_id", F.lit(NO_ID)).alias("i"), F.col("best_rid").alias("r"), F.col("best_id").alias("id"))
    keepers = links.groupBy("root").agg(F.min(first).alias("k"), F.sum("n").alias("group_size"))
    reps = links.select(F.col("rid").alias("rep"), "root").join(keepers, "root").select("rep", "k.id", "k.r", "group_size")
    return local.select("rid", "rep", "doc_id", "chars", "sha").join(reps, "rep")


def _routed(spark: SparkSession, local: DataFrame, todo: DataFrame) -> DataFrame:
    """The rows with the number of their group instead of their digits."""
    at = lambda k: F.coalesce(F.get("digits", F.lit(k)), F.element_at("digits", -1))  # noqa: E731  an ended text keeps its last
    left = local.where("n is not null").select("digits", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    grp, k = at(0), 0
    while True:
        sums = left.groupBy(at(k).alias("_d")).agg(F.sum("size").alias("s"), F.max(F.size("digits")).alias("more"))
        large = sums.where((F.col("s") > GROUP_BYTES) & (F.col("more") > k + 1)).select("_d", F.lit(True).alias(f"_more{k}"))
        large = materialize(spark, large, "exact-large")
        if large.isEmpty():
            return todo.withColumn("grp", grp).drop("digits", *(f"_more{j}" for j in range(k)))
        large = F.broadcast(large)  # at most one row for each GROUP_BYTES of text
        left = left.join(large.select("_d"), at(k) == F.col("_d"), "left_semi")
        todo = todo.join(large, at(k) == F.col("_d"), "left").drop("_d")
        grp = F.when(F.col(f"_more{k}"), at(k + 1)).otherwise(grp)
        k += 1


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns: the longest original text, then the smallest id, then any one of repeated rows."""
    names = docs.columns
    twice = [n for n in names if names.count(n) > 1]
    # Id and text are carried once if their types are the operator's.
    same = [n for n, kind in (("text", "string"), ("doc_id", "bigint")) if dict(docs.dtypes).get(n) == kind and n not in twice]
    carry = [n for n in names if n not in same]
    local = locally(spark, docs, carry=carry)
    dropped = materialize(spark, resolved(spark, local).where("rid != r").select("rid"), "exact-dropped")
    own = iter(range(len(carry)))
    return without(spark, local, dropped, "rid").select(*(F.col(n if n in same else f"_{next(own)}").alias(n) for n in names))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256, length(text)::BIGINT AS chars FROM g
"""
