"""Suffix-array dedup: removes every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too.

The suffixes are sorted by the difference-cover algorithm: the triples at positions that are not multiples of three are sampled,
sorted and named; the string of names is sorted by recursion; the remaining suffixes follow from one byte and the rank of the
next; the two orders are merged. Then neighbours in the order are compared over ``LENGTH`` bytes.

The text is distributed so that no two equal strings of ``LENGTH`` bytes are parted. Every window of that length has an
anchor, the least hash of its grams; equal windows have equal anchors. Neighbouring windows with one anchor form a chunk. Chunks
meet by anchor: an anchor that one chunk holds has nothing to compare; equal chunks (by a 64-bit digest beside the
64-bit anchor) cover each other whole and go on as one; the different chunks of an anchor are suffix-sorted together.
Where the chunks of an anchor exceed ``GROUP_BYTES``, they are cut further by the anchors of another hash, up to
``ROUNDS`` times, and equal pieces collapse again after each; what still exceeds it is spread by its single windows, held
against each other by a digest of 128 bits. So very frequent passages do not gather their surroundings in one task.

Defined results: null text is empty; texts shorter than ``LENGTH`` bytes keep everything; matches never cross rows; equal
rows match each other; nulls and repeats among ids do not matter, rows are told apart by number; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blocks, materialize, mix, pack, parallelism, raw_texts

LENGTH, GRAM = 400, 32
BLOCK_BYTES = 1 << 20
#: Bytes that are suffix-sorted at a time, and bytes of one anchor from which its chunks are cut further.
SORT_BYTES, GROUP_BYTES = 1 << 20, 4 << 20
#: Further hashes that are tried on crowded anchors.
ROUNDS = 3
#: Windows that are digested at a time, and starts of a chunk that are gathered in one row.
WINDOWS, STARTS = 1 << 16, 4096
#: Copies from which a chunk counts as hot: its rows are not dealt by its digest.
HOT_ROWS = 1000


def _named(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, names from 1) of rows of keys."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``s`` (whole numbers of at least 1)."""
    s = s.astype(np.int64)
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    p = np.concatenate([s, np.zeros(4, np.int64)])
    most = int(p.max()) + 1
    # The sample: all positions that are 1 or 2 modulo 3. If n is 1 modulo 3, position n ends the first half.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    a, b, c = p[sample], p[sample + 1], p[sample + 2]
    order, names = _named([(a * most + b) * most + c] if most < 1 << 20 else [a * most + b, c])
    if names.max() < len(names):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    wide = len(rank) + 1
    key0 = p[zero] * wide + rank[zero + 1]
    zero = zero[np.argsort(key0, kind="stable")]
    key0 = p[zero] * wide + rank[zero + 1]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    # Against the first kind one entry and a rank decide, against the second two entries and a rank.
    less1 = np.searchsorted(p[first] * wide + rank[first + 1], key0)
    pair0, pair2 = p[zero] * most + p[zero + 1], p[second] * most + p[second + 1]
    _, code = np.unique(np.concatenate([pair0, pair2]), return_inverse=True)
    less2 = np.searchsorted(code[len(zero) :] * wide + rank[second + 2], code[: len(zero)] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + less1 + less2
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = sample
    return out


def repeated_starts(chunks: list[bytes]) -> list[np.ndarray]:
    """Of each chunk, whether the window at each start is found at another start of any chunk."""
    n = np.array([len(x) - LENGTH + 1 for x in chunks])
    ends = np.cumsum([len(x) + 1 for x in chunks])
    starts = ends - np.array([len(x) + 1 for x in chunks])
    buf = np.frombuffer(b"\0".join([*chunks, b""]), np.uint8)
    s = buf.astype(np.int64) + 2
    s[ends - 1] = 1
    order = suffix_array(s)
    own = np.zeros(len(buf), bool)
    for b, k in zip(starts.tolist(), n.tolist(), strict=True):
        own[b : b + k] = True
    order = order[own[order]]
    left, right = order[:-1], order[1:]
    same = np.arange(len(left))
    for off in (*range(0, LENGTH - 8, 56), LENGTH - 8):  # eight bytes here and there first
        word = _eight(buf, off)
        same = same[word[left[same]] == word[right[same]]]
    views = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    hit = np.zeros(len(buf), bool)
    for at in range(0, len(same), 4096):
        some = same[at : at + 4096]
        equal = some[(views[left[some]] == views[right[some]]).all(1)]
        hit[left[equal]] = hit[right[equal]] = True
    return [hit[b : b + k] for b, k in zip(starts.tolist(), n.tolist(), strict=True)]


def _eight(buf: np.ndarray, off: int) -> np.ndarray:
    """The eight bytes at each position plus ``off``, as one number; short at the end."""
    padded = np.concatenate([buf[off:], np.zeros(8 + off, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf)].copy().view(np.uint64).ravel()


def window_anchors(buf: np.ndarray, seed: int) -> np.ndarray:
    """The anchor of the window at each position of ``buf``; only those of whole windows mean something."""
    base, h, width = np.uint64(0x9E3779B97F4A7C15 + 2 * seed), buf.astype(np.uint64) + np.uint64(1), 1
    factor = base
    while width < GRAM:
        h = h[:-width] * factor + h[width:]
        factor, width = factor * factor, 2 * width
    h = mix(h ^ np.uint64(seed * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF))
    span, m, width = LENGTH - GRAM + 1, h, 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (span - width)], m[span - width :])


def chunks_of(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window's start in the text, windows) of every chunk."""
    none = np.zeros(0, np.int64)
    buf, starts, ends = pack(texts, 1)
    if len(buf) < LENGTH:
        return none, none.view(np.uint64), none, none
    with np.errstate(over="ignore"):
        m = window_anchors(buf, seed)
    length = ends - starts
    count = np.maximum(length - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    if not len(text):
        return none, none.view(np.uint64), none, none
    value = m[starts[text] + at]
    new = np.ones(len(text), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return text[head], value[head], at[head], np.diff(np.append(head, len(text)))


def _repeats_inside(chunk: bytes) -> bool:
    """Whether a chunk may hold a window twice.

    All of up to LENGTH - GRAM + 1 windows share the gram at the last one's start; two that are equal at a distance repeat it
    at that distance. More windows than that have one anchor only where its gram recurs.
    """
    n = len(chunk) - LENGTH + 1
    return n > LENGTH - GRAM + 1 or n > 1 and chunk.find(chunk[n - 1 : n - 1 + GRAM], n) >= 0


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, n = TaskContext.get().partitionId() << 40, 0
    for b in blocks(batches, "text", BLOCK_BYTES):
        texts = raw_texts(b)
        text, anchor, start, count = chunks_of(texts)
        lists = [[[] for _ in texts] for _ in range(5)]
        for t, a, s, k in zip(text.tolist(), anchor.view(np.int64).tolist(), start.tolist(), count.tolist(), strict=True):
            chunk = texts[t][s : s + k + LENGTH - 1]
            for into, x in zip(lists, (a, xxhash.xxh3_64_intdigest(chunk) - (1 << 63), s, k, _repeats_inside(chunk)), strict=True):
                into[t].append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(range(base + n, base + n + len(texts)), pa.int64()), b.column("doc_id"), pa.array(texts, pa.binary()), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds, strict=True))], names=_NAMES)
        n += len(texts)


_SPLIT = "rid long, doc_id long, bytes binary, anchor array<long>, digest array<long>, start array<int>, n array<int>, inside array<boolean>"
_NAMES = [x.split()[0] for x in _SPLIT.split(", ")]
_RANGES = "anchor long, digest long, a int, b int"


def _ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by group -> ranges of repeated starts, counted from the first start of the chunk they were cut from."""

    def out(rows):
        cols: list[list] = [[], [], [], []]
        for (anchor, digest, base, _), hit in zip(rows, repeated_starts([x[3] for x in rows]), strict=True):
            for a, b in zip(*(x.tolist() for x in _ranges(hit)), strict=True):
                for c, x in zip(cols, (anchor, digest, base + a, base + b), strict=True):
                    c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "digest", "a", "b"])

    # Different groups never share a window, so any number of them can be sorted in one go.
    held, size, last = [], 0, None
    for b in batches:
        for group, anchor, digest, base, chunk in zip(*(b.column(k).to_pylist() for k in ("g", "anchor", "digest", "base", "chunk")), strict=True):
            if group != last and size > SORT_BYTES:
                yield out(held)
                held, size = [], 0
            last = group
            held.append((anchor, digest, base, chunk))
            size += len(chunk)
    if held:
        yield out(held)


def _recut(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "chunk", BLOCK_BYTES):
            texts = b.column("chunk").to_pylist()
            g, anchor, digest, base = (b.column(k).to_pylist() for k in ("g", "anchor", "digest", "base"))
            text, value, start, count = (x.tolist() for x in chunks_of(texts, seed))
            pieces = [texts[t][s : s + k + LENGTH - 1] for t, s, k in zip(text, start, count, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_64_intdigest(f"{g[t]},{v}") - (1 << 63) for t, v in zip(text, value, strict=True)], pa.int64()), pa.array([anchor[t] for t in text], pa.int64()), pa.array([digest[t] for t in text], pa.int64()),
                pa.array([base[t] + s for t, s in zip(text, start, strict=True)], pa.int32()), pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in pieces], pa.int64()), pa.array(pieces, pa.binary()),
            ], names=["g", "anchor", "digest", "base", "piece", "chunk"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, a digest of each window of the pieces, and where it starts in the chunk they were cut from."""
    for b in batches:
        for group, anchor, digest, base, chunk in zip(*(b.column(k).to_pylist() for k in ("g", "anchor", "digest", "base", "chunk")), strict=True):
            n = len(chunk) - LENGTH + 1
            for at in range(0, n, WINDOWS):
                some = range(at, min(at + WINDOWS, n))
                made = [hashlib.blake2b(chunk[k : k + LENGTH], digest_size=16).digest() for k in some]
                owner = [pa.array([x] * len(some), pa.int64()) for x in (group, anchor, digest)]
                yield pa.RecordBatch.from_arrays([*owner, pa.array([base + k for k in some], pa.int32()), pa.array(made, pa.binary())], names=["g", "anchor", "digest", "at", "w"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of a chunk -> ranges."""
    for b in batches:
        cols: list[list] = [[], [], [], []]
        for anchor, digest, at in zip(*(b.column(k).to_pylist() for k in ("anchor", "digest", "at")), strict=True):
            x = np.sort(np.array(at, np.int64))
            new = np.flatnonzero(np.diff(x) > 1)
            for a, e in zip(x[np.append(0, new + 1)].tolist(), (x[np.append(new, len(x) - 1)] + 1).tolist(), strict=True):
                for c, v in zip(cols, (anchor, digest, a, e), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "digest", "a", "b"])


def _spread(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Ranges of repeated starts of groups of any size: their windows are dealt by digest, so no group meets in one task."""
    each = materialize(spark, chunks.mapInArrow(_windows, "g long, anchor long, digest long, at int, w binary"), "suffix-windows")
    twice = each.groupBy("g", "w").count().where("count > 1").select("g", "w")
    starts = each.join(twice, ["g", "w"], "left_semi").groupBy("anchor", "digest", F.floor(F.col("at") / STARTS)).agg(F.collect_list("at").alias("at"))
    return starts.select("anchor", "digest", "at").mapInArrow(_joined, _RANGES)


def covered(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, bytes, and starts and stops of the covered ranges (they may touch or overlap; null where there is none)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    split = materialize(spark, rows.mapInArrow(_split, _SPLIT), "suffix-split")
    each = split.select("rid", F.explode(F.arrays_zip("anchor", "digest", "start", "n", "inside")).alias("c")).select("rid", "c.*")
    kinds = each.groupBy("anchor", "digest").agg(F.count("*").alias("times"), F.min(F.struct("rid", "start")).alias("at"), F.first("n").alias("n"), F.max("inside").alias("inside"))
    # Anchors with one chunk that occurs once have nothing to compare.
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + LENGTH).alias("size"))
    kinds = materialize(spark, kinds.join(groups.where("kinds > 1").select("anchor", "kinds", "size"), "anchor", "left").where("times > 1 or kinds > 1 or inside"), "suffix-kinds")
    whole = kinds.where("times > 1").select("anchor", "digest", F.lit(0).alias("a"), F.col("n").alias("b"))
    # A chunk alone under its anchor needs a look only if it may repeat itself and is not covered already.
    some = kinds.where("kinds > 1 or (inside and times = 1)").select(F.col("at.rid").alias("rid"), F.col("at.start").alias("start"), "n", "anchor", "digest", F.coalesce("size", F.lit(0)).alias("size"))
    some = materialize(spark, some, "suffix-chunks")
    texts = split.select("rid", "bytes").join(some.hint("merge"), "rid")  # one way at every size
    chunks = texts.select(F.col("anchor").alias("g"), "anchor", "digest", F.lit(0).alias("base"), F.expr(f"substring(bytes, start + 1, n + {LENGTH - 1})").alias("chunk"), "size")
    parts = parallelism(spark)
    parted = materialize(spark, chunks, "suffix-bytes")
    found = whole
    crowded = parted.where(F.col("size") > GROUP_BYTES).drop("size")
    for seed in range(1, ROUNDS + 1):
        if crowded.isEmpty():
            break
        cut = materialize(spark, crowded.mapInArrow(_recut(seed), "g long, anchor long, digest long, base int, piece long, chunk binary"), "suffix-cut")
        # Equal pieces of a group cover each other whole and go on as one, as the chunks did.
        pieces = cut.groupBy("g", "piece").agg(F.count("*").alias("times"), F.min(F.struct("anchor", "digest", "base", "chunk")).alias("c"))
        pieces = materialize(spark, pieces.select("g", "piece", "times", "c.*"), "suffix-pieces")
        starts = (F.length("chunk") - (LENGTH - 1)).alias("n")
        twice = cut.select("g", "piece", "anchor", "digest", "base", starts).join(pieces.where("times > 1").select("g", "piece"), ["g", "piece"], "left_semi")
        found = found.union(twice.select("anchor", "digest", F.col("base").alias("a"), (F.col("base") + F.col("n")).alias("b")))
        # One piece alone is only compared with itself, where it is long enough for that and not covered already.
        sizes = pieces.groupBy("g").agg(F.count("*").alias("k"), F.sum(F.length("chunk")).alias("size"), F.max(F.when(F.col("times") == 1, F.length("chunk"))).alias("longest"))
        sizes = materialize(spark, sizes.where(f"k > 1 or longest > {LENGTH}"), "suffix-sizes")
        # At most one for each GROUP_BYTES of text, so they are broadcast and a crowded group is never gathered.
        large = F.broadcast(sizes.where(F.col("size") > GROUP_BYTES).select("g"))
        crowded = pieces.join(large, "g", "left_semi")
        small = pieces.join(large, "g", "left_anti").join(sizes.where(F.col("size") <= GROUP_BYTES).select("g"), "g", "left_semi")
        found = found.union(_found(small, parts))
    if not crowded.isEmpty():
        found = found.union(_spread(spark, crowded))
    found = materialize(spark, found.union(_found(parted.where(F.col("size") <= GROUP_BYTES), parts)), "suffix-found")
    # A chunk with copies is covered whole. Those with very many are at most BROADCAST_ROWS by the choice of the bound.
    total = kinds.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = F.broadcast(kinds.where(F.col("times") > max(HOT_ROWS, total // BROADCAST_ROWS)).select("anchor", "digest"))
    often = each.join(hot, ["anchor", "digest"], "left_semi").select("rid", "anchor", "digest", "start", F.lit(0).alias("a"), F.col("n").alias("b"))
    rest = each.select("rid", "anchor", "digest", "start").join(hot, ["anchor", "digest"], "left_anti").join(found.join(hot, ["anchor", "digest"], "left_anti"), ["anchor", "digest"])
    ranges = often.unionByName(rest)
    per = ranges.groupBy("rid").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + LENGTH - 1).alias("b"))).alias("r"))
    return split.select("rid", "doc_id", "bytes").join(per, "rid", "left").select("doc_id", "bytes", F.col("r.a").alias("a"), F.col("r.b").alias("b"))


def _found(chunks: DataFrame, parts: int) -> DataFrame:
    dealt = chunks.select("g", "anchor", "digest", "base", "chunk").repartition(parts, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(_compared, _RANGES)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>, kept binary"


def _cleaned(batches: Iterator[pa.RecordBatch], schema: str) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in schema.split(", ")]
    for b in blocks(batches, "bytes", BLOCK_BYTES):
        cols: list[list] = [[] for _ in range(7)]
        for text, starts, stops in zip(b.column("bytes").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            s, e = [], []
            if starts:
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, stops, -1)
                s, e = (x.tolist() for x in _ranges(np.cumsum(edge[:-1]) > 0))
            kept = b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)], strict=True))
            for c, x in zip(cols, (len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), s, e, kept), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))][: len(names)], names=names)


def remove_repeats(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and stops of the removed runs and, if ``whole``, kept (the bytes that stay)."""
    schema = _RESULT if whole else _RESULT.rsplit(", ", 1)[0]
    return covered(spark, docs, doc_id, text).mapInArrow(lambda batches: _cleaned(batches, schema), schema)


#: For small tables: every string of LENGTH bytes by a digest.
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i::BIGINT AS i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS d FROM (SELECT r, h, unnest(generate_series(0, length(h) // 2 - {LENGTH})) AS i FROM t)),
c AS (SELECT r, i FROM w SEMI JOIN (SELECT d FROM w GROUP BY d HAVING count(*) > 1) USING (d)),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM c),
k AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
s AS (SELECT r, run, min(i) AS a, max(i) + {LENGTH} AS b FROM k GROUP BY r, run),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY run), 0) AS z FROM s),
n AS (SELECT r, count(*) AS n, sum(b - a)::BIGINT AS gone, max(b) AS last, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY run) AS kept FROM o JOIN t USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256, coalesce(starts, []) AS starts, coalesce(stops, []) AS stops
FROM t LEFT JOIN n USING (r)
"""
