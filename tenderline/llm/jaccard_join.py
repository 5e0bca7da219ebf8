"""Similarity join on word shingles by T-occurrence search.

Two documents link when ``den * |intersection| >= num * |union|`` of their shingle sets.

1. Every row gets a number and its set's fingerprint; of rows in one task that hold equal sets only the first goes on.
2. Candidates by pigeonhole. Two linked sets of at most s shingles differ in at most d = 2 s (den - num) / (den + num)
   shingles. The shingles' range is cut into more than d parts, so some part is equal in both. A set sends one key for each
   part that is not empty, made from the part's content, under the size class in which it can be the larger set and under
   the next one; linked sizes never lie further apart. There are some more parts than d + 1, the allowance: a set whose keys
   that others share, together with its empty parts, do not exceed it has d + 1 parts of its own, so it links with nothing
   and leaves. That is asked again of the sets that remain. (Two sets that both have more empty parts than the allowance may
   have no filled part in common; such sets also send the shingles of least hash, so many that linked sets have one of them in common.)
   So linked sets stay and share a key, and sets that share a passage mostly leave. Rows with equal keys are chained to the first of them.
3. The chains' components are clusters that no link leaves. In each, a set looks for the earlier (not larger) ones that
   share at least T shingles with it (T follows from its size and the least size that can link): a heap merges the short inverted lists, skipping ids that too few lists can hold; the L longest
   (DivideSkip) are probed by binary search for the sets that reached T - L. Sets whose component is already joined to the
   asking one need no search, so a task returns a spanning forest of its links.
   A cluster of more than ``CLUSTER`` shingles is cut into blocks that are searched together with one small hub; what the
   hub joins needs no further search. Keys that sets of different components still share make new, smaller clusters of the rest. Only
   where one of those is too large again, every two of its blocks meet in a task of their own.
4. The links' components are the result.

Shingles are 64-bit hashes of their words.

Defined results: null and empty texts, and texts of white space, have the empty set, link with nothing and are a component
of their own, named by their own id; with fewer words than a shingle has, the whole sequence is the one shingle; a null
id is greater than any other; equal rows link like any equal texts; an empty table gives an empty result. Other columns
are carried by position, so clashing names are kept.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, among, blocks, col, materialize, mix, pack, parallelism, raw_texts, recorded, release, remove, run_hashes, unread, without, word_hashes, word_spans
from .components import components

BLOCK_BYTES = 1 << 20
#: The keys are shuffled in so many slices, one after the other, where there are more shingles than that: most keys are no
#: other set's, and the files of a slice go before the next one is made.
SLICES, SLICED = 4, 2_000_000
#: Shingles of a cluster that one task holds.
CLUSTER = 1_000_000
#: The hub is this part of a block.
HUB = 4
#: Rows from which a component counts as hot: its rows are not dealt by its name.
HOT_ROWS = 1000
#: Weight of a binary probe against a merged entry in the choice of L.
MU = 0.002


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the texts' sorted distinct shingles one after the other, and where each text's stop."""
    texts = [t.lower() for t in texts]  # A-Z only: these are bytes
    buf, starts, ends = pack(texts, 1)
    w0, w1 = word_spans(buf, starts, ends)
    first = np.searchsorted(w0, starts)
    count = np.searchsorted(w0, ends) - first
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    size = np.minimum(count, k)[owner]
    h = mix(run_hashes(word_hashes(buf, w0, w1), at, size) + size.astype(np.uint64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.cumsum(np.bincount(owner[new], minlength=len(texts)))


def _prints(h: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(size, sum, sum) of each set: equal for equal sets."""
    starts = np.concatenate([[0], ends[:-1]])
    s1, s2 = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(x)), dtype=np.uint64)]) for x in (1, 2))
    return list(zip((ends - starts).tolist(), (s1[ends] - s1[starts]).tolist(), (s2[ends] - s2[starts]).tolist(), strict=True))


@lru_cache(None)
def _bounds(num: int, den: int) -> np.ndarray:
    """Least sizes of the size classes: a linked partner's size lies in the same class or the next one."""
    b = [1]
    while b[-1] < 1 << 40:
        b.append(b[-1] * den // num + 1)
    return np.array(b)


@lru_cache(None)
def _parts(c: int, num: int, den: int) -> tuple[int, int]:
    """(parts, empty parts that do no harm) where the larger set is of class ``c``."""
    b = _bounds(num, den)
    differ = int(2 * (b[c + 1] - 1) * (den - num) // (den + num))
    if not differ:
        return 1, 0
    slack = 1 + math.ceil(2 * differ * math.exp(-b[max(c - 1, 0)] / (differ + 1)))
    return differ + 1 + slack, slack


def keys(h: np.ndarray, ends: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, twice the position of the set plus 1 for the next class, shared keys that do not matter) of all sets that are not empty."""
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    c = np.searchsorted(_bounds(num, den), n, side="right") - 1
    out_k, out_s, out_a = [], [], []
    for up in (0, 1):
        own = np.maximum(c, 0) + up
        table = {x: _parts(int(x), num, den) for x in np.unique(own)}
        g, slack = (np.array([table[x][k] for x in own]) for k in (0, 1))
        which = np.repeat(np.arange(len(n)), n)
        part = ((h >> np.uint64(32)) * g[which].astype(np.uint64)) >> np.uint64(32)  # rises with h: a part's shingles are neighbours
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (part[1:] != part[:-1]) | (which[1:] != which[:-1])
            at = np.flatnonzero(new)
            total = np.add.reduceat(mix(h + np.uint64(3)), at)
            out_k.append(mix(total + mix(own[which[at]].astype(np.uint64) << np.uint64(40) | part[at])))
            full = np.bincount(which[at], minlength=len(n))
            allow = slack - (g - full)
            # Sets with too many empty parts: of n shingles in the order of their hashes, linked sets share one of the first n - T + 1.
            many = np.flatnonzero((n > 0) & (allow < 0))
            first = n[many] + num * n[many] // -den + 1
            few = np.repeat(many, first)
            place = np.repeat(starts[many], first) + np.arange(len(few)) - np.repeat(np.cumsum(first) - first, first)
            out_k.append(mix(mix(h[place] + np.uint64(5)) + own[few].astype(np.uint64)))
            for x in (which[at], few):
                out_s.append(2 * x + up)
                out_a.append(allow[x])
    if not out_k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_k), np.concatenate(out_s), np.concatenate(out_a)


def _numbered(k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 40, 0
        seen: dict[tuple, int] = {}
        for b in blocks(batches, "_text", BLOCK_BYTES):
            prints = _prints(*shingle_sets(raw_texts(b, "_text"), k))
            rid = [base + n + r for r in range(len(prints))]
            rep = [r if not p[0] else seen.setdefault(p, r) for r, p in zip(rid, prints, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(rep, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), *b.columns], names=["_rid", "_rep", "_n", *names])
            n += len(prints)

    return run


def _keyed(k: int, num: int, den: int, slices: int, mine: int):
    """The keys that fall into slice ``mine``, by their lowest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK_BYTES):
            key, at, allow = keys(*shingle_sets(raw_texts(b, "_text"), k), num, den)
            if slices > 1:
                some = np.flatnonzero(key % np.uint64(slices) == np.uint64(mine))
                key, at, allow = key[some], at[some], allow[some]
            rid = 2 * b.column("_rid").to_numpy()[at >> 1] + (at & 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid), pa.array(allow.astype(np.int32))], names=["key", "rid", "allow"])

    return run


_KEYED = "key long, rid long, allow int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has too; a single row is held back between batches."""
    held, shared_before = None, []
    for b in batches:
        b = pa.RecordBatch.from_arrays([pa.concat_arrays([held.column(k), b.column(k)]) for k in range(3)], names=b.schema.names) if held is not None else b
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if shared_before and key[0] == shared_before[0]:
            keep[0] = True
        # The last row waits for the next batch, unless its key is known to be shared.
        held = None if keep[-1] else b.slice(b.num_rows - 1)
        if keep.any():
            yield b.filter(pa.array(keep))
        shared_before = [key[-1]] if keep[-1] else []


def _candidates(spark: SparkSession, numbered: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A written table of the keys (key, rid, allow) that several sets have."""
    sets = numbered.where("_rep = _rid and _n > 0")
    slices = SLICES if (sets.agg(F.sum("_n")).first()[0] or 0) > SLICED else 1
    found = []
    for mine in range(slices):
        keyed = sets.select("_rid", "_text").mapInArrow(_keyed(k, num, den, slices, mine), _KEYED)
        found.append(materialize(spark, keyed.repartition(parallelism(spark), "key").sortWithinPartitions("key").mapInArrow(_shared, _KEYED), "shared"))
        release(spark)
    return reduce(DataFrame.union, found)


def _remaining(spark: SparkSession, shared: DataFrame, rounds: int = 2) -> DataFrame:
    """The shared rows of the sets whose shared keys exceed what is allowed, asked ``rounds`` times."""
    for _ in range(rounds):
        some = shared.groupBy("rid").agg(F.count("*").alias("n"), F.first("allow").alias("a")).where("n > a").select("rid")
        left = shared.join(some, "rid", "left_semi")
        lists = left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        shared = materialize(spark, left.join(lists, "key", "left_semi").select("key", "rid", "allow"), "shared")
        release(spark)
    return shared


def merged(lists: list[np.ndarray], weights: list[int], least: int):
    """(number, weight) of the numbers whose lists (rising) weigh at least ``least`` together, by a heap of the lists' heads.

    Where too few heads are equal, the smallest heads that together stay below ``least`` jump to the next head: no number before it
    can reach ``least``.
    """
    heap = [(int(x[0]), k) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while heap:
        top, popped, total = heap[0][0], [], 0
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
            total += weights[popped[-1]]
        if total >= least:
            yield top, total
            to = top + 1
        else:
            while heap and total + weights[heap[0][1]] < least:
                popped.append(heapq.heappop(heap)[1])
                total += weights[popped[-1]]
            if not heap:
                return
            to = heap[0][0]
        for k in popped:
            x = lists[k]
            if x[at[k]] < to:
                at[k] = bisect_left(x, to, at[k] + 1)
            if at[k] < len(x):
                heapq.heappush(heap, (int(x[at[k]]), k))


class Parts:
    """Which sets are joined; the smaller side is renamed."""

    def __init__(self, n: int):
        self.of, self.members = np.arange(n), [[k] for k in range(n)]

    def join(self, a: int, b: int) -> None:
        a, b = int(self.of[a]), int(self.of[b])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []


def search(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets (sorted hashes), by positions. Sizes must rise."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    parts, left = Parts(m), 0  # components among the sets so far
    out: list[tuple[int, int]] = []
    owner = np.repeat(np.arange(m), size)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")  # by shingle, then by set
    lists = owner[order].astype(np.int32)
    sorted_h = flat[order]
    head = np.ones(len(flat), bool)
    head[1:] = sorted_h[1:] != sorted_h[:-1]
    first = np.flatnonzero(head)
    # Shingles that the same sets hold (those of one passage, say) share one list, which weighs as much as they are many.
    length = np.diff(np.append(first, len(flat)))
    kind = np.add.reduceat(mix(lists.astype(np.uint64) + np.uint64(1)), first) + mix(length.astype(np.uint64)) if len(flat) else sorted_h
    _, one, place = np.unique(kind, return_index=True, return_inverse=True)
    number = np.cumsum(head) - 1
    begin = first[number]
    start_of, before = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    start_of[order] = first[one][place][number] if len(flat) else begin
    before[order] = np.arange(len(flat)) - begin  # sets before this one in the list
    ends = np.cumsum(size)
    for q in range(m):
        left += 1
        sl = slice(ends[q] - size[q], ends[q])
        start, length = start_of[sl], before[sl]
        low = int(np.searchsorted(size, -(-num * size[q] // den)))
        if low == q:
            continue
        # Common shingles that the smallest set not too small to link needs; the larger ones need no fewer.
        least = int(-(-num * (size[q] + size[low]) // (num + den)))
        if np.count_nonzero(length) < least:
            continue
        start, where, weight = np.unique(start, return_index=True, return_counts=True)
        length = length[where]
        by = np.argsort(length, kind="stable")
        weight = weight[by]
        most = min(least - 1, int(least / (MU * math.log2(max(2, length[by[-1]])) + 1)))
        cut = int(np.searchsorted(-np.cumsum(weight[::-1])[::-1], -most))  # the longest lists from here on weigh L or less
        aside = int(weight[cut:].sum())
        mine = [lists[s : s + n] for s, n in zip(start[by].tolist(), length[by].tolist(), strict=True)]
        short, long, weight = mine[:cut], mine[cut:], weight.tolist()
        if low:  # too small to link
            short = [x[np.searchsorted(x, low) :] for x in short]
        while left > 1:
            joined, last = _first_links(merged(short, weight, least - aside), long, weight[cut:], size, q, parts, num, den)
            for c in joined:
                out.append((q, c))
                parts.join(q, c)
                left -= 1
            if not joined:
                break
            # The sets that are joined now, and those that have been looked at, leave the lists.
            short = [x[np.searchsorted(x, last, side="right") :] for x in short]
            short = [x[parts.of[x] != parts.of[q]] for x in short]
    return out


def _first_links(found, long: list[np.ndarray], weight: list[int], size: np.ndarray, q: int, parts: Parts, num: int, den: int) -> tuple[list[int], int]:
    """(sets of different components that link with ``q``, the last set looked at), from the first candidates in which there is such a set."""
    step = 8
    while True:
        some = [x for _, x in zip(range(step), found, strict=False)]
        if not some:
            return [], 0
        last = some[-1][0]
        step = min(4 * step, 1024)
        now, have = np.array(some).T
        need = -(-num * (size[q] + size[now]) // (num + den))
        rest = sum(weight)
        for x, w in zip(long, weight, strict=True):
            alive = have + rest >= need
            if not alive.all():
                now, have, need = now[alive], have[alive], need[alive]
                if not len(now):
                    break
            rest -= w
            if len(x):
                have = have + w * (x[np.minimum(x.searchsorted(now), len(x) - 1)] == now)
        linked = {int(parts.of[c]): c for c in now[have >= need].tolist()}
        if linked:
            return list(linked.values()), last


def _searched(k: int, num: int, den: int):
    def links(rids: list[int], texts: list[bytes]):
        sets, some, size = [], [], 0
        for n, t in enumerate(texts, 1):  # a bounded part of the texts at a time
            some.append(t)
            size += len(t)
            if size > BLOCK_BYTES or n == len(texts):
                h, ends = shingle_sets(some, k)
                sets += [x.copy() for x in np.split(h, ends[:-1])]
                some, size = [], 0
        by = sorted(range(len(rids)), key=lambda r: (len(sets[r]), rids[r]))
        found = search([sets[r] for r in by], num, den)
        return pa.RecordBatch.from_arrays([pa.array([rids[by[a]] for a, _ in found], pa.int64()), pa.array([rids[by[b]] for _, b in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rids, texts = None, [], []
        for b in batches:
            for group, rid, text in zip(b.column("g").to_pylist(), b.column("_rid").to_pylist(), raw_texts(b, "_text"), strict=True):
                if group != last and rids:
                    yield links(rids, texts)
                    rids, texts = [], []
                last = group
                rids.append(rid)
                texts.append(text)
        if rids:
            yield links(rids, texts)

    return run


def number(spark: SparkSession, docs: DataFrame, carry: list[str], k: int, text: str, doc_id: str) -> DataFrame:
    """A written table: _rid, _rep (the first row of the task with an equal set), _n (its size), _id, _text, _0, _1, ... (the columns in ``carry``)."""
    own = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(doc_id).cast("long").alias("_id"), *(col(c).alias(o) for c, o in zip(carry, own, strict=True)))
    schema = "_rid long, _rep long, _n long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialize(spark, rows.mapInArrow(_numbered(k, rows.columns), schema), "shingled")


def grouped(spark: SparkSession, numbered: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """_rid, component_id, kept for each row of the written table: the component's least id, and one row of those with that id."""
    with recorded() as paths:
        shared = _remaining(spark, _candidates(spark, numbered, k, num, den))
        shared = materialize(spark, shared.select("key", F.shiftright("rid", 1).alias("a")), "shared")
    remove(spark, unread(paths, shared))
    clusters = _chained(spark, shared)
    links = _links(spark, numbered, shared, clusters, k, num, den)
    comps = components(spark, links)
    at = numbered.select("_rid", "_rep", "_id").join(comps.select(F.col("v").alias("_rep"), "comp"), "_rep", "left").withColumn("comp", F.coalesce("comp", "_rep"))
    at = materialize(spark, at.select("_rid", "_id", "comp"), "near-rows")
    no_id = F.lit((1 << 63) - 1)
    least = at.groupBy("comp").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("_id", no_id).alias("i"), F.col("_rid").alias("r"), F.col("_id").alias("id"))).alias("k"))
    least = materialize(spark, least.where("n > 1"), "near-least")  # a row alone needs no look-up
    # Hot components are at most BROADCAST_ROWS by the choice of the bound, so their rows stay where they are.
    hot = F.broadcast(least.where(F.col("n") > max(HOT_ROWS, numbered.count() // BROADCAST_ROWS)).drop("n"))
    out = at.join(hot, "comp").unionByName(at.join(hot.select("comp"), "comp", "left_anti").join(least.drop("n"), "comp", "left"))
    return out.select("_rid", F.when(F.col("k").isNull(), F.col("_id")).otherwise(F.col("k.id")).alias("component_id"), F.coalesce(F.col("_rid") == F.col("k.r"), F.lit(True)).alias("kept"))


def _chained(spark: SparkSession, shared: DataFrame) -> DataFrame:
    """(v, comp) of the sets that shared keys chain together."""
    first = shared.groupBy("key").agg(F.min("a").alias("b"))
    return components(spark, shared.join(first, "key").select("a", "b"))


def join(spark: SparkSession, docs: DataFrame, carry: list[str], k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row: _0, _1, ... (the columns in ``carry``), n_shingles, component_id, kept.

    component_id is the least id of the component, kept marks one row of it: with that id, or the first such.
    """
    numbered = number(spark, docs, carry, k, text, doc_id)
    out = numbered.drop("_text", "_id", "_rep").join(grouped(spark, numbered, k, num, den), "_rid")
    return out.select(*(f"_{i}" for i in range(len(carry))), F.col("_n").alias("n_shingles"), "component_id", "kept")


def _sized(spark: SparkSession, sizes: DataFrame, clusters: DataFrame) -> DataFrame:
    """A written table of the clusters' sets: v, n, comp, blocks. Shingles are summed before the shuffle; only clusters of several blocks are joined back."""
    members = materialize(spark, sizes.join(clusters, "v"), "members")
    large = members.groupBy("comp").agg(F.sum("n").alias("total")).where(F.col("total") > CLUSTER)
    large = materialize(spark, large.select("comp", F.ceil(F.col("total") / CLUSTER).cast("int").alias("blocks")), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    return members.join(large, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _links(spark: SparkSession, numbered: DataFrame, shared: DataFrame, clusters: DataFrame, k: int, num: int, den: int) -> DataFrame:
    sizes = numbered.where("_rep = _rid and _n > 0").select(F.col("_rid").alias("v"), F.col("_n").alias("n"))
    members = _sized(spark, sizes, clusters)
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    # Some sets of a large cluster, a part of a block together, meet all of its blocks.
    hub = F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks") * HUB) == 0
    to = F.when((F.col("blocks") > 1) & hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    first = materialize(spark, _found(spark, numbered, members.select("v", F.explode(to).alias("p"), "comp").select("v", F.concat_ws("-", "comp", "p").alias("g")), k, num, den), "links")
    large = materialize(spark, members.where("blocks > 1").select("v"), "large-sets")
    if large.isEmpty():
        return first
    # What may still link are sets of different components that share a key.
    joined = components(spark, first)
    rows = shared.join(large.withColumnRenamed("v", "a"), "a", "left_semi").join(joined.withColumnRenamed("v", "a"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    rows = materialize(spark, rows.select("key", "a", "comp"), "shared")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    again = _sized(spark, sizes, _chained(spark, materialize(spark, rows.join(mixed, "key", "left_semi").select("key", "a"), "shared")))
    # Rows of blocks i <= j meet in the group (comp, i, j).
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    groups = again.select("v", F.explode(pair).alias("p"), "comp").select("v", F.concat_ws("-", "comp", "p.i", "p.j").alias("g"))
    return first.union(materialize(spark, _found(spark, numbered, groups, k, num, den), "links"))


def _found(spark: SparkSession, numbered: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of the sets that meet in a group (v, g)."""
    members = materialize(spark, groups.select(F.col("v").alias("_rid"), "g"), "clusters")
    texts = numbered.select("_rid", "_text")
    if members.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(members), "_rid")
    else:  # only the members' texts move
        texts = among(spark, texts, members.select("_rid").distinct(), "_rid").join(members, "_rid")
    dealt = texts.select("g", "_rid", "_text").repartition(parallelism(spark), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(_searched(k, num, den), "a long, b long")


def op(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for three words and 90 %."""
    return join(spark, docs, ["doc_id"], k=3, num=90, den=100).select(F.col("_0").alias("doc_id"), "n_shingles", "component_id")


def keep(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, with all columns."""
    names = docs.columns
    # The operator's own columns stand for id and text; they are carried once if their types are the operator's.
    twice = [n for n in names if names.count(n) > 1]
    same = {n: o for n, o, kind in (("text", "_text", "string"), ("doc_id", "_id", "bigint")) if dict(docs.dtypes).get(n) == kind and n not in twice}
    carry = [n for n in names if n not in same]
    numbered = number(spark, docs, carry, k, "text", "doc_id")
    dropped = materialize(spark, grouped(spark, numbered, k, num, den).where("not kept").select("_rid"), "near-dropped")
    own = iter(range(len(carry)))
    return without(spark, numbered, dropped, "_rid").select(*(F.col(same[n] if n in same else f"_{next(own)}").alias(n) for n in names))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT s.* FROM s SEMI JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM often a JOIN often b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
