"""Exact dedup, Jaccard join and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderline.llm import common, components, exact_dedup, jaccard_join, queries, suffix_dedup
from tenderline.llm.common import materialize, table

from ..compare import duck, same
from . import cases

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), (i is None, i or 0), i))
    out = []
    for norm, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[2], members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def test_exact(spark, sf_dir):
    same(queries.queries()["op2_exact_dedup"](spark, sf_dir), exact_dedup.SQL, sf_dir)


@pytest.mark.parametrize("bounds", [(24 << 20, 64, 64 << 20), (500, 8, 400)])
def test_exact_cases(spark, monkeypatch, bounds):
    for name, v in zip(("BLOCK_BYTES", "DIGIT", "GROUP_BYTES"), bounds, strict=True):
        monkeypatch.setattr(exact_dedup, name, v)
    rows = [r[:2] for r in cases.rows()] + [(100 + i, "the same beginning of many texts, longer than a digit " * 3 + str(i % 7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(spark, docs).collect())
    assert got == exact_brute(rows)


def test_exact_routes(spark, monkeypatch):
    """Texts that begin alike are parted before they move; equal ones stay together."""
    monkeypatch.setattr(exact_dedup, "GROUP_BYTES", 2000)
    rows = [(i, "x" * 600 + str(i % 40) * 9) for i in range(200)] + [(300 + i, "y" * 50) for i in range(90)] + [(500, ""), (501, None)]
    local = exact_dedup.locally(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("n is not null")
    routed = exact_dedup._routed(spark, local, local.select("digits", F.col("text").alias("norm")))
    sizes = {r.grp: (r.s, r.k) for r in routed.groupBy("grp").agg(F.sum(F.length("norm")).alias("s"), F.count_distinct("norm").alias("k")).collect()}
    assert all(s <= 2000 or k == 1 for s, k in sizes.values()) and len(sizes) == 42
    assert routed.groupBy("norm").agg(F.count_distinct("grp").alias("g")).where("g > 1").count() == 0


def test_exact_keep(spark):
    kept = exact_dedup.keep(spark, cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    norms = [SPACE.sub("", r.text or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({SPACE.sub("", r[1] or "") for r in cases.rows()})
    assert exact_dedup.groups(spark, cases.empty(spark)).count() == 0 and exact_dedup.keep(spark, cases.empty(spark)).count() == 0


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    return out


def jaccard_brute(rows, k, num, den):
    sets = sets_of(rows, k)
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and den * common >= num * (len(a) + len(sets[j]) - common):
                up[find(i)] = find(j)
    roots = [find(i) for i in range(len(rows))]
    best = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    return Counter((i, len(s), None if best[r][0] else best[r][1]) for (i, _), s, r in zip(rows, sets, roots, strict=True))


def test_merge_of_lists():
    random.seed(12)
    for _ in range(300):
        lists = [np.array(sorted(random.sample(range(40), random.randint(0, 25))), np.int32) for _ in range(random.randint(1, 9))]
        weights = [random.randint(1, 3) for _ in lists]
        least = random.randint(1, sum(weights))
        count = Counter()
        for y, w in zip(lists, weights, strict=True):
            count.update(dict.fromkeys(y.tolist(), w))
        assert list(jaccard_join.merged(lists, weights, least)) == sorted((x, n) for x, n in count.items() if n >= least)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_search(num, den):
    """The forest of a search joins exactly what all pairs join."""
    rng = np.random.default_rng(num)
    for _ in range(30):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)])) for _ in range(25)]
        sets += [np.unique(np.append(base[k:], base[:1])) for k in range(0, 12, 2)] * 2
        sets.sort(key=len)

        def joined(links):
            p = jaccard_join.Parts(len(sets))
            for a, b in links:
                if p.of[a] != p.of[b]:
                    p.join(a, b)
            return {tuple(np.flatnonzero(p.of == x)) for x in p.of}

        size = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if den * size(a, b) >= num * (len(sets[a]) + len(sets[b]) - size(a, b))]
        got = jaccard_join.search(sets, num, den)
        assert joined(got) == joined(pairs) and len(got) == len(sets) - len(joined(pairs)) and set(got) <= set(pairs)


def test_sets_with_many_empty_parts_meet():
    """Two like sets whose shingles all fall into one part, so that no filled part of theirs is equal, still share a key."""
    a = np.sort(np.arange(40, dtype=np.uint64) * np.uint64(3) + np.uint64(7))
    b = np.sort(np.append(a[:-1], np.uint64(9999)))
    other = np.sort(np.arange(40, dtype=np.uint64) * np.uint64(5) + np.uint64(1 << 20))
    key, at, _ = jaccard_join.keys(np.concatenate([a, b, other]), np.array([40, 80, 120]), 90, 100)
    own = [set(key[at >> 1 == k].tolist()) for k in range(3)]
    assert own[0] & own[1] and not own[2] & (own[0] | own[1])


@pytest.mark.parametrize(("k", "num", "cluster"), [(3, 90, 1_000_000), (5, 80, 1_000_000), (5, 80, 300), (1, 60, 1_000_000)])
def test_jaccard(spark, monkeypatch, k, num, cluster):
    monkeypatch.setattr(jaccard_join, "CLUSTER", cluster)
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 3)
    random.seed(k)
    base = [cases.words(random.randint(5, 120), 50 + s).split() for s in range(6)]
    rows = [r[:2] for r in cases.rows()]
    for n in range(80):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = random.choice(["zu", "za", "KA"])
        rows.append((200 + n, " ".join(w[random.randint(0, 2) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in jaccard_join.join(spark, docs, ["doc_id"], k, num, 100).select("_0", "n_shingles", "component_id").collect())
    assert got == jaccard_brute(rows, k, num, 100)


def test_jaccard_slices(spark, monkeypatch):
    """The keys of a large table are shuffled slice by slice, and long lists of rows move no other texts; neither changes the result."""
    rows = [(i, cases.words(60, 500 + i // 3) + " tail" * (i % 2)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    numbered = jaccard_join.number(spark, docs, ["doc_id"], 3, "text", "doc_id")
    whole = {tuple(r) for r in jaccard_join._candidates(spark, numbered, 3, 90, 100).collect()}
    monkeypatch.setattr(jaccard_join, "SLICED", 0)
    written = []
    monkeypatch.setattr(jaccard_join, "materialize", lambda spark, df, name: (written.append((name, out := materialize(spark, df, name))), out)[1])
    cut = jaccard_join._candidates(spark, numbered, 3, 90, 100)
    slices = [{r.key % jaccard_join.SLICES for r in t.collect()} for n, t in written if n == "shared"]
    assert slices == [{k} for k in range(jaccard_join.SLICES)]
    assert {tuple(r) for r in cut.collect()} == whole
    for m in (common, jaccard_join):
        monkeypatch.setattr(m, "BROADCAST_ROWS", 4)
    assert Counter(tuple(r) for r in jaccard_join.op(spark, docs).collect()) == jaccard_brute(rows, 3, 90, 100)


@pytest.mark.parametrize("most", [4, 30, 500])
def test_among(spark, monkeypatch, most):
    """The three ways to find rows by number give the same, and the bits move no row."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    numbers = [*range(0, 900, 7), 63, 64, 127, *range(5 << 40, (5 << 40) + 70)]
    rows = spark.createDataFrame([(x, str(x)) for x in [*range(900), *range(5 << 40, (5 << 40) + 99)]], "n long, t string")
    picked = spark.createDataFrame([(x,) for x in numbers], "n long")
    inside, outside = common.among(spark, rows, picked, "n"), common.without(spark, rows, picked, "n")
    assert {r.n for r in inside.collect()} == set(numbers) and inside.columns == rows.columns == outside.columns
    assert {r.n for r in outside.collect()} == {r.n for r in rows.collect()} - set(numbers)
    assert most == 4 or "SortMergeJoin" not in outside._jdf.queryExecution().executedPlan().toString()


def test_jaccard_query(spark, sf_dir):
    got = Counter(tuple(r) for r in queries.queries()["op6_jaccard_join"](spark, sf_dir).collect())
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert got == jaccard_brute(rows, 3, 90, 100)


def test_jaccard_keep(spark):
    docs = cases.frame(spark)
    kept = jaccard_join.keep(spark, docs)
    assert kept.columns == docs.columns
    rows = [r[:2] for r in cases.rows()]
    empties = sum(not s for s in sets_of(rows, 5))
    brute = jaccard_brute(rows, 5, 80, 100)
    assert kept.count() == empties + len({c for (_, n, c) in brute if n})
    assert jaccard_join.op(spark, cases.empty(spark)).count() == 0 and jaccard_join.keep(spark, cases.empty(spark)).count() == 0


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {v: v for e in edges for v in e}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        up[find(a)] = find(b)
    got = {r.v: r.comp for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: find(v) for e in edges for v in e if e[0] != e[1]}
    assert set(got) == set(want) and len({(got[v], want[v]) for v in want}) == len(set(want.values())) == len(set(got.values()))


def suffix_brute(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        c = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                c[k] += 1
                c[k + length] -= 1
        gone = np.cumsum(c[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_array():
    random.seed(8)
    for n in (*range(1, 30), 300):
        for k in (1, 2, 3, 250):
            s = np.array([random.randint(1, k) for _ in range(n)])
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: tuple(s[i:]))


@pytest.mark.parametrize("crowded", [4 << 20, 2000])
def test_suffix(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", crowded)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 3)
    random.seed(2)
    p = cases.words(700, 77)
    junk = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    rows = [r[:2] for r in cases.rows() if len(r[1] or "") < 20_000] + [(300, p[:399]), (301, p[:400]), (302, p[1:401]), (303, "ab" * 300), (304, junk(90) * 9), (305, junk(30) + p[900:1500] + junk(50) + p[900:1500])]
    rows += [(400 + n, junk(random.randint(0, 200)) + p[(s := random.randint(0, 1500)) : s + random.randint(300, 700)] + junk(random.randint(0, 200))) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(spark, docs)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == suffix_brute(rows)
    whole = got.collect()
    assert all(len(r.kept) == r.n_bytes - r.n_removed and len(r.starts) == r.n_spans for r in whole)


def test_suffix_hot_passage(spark, monkeypatch):
    """One passage in many surroundings: no group of several chunks beyond GROUP_BYTES goes to one task, and the result is whole."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4000)
    sizes, found = [], suffix_dedup._found

    def watched(chunks, parts):
        sizes.extend(r.s for r in chunks.groupBy("g").agg(F.sum(F.length("chunk")).alias("s"), F.count("*").alias("k")).where("k > 1").collect())
        return found(chunks, parts)

    monkeypatch.setattr(suffix_dedup, "_found", watched)
    random.seed(5)
    p = cases.words(200, 78)[:600]
    junk = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    fronts = [junk(300) for _ in range(60)]
    rows = [(n, fronts[n] + p + junk(300)) for n in range(60)]
    # Some share a part of their surroundings with another, so windows across the border repeat too.
    rows += [(60 + n, junk(50) + fronts[n][200:] + p + junk(40)) for n in range(8)] + [(70, "ab" * 3000), (71, junk(7) * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(spark, docs, whole=False).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == suffix_brute(rows)
    assert max(sizes) <= 4000


def test_suffix_query(spark, sf_dir):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.queries()["op10_suffix_dedup"](spark, sf_dir).collect())
    names, rows = duck("SELECT doc_id, text FROM documents", sf_dir)
    assert got == suffix_brute(rows)
    same(queries.queries()["op10_suffix_dedup"](spark, sf_dir), suffix_dedup.SQL, sf_dir)
    assert suffix_dedup.remove_repeats(spark, cases.empty(spark)).count() == 0
