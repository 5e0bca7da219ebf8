import random

from pyspark.sql import functions as F

from tenderline.operators import coverage, merge


def test_profiles_against_a_fold(spark):
    random.seed(5)
    sources = [*merge.PROFILE_PRIORITY, "other"]
    value = lambda: random.choice([None, "a", "b", "c"])
    old = {k: (value(), random.choice(sources)) for k in range(40) if random.random() < 0.7}
    batch = [(random.randrange(40), value(), n) for n in range(150)]
    for source in sources:
        want = {k: list(v) for k, v in old.items()}
        p = merge.PROFILE_PRIORITY.get(source, 0)
        for k, v, _ in batch:
            if k not in want:
                want[k] = [v, source]
                continue
            over = p >= merge.PROFILE_PRIORITY.get(old.get(k, (None, source))[1], 0)
            if v is not None and (over or want[k][0] is None):
                want[k][0] = v
            if over:
                want[k][1] = source
        existing = spark.createDataFrame([(k, *v) for k, v in old.items()], "k int, f string, profile_source string")
        new = spark.createDataFrame([(k, v, source, n) for k, v, n in batch], "k int, f string, profile_source string, n int")
        got = {r.k: [r.f, r.profile_source] for r in merge.merge_profiles(existing, new, "k", ["f"], "n").collect()}
        assert got == want


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", "done"), (2, "b", "done")], "k int, v string, status string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "k int, v string, n int")
    go = lambda t: merge.upsert(t, new, ["k"], "n", ["status"], {"status": F.lit("new")})
    once = go(old)
    want = [(1, "a", "done"), (2, "y", "done"), (3, "z", "new")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, go(once).collect())) == want
    assert merge.upsert_counts(old, new, ["k"]).first() == (1, 2)


def test_gaps_and_intervals_tile_the_range(spark):
    random.seed(9)
    days = [(k, d) for k in range(20) for d in range(60) if random.random() < 0.6]
    base = F.to_date(F.lit("2026-01-01"))
    have = spark.createDataFrame(days, "k int, n int").select("k", F.date_add(base, F.col("n")).alias("day"))
    runs = coverage.islands(have, ["k"], "day")
    wanted = spark.range(20).select(F.col("id").cast("int").alias("k"), F.date_add(base, 5).alias("date_from"), F.date_add(base, 50).alias("date_to"))
    gaps = coverage.gaps(runs, wanted, ["k"]).select("k", F.explode(F.sequence("date_from", "date_to")).alias("day"))
    inside = have.where((F.col("day") >= F.date_add(base, 5)) & (F.col("day") <= F.date_add(base, 50)))
    assert gaps.join(inside, ["k", "day"]).count() == 0 and gaps.count() + inside.count() == 20 * 46


def test_cache_ranges(spark):
    c = spark.createDataFrame([("a", "2026-01-01", "2026-01-10", 1), ("a", "2026-02-01", "2026-02-10", 2), ("b", "2026-01-01", "2026-01-10", 3)], "k string, f string, t string, v int").select("k", F.to_date("f").alias("date_from"), F.to_date("t").alias("date_to"), "v")
    new = spark.createDataFrame([("a", "2026-01-05", "2026-01-20", 9)], "k string, f string, t string, v int").select("k", F.to_date("f").alias("date_from"), F.to_date("t").alias("date_to"), "v")
    assert sorted(r.v for r in merge.replace_ranges(c, new, ["k"]).collect()) == [2, 3, 9]
