"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a 40-bit hash of its id. A source's budget becomes a threshold on that hash: the words of the source
are summed by the first ten bits of the hash, the bucket in which the running sum passes the budget is found, and only
the rows of that bucket are summed again by the next ten bits, four times in all. A filter on the threshold then takes
the documents; nothing is sorted. A target above the source's size takes every document ``floor(target / size)`` times
and thresholds the rest, so the copies' thresholds are nested.

Defined results: null text has size 0; a null source is a source of its own, the last; a null id hashes as empty text;
rows that share an id share a hash and are taken together; an empty table gives an empty result; a source of size 0 has
target 0 and takes nothing. Columns beside id, text and source are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Bits of the hash, and bits that each histogram resolves.
HASH_BITS, STEP_BITS = 40, 10
#: Weights go round in this order over the sources.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times the size of its source.
MOST_TIMES = 3


def size_column(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_column(doc_id):
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _key(source):
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """skey, source, source_size -> the same with target: the least of the cap and the common level times the weight.

    With the k sources of the lowest cap per weight stopped, the level that spends the total is (total - their caps) /
    (weight of the others). The true level is the largest of these, as each of them spends at most the total. One row a
    source goes through the two windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    s = sizes.withColumn("w", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * MOST_TIMES)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("skey")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    others = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("lv", left.cast("double") / others.cast("double"))
    s = s.withColumn("level", F.max("lv").over(everything))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w").cast("double"))).select("skey", "source_size", "target")


def plan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, limits): a small row for each document, and for each source its target, whole copies and hash threshold."""
    rows = materialize(spark, docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _key(source).alias("skey"), size_column(text).alias("size"), hash_column(doc_id).alias("h")), "mix")
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    t = targets(sizes)
    t = t.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    limits = materialize(spark, t, "mix-targets")
    at = limits.select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("spent"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = rows.join(at, "skey").where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        hist = inside.groupBy("skey", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.first("spent").alias("spent"), F.first("budget").alias("budget"))
        w = Window.partitionBy("skey").orderBy("b")
        hist = hist.withColumn("cum", F.col("spent") + F.sum("n").over(w))
        over = hist.where(F.col("cum") > F.col("budget"))
        edge = F.min_by(F.struct("b", "cum", "n", "budget"), "b").alias("e")
        at = over.groupBy("skey").agg(edge).select("skey", F.col("e.budget").alias("budget"), F.col("e.b").alias("prefix"), (F.col("e.cum") - F.col("e.n")).alias("spent"), F.col("e.cum").alias("cum"))
        at = materialize(spark, at, "mix-edge")
    # The last bucket goes with the side that leaves the sum nearer to the budget. No edge: all rows fit.
    nearer = (F.col("cum") + F.col("spent")).cast("double") < 2 * F.col("budget")
    edges = at.select("skey", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
    limits = limits.join(edges, "skey", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1 << HASH_BITS)))
    return rows, limits


def mix(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies, source."""
    rows, limits = plan(spark, docs, doc_id, text, source)
    out = rows.join(limits, "skey")
    out = out.withColumn("copies", F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
    out = out.withColumn("copies", F.least("copies", F.lit(MOST_TIMES)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def take(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed documents with all their columns: each row as often as the mix takes it."""
    _, limits = plan(spark, docs)
    names = docs.columns
    own = {n: f"_{k}" for k, n in enumerate(names)}
    limits = limits.select("skey", "copies", "threshold")
    out = docs.toDF(*own.values()).withColumn("skey", _key(own["source"])).join(limits, "skey")
    n = F.col("copies") + F.when(hash_column(own["doc_id"]) < F.col("threshold"), 1).otherwise(0)
    out = out.withColumn("n", F.least(n, F.lit(MOST_TIMES)).cast("int")).where("n > 0")
    return out.select(*own.values(), F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("one")).drop("one").toDF(*names)


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS h FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weights AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM sizes),
levels AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER b, 0))::DOUBLE / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS lv
           FROM weights WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, (max(lv) OVER ()) * w::DOUBLE) AS target FROM levels),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM targets),
summed AS (
  SELECT r.doc_id, r.source, r.size, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum,
         sum(r.size) OVER (PARTITION BY r.source, r.h)::BIGINT AS own
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source),
counted AS (SELECT *, least(copies + CASE WHEN cum <= budget OR (2 * cum - own)::DOUBLE < 2 * budget THEN 1 ELSE 0 END, 3)::BIGINT AS n FROM summed)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken, n AS copies, source FROM counted
"""
