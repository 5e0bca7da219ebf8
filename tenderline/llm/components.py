"""Connected components by repeated contraction, for any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(a, b) long -> (v, comp): comp is one of the component's nodes. Nodes without an edge to another node do not appear.

    Each round, a node takes the least of its neighbours and itself (a partial aggregate, so a node with very many links
    is no hot spot), then its choice's choice; edges are renamed and those inside one name fall away. A round at least
    halves the nodes that have edges. The rounds' choices are followed from the last back to the first, so all rounds together join
    about twice as many rows as there are nodes. Every round is written to the shared folder.
    """
    left = materialize(spark, edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(spark, both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p")), "least")
        up = least.select(F.col("v").alias("p"), F.col("p").alias("up"))
        least = materialize(spark, least.join(up, "p").select("v", F.col("up").alias("p")), "least")
        rounds.append(least)
        a, b = least.select(F.col("v").alias("a"), F.col("p").alias("pa")), least.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        renamed = left.join(a, "a").join(b, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = materialize(spark, renamed, "edges")
    if not rounds:
        return spark.createDataFrame([], "v long, comp long")
    comps = rounds.pop().select("v", F.col("p").alias("comp"))
    for least in reversed(rounds):  # a choice without an edge in the next round is its component's name
        names = comps.withColumnRenamed("v", "p")
        comps = materialize(spark, least.join(names, "p", "left").select("v", F.coalesce("comp", "p").alias("comp")), "comps")
    return comps
