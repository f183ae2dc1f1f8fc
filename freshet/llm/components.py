"""Connected components of a distributed edge list, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common


def components(spark: SparkSession, edges: DataFrame, root: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, of one orderable type); component is its smallest node.

    Each round points every node's larger neighbours at the smallest of its neighbourhood (large star), then its
    smaller ones (small star); edges never grow in number and the fixpoint is one star per component, reached in
    O(log^2) rounds.  Rounds are written below ``root``.  No group is gathered: minima are plain aggregates, joined back.
    """
    e = common.stage(
        spark,
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
        f"{root}/edges-0",
    )
    turn = 0
    while True:
        turn += 1
        large = common.stage(spark, _star(spark, _both(e), f"{root}/least-{turn}a", larger=True), f"{root}/large-{turn}")
        small = _star(spark, large.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("o")), f"{root}/least-{turn}b", larger=False)
        new = common.stage(spark, small, f"{root}/edges-{turn}")
        for done in (f"least-{turn}a", f"least-{turn}b", f"large-{turn}"):
            common.delete(spark, f"{root}/{done}")
        # a star forest is a fixpoint: no centre is itself a leaf, and no leaf has two centres
        ends = new.select(F.col("a").alias("n"), F.lit(0).alias("leaf")).unionByName(new.select(F.col("b").alias("n"), F.lit(1).alias("leaf")))
        moving = not ends.groupBy("n").agg(F.min("leaf").alias("lo"), F.sum("leaf").alias("k")).where("k > 1 OR (k > 0 AND lo = 0)").isEmpty()
        if turn > 1:
            common.delete(spark, f"{root}/edges-{turn - 1}")
        e = new
        if not moving:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("n"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("o")))


def _star(spark: SparkSession, neighbours: DataFrame, uri: str, larger: bool) -> DataFrame:
    """Edges (a, b), a < b, from each neighbour o of n (all larger than n; else all smaller, and n itself) to the least of n and its neighbours.

    The minima are staged at ``uri``: the join then reads two plain shuffles, and a centre of very many neighbours is split over tasks.
    """
    least = common.stage(spark, neighbours.groupBy("n").agg(F.min("o").alias("m")).withColumn("m", F.least("n", "m")), uri)
    joined = neighbours.join(least, "n")
    if larger:
        linked = joined.where("o > n").select(F.col("m").alias("a"), F.col("o").alias("b"))
    else:
        linked = joined.select(F.col("m").alias("a"), F.col("o").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
    return linked.where("a < b").distinct()
