"""Group-by over consecutive rows: runs of equal keys in an order, however long, over any number of partitions.

Rows are written in ranges of the order.  Each range finds its own runs; a table of one short row a range tells which first run continues the run before it, and
so how many runs begin before each range.  Pieces of one run then meet as one row a range, so a run over all partitions is never one task's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about: ranges, and tasks of all later steps, are as many as the rows ask for, so no task's memory grows with the table.
ROWS = 250_000


def consecutive(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], work: str) -> DataFrame:
    """(run, keys, first_<order>, last_<order>, n, sums) of each maximal stretch of rows, by ``order`` (unique, not null), with equal ``keys`` (null equals null); runs count from 0.

    ``sums`` are columns that are added up, named; ``work`` is a folder that all executors share.
    """
    spark, order, keys = df.sparkSession, list(order), list(keys)
    rows = df.select(*keys, *order, *[c.alias(n) for n, c in sums.items()])
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{work}/rows")
    table = spark.read.parquet(f"{work}/rows").repartition(parts, "__part")
    key, place = F.struct(*keys), F.struct(*order)
    by = Window.partitionBy("__part").orderBy(*order)
    # a range's first row begins a run of its own until the ranges are compared
    begins = F.coalesce((~F.lag(key).over(by).eqNullSafe(key)).cast("long"), F.lit(1).cast("long"))
    own = table.withColumn("__begins", begins).withColumn("__own", F.sum("__begins").over(by))
    total = {"n": F.count("*"), **{n: F.sum(n) for n in sums}}
    pieces = own.groupBy("__part", "__own").agg(F.first(key).alias("__key"), F.min(place).alias("__first"), F.max(place).alias("__last"), *[c.alias(n) for n, c in total.items()])
    pieces.write.mode("overwrite").parquet(f"{work}/pieces")
    pieces = spark.read.parquet(f"{work}/pieces")
    ends = pieces.groupBy("__part").agg(F.min("__first").alias("__lo"), F.max("__own").alias("__runs"), F.min_by("__key", "__own").alias("__head"), F.max_by("__key", "__own").alias("__tail"))
    ranges = Window.orderBy("__lo")  # a row a range
    goes_on = F.coalesce(F.lag(F.struct("__tail")).over(ranges).eqNullSafe(F.struct(F.col("__head").alias("__tail"))), F.lit(False)).cast("long")
    ends = ends.withColumn("__goes_on", goes_on)
    before = F.sum(F.col("__runs") - F.col("__goes_on")).over(ranges) - F.col("__runs")
    joined = pieces.join(F.broadcast(ends.select("__part", before.alias("__before"))), "__part").withColumn("run", F.col("__before") + F.col("__own") - 1)
    merged = joined.repartition(parts, "run").groupBy("run").agg(F.first("__key").alias("__key"), F.min("__first").alias("__first"), F.max("__last").alias("__last"), *[F.sum(n).alias(n) for n in total])
    return merged.select("run", *[F.col(f"__key.{k}").alias(k) for k in keys], *[F.col(f"__{e}.{o}").alias(f"{e}_{o}") for e in ("first", "last") for o in order], *total)
