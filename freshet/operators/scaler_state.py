"""A scaler that grows: stored sums and value counts of each batch of data, from which a scaler is fitted without reading the data again.

``<state>/moments`` has a row a batch and feature (count, mean, sum of squared deviations, least and greatest value), ``<state>/values`` how often each value of a feature occurs, for
features whose median may be asked for.  Both are partitioned by ``batch``: a batch that is folded in again replaces itself.  New basins or new features are new batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.scaler import choice, median_of_counts


def fold(df: DataFrame, features: Iterable[str], state: str, batch: str, medians: Iterable[str] = ()) -> None:
    """Adds ``df``'s rows to the state as ``batch``; ``medians`` names the features whose values are counted."""
    features, medians = list(features), list(medians)
    if unknown := [f for f in medians if f not in features]:
        raise ValueError(f"medians of features that are not folded in: {unknown}")
    v = lambda f: F.col(f).cast("double")
    parts = {"n": F.count, "mean": F.avg, "var": F.var_pop, "lo": F.min, "hi": F.max}
    one = df.agg(*[g(v(f)).alias(f"{f}\0{n}") for f in features for n, g in parts.items()])
    take = lambda f, n: F.col(f"`{f}\0{n}`")
    rows = [F.struct(F.lit(f).alias("feature"), take(f, "n").alias("n"), take(f, "mean").alias("mean"), (take(f, "var") * take(f, "n")).alias("m2"), take(f, "lo").alias("lo"), take(f, "hi").alias("hi")) for f in features]
    _put(one.select(F.inline(F.array(*rows))), f"{state}/moments", batch)
    if medians:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), v(f).alias("v")) for f in medians])))
        _put(long.where("v IS NOT NULL").groupBy("feature", "v").agg(F.count("*").alias("n")), f"{state}/values", batch)


def _put(df: DataFrame, path: str, batch: str) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def moments(spark: SparkSession, state: str) -> DataFrame:
    """(feature, n, mean, std, lo, hi) of all batches together: deviations are taken about the common mean, so large means lose no digits."""
    rows = spark.read.parquet(f"{state}/moments").where("n > 0")
    means = rows.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("common"))
    apart = F.col("mean") - F.col("common")
    joined = rows.join(means, "feature").groupBy("feature", "common")
    return joined.agg(
        F.sum("n").alias("n"), F.sqrt(F.sum(F.col("m2") + F.col("n") * apart * apart) / F.sum("n")).alias("std"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).select("feature", "n", F.col("common").alias("mean"), "std", "lo", "hi")


def fitted(spark: SparkSession, state: str, custom: Mapping[str, Mapping[str, str]] | None = None, work: str | None = None) -> DataFrame:
    """(feature, center, scale, mean, std) of everything folded in, as :func:`freshet.operators.scaler.fit` gives it for all data at once.

    Medians are searched in the counted values below the shared folder ``work``.
    """
    table = moments(spark, state)
    rows = []
    for f in sorted(r.feature for r in table.select("feature").collect()):  # a row a feature
        center, scale = choice(custom, f)
        median = None
        if "median" in (center, scale):
            if work is None:
                raise ValueError("a median needs a work folder")
            counts = spark.read.parquet(f"{state}/values").where(F.col("feature") == f).groupBy("v").agg(F.sum("n").alias("n"))
            median = F.lit(median_of_counts(counts, f"{work}/median-{f}")).cast("double")
        of = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("lo"), "max": F.col("hi"), "minmax": F.col("hi") - F.col("lo"), "median": median}
        here = F.col("feature") == f
        rows.append(F.when(here, F.struct((F.lit(0.0) if center == "none" else of[center]).alias("center"), (F.lit(1.0) if scale == "none" else of[scale]).alias("scale"))))
    if not rows:
        return table.select("feature", F.col("mean").alias("center"), F.col("std").alias("scale"), "mean", "std")
    return table.withColumn("x", F.coalesce(*rows)).select("feature", "x.center", "x.scale", "mean", "std")
