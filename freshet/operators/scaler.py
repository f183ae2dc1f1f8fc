"""Feature scaler: fit in one aggregation a table, apply as folded literals, invert, save and load."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.operators.splits import hashed
from freshet.schema import BASIN, DATE, SCALER

STATISTICS = ("mean", "std", "median", "min", "max", "minmax")


class ZeroScale(ValueError):
    """A feature has no spread to scale by."""


def statistic(name: str, feature: str):
    """Aggregate of one feature over all its rows; NULLs are skipped, the deviation is the population's."""
    v = F.col(feature).cast("double")
    return {
        "mean": F.avg(v),
        "std": F.stddev_pop(v),
        "median": F.median(v),
        "min": F.min(v),
        "max": F.max(v),
        "minmax": F.max(v) - F.min(v),
    }[name]


def choice(custom: Mapping[str, Mapping[str, str]] | None, feature: str) -> tuple[str, str]:
    """(centering, scaling) of a feature; names in any case, ``none`` for neither."""
    own = (custom or {}).get(feature, {})
    center, scale = str(own.get("centering", "mean")).lower(), str(own.get("scaling", "std")).lower()
    for x in (center, scale):
        if x not in (*STATISTICS, "none"):
            raise ValueError(f"unknown statistic {x!r} for {feature}")
    return center, scale


def exact_median(df: DataFrame, feature: str, work: str) -> float | None:
    """The median of a feature of any number of distinct values, which a single aggregate would hold in one task."""
    v = F.col(feature).cast("double").alias("v")
    return median_of_counts(df.select(v).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")), work)


def median_of_counts(counts: DataFrame, work: str) -> float | None:
    """The median of values ``v`` that occur ``n`` times each.

    They are written in ranges below ``work``; the counts of the ranges, in the order of their least values, tell which one or two hold the middle, and only these are read.
    """
    spark = counts.sparkSession
    counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(work)
    table = spark.read.parquet(work)
    parts = sorted((r.lo, r.part, r.n) for r in table.groupBy("part").agg(F.min("v").alias("lo"), F.sum("n").alias("n")).collect())  # a row a partition
    total = sum(n for *_, n in parts)
    found = []
    for rank in {(total - 1) // 2, total // 2} if total else ():
        before = 0
        for _, part, n in parts:
            if rank < before + n:
                until = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
                found.append(table.where(F.col("part") == part).withColumn("until", until).where(F.col("until") > rank - before).agg(F.min("v")).first()[0])
                break
            before += n
    return sum(found) / len(found) if found else None


def fit(df: DataFrame, features: Iterable[str], custom: Mapping[str, Mapping[str, str]] | None = None, work: str | None = None) -> DataFrame:
    """(feature, center, scale, mean, std) of one table, from one pass with only the needed aggregates; one row a feature.

    Fit each table by itself, before joining: statics count once a basin, forecasts once a lead time.  A median is an aggregate that holds all
    distinct values; for large tables name a shared folder ``work``, and it is found by :func:`exact_median`.
    """
    features = list(features)
    aggregates, rows = {}, []
    for f in features:
        center, scale = choice(custom, f)
        for name in {"mean", "std", center, scale} - {"none"}:
            large = name == "median" and work is not None
            aggregates[f"{f}\0{name}"] = F.max(F.lit(exact_median(df, f, f"{work}/median-{f}")).cast("double")) if large else statistic(name, f)
        take = lambda n, f=f: F.col(f"`{f}\0{n}`")
        rows.append(
            F.struct(
                F.lit(f).alias("feature"),
                (F.lit(0.0) if center == "none" else take(center)).alias("center"),
                (F.lit(1.0) if scale == "none" else take(scale)).alias("scale"),
                take("mean").alias("mean"),
                take("std").alias("std"),
            )
        )
    if not features:
        return df.sparkSession.createDataFrame([], SCALER)
    return df.agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.inline(F.array(*rows)))


def with_aliases(scaler: DataFrame, targets: Iterable[str]) -> DataFrame:
    """Adds the parameters of each target under ``<target>_obs`` and ``<target>_sim``."""
    names = F.when(F.col("feature").isin(list(targets)), F.array("feature", F.concat("feature", F.lit("_obs")), F.concat("feature", F.lit("_sim")))).otherwise(F.array("feature"))
    return scaler.select(F.explode(names).alias("feature"), "center", "scale", "mean", "std")


def zero_scales(scaler: DataFrame) -> DataFrame:
    return scaler.where((F.col("scale") == 0) | (F.col("std") == 0))


def check(scaler: DataFrame) -> DataFrame:
    bad = sorted(r.feature for r in zero_scales(scaler).select("feature").collect())  # one row a feature at most
    if bad:
        raise ZeroScale(f"features with zero scale: {bad}")
    return scaler


Parameters = Mapping[str, tuple[float, float]]


def parameters(scaler: DataFrame) -> Parameters:
    """feature -> (center, scale); as many rows as there are features."""
    return {r.feature: (r.center, r.scale) for r in scaler.select("feature", "center", "scale").collect()}


def _apply(df: DataFrame, scaler: DataFrame | Parameters, features: Iterable[str], formula) -> DataFrame:
    known = parameters(scaler) if isinstance(scaler, DataFrame) else scaler
    features = list(features)
    absent = [f for f in features if f not in known]
    if absent:
        raise ValueError(f"features not in the scaler: {absent}")
    lit = lambda x: F.lit(x).cast("double")
    return df.withColumns({f: formula(F.col(f).cast("double"), lit(known[f][0]), lit(known[f][1])) for f in features})


def scale(df: DataFrame, scaler: DataFrame | Parameters, features: Iterable[str]) -> DataFrame:
    return _apply(df, scaler, features, lambda x, c, s: F.try_divide(x - c, s))


def unscale(df: DataFrame, scaler: DataFrame | Parameters, features: Iterable[str]) -> DataFrame:
    return _apply(df, scaler, features, lambda x, c, s: x * s + c)


def normalised_zero(scaler: DataFrame) -> DataFrame:
    """(feature, zero): where a flow of zero lies on the scaled axis."""
    return scaler.select("feature", (-F.try_divide("center", "scale")).alias("zero"))


def with_noise(df: DataFrame, scaler: DataFrame, targets: Iterable[str], sigma: float, seed: int = 0, keys: Iterable[str] = (BASIN, DATE)) -> DataFrame:
    """Label noise on scaled targets, in proportion to the unscaled value: y + (y + mean / std) * N(0, sigma).

    Draws come from hashes of seed, target and a row's ``keys``, so they do not depend on how rows are dealt.
    """
    ratio = {r.feature: r.ratio for r in scaler.select("feature", F.try_divide("mean", "std").alias("ratio")).collect()}
    uniform = lambda t, k: (hashed(seed, F.lit(t), F.lit(k), *[F.col(c) for c in keys]) + F.lit(0.5)) / F.lit(2.0**32)
    normal = lambda t: F.sqrt(F.lit(-2.0) * F.ln(uniform(t, 0))) * F.cos(F.lit(2.0) * F.pi() * uniform(t, 1))
    return df.withColumns({t: F.col(t) + (F.col(t) + F.lit(ratio[t])) * normal(t) * F.lit(sigma) for t in targets})


def save(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved scaler, checked; a missing one is an error."""
    return check(spark.read.schema(SCALER).parquet(path))
