"""Skill metrics of simulated against observed flow, over pairs in which both are there.

Moment metrics of any grouping come from one aggregation; flow-duration metrics add sorted arrays to it; peak metrics need a scan of the
ordered series and run in grouped Arrow functions (:mod:`freshet.functions.peaks`).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOMENTS = ("NSE", "MSE", "RMSE", "KGE", "Alpha-NSE", "Pearson-r", "Beta-KGE", "Beta-NSE")
CURVES = ("FHV", "FMS", "FLV")
PEAKS = ("Peak-Timing", "Missed-Peaks", "Peak-MAPE")
#: In the order in which they are reported.
AVAILABLE = ("NSE", "MSE", "RMSE", "KGE", "Alpha-NSE", "Pearson-r", "Beta-KGE", "Beta-NSE", "FHV", "FMS", "FLV", "Peak-Timing", "Missed-Peaks", "Peak-MAPE")
_TINY = 1e-6


def available() -> list[str]:
    return list(AVAILABLE)


def resolve(names: str | Iterable[str]) -> list[str]:
    """Metric names in any case; ``all`` for every metric."""
    names = [names] if isinstance(names, str) else list(names)
    if any(n.lower() == "all" for n in names):
        return available()
    known = {n.lower(): n for n in AVAILABLE}
    unknown = [n for n in names if n.lower() not in known]
    if unknown:
        raise RuntimeError(f"unknown metrics: {unknown}")
    return [known[n.lower()] for n in names]


def moments(obs: Column, sim: Column) -> dict[str, Column]:
    """The eleven sums every moment metric is made of, as aggregates over complete pairs."""
    both = obs.isNotNull() & sim.isNotNull()
    o, s = F.when(both, obs), F.when(both, sim)
    return {
        "n": F.count(o), "mo": F.avg(o), "ms": F.avg(s), "so": F.stddev_pop(o), "ss": F.stddev_pop(s), "vo": F.var_pop(o),
        "cov": F.covar_pop(o, s), "sq": F.sum((s - o) * (s - o)),
    }


def from_moments(weights: Sequence[float] = (1.0, 1.0, 1.0)) -> dict[str, Column]:
    """Metrics over the columns of :func:`moments`; NULL where undefined."""
    if len(weights) != 3:
        raise ValueError("KGE takes three weights")
    n, mo, ms, so, ss, vo, cov, sq = (F.col(c) for c in ("n", "mo", "ms", "so", "ss", "vo", "cov", "sq"))
    r = F.when(n >= 2, F.try_divide(cov, so * ss))
    alpha, beta = F.try_divide(ss, so), F.try_divide(ms, mo)
    parts = [F.lit(float(w)) * (x - 1) * (x - 1) for w, x in zip(weights, (r, alpha, beta), strict=True)]
    mse = F.try_divide(sq, n)
    return {
        "NSE": 1 - F.try_divide(sq, n * vo),
        "MSE": mse,
        "RMSE": F.sqrt(mse),
        "KGE": F.when(n >= 2, 1 - F.sqrt(parts[0] + parts[1] + parts[2])),
        "Alpha-NSE": alpha,
        "Pearson-r": r,
        "Beta-KGE": beta,
        "Beta-NSE": F.try_divide(ms - mo, so),
    }


def curves(obs: Column, sim: Column) -> dict[str, Column]:
    """Flow-duration curves: both series sorted downwards, each by itself, over complete pairs."""
    both = obs.isNotNull() & sim.isNotNull()
    down = lambda c: F.sort_array(F.collect_list(F.when(both, c)), asc=False)
    return {"fo": down(obs), "fs": down(sim)}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _log_obs(x: Column) -> Column:
    return F.ln(F.when(x == 0, F.lit(_TINY)).otherwise(x))


def _log_sim(x: Column) -> Column:
    return F.ln(F.when(x <= 0, F.lit(_TINY)).otherwise(x))


def fhv(h: float = 0.02) -> Column:
    """Bias of the highest flows, %."""
    k = F.bround(F.lit(h) * F.size("fo")).cast("int")
    o, s = _sum(F.slice("fo", 1, k)), _sum(F.slice("fs", 1, k))
    return F.when(k > 0, F.try_divide(s - o, o) * 100)


def fms(lower: float = 0.2, upper: float = 0.7) -> Column:
    """Bias of the middle section's slope, %."""
    if not 0 < lower < upper < 1:
        raise ValueError("0 < lower < upper < 1 is required")
    at = lambda c, q: F.get(F.col(c), F.bround(F.lit(q) * F.size("fo")).cast("int"))
    o = _log_obs(at("fo", lower)) - _log_obs(at("fo", upper))
    s = _log_sim(at("fs", lower)) - _log_sim(at("fs", upper))
    return F.try_divide(s - o, o + _TINY) * 100


def flv(low: float = 0.3) -> Column:
    """Bias of the lowest flows, %; the logarithms are taken above their least value."""
    n = F.size("fo")
    k = F.bround(F.lit(low) * n).cast("int")
    k = F.when(k == 0, n).otherwise(k)
    volume = lambda c, log: F.transform(F.slice(c, n - k + 1, k), log)
    above = lambda a: _sum(a) - F.size(a) * F.array_min(a)
    o, s = above(volume("fo", _log_obs)), above(volume("fs", _log_sim))
    return F.when(n > 0, -F.try_divide(s - o, o + _TINY) * 100)


def _ranked(pairs: DataFrame, keys: Sequence[str], column: str, work: str) -> DataFrame:
    """(keys, v, n, before, total): distinct values of a column with their numbers, and how many of the group are larger.

    Values are counted, written in ranges below ``work``, and numbered range by range, so no task holds a group.
    """
    spark = pairs.sparkSession
    counts = pairs.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    order = [*keys, F.desc("v")]
    counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(work)
    table = spark.read.parquet(work)
    sums = table.groupBy(*keys, "part").agg(F.sum("n").alias("here"), F.max("v").alias("top"))  # a row a group and range
    earlier = F.sum("here").over(Window.partitionBy(*keys).orderBy(F.desc("top"))) - F.col("here")
    sums = sums.select(*keys, "part", earlier.alias("earlier"), F.sum("here").over(Window.partitionBy(*keys)).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(F.desc("v"))) - F.col("n")
    return table.withColumn("inside", inside).join(sums, [*keys, "part"]).select(*keys, "v", "n", (F.col("earlier") + F.col("inside")).alias("before"), "total")


def pooled_curves(df: DataFrame, keys: Sequence[str], work: str, obs: str = "obs", sim: str = "sim") -> DataFrame:
    """FHV, FMS and FLV of groups of any size (all basins of a lead time, say), which :func:`evaluate` would gather in one row each."""
    pairs = df.select(*keys, F.col(obs).cast("double").alias("o"), F.col(sim).cast("double").alias("s")).where("o IS NOT NULL AND s IS NOT NULL")
    n, before, after, v = F.col("total"), F.col("before"), F.col("before") + F.col("n"), F.col("v")
    share = lambda q: F.bround(F.lit(q) * n).cast("long")
    low = F.when(share(0.3) == 0, n).otherwise(share(0.3))
    sides = []
    for column, log in (("o", _log_obs), ("s", _log_sim)):
        among = lambda a, b: F.greatest(F.lit(0), F.least(after, b) - F.greatest(before, a))
        at = lambda k, x: F.max(F.when((before <= k) & (k < after), x))
        sides.append(
            _ranked(pairs, keys, column, f"{work}/{column}").groupBy(*keys).agg(
                F.sum(v * among(F.lit(0), share(0.02))).alias(f"{column}_high"), F.max(share(0.02)).alias("k"),
                (at(share(0.2), log(v)) - at(share(0.7), log(v))).alias(f"{column}_slope"),
                (F.sum(log(v) * among(n - low, n)) - F.max(low) * at(n - 1, log(v))).alias(f"{column}_low"),
            )
        )
    both = sides[0].join(sides[1].drop("k"), list(keys))
    bias = lambda name, tiny: F.try_divide(F.col(f"s_{name}") - F.col(f"o_{name}"), F.col(f"o_{name}") + tiny) * 100
    return both.select(*keys, F.when(F.col("k") > 0, bias("high", 0.0)).alias("FHV"), bias("slope", _TINY).alias("FMS"), (-bias("low", _TINY)).alias("FLV"))


def evaluate(df: DataFrame, keys: Sequence[str], metrics: str | Iterable[str] = "all", obs: str = "obs", sim: str = "sim", date: str = "date", resolution: str = "1D") -> DataFrame:
    """One row of metrics a group.  Moment and curve metrics share one aggregation; peak metrics, if asked for, add a grouped pass.

    Curve and peak metrics gather a group's series, as fits a basin's; for curves of larger groups there is :func:`pooled_curves`.
    """
    wanted = resolve(metrics)
    o, s = F.col(obs).cast("double"), F.col(sim).cast("double")
    parts = moments(o, s) | (curves(o, s) if set(wanted) & set(CURVES) else {})
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])
    made = from_moments() | {"FHV": fhv(), "FMS": fms(), "FLV": flv()}
    out = table.select(*keys, F.col("n").alias("n_pairs"), *[made[m].alias(m) for m in wanted if m in made])
    if set(wanted) & set(PEAKS):
        from freshet.functions.peaks import peak_metrics

        peaks = peak_metrics(df, keys, obs, sim, date, resolution).select(*keys, *[m for m in wanted if m in PEAKS])
        match = out.columns[: len(keys)]
        out = out.join(peaks, match, "left")
    return out.select(*keys, "n_pairs", *wanted)
