"""Evaluation: tables of skill from results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.cmal import reduce_samples
from freshet.functions.metrics import available, evaluate, resolve
from freshet.schema import BASIN, DATE


def clip(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Negative values become zero; for metrics only, never in stored results."""
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def evaluation_step(df: DataFrame, last_n: int, steps: int | None = None) -> DataFrame:
    """The first of the last ``last_n`` of the stored ``steps`` (as many, if not given) of each issue date; time steps count from 0."""
    return df.where(F.col("time_step") == F.lit((steps or last_n) - last_n)) if last_n else df


def pair_steps(sim: DataFrame, obs: DataFrame, keys: Sequence[str] = (BASIN, DATE, "time_step")) -> DataFrame:
    """Simulations and observations of the basins that both have, by date and step; a side without a value is NULL."""
    both = sim.select(BASIN).distinct().join(obs.select(BASIN).distinct(), BASIN)
    paired = sim.select(*keys, "sim").join(obs.select(*keys, "obs"), list(keys), "full_outer")
    return paired.join(both, BASIN, "left_semi").select(*keys, "obs", "sim")


def skill_bars(table: DataFrame, metric: str, train: DataFrame, test: DataFrame, lead: int | None = 0) -> DataFrame:
    """(rank, basin, metric, class) of each basin's skill at one lead time, from the least; class is train, test or other."""
    from freshet.operators.splits import classify

    rows = table if lead is None or "lead_time" not in table.columns else table.where(F.col("lead_time") == lead)
    named = rows.select(BASIN, metric).join(classify(rows.select(BASIN).distinct(), train, test), BASIN)
    order = Window.orderBy(F.col(metric).asc_nulls_last(), BASIN)  # a row a basin
    return named.select(F.row_number().over(order).alias("rank"), BASIN, metric, "class")


def basins_per_product(dynamics: DataFrame, products: Mapping[str, Sequence[str]]) -> DataFrame:
    """(product, basins): basins for which a product has any value of its bands, in one pass."""
    there = [F.max(F.greatest(*[F.col(c).isNotNull().cast("int") for c in (*bands, bands[0])])).alias(p) for p, bands in products.items()]
    have = dynamics.groupBy(BASIN).agg(*there)
    return have.agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in products]).unpivot([], list(products), "product", "basins")


def reduce_ensemble(df: DataFrame, how: str = "mean") -> DataFrame:
    return df.withColumn("sim", reduce_samples(F.col("sim_samples"), how))


def skill(results: DataFrame, keys: Sequence[str] = (BASIN, "lead_time"), metrics: str | Iterable[str] = "all", clipped: bool = False) -> DataFrame:
    """Metrics of each basin and lead time, in one pass over the results."""
    return evaluate(clip(results, ["sim"]) if clipped else results, keys, metrics)


def undefined(results: DataFrame, keys: Sequence[str] = (BASIN,)) -> DataFrame:
    """Groups whose observations or simulations are all missing; their metrics are NULL, which this names."""
    return results.groupBy(*keys).agg(F.count("obs").alias("n_obs"), F.count("sim").alias("n_sim")).where("n_obs = 0 OR n_sim = 0")


def targets_skill(results: DataFrame, targets: Mapping[str, Iterable[str]] | Sequence[str], keys: Sequence[str] = (BASIN,)) -> DataFrame:
    """Wide table for several targets (columns ``<target>_obs``, ``<target>_sim``), metrics named ``<target>_<metric>`` if there is more than one."""
    named = {t: resolve(m) for t, m in (targets if isinstance(targets, Mapping) else {t: available() for t in targets}).items()}
    keep = lambda t, m: m if len(named) == 1 else f"{t}_{m}"
    # one row a target, so that all targets share one exchange and one aggregation of each kind
    pairs = F.array(*[F.struct(F.lit(t).alias("__target"), F.col(f"{t}_obs").cast("double").alias("obs"), F.col(f"{t}_sim").cast("double").alias("sim")) for t in named])
    others = [c for c in results.columns if c in (*keys, DATE)]
    long = results.select(*others, F.inline(pairs))
    wanted = [m for m in available() if any(m in ms for ms in named.values())]
    table = evaluate(long, [*keys, "__target"], wanted)
    picked = [F.max(F.when(F.col("__target") == t, F.col(f"`{m}`"))).alias(keep(t, m)) for t, ms in named.items() for m in ms]
    return table.groupBy(*keys).agg(*picked)


def by_frequency(table: DataFrame, metrics: Sequence[str], frequencies: Sequence[str], keys: Sequence[str] = (BASIN,)) -> DataFrame:
    """A row a group with a column ``<metric>_<frequency>`` for each; of a single frequency the metrics keep their names."""
    one = len(frequencies) == 1
    picked = lambda m, f: F.max(F.when(F.col("freq") == f, F.col(f"`{m}`"))).alias(m if one else f"{m}_{f}")
    return table.where(F.col("freq").isin(list(frequencies))).groupBy(*keys).agg(*[picked(m, f) for m in metrics for f in frequencies])


def median_skill(table: DataFrame, metrics: Iterable[str], by: Sequence[str] = ()) -> DataFrame:
    """Median of each metric over the basins, NULLs left out."""
    return table.groupBy(*by).agg(*[F.median(m).alias(m) for m in metrics])


def mean_skill(table: DataFrame, metrics: Iterable[str], by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def validation_loss(batches: DataFrame, loss: str = "loss", n: str = "n_samples", by: Sequence[str] = ()) -> DataFrame:
    """Mean loss weighted by samples; batches without a loss are left out."""
    there = F.col(loss).isNotNull()
    return batches.groupBy(*by).agg(F.try_divide(F.sum(F.when(there, F.col(loss) * F.col(n))), F.sum(F.when(there, F.col(n)))).alias("loss"))


def above(table: DataFrame, metric: str, least: float) -> DataFrame:
    return table.where(F.col(metric) > least)


def compare(base: DataFrame, other: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (BASIN, "lead_time")) -> DataFrame:
    """Two runs side by side: ``<metric>_base``, ``<metric>_other`` and the gain."""
    a = base.select(*keys, *[F.col(m).alias(f"{m}_base") for m in metrics])
    b = other.select(*keys, *[F.col(m).alias(f"{m}_other") for m in metrics])
    return a.join(b, list(keys)).select(*keys, *[c for m in metrics for c in (F.col(f"{m}_base"), F.col(f"{m}_other"), (F.col(f"{m}_other") - F.col(f"{m}_base")).alias(f"{m}_gain"))])


def without_observations(dense: DataFrame, periods: Sequence[tuple], obs: str = "obs") -> DataFrame:
    """Basins that have no observation in some period: one pass with a conditional count a period."""
    inside = [F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")) for start, end in periods]
    counts = dense.groupBy(BASIN).agg(*[F.count(F.when(x, F.col(obs))).alias(f"n{i}") for i, x in enumerate(inside)])
    return counts.where(F.least(*[F.col(f"n{i}") for i in range(len(periods))], F.lit(1)) == 0).select(BASIN)


def null_runs(dense: DataFrame, column: str = "obs") -> DataFrame:
    """(basin, start, end, length) of each run of days without a value."""
    order = Window.partitionBy(BASIN).orderBy(DATE)
    marked = dense.withColumn("__there", F.count(column).over(order)).where(F.col(column).isNull())
    return marked.groupBy(BASIN, "__there").agg(F.min(DATE).alias("start_date"), F.max(DATE).alias("end_date"), F.count("*").alias("n_days")).drop("__there")


def time_steps(predictions: DataFrame, last: str = "last_date", factor: int = 1, lead_time: int = 0) -> DataFrame:
    """Position of each predicted date in its sequence: days behind the sequence's last date, plus the lead time."""
    return predictions.withColumn("time_step", F.date_diff(F.col(DATE), F.col(last)) + factor - 1 + lead_time)
