"""Command line over stored results: ``python -m freshet evaluate RUN OUTPUT``.

Reads the results of a run's newest (or a given) epoch, evaluates each basin, and by lead time where results have time steps, and writes below the output folder

* ``metrics``: CSV with a header, a row a basin (and lead time);
* ``summary``: medians and means over basins, with the number of basins that have each metric;
* ``undefined``: basins whose observations or simulations are all missing, which have no metrics.

A rerun replaces all three.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.metrics import resolve
from freshet.plans import evaluation
from freshet.sources import tables


def results_of(spark: SparkSession, run: str, period: str, epoch: int | None, target: str | None) -> tuple[DataFrame, list[str]]:
    """(basin, date, obs, sim and lead_time, if there are steps) of a stored run, and the keys of its groups; samples are reduced to their mean."""
    df = tables.read_results(spark, run, period, epoch)
    prefix = f"{target}_" if target else ""
    if f"{prefix}sim_samples" in df.columns:
        df = df.withColumn("sim_samples", F.col(f"{prefix}sim_samples")).transform(evaluation.reduce_ensemble)
    elif prefix:
        df = df.withColumn("sim", F.col(f"{prefix}sim"))
    if prefix:
        df = df.withColumn("obs", F.col(f"{prefix}obs"))
    steps = "time_step" in df.columns
    keys = ["basin", *(["freq"] if "freq" in df.columns else []), *(["lead_time"] if steps else [])]
    return df.withColumn("lead_time", F.col("time_step").cast("int")) if steps else df, keys


def evaluate(
    spark: SparkSession, run: str, output: str, metrics: str | Sequence[str] = "all", period: str = "test", epoch: int | None = None, target: str | None = None, clipped: bool = False
) -> dict[str, DataFrame]:
    """Evaluates stored results and writes the tables; returns them read back."""
    wanted = resolve(metrics)
    results, keys = results_of(spark, run, period, epoch, target)
    by = [k for k in keys if k != "basin"]
    skill = evaluation.skill(results, keys, wanted, clipped)
    tables.write_metrics(skill, f"{output}/metrics")
    skill = tables.read_metrics(spark, f"{output}/metrics", keys)
    parts = [(name, {"median": F.median, "mean": F.avg, "basins": F.count}[name]) for name in ("median", "mean", "basins")]
    rows = F.array(*[F.struct(F.lit(name).alias("statistic"), *[F.col(f"`{name} {m}`").cast("double").alias(m) for m in wanted]) for name, _ in parts])
    summary = skill.groupBy(*by).agg(*[f(F.col(f"`{m}`")).alias(f"{name} {m}") for name, f in parts for m in wanted]).select(*by, F.inline(rows))
    summary.write.mode("overwrite").parquet(f"{output}/summary")
    evaluation.undefined(results, keys).write.mode("overwrite").parquet(f"{output}/undefined")
    return {"metrics": skill, "summary": spark.read.parquet(f"{output}/summary"), "undefined": spark.read.parquet(f"{output}/undefined")}


def main(words: Sequence[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="freshet", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = args.add_subparsers(dest="what", required=True)
    one = what.add_parser("evaluate")
    one.add_argument("run", help="folder of the run")
    one.add_argument("output")
    one.add_argument("--metrics", nargs="+", default="all")
    one.add_argument("--period", default="test")
    one.add_argument("--epoch", type=int)
    one.add_argument("--target", help="prefix of the result columns, where they have one")
    one.add_argument("--clip", action="store_true", help="negative simulations count as zero")
    a = args.parse_args(words)
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    try:
        found = evaluate(spark, a.run, a.output, a.metrics, a.period, a.epoch, a.target, a.clip)
        for r in found["summary"].where("statistic = 'median'").collect():
            print(r.asDict())
    finally:
        spark.stop()
