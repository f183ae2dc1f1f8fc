"""Job: training, validation and test samples of all basins, scaled by what the training period shows.

Reads dynamics and statics by SQL over Parquet tables, prepares each period with the library (crop, fill, fit on training data only, validate, cut sequences) and writes below the
output folder, all as Parquet:

* ``scaler``: center, scale, mean and deviation of each feature;
* ``samples``: a row a sample with its arrays and static attributes, partitioned by ``split`` and ``basin``;
* ``coverage``: days and valid samples of each split and basin, and how many days fail each check; partitioned by ``split``.

A rerun replaces the partitions it makes, with the same rows.

    python -m jobs.training_samples TABLES OUTPUT [--config FILE]
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import config
from freshet.operators import scaler
from freshet.plans.dataset import Prepared, prepare, sequences_of
from jobs.common import log, selected, settings, start

CONFIG = Path(__file__).with_suffix(".yaml")
SPLITS = ("train", "validation", "test")


def coverage(p: Prepared) -> DataFrame:
    """(basin, days, valid, fails_<check>): days of the period; a day may fail several checks."""
    checks = [c for c in p.valid.columns if c.startswith("valid_") and c != "valid_dates"]
    days = p.valid.where("valid_dates")
    fails = [F.count(F.when(~F.col(c), 1)).alias(c.replace("valid_", "fails_")) for c in checks]
    return days.groupBy("basin").agg(F.count("*").alias("days"), F.count(F.when(F.col("valid"), 1)).alias("valid"), *fails)


def _replace(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    log.info("wrote %s by %s", path, ", ".join(by))


def run(spark: SparkSession, tables: str, output: str, settings: Mapping) -> dict[str, DataFrame]:
    """Does the job; returns the tables it wrote, read back."""
    cfg = config.from_dict(dict(settings["run"]))
    dynamics = selected(spark, settings["dynamics"], tables)
    statics = selected(spark, settings["statics"], tables) if "statics" in settings else None
    static, fitted = cfg.features("static_attributes"), None
    for split in SPLITS:
        p = prepare(spark, cfg, (statics, dynamics, None), split, fitted, f"{output}/work")
        if fitted is None:
            scaler.save(p.scaler, f"{output}/scaler")
            fitted = scaler.load(spark, f"{output}/scaler")
            log.info("wrote %s/scaler: %d features", output, fitted.count())
        named = F.lit(split).alias("split")
        rows = sequences_of(cfg, p)
        if statics is not None:
            rows = rows.join(scaler.scale(statics, fitted, static).select("basin", *static), "basin")
        _replace(rows.select(named, "*"), f"{output}/samples", "split", "basin")
        _replace(coverage(p).select(named, "*"), f"{output}/coverage", "split")
    found = {t: spark.read.parquet(f"{output}/{t}") for t in ("scaler", "samples", "coverage")}
    for r in found["coverage"].groupBy("split").agg(F.count("*").alias("basins"), F.sum("days").alias("days"), F.sum("valid").alias("valid")).orderBy("split").collect():
        log.info("%s: %d basins, %d days, %d valid samples", r.split, r.basins, r.days, r.valid)
    return found


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("tables", help="folder of the Parquet tables")
    args.add_argument("output", help="folder for the output; all executors have to reach it")
    args.add_argument("--config", default=str(CONFIG))
    a = args.parse_args()
    spark = start("training samples")
    try:
        run(spark, a.tables, a.output, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
