"""What the jobs share: configuration, input tables, log."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text())


def selected(spark: SparkSession, source: Mapping, tables: str) -> DataFrame:
    """The rows of ``source``: its SQL over its tables (in braces), each Parquet below the folder ``tables``."""
    frames = {t: spark.read.parquet(f"{tables}/{t}.parquet") for t in source["tables"]}
    for t in frames:
        log.info("reads %s/%s.parquet", tables, t)
    return spark.sql(source["sql"], **frames)


def start(name: str) -> SparkSession:
    """A session for a command line; the one who calls stops it."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark
