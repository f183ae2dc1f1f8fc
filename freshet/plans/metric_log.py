"""Figures of a running plan, kept as rows: losses, shares of NULLs and counts are observed while a result is written, without a second pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SCHEMA = "run string, step long, name string, value double"


def null_shares(columns) -> dict[str, Column]:
    """The share of NULLs of each column."""
    return {f"null_{c}": F.avg(F.col(c).isNull().cast("double")) for c in columns}


def write_logged(df: DataFrame, write: Callable[[DataFrame], None], figures: Mapping[str, Column], log: str, run: str, step: int) -> dict[str, float | None]:
    """Runs ``write(df)`` and appends the ``figures`` (aggregates over ``df``) of exactly the rows it wrote to the log table, a row a figure.

    The log is partitioned by run and step; a step that is run again replaces its rows.
    """
    seen = Observation()
    write(df.observe(seen, *[c.cast("double").alias(n) for n, c in figures.items()]))
    found = {n: seen.get[n] for n in figures}
    rows = df.sparkSession.createDataFrame([(run, step, n, v) for n, v in found.items()], SCHEMA)
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "step").parquet(log)
    return found
