"""Tables bucketed and sorted by basin, so that joins, windows and aggregations by basin find their rows together and need no exchange."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from freshet.schema import BASIN, DATE


def bucketed(df: DataFrame, path: str, buckets: int, by: str = BASIN, order: Sequence[str] = (DATE,), name: str | None = None) -> DataFrame:
    """Writes ``df`` to ``path`` in ``buckets`` buckets of ``by``, one file each, and reads it back as a table.

    Tables that are to be used together need the same number of buckets.  The name is unique, unless one is given; the table's files stay if it is dropped.
    """
    name = name or f"freshet_{uuid.uuid4().hex}"
    order = [by, *(c for c in order if c in df.columns)]
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(*order).mode("overwrite").option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """While it holds, plans made in it join bucketed tables by basin *and* other keys where they lie; by default Spark wants such tables bucketed by all keys of the join."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
