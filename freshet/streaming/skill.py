"""Skill over streams: moment metrics decompose into sums, so they can be kept up to date in windows with late data.

Beyond batch evaluation: a stream of (ts, basin, obs, sim) is folded to windowed sums with a watermark; the metrics are projections of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.metrics import from_moments, moments


def windowed_skill(stream: DataFrame, window: str = "1 day", late: str = "1 day", keys: tuple[str, ...] = ("basin",), ts: str = "ts") -> DataFrame:
    """Moment metrics of each key and window; works on streams (append or update mode) and on batches alike."""
    sums = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), *keys).agg(*[c.alias(n) for n, c in moments(F.col("obs"), F.col("sim")).items()])
    return sums.select("window", *keys, F.col("n").alias("n_pairs"), *[c.alias(n) for n, c in from_moments().items()])
