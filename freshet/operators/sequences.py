"""Sample sequences by slicing one array a basin.

A window with ``collect_list`` writes every value as often as windows hold it before anything is filtered.  Here a basin's series is
gathered once, sorted, and only the valid samples slice it: one exchange, and the series is not copied to the samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.schema import BASIN, DATE, LEAD


def _field(structs, name: str):
    """One field of each struct of an array."""
    return F.transform(structs, lambda x: x[name])


def windows(dense: DataFrame, features: Sequence[str], first: int, last: int, valid: str | None = None, names: Sequence[str] | None = None, dates: bool = False) -> DataFrame:
    """(basin, date, one array a feature) with the values at day offsets ``first`` .. ``last`` of each sample date.

    Only windows that lie inside the series, and (``valid``) rows whose flag is true.  ``dense`` has a row a day, so places are offsets.
    """
    return frames(dense, [(features, first, last, names or features)], valid, (first, last) if dates else None)


def frames(dense: DataFrame, wanted: Sequence[tuple[Sequence[str], int, int, Sequence[str]]], valid: str | None = None, dates: tuple[int, int] | None = None) -> DataFrame:
    """As :func:`windows` for several frames, each (features, first, last, names), from one gathering of the series; all frames must lie inside it."""
    columns = list(dict.fromkeys(f for features, *_ in wanted for f in features))
    place = {f: f"f{i}" for i, f in enumerate(columns)}
    row = F.struct(F.col(DATE).alias("d"), F.col(valid).alias("v") if valid else F.lit(True).alias("v"), *[F.col(f).alias(n) for f, n in place.items()])
    series = dense.groupBy(BASIN).agg(F.array_sort(F.collect_list(row)).alias("s"))
    spans = [(first, last) for _, first, last, _ in wanted] + ([dates] if dates else [])
    lo, hi = F.lit(1 - min(0, *(a for a, _ in spans))), F.size("s") - max(0, *(b for _, b in spans))
    places = F.filter(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), lambda p: F.get(F.col("s"), p - 1)["v"])
    cut = lambda p, a, b: F.slice(F.col("s"), p + a, F.lit(b - a + 1))
    made = F.transform(
        places,
        lambda p: F.struct(
            F.get(F.col("s"), p - 1)["d"].alias(DATE),
            *([_field(cut(p, *dates), "d").alias("dates")] if dates else []),
            *[_field(cut(p, a, b), place[f]).alias(n) for features, a, b, names in wanted for f, n in zip(features, names, strict=True)],
        ),
    )
    return series.select(BASIN, F.inline(made))


def hindcast(dense: DataFrame, features: Sequence[str], seq_length: int, valid: str | None = None) -> DataFrame:
    """Days t-L+1 .. t."""
    return windows(dense, features, -(seq_length - 1), 0, valid)


def hindcast_of_forecasts(dense_first_lead: DataFrame, features: Sequence[str], seq_length: int, valid: str | None = None) -> DataFrame:
    """Smallest lead time of the days t-L .. t-1."""
    return windows(dense_first_lead, features, -seq_length, -1, valid)


def target(dense: DataFrame, features: Sequence[str], seq_length: int, lead_time: int, valid: str | None = None) -> DataFrame:
    """Days t+lead-L+1 .. t+lead."""
    return windows(dense, features, lead_time - seq_length + 1, lead_time, valid)


def sample_dates(dense: DataFrame, seq_length: int, lead_time: int, valid: str | None = None) -> DataFrame:
    return windows(dense, [], lead_time - seq_length + 1, lead_time, valid, dates=True)


def forecast(forecasts: DataFrame, features: Sequence[str]) -> DataFrame:
    """All lead times of each issue date, in order (collected as structs, so that NULLs keep their places)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(LEAD), *[F.col(f) for f in features])))
    return forecasts.groupBy(BASIN, DATE).agg(rows.alias("s")).select(BASIN, DATE, *[_field(F.col("s"), f).alias(f) for f in features])


def with_overlap(sequences: DataFrame, dense_first_lead: DataFrame, features: Sequence[str], overlap: int, min_lead: int) -> DataFrame:
    """Prefixes each forecast sequence with the first lead time of the days [t+1-m-o, t+1-m)."""
    before = windows(dense_first_lead, features, 1 - min_lead - overlap, -min_lead, names=[f"__{f}" for f in features])
    return sequences.join(before, [BASIN, DATE]).select(BASIN, DATE, *[F.concat(f"__{f}", f).alias(f) for f in features])


def timestep_counters(seq_length: int, leads: Sequence[int], overlap: int = 0) -> tuple[list[int], list[int]]:
    """Counter features: zeros for the hindcast; lead times for the forecast, the least repeated over the overlap."""
    return [0] * seq_length, [min(leads)] * overlap + list(leads) if leads else []


def last_n(column: str, n: int):
    """The last n steps of a sequence."""
    return F.slice(column, -n, n)


def steps_of(predict_last_n: int | Mapping[str, int], frequency: str | None, frequencies: Sequence[str]) -> int:
    """The last steps that are predicted at a frequency; without one, at the first in use."""
    return predict_last_n if isinstance(predict_last_n, int) else predict_last_n[frequency or frequencies[0]]


def basin_batches(samples: DataFrame, size: int) -> DataFrame:
    """``samples`` with a batch number for each basin: batches never mix basins, the remainder is a batch of its own."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(BASIN).orderBy(DATE)) - 1
    return samples.withColumn("batch", F.floor(k / size).cast("long"))


def limit_batches(batches: DataFrame, n: int) -> DataFrame:
    """The first n batches of each basin (all, if n is 0)."""
    return batches.where(F.col("batch") < n) if n > 0 else batches


def per_basin_std(dense: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Population deviation of each (scaled) target over a basin's dates."""
    return dense.groupBy(BASIN).agg(*[F.stddev_pop(F.col(t).cast("double")).alias(t) for t in targets])
