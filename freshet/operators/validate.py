"""Sample validation: which (basin, date) pairs have the data a sample needs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.align import Period, in_periods
from freshet.schema import BASIN, DATE, LEAD


class NoSamples(ValueError):
    """No valid sample is left."""


def _fold(columns: Iterable[Column], either: bool) -> Column:
    out = F.lit(not either)
    for c in columns:
        out = (out | c) if either else (out & c)
    return out


def any_valid(features: Iterable[str]) -> Column:
    return _fold((F.col(f).isNotNull() for f in features), True)


def all_valid(features: Iterable[str]) -> Column:
    return _fold((F.col(f).isNotNull() for f in features), False)


def any_group(groups: Iterable[Sequence[str]]) -> Column:
    """Some group is complete."""
    return _fold((all_valid(g) for g in groups), True)


def all_groups(groups: Iterable[Sequence[str]]) -> Column:
    """Every group has some feature."""
    return _fold((any_valid(g) for g in groups), False)


def policy(method: str | None, groups: Sequence[Sequence[str]]) -> Column:
    """Validity of a row under a missing-data method; groups are honoured as given."""
    if method in ("masked_mean", "attention", "unioning") and (not groups or any(isinstance(g, str) or not g for g in groups)):
        raise ValueError(f"{method} needs non-empty feature groups")
    flat = [f for g in groups for f in ([g] if isinstance(g, str) else g)]
    if method is None or method == "none":
        return all_valid(flat)
    if method == "input_replacing":
        return any_valid(flat)
    if method in ("masked_mean", "attention"):
        return any_group(groups)
    if method == "unioning":
        return all_groups(groups)
    raise ValueError(f"unknown missing-data method {method!r}")


def over_leads(forecasts: DataFrame, features: Sequence[str], leads: int) -> DataFrame:
    """Forecasts folded to one row an issue date: per feature its value if it is there at all ``leads`` lead times (``f``), and if at any (``f__any``)."""
    aggregates = []
    for f in features:
        aggregates.append(F.when(F.count(f) == leads, F.max(f)).alias(f))
        aggregates.append(F.max(f).alias(f"{f}__any"))
    return forecasts.groupBy(BASIN, DATE).agg(*aggregates)


def lead_policy(method: str | None, groups: Sequence[Sequence[str]]) -> Column:
    """As :func:`policy`, on a table from :func:`over_leads`: complete means at every lead time, some means at any."""
    if method in (None, "none", "masked_mean", "attention"):
        return policy(method, groups)
    return policy(method, [[f"{f}__any" for f in ([g] if isinstance(g, str) else g)] for g in groups])


def nonzero(features: Iterable[str]) -> Column:
    """Some feature differs from zero; NULL counts as different."""
    return _fold((F.coalesce(F.col(f) != 0, F.lit(True)) for f in features), True)


def frame(n: int, shift: int = 0):
    """The window of ``n`` rows that ends ``shift`` rows behind the current one."""
    return Window.partitionBy(BASIN).orderBy(DATE).rowsBetween(-(n - 1) + shift, shift)


def sequence_all(mask: Column, n: int, shift: int = 0) -> Column:
    """Every row of the window is there and true."""
    w = frame(n, shift)
    return F.when(F.count(F.lit(1)).over(w) == n, F.coalesce(F.min(F.coalesce(mask, F.lit(False))).over(w), F.lit(False))).otherwise(F.lit(False))


def sequence_any(mask: Column, n: int, shift: int = 0) -> Column:
    """The window lies inside the series, and some row is true."""
    w = frame(n, shift)
    return F.when(F.count(F.lit(1)).over(w) == n, F.coalesce(F.max(F.coalesce(mask, F.lit(False))).over(w), F.lit(False))).otherwise(F.lit(False))


def masks(
    dense: DataFrame,
    *,
    train: bool,
    periods: Sequence[Period],
    method: str | None = None,
    statics: Sequence[str] = (),
    hindcast: Sequence = (),
    forecast: Sequence = (),
    targets: Sequence[str] = (),
    lead_time: int = 0,
    seq_length: int | None = None,
    predict_last_n: int | None = None,
    overlap: int | None = None,
    min_lead: int | None = None,
    skip_zero: bool = False,
) -> DataFrame:
    """``dense`` (one row a basin and day) with a boolean column for each check and their conjunction, ``valid``.

    Forecast features are columns from :func:`over_leads`; for the overlap their first lead time is in ``<f>__lead0``.
    All window checks share one partitioning and order, so they cost one exchange and one sort.
    """
    if not (statics or hindcast or forecast or targets):
        raise ValueError("no features to validate")
    groups = lambda x: [[f] if isinstance(f, str) and method in ("masked_mean", "attention", "unioning") else f for f in x]
    found: dict[str, Column] = {}
    if statics:
        found["statics"] = all_valid(statics)
    if hindcast:
        if seq_length is None:
            raise ValueError("hindcasts need seq_length")
        found["hindcasts"] = sequence_all(policy(method, groups(hindcast)), seq_length)
    if forecast:
        found["forecasts"] = F.coalesce(lead_policy(method, groups(forecast)), F.lit(False))
        if overlap:
            if min_lead is None:
                raise ValueError("an overlap needs min_lead")
            first = [f"{f}__lead0" if isinstance(f, str) else [f"{x}__lead0" for x in f] for f in forecast]
            found["forecast_overlap"] = sequence_all(policy(method, groups(first)), overlap, -min_lead)
    if targets and train:
        if predict_last_n is None:
            raise ValueError("targets need predict_last_n")
        if skip_zero:
            found["non_zero_targets"] = nonzero(targets)
        found["targets"] = sequence_any(any_valid(targets), predict_last_n, lead_time)
    found["dates"] = in_periods(periods)
    out = dense.withColumns({f"valid_{n}": c for n, c in found.items()})
    return out.withColumn("valid", _fold((F.col(f"valid_{n}") for n in found), False))


def sample_index(valid: DataFrame) -> DataFrame:
    """(sample_id, basin, date) of the valid rows, numbered by basin and date without a single-task sort.

    Rows are counted for each basin; the basins' counts (one short row a basin) give each its first number.
    """
    rows = valid.where("valid").select(BASIN, DATE)
    counts = rows.groupBy(BASIN).agg(F.count("*").alias("n"))
    first = counts.select(BASIN, (F.sum("n").over(Window.orderBy(BASIN)) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy(BASIN).orderBy(DATE)) - 1
    return rows.withColumn("k", within).join(first, BASIN).select((F.col("first") + F.col("k")).alias("sample_id"), BASIN, DATE)


def require_samples(index: DataFrame) -> DataFrame:
    if index.isEmpty():
        raise NoSamples("no valid samples")
    return index


def first_lead(forecasts: DataFrame, features: Sequence[str]) -> DataFrame:
    """Values at the smallest lead time, as ``<f>__lead0``."""
    least = forecasts.agg(F.min(LEAD).alias("__least"))  # a single row
    rows = forecasts.join(F.broadcast(least), F.col(LEAD) == F.col("__least"), "left_semi")
    return rows.select(BASIN, DATE, *[F.col(f).alias(f"{f}__lead0") for f in features])
