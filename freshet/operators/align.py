"""Alignment of tables on (basin, date, lead time): densify, shift, merge, crop."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.schema import BASIN, DATE, LEAD

Period = tuple[date | str, date | str]


def calendar(df: DataFrame, start=None, end=None, step: str = "1 day") -> DataFrame:
    """Every (basin, date) between a basin's first and last date, or between fixed bounds.  One short row a basin before it is exploded."""
    lo = F.lit(start).cast("date") if start is not None else F.min(DATE)
    hi = F.lit(end).cast("date") if end is not None else F.max(DATE)
    bounds = df.groupBy(BASIN).agg(lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    return bounds.select(BASIN, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(DATE))


def densify(df: DataFrame, start=None, end=None, step: str = "1 day") -> DataFrame:
    """Add the missing dates of each basin as rows of NULLs, between its first and last date or between fixed bounds.

    Without bounds each row is repeated up to the next one's date: one scan and one exchange by basin, which windows over basins then
    share.  With bounds the calendar is joined.  Rows that share a date all stay; rows without a basin or date go.
    """
    if start is not None or end is not None:
        return calendar(df, start, end, step).join(df, [BASIN, DATE], "left")
    kind = df.schema[DATE].dataType
    by = Window.partitionBy(BASIN).orderBy(DATE)
    rows = df.where(F.col(BASIN).isNotNull() & F.col(DATE).isNotNull()).withColumn("__next", F.lead(DATE).over(by))
    last = F.greatest(F.col(DATE), F.coalesce((F.col("__next") - F.expr(f"interval {step}")).cast(kind), F.col(DATE)))
    rows = rows.withColumn("__date", F.explode(F.sequence(F.col(DATE), last, F.expr(f"interval {step}"))))
    values = [F.when(F.col("__date") == F.col(DATE), F.col(c)).alias(c) for c in df.columns if c not in (BASIN, DATE)]
    return rows.select(BASIN, F.col("__date").alias(DATE), *values)


def in_periods(periods: Sequence[Period], before: int = 0, after: int = 0, column: str = DATE) -> Column:
    """The date lies in one of the periods (both ends included), each extended by days; a predicate that reaches the scan."""
    found = F.lit(False)
    for start, end in periods:
        lo = F.date_sub(F.lit(start).cast("date"), before) if before else F.lit(start).cast("date")
        hi = F.date_add(F.lit(end).cast("date"), after) if after else F.lit(end).cast("date")
        found = found | F.col(column).between(lo, hi)
    return found


def check_periods(starts: Sequence, ends: Sequence) -> list[Period]:
    if len(starts) != len(ends):
        raise ValueError("start and end dates differ in number")
    periods = list(zip(starts, ends, strict=True))
    if any(not str(a) < str(b) for a, b in periods):
        raise ValueError("a period must end after its start")
    return periods


def crop(df: DataFrame, periods: Sequence[Period], before: int = 0, after: int = 0) -> DataFrame:
    return df.where(in_periods(periods, before, after))


def shift(df: DataFrame, column: str, steps: int, into: str | None = None) -> DataFrame:
    """Value of ``steps`` rows earlier (later, if negative) of the same basin; by position, so densify first."""
    by = Window.partitionBy(BASIN).orderBy(DATE)
    return df.withColumn(into or column, F.lag(column, steps).over(by) if steps >= 0 else F.lead(column, -steps).over(by))


def expand_lead_times(df: DataFrame, column: str, leads: Iterable[int]) -> DataFrame:
    """(basin, date, lead_time, column): at each lead time the value of ``date + lead_time``; NULL beyond the end."""
    if LEAD in df.columns:
        raise ValueError("the table has lead times already")
    by = Window.partitionBy(BASIN).orderBy(DATE)
    leads = list(leads)
    rows = df.select(BASIN, DATE, F.array(*[F.struct(F.lit(n).alias(LEAD), F.lead(column, n).over(by).alias(column)) for n in leads]).alias("rows"))
    return rows.select(BASIN, DATE, F.inline("rows"))


def outer_merge(tables: Sequence[DataFrame], keys: Sequence[str] = (BASIN, DATE)) -> DataFrame:
    """Full outer join on shared keys."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(keys), "full_outer")
    return out


def merge_no_conflict(a: DataFrame, b: DataFrame, key: str = BASIN) -> DataFrame:
    """Full outer join in which shared columns must be equal or NULL on one side; a conflict fails the query when it is run."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    renamed = b.select(key, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in b.columns if c != key])
    joined = a.join(renamed, key, "full_outer")
    for c in shared:
        conflict = F.raise_error(F.concat(F.lit(f"conflicting values of {c} for "), F.col(key).cast("string"))).cast(a.schema[c].dataType)
        clash = F.col(c).isNotNull() & F.col(f"__{c}").isNotNull() & (F.col(c) != F.col(f"__{c}"))
        joined = joined.withColumn(c, F.when(clash, conflict).otherwise(F.coalesce(c, f"__{c}")))
    return joined.drop(*[f"__{c}" for c in shared])


def broadcast_static(df: DataFrame, statics: DataFrame) -> DataFrame:
    """Static columns on every row of their basin; Spark broadcasts statics while they are small and sorts otherwise."""
    return df.join(statics, BASIN, "left")


def select_basins(df: DataFrame, basins: DataFrame | Sequence[str]) -> DataFrame:
    """Rows of the given basins: a pushed-down filter for a list, a semi-join for a table."""
    return df.join(basins.select(BASIN), BASIN, "left_semi") if isinstance(basins, DataFrame) else df.where(F.col(BASIN).isin(list(basins)))


def missing_basins(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.select(BASIN).distinct().join(have.select(BASIN), BASIN, "left_anti")


def require_basins(wanted: DataFrame, have: DataFrame) -> None:
    gone = [r[0] for r in missing_basins(wanted, have).limit(20).collect()]
    if gone:
        raise ValueError(f"basins without data: {gone}")


def prefix_filter(df: DataFrame, subdataset: str, exact: bool = True) -> DataFrame:
    """Basins of a subdataset; ``exact`` asks for the underscore behind it, so one name does not match a longer one."""
    return df.where(F.col(BASIN).startswith(f"{subdataset}_" if exact else subdataset))


def melt_leads(df: DataFrame, feature: str, leads: Sequence[str]) -> DataFrame:
    """Wide forecasts (a column a lead day) to (basin, date, lead_time, feature)."""
    long = df.unpivot([BASIN, DATE], list(leads), LEAD, feature)
    return long.withColumn(LEAD, F.col(LEAD).cast("int"))


def lead_slice(df: DataFrame, last: int, first: int = 1) -> DataFrame:
    return df.where(F.col(LEAD).between(first, last))


def outer_concat(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables one after another; columns that one lacks are NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def concat_override(tables: Sequence[DataFrame], keys: Sequence[str] = (BASIN, DATE)) -> DataFrame:
    """One row a key: that of the first table that has it."""
    ranked = outer_concat([t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)])
    values = [c for c in ranked.columns if c not in (*keys, "__rank")]
    return ranked.groupBy(*keys).agg(F.min_by(F.struct(*values), "__rank").alias("__first")).select(*keys, "__first.*")


def by_basin(df: DataFrame) -> DataFrame:
    """Each basin's rows together and in the order of dates."""
    return df.repartition(BASIN).sortWithinPartitions(BASIN, DATE)
