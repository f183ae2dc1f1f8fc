"""Skill kept up to date as results arrive: sums of each batch are stored under its number, and only what they touch is evaluated again.

Every moment metric is made of six sums over pairs of observation and simulation.  A batch adds one row of sums for each key it has, written as one partition of the
state table that a repeated batch replaces; so a batch that is run again changes nothing, and late results are simply more pairs.  Decimal inputs make the sums exact,
so results do not depend on how pairs were dealt to batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.metrics import from_moments, resolve

SUMS = ("n", "o", "s", "oo", "ss", "os")
#: Variances below this share of the squared mean count as none: sums do not tell them from rounding.
_FLAT = 1e-13


def sums(pairs: DataFrame, keys: Sequence[str], obs: str = "obs", sim: str = "sim") -> DataFrame:
    """(keys, n, o, s, oo, ss, os): the sums of complete pairs, a row a key."""
    o, s = F.col(obs), F.col(sim)
    there = pairs.where(o.isNotNull() & s.isNotNull())
    return there.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in (("o", o), ("s", s), ("oo", o * o), ("ss", s * s), ("os", o * s))])


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of sums."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def moments_of(sums_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns that :func:`freshet.functions.metrics.from_moments` reads."""
    n, o, s, oo, ss, os_ = (F.col(c).cast("double") for c in SUMS)
    mo, ms = o / n, s / n
    flat = lambda v, m: F.when(v > F.lit(_FLAT) * m * m, v).otherwise(F.lit(0.0))
    vo, vs = flat(oo / n - mo * mo, mo), flat(ss / n - ms * ms, ms)
    return sums_.select(*keys, F.col("n"), mo.alias("mo"), ms.alias("ms"), F.sqrt(vo).alias("so"), F.sqrt(vs).alias("ss"), vo.alias("vo"), (os_ / n - mo * ms).alias("cov"), (ss - 2 * os_ + oo).alias("sq"))


def skill_of(sums_: DataFrame, keys: Sequence[str], metrics: str | Sequence[str] = ("NSE", "KGE")) -> DataFrame:
    """(keys, n_pairs, metrics) from sums; only metrics made of moments."""
    made: dict[str, Column] = from_moments()
    wanted = resolve(metrics)
    unknown = [m for m in wanted if m not in made]
    if unknown:
        raise ValueError(f"not made of moments: {unknown}")
    return moments_of(sums_, keys).select(*keys, F.col("n").alias("n_pairs"), *[made[m].alias(m) for m in wanted])


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, None where nothing is written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def into_state(state: str, keys: Sequence[str], log: Callable[[str], None] = lambda _: None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch's sums become the partition ``batch`` of the table ``state``, in place of an earlier try."""

    def put(pairs: DataFrame, batch: int) -> None:
        found = sums(pairs, keys).withColumn("batch", F.lit(batch).cast("long"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state)
        written = existing(pairs.sparkSession, state)
        r = written.where(F.col("batch") == batch).agg(F.count("*").alias("keys"), F.sum("n").alias("pairs")).first() if written is not None else None
        log(f"wrote {state}, batch {batch}: {r['pairs'] or 0 if r else 0} pairs of {r['keys'] if r else 0} keys")

    return put


def stale(spark: SparkSession, state: str, skill: str, part: str) -> dict:
    """Values of ``part`` (few: years, say) that have batches which their skill does not hold yet, with the newest batch of each."""
    have = existing(spark, state)
    if have is None:
        return {}
    newest = have.groupBy(part).agg(F.max("batch").alias("newest"))
    done = existing(spark, skill)
    if done is not None:
        through = done.groupBy(part).agg(F.min("through_batch").alias("through"))
        newest = newest.join(through, part, "left").where("through IS NULL OR newest > through")
    return {r[part]: r["newest"] for r in newest.collect()}


def refresh(spark: SparkSession, state: str, skill: str, keys: Sequence[str], part: str, metrics: str | Sequence[str] = ("NSE", "KGE")) -> dict:
    """Evaluate the partitions of ``skill`` (by ``part``, one of the keys) that new batches touch; returns them with their newest batch.

    Which these are follows from the two tables, so a run that was broken off between them is made good by the next one.
    """
    todo = stale(spark, state, skill, part)
    if todo:
        rows = spark.read.parquet(state).where(F.col(part).isin(list(todo)))
        through = F.max("batch").alias("through_batch")
        table = skill_of(merge(rows, keys), keys, metrics).join(rows.groupBy(part).agg(through), part)
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(skill)
    return todo
