"""Experiment design: basin splits, period splits, screens."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.schema import BASIN


def subdataset():
    return F.split_part(F.col(BASIN), F.lit("_"), F.lit(1))


def hashed(seed: int, *parts) -> Column:
    """A number of 32 bits from seed and values (as strings), the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def kfold(basins: DataFrame, k: int = 10, seed: int = 42, key=None) -> DataFrame:
    """(basin, fold): folds 0 .. k-1 from a hash of seed and basin; stable under other basins coming and going, no sort."""
    order = F.pmod(hashed(seed, F.col(BASIN)) if key is None else key, F.lit(k))
    return basins.select(BASIN, order.cast("int").alias("fold"))


def kfold_even(basins: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """As :func:`kfold` with folds of equal size (one global sort over the basins, which are few)."""
    by = Window.orderBy(F.xxhash64(F.lit(seed), F.col(BASIN)), BASIN)
    return basins.select(BASIN, (F.ntile(k).over(by) - 1).alias("fold"))


def fold_rows(folds: DataFrame, k: int) -> DataFrame:
    """(basin, split, role): every basin tests in its own fold and trains in all others."""
    splits = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("split")
    return folds.select(BASIN, "fold", splits).select(BASIN, "split", F.when(F.col("split") == F.col("fold"), "test").otherwise("train").alias("role"))


def leave_group_out(basins: DataFrame, group=None) -> DataFrame:
    """(left_out, basin, role): each subdataset is left out once.  The groups' table has a row a group."""
    g = basins.select(BASIN, (group if group is not None else subdataset()).alias("grp"))
    groups = g.groupBy().agg(F.array_sort(F.collect_set("grp")).alias("groups"))
    return g.join(F.broadcast(groups)).select(F.explode("groups").alias("left_out"), BASIN, "grp").select("left_out", BASIN, F.when(F.col("grp") == F.col("left_out"), "test").otherwise("train").alias("role"))


def gauged(basins: DataFrame, subdatasets: Sequence[str] | None = None) -> DataFrame:
    """Basins that train and test alike, all or those of some subdatasets."""
    return basins.select(BASIN) if subdatasets is None else basins.where(subdataset().isin(list(subdatasets))).select(BASIN)


def dev_sample(basins: DataFrame, n: int, seed: int = 42, group=None, order=None) -> DataFrame:
    """n basins of each subdataset."""
    b = basins.withColumn("grp", group if group is not None else subdataset())
    by = Window.partitionBy("grp").orderBy(order if order is not None else F.xxhash64(F.lit(seed), F.col(BASIN)), BASIN)
    return b.withColumn("k", F.row_number().over(by)).where(F.col("k") <= n).select("grp", BASIN)


def temporal_cv(spark: SparkSession, first: int, last: int, start: int, end: int, buffer: int = 1) -> DataFrame:
    """(test_year, role, start_date, end_date): each year tests once; training is before and behind it, ``buffer`` years away; empty ranges are dropped."""
    y = F.col("test_year")
    date = lambda year, month, day: F.make_date(year, F.lit(month), F.lit(day))
    rows = F.array(
        F.struct(F.lit("test").alias("role"), date(y, 1, 1).alias("start_date"), date(y, 12, 31).alias("end_date")),
        F.struct(F.lit("train").alias("role"), date(F.lit(start), 1, 1).alias("start_date"), date(y - 1 - buffer, 12, 31).alias("end_date")),
        F.struct(F.lit("train").alias("role"), date(y + 1 + buffer, 1, 1).alias("start_date"), date(F.lit(end), 12, 31).alias("end_date")),
    )
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("test_year"))
    return years.select("test_year", F.inline(rows)).where("start_date <= end_date")


def config_grid(space: DataFrame, time: DataFrame) -> DataFrame:
    """Every basin split with every period split; both are lists of experiments, a few rows each."""
    return space.crossJoin(time)


def zero_variance(df: DataFrame, features: Iterable[str], split: str = "split") -> DataFrame:
    """Distinct features without variance over the training basins of some split."""
    features = list(features)
    found = df.groupBy(split).agg(*[F.var_samp(F.col(f).cast("double")).alias(f) for f in features])
    return found.unpivot([split], features, "feature", "variance").where("variance = 0").select("feature").distinct()


def classify(all_basins: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(basin, class): train, else test, else other."""
    t = train.select(BASIN, F.lit(True).alias("__train")).distinct()
    u = test.select(BASIN, F.lit(True).alias("__test")).distinct()
    return all_basins.join(t, BASIN, "left").join(u, BASIN, "left").select(BASIN, F.when(F.col("__train"), "train").when(F.col("__test"), "test").otherwise("other").alias("class"))


def pair_files(names: DataFrame, column: str = "name") -> DataFrame:
    """(experiment, train, test) from basin file names such as ``split1_train.txt``."""
    return (
        names.select(F.regexp_extract(column, r"^(?:(.*)_)?(train|test)\.txt$", 1).alias("experiment"), F.regexp_extract(column, r"^(?:(.*)_)?(train|test)\.txt$", 2).alias("role"), column)
        .where("role <> ''")
        .groupBy("experiment")
        .pivot("role", ["train", "test"])
        .agg(F.first(column))
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n): equal-width bins between the least and the greatest value, both included; empty bins are left out."""
    bounds = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    v = F.col(column).cast("double")
    at = F.least(F.floor(F.coalesce(F.try_divide((v - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(bounds)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def random_basins(basins: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n basins drawn by a hash of seed and basin, so a run that is repeated draws the same."""
    return basins.select(BASIN).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(BASIN).cast("string"))), BASIN).limit(n)


def common_basins(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(BASIN).intersect(b.select(BASIN))


def basins_without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct basins of ``a`` that ``b`` has not."""
    return a.select(BASIN).subtract(b.select(BASIN))


def union_ranges(ranges: DataFrame) -> DataFrame:
    """Distinct dates of many ranges (start_date, end_date; both ends included), which may overlap.  Ranges are exploded where they are, dates merged before they move."""
    return ranges.where("start_date <= end_date").select(F.explode(F.sequence("start_date", "end_date")).alias("date")).distinct()


def union_dates(spark: SparkSession, periods: Sequence[tuple]) -> DataFrame:
    """Distinct dates of some periods (both ends included), which may overlap."""
    rows = F.array(*[F.struct(F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for a, b in periods])
    return spark.range(1).select(F.inline(rows)).select(F.explode(F.sequence("a", "b")).alias("date")).distinct()
