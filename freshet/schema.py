"""Data model: table schemas and feature-name helpers.

Three tidy tables hold everything: statics (one row a basin), dynamics (basin, date) and forecasts (basin, issue date, lead time in
days).  A missing value is NULL inside the engine; NaN is turned to NULL once, at ingest.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASIN, DATE, LEAD = "basin", "date", "lead_time"
MIN_LEAD = 1

SCALER = T.StructType([T.StructField("feature", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("center", "scale", "mean", "std")])
RESULTS = T.StructType(
    [
        T.StructField(BASIN, T.StringType()),
        T.StructField("freq", T.StringType()),
        T.StructField(DATE, T.DateType()),
        T.StructField("time_step", T.IntegerType()),
        T.StructField("obs", T.DoubleType()),
        T.StructField("sim", T.DoubleType()),
        T.StructField("sim_samples", T.ArrayType(T.DoubleType())),
    ]
)


def table_schema(features: Iterable[str], lead: bool = False, date: bool = True) -> T.StructType:
    """Schema of a feature table: keys, then one FLOAT column a feature."""
    keys = [T.StructField(BASIN, T.StringType())]
    if date:
        keys.append(T.StructField(DATE, T.DateType()))
    if lead:
        keys.append(T.StructField(LEAD, T.IntegerType()))
    return T.StructType(keys + [T.StructField(f, T.FloatType()) for f in features])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL, so that SQL aggregates skip it."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))})


def null_to_nan(df: DataFrame) -> DataFrame:
    """The reverse, for exports to array formats."""
    return df.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(float("nan"))) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))})


def assert_float(df: DataFrame, features: Iterable[str]) -> None:
    """Every feature column must be FLOAT."""
    wrong = [f.name for f in df.schema if f.name in set(features) and not isinstance(f.dataType, T.FloatType)]
    if wrong:
        raise ValueError(f"features not in single precision: {wrong}")


# --- feature lists --------------------------------------------------------------------------------------------------


def flatten(features) -> list[str]:
    """Feature names of a list, a list of lists or a mapping of lists, in order."""
    if not features:
        return []
    if isinstance(features, Mapping):
        features = list(features.values())
    out: list[str] = []
    for f in features:
        out.extend([f] if isinstance(f, str) else flatten(f))
    return out


def unique(items: Iterable) -> list:
    return list(dict.fromkeys(items))


def prefix(feature: str) -> str:
    return feature.partition("_")[0]


def group(features) -> list[list[str]]:
    """Feature groups: given groups as they are; a flat list is grouped by the prefix before the first underscore."""
    if isinstance(features, Mapping):
        return [list(v) for v in features.values()]
    features = list(features)
    if any(not isinstance(f, str) for f in features):
        return [[f] if isinstance(f, str) else list(f) for f in features]
    found: dict[str, list[str]] = {}
    for f in features:
        found.setdefault(prefix(f), []).append(f)
    return list(found.values())


def product(feature: str) -> str:
    """Product a feature belongs to; one product's folder has an underscore in its name."""
    name = prefix(feature).upper()
    return {"ERA5LAND": "ERA5_LAND"}.get(name, name)


def product_bands(features: Iterable[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for f in features:
        found.setdefault(product(f), []).append(f)
    return found


def band_table(features: DataFrame, column: str = "feature") -> DataFrame:
    """(product, bands): sorted features of each product, for a table of feature names."""
    name = F.upper(F.split_part(column, F.lit("_"), F.lit(1)))
    name = F.when(name == "ERA5LAND", "ERA5_LAND").otherwise(name)
    return features.select(name.alias("product"), column).groupBy("product").agg(F.array_sort(F.collect_set(column)).alias("bands"))
