"""Data sets: the three tables of a configuration, from CSV folders or from Zarr products.

``tables``: attributes, hindcasts, forecasts and targets in the CSV layouts of :mod:`freshet.sources.tables`.
``zarr``: hindcasts and forecasts from ``<dynamics>/<PRODUCT>/timeseries.zarr``, a store a product, whose bands are features; attributes and targets as CSV.

Dynamics are (basin, date, a column a feature) and hold the hindcasts, the masks of the union mapping and the targets; forecasts are
(basin, date, lead_time, ...) with the lead times 1 up to the configuration's.  A hindcast feature of a product with lead times is taken at the least of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.config import Config
from freshet.operators.align import lead_slice, outer_merge
from freshet.schema import BASIN, DATE, LEAD, product_bands, unique
from freshet.sources import tables, zarr3
from freshet.sources.registry import Tables, register


def basins_of(spark: SparkSession, cfg: Config) -> list[str]:
    """All basins of the run, of whatever period."""
    files = [f for f in (cfg.train_basin_file, cfg.validation_basin_file, cfg.test_basin_file) if f is not None]
    if not files:
        raise ValueError("the configuration names no basin file")
    return sorted({b for f in dict.fromkeys(map(str, files)) for b in tables.read_basins(spark, f)})


def hindcast_features(cfg: Config) -> list[str]:
    """Hindcast inputs and what their gaps are filled from."""
    return unique([*cfg.features("hindcast_inputs"), *(cfg.union_mapping or {}).values()])


def statics_of(spark: SparkSession, cfg: Config, basins: Sequence[str]) -> DataFrame | None:
    names = cfg.features("static_attributes")
    return tables.read_attributes(spark, str(cfg.statics_data_dir), basins, names) if names else None


def targets_of(spark: SparkSession, cfg: Config, basins: Sequence[str]) -> DataFrame | None:
    names = cfg.features("target_variables")
    return tables.read_timeseries(spark, str(cfg.targets_data_dir), basins, names) if names else None


def _merged(parts: Iterable[DataFrame | None], keys: Sequence[str]) -> DataFrame | None:
    there = [p for p in parts if p is not None]
    return outer_merge(there, keys) if there else None


def _by_subdataset(basins: Sequence[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for b in basins:
        found.setdefault(b.partition("_")[0], []).append(b)
    return found


def csv_forecasts(spark: SparkSession, cfg: Config, basins: Sequence[str]) -> DataFrame | None:
    """Forecast features side by side; lead times beyond the configuration's are left out."""
    parts = []
    for feature in cfg.features("forecast_inputs"):
        one = None
        for sub, names in _by_subdataset(basins).items():
            more = tables.read_forecasts(spark, f"{cfg.dynamics_data_dir}/timeseries/csv/{sub}", names, feature)
            one = more if one is None else one.unionByName(more)
        parts.append(one)
    found = _merged(parts, (BASIN, DATE, LEAD))
    return None if found is None else lead_slice(found, max(cfg.lead_time, 1), 0)


def load_tables(spark: SparkSession, cfg: Config) -> Tables:
    basins = basins_of(spark, cfg)
    targets = cfg.features("target_variables")
    names = [f for f in hindcast_features(cfg) if f not in targets and f not in cfg.features("forecast_inputs")]
    hindcasts = tables.read_timeseries(spark, str(cfg.dynamics_data_dir), basins, names) if names else None
    dynamics = _merged((hindcasts, targets_of(spark, cfg, basins)), (BASIN, DATE))
    if dynamics is None:
        raise ValueError("the configuration names no hindcast input and no target")
    return statics_of(spark, cfg, basins), dynamics, csv_forecasts(spark, cfg, basins)


def _lead_days(df: DataFrame) -> DataFrame:
    """Lead times as whole days, whatever unit the store keeps them in."""
    kind = dict(df.dtypes)[LEAD]
    if kind in ("date", "timestamp"):  # days since an origin
        return df.withColumn(LEAD, F.date_diff(F.col(LEAD).cast("date"), F.lit("1970-01-01").cast("date")))
    days = F.col(LEAD) / F.lit(86_400 * 10**9) if kind == "bigint" else F.col(LEAD)
    return df.withColumn(LEAD, F.when(F.abs(F.col(LEAD)) >= 3600, days).otherwise(F.col(LEAD)).cast("int"))


def read_product(spark: SparkSession, root: str, product: str, bands: Sequence[str], basins: Sequence[str], last_lead: int) -> DataFrame:
    """Bands of one product for some basins; with lead times, those from 0 to ``last_lead``."""
    zarr3.register(spark)
    df = spark.read.format("zarr3").option("variables", ",".join(bands)).option("basins", ",".join(basins)).load(f"{root}/{product}/timeseries.zarr")
    if LEAD in df.columns:
        df = lead_slice(_lead_days(df), last_lead, 0)
    return df


def zarr_hindcasts(spark: SparkSession, cfg: Config, basins: Sequence[str], features: Sequence[str]) -> DataFrame | None:
    parts = []
    for product, bands in product_bands(features).items():
        df = read_product(spark, str(cfg.dynamics_data_dir), product, bands, basins, max(cfg.lead_time, 1))
        if LEAD in df.columns:
            df = df.groupBy(BASIN, DATE).agg(*[F.min_by(b, LEAD).alias(b) for b in bands])
        parts.append(df.select(BASIN, DATE, *bands))
    return _merged(parts, (BASIN, DATE))


def zarr_forecasts(spark: SparkSession, cfg: Config, basins: Sequence[str]) -> DataFrame | None:
    parts = []
    for product, bands in product_bands(cfg.features("forecast_inputs")).items():
        df = read_product(spark, str(cfg.dynamics_data_dir), product, bands, basins, max(cfg.lead_time, 1))
        if LEAD not in df.columns:
            raise ValueError(f"the forecast product {product} has no lead times")
        parts.append(df.select(BASIN, DATE, LEAD, *bands))
    return _merged(parts, (BASIN, DATE, LEAD))


def load_zarr(spark: SparkSession, cfg: Config) -> Tables:
    basins = basins_of(spark, cfg)
    targets = cfg.features("target_variables")
    hindcasts = zarr_hindcasts(spark, cfg, basins, [f for f in hindcast_features(cfg) if f not in targets])
    dynamics = _merged((hindcasts, targets_of(spark, cfg, basins)), (BASIN, DATE))
    if dynamics is None:
        raise ValueError("the configuration names no hindcast input and no target")
    return statics_of(spark, cfg, basins), dynamics, zarr_forecasts(spark, cfg, basins)


register("tables", load_tables)
register("zarr", load_zarr)
