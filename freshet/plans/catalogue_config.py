"""Queries that start from a configuration: stores and files are written from the warehouse views, then data sets are loaded, prepared and evaluated as a configuration says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import config
from freshet.functions import cmal
from freshet.plans import dataset, views
from freshet.plans.catalogue import _BANDS, _query, _round
from freshet.plans.catalogue_files import _NAMED, _named
from freshet.plans.views import sql
from freshet.sources import registry, tables
from freshet.sources.work import folder
from freshet.sources.zarr3_writer import save

_RUN = {
    "experiment_name": "config", "static_attributes": ["region"], "target_variables": ["q"], "seq_length": 3, "lead_time": 2, "predict_last_n": 1,
    "train_start_date": "01/02/1995", "train_end_date": "31/12/1996",
}


def _layout(spark: SparkSession, d: str, kind: str) -> config.Config:
    """Attributes, targets, a hindcast and a forecast feature of all basins in the layout of a data set, and the configuration that names them."""
    root = folder(spark, f"dataset-{kind}")
    two, lead = _named(views.two_products(spark, d)), _named(views.lead_flow(spark, d)).withColumn("lead_time", F.col("lead_time").cast("long") - 1)
    daily = _named(views.daily_flow(spark, d)).select("basin", "date", F.col("obs").alias("q"))
    tables.write_attributes(_named(views.statics(spark, d)).select("basin", "region"), root, "a")
    tables.write_basins(daily.select("basin").distinct(), f"{root}/basins")
    names = ("era5land_p", "hres_p") if kind == "zarr" else ("p", "f")
    hindcast = two.select("basin", "date", F.col("a").alias(names[0]))
    forecast = lead.where("lead_time <= 3").select("basin", "date", "lead_time", F.col("obs").alias(names[1]))
    if kind == "zarr":
        save(hindcast, f"{root}/ERA5_LAND/timeseries.zarr", ["basin", "date"])
        save(forecast, f"{root}/HRES/timeseries.zarr", ["basin", "date", "lead_time"], chunks={"basin": 1, "date": 400, "lead_time": 4})
        tables.write_timeseries(daily, root)
    else:
        tables.write_timeseries(hindcast.join(daily, ["basin", "date"], "full_outer"), root)
        wide = forecast.groupBy("basin", "date").pivot("lead_time", list(range(4))).agg(F.first(names[1]))
        for sub in range(5):
            tables.write_forecasts(wide.where(F.col("basin").startswith(f"r{sub}_")), f"{root}/timeseries/csv/r{sub}", names[1])
    cfg = config.from_dict(_RUN | {"dataset": kind, "hindcast_inputs": [names[0]], "forecast_inputs": [names[1]]})
    cfg.data_dir = cfg.statics_data_dir = cfg.dynamics_data_dir = cfg.targets_data_dir = root
    cfg.train_basin_file = f"{root}/basins"
    return cfg


def _loaded(spark: SparkSession, d: str, kind: str) -> DataFrame:
    cfg = _layout(spark, d, kind)
    statics, dynamics, forecasts = registry.load(spark, cfg)
    p, f = cfg.hindcast_inputs[0], cfg.forecast_inputs[0]
    rows = forecasts.where(F.col(f).isNotNull()).join(dynamics, ["basin", "date"], "left").join(statics, "basin", "left")
    return rows.select("basin", "date", F.col("lead_time").cast("int").alias("lead_time"), F.col(f"`{f}`").alias("f"), F.col(p).alias("p"), "q", "region")


def _loaded_sql(least: int) -> str:
    return (
        f"{sql('lines', 'lead', 'two', 'daily', 'statics')} SELECT {_NAMED} AS basin, date, lead_time - 1 AS lead_time, lead_flow.obs::FLOAT AS f, a::FLOAT AS p, daily.obs::FLOAT AS q, region::FLOAT AS region "
        f"FROM lead_flow LEFT JOIN two USING (basin, date) LEFT JOIN daily USING (basin, date) LEFT JOIN statics USING (basin) WHERE lead_time - 1 BETWEEN {least} AND 2"
    )


@_query("dataset_zarr", _loaded_sql(0))
def _(spark, d):
    return _loaded(spark, d, "zarr")


@_query("dataset_tables", _loaded_sql(0))
def _(spark, d):
    return _loaded(spark, d, "tables")


@_query(
    "dataset_scaler",
    f"{sql('lines', 'lead', 'two', 'daily', 'statics')}, d AS (SELECT date, a::FLOAT AS a, obs::FLOAT AS q FROM two JOIN daily USING (basin, date) WHERE date BETWEEN DATE '1995-02-01' - 3 AND DATE '1996-12-31' + 2), "
    "f AS (SELECT obs::FLOAT AS f FROM lead_flow WHERE lead_time - 1 BETWEEN 1 AND 2 AND date BETWEEN DATE '1995-02-01' - 3 AND DATE '1996-12-31' + 2) "
    "SELECT 'era5land_p' AS feature, round(avg(a::DOUBLE), 5) AS mean, round(stddev_pop(a::DOUBLE), 5) AS std FROM d UNION ALL SELECT 'q', round(avg(q::DOUBLE), 5), round(stddev_pop(q::DOUBLE), 5) FROM d "
    "UNION ALL SELECT 'region', round(avg(region::DOUBLE), 5), round(stddev_pop(region::DOUBLE), 5) FROM statics WHERE basin IN (SELECT basin FROM daily) UNION ALL SELECT 'hres_p', round(avg(f::DOUBLE), 5), round(stddev_pop(f::DOUBLE), 5) FROM f",
)
def _(spark, d):
    p = dataset.prepare(spark, _layout(spark, d, "zarr"), work=folder(spark, "prepared"))
    return _round(p.scaler.select("feature", "mean", "std"), "mean", "std", digits=5)


@_query(
    "pit_of_first_points",
    f"{_BANDS}, o AS (SELECT * FROM q WHERE obs IS NOT NULL ORDER BY vec_id LIMIT 40) " + " UNION ALL ".join(f"SELECT {p} AS q, round(avg((obs < q{p})::INTEGER), 6) AS share FROM o" for p in range(0, 101, 5)),
)
def _(spark, d):
    return _round(cmal.reliability(views.ensemble(spark, d), first=40, order=["vec_id"]), "share")
