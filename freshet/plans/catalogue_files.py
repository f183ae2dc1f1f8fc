"""Queries of the sources and sinks, which write the warehouse views in a layout and read them back, and of experiment helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import cmal, metrics
from freshet.operators import align, scaler, sequences, splits
from freshet.plans import evaluation, views
from freshet.plans.catalogue import _DENSE, _MOMENTS, _SKILL, _basins, _curve, _dense, _mom, _query, _round, _skill
from freshet.plans.views import sql
from freshet.sources import tables, zarr3
from freshet.sources.work import folder
from freshet.sources.zarr3_writer import rechunk, save

_NAMED = "'r' || (basin % 5) || '_' || basin"


def _named(df: DataFrame) -> DataFrame:
    """Basins named as ``<subdataset>_<gauge>``."""
    return df.withColumn("basin", F.concat(F.lit("r"), (F.col("basin") % 5).cast("string"), F.lit("_"), F.col("basin").cast("string")))


def _names(df: DataFrame) -> list[str]:
    return sorted(r[0] for r in df.select("basin").distinct().collect())


def _rows(spark, schema_: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema_)


# --- files ----------------------------------------------------------------------------------------------------------


@_query("csv_attributes", f"{sql('statics')} SELECT {_NAMED} AS basin, region::FLOAT AS region, n_suppliers::FLOAT AS n_suppliers FROM statics")
def _(spark, d):
    s, root = _named(views.statics(spark, d)), folder(spark, "attributes")
    tables.write_attributes(s.select("basin", "region"), root, "a")
    tables.write_attributes(s.select("basin", "region", "n_suppliers"), root, "b")
    return tables.read_attributes(spark, root, _names(s), ["region", "n_suppliers"])


@_query("csv_series", f"{sql('lines', 'two')} SELECT {_NAMED} AS basin, date, 0 AS lead_time, b::FLOAT AS b, a::FLOAT AS a FROM two")
def _(spark, d):
    two, root = _named(views.two_products(spark, d)), folder(spark, "series")
    tables.write_timeseries(two, root)
    return tables.read_hindcasts(spark, root, _names(two), ["b", "a"])


@_query(
    "csv_forecasts",
    f"{sql('lines', 'lead')} SELECT {_NAMED.replace('basin', 'k.basin')} AS basin, k.date, l AS lead_time, obs::FLOAT AS q FROM (SELECT DISTINCT basin, date FROM lead_flow) k CROSS JOIN (SELECT unnest(range(1, 8))::INTEGER AS l) LEFT JOIN lead_flow f ON f.basin = k.basin AND f.date = k.date AND f.lead_time = l",
)
def _(spark, d):
    root = folder(spark, "forecasts")
    wide = _named(views.lead_flow(spark, d).groupBy("basin", "date").pivot("lead_time", list(range(1, 8))).agg(F.first("obs")))
    tables.write_forecasts(wide, root, "q")
    return tables.read_forecasts(spark, root, _names(wide), "q")


@_query("basin_list", f"SELECT {_NAMED.replace('basin', 'n_nationkey')} AS basin FROM nation")
def _(spark, d):
    root = folder(spark, "basins")
    tables.write_basins(_named(_basins(spark, d)), root)
    return _rows(spark, "basin string", [(b,) for b in tables.read_basins(spark, root)])


@_query("results_newest", f"{sql('lines', 'daily')} SELECT {_NAMED} AS basin, date, obs, obs + 12 AS sim FROM daily")
def _(spark, d):
    flow, run = _named(views.daily_flow(spark, d)).select("basin", "date", "obs"), folder(spark, "run")
    for epoch in (3, 12):
        tables.write_results(flow.withColumn("sim", F.col("obs") + epoch), f"{run}/test/model_epoch{epoch:03d}/results")
    return tables.read_results(spark, run)


@_query(
    "results_zarr",
    f"{sql('lines', 'daily')}, cells AS (SELECT basin, date FROM (SELECT DISTINCT basin FROM daily) CROSS JOIN (SELECT DISTINCT date FROM daily)) SELECT {_NAMED} AS basin, date, 0 AS time_step, obs::FLOAT AS obs, (obs * 2)::FLOAT AS sim FROM cells LEFT JOIN daily USING (basin, date)",
)
def _(spark, d):
    run = folder(spark, "run")
    flow = _named(views.daily_flow(spark, d)).select("basin", "date", F.lit(0).alias("time_step"), "obs", (F.col("obs") * 2).alias("sim"))
    tables.write_results(flow, f"{run}/test/model_epoch001/results.zarr", "zarr")
    return tables.read_results(spark, run)


@_query("zarr_some_basins", f"{sql('lines', 'daily')}, cells AS (SELECT basin, date FROM (SELECT DISTINCT basin FROM daily WHERE basin IN (3, 7)) CROSS JOIN (SELECT DISTINCT date FROM daily)) SELECT {_NAMED} AS basin, date, obs::FLOAT AS obs FROM cells LEFT JOIN daily USING (basin, date)")
def _(spark, d):
    store = f"{folder(spark, 'store')}/timeseries.zarr"
    zarr3.write(_named(views.daily_flow(spark, d)), store, ["basin", "date"], ["obs", "sim"])
    zarr3.register(spark)
    return spark.read.format("zarr3").option("variables", "obs").option("basins", "r3_3,r2_7").load(store)


_CELLS = "cells AS (SELECT basin, date FROM (SELECT DISTINCT basin FROM daily) CROSS JOIN (SELECT DISTINCT date FROM daily))"


@_query("results_append", f"{sql('lines', 'daily')}, {_CELLS} SELECT {_NAMED} AS basin, date, obs::FLOAT AS obs, sim::FLOAT AS sim FROM cells LEFT JOIN daily USING (basin, date)")
def _(spark, d):
    run, flow = folder(spark, "run"), _named(views.daily_flow(spark, d))
    least = flow.agg(F.min("basin")).first()[0]
    nothing = F.lit(None).cast("double")
    # the first basins bring all dates, so that those of the others are there
    days = flow.select(F.lit(least).alias("basin"), "date", nothing.alias("obs"), nothing.alias("sim"))
    first = flow.where(F.col("basin") == least).unionByName(days).groupBy("basin", "date").agg(F.max("obs").alias("obs"), F.max("sim").alias("sim"))
    rest = flow.where(F.col("basin") != least)
    path = f"{run}/test/model_epoch001/results.zarr"
    tables.write_results(first, path, "zarr")
    for some in (F.col("basin") < "r2", F.col("basin") >= "r2"):
        tables.write_results(rest.where(some), path, "zarr", append=True)
    return tables.read_results(spark, run)


@_query(
    "zarr_filters",
    f"{sql('lines', 'lead')}, cells AS (SELECT basin, date, lead_time FROM (SELECT DISTINCT basin FROM lead_flow) CROSS JOIN (SELECT DISTINCT date FROM lead_flow) CROSS JOIN (SELECT DISTINCT lead_time FROM lead_flow)) SELECT {_NAMED} AS basin, date, lead_time::BIGINT AS lead_time, obs::FLOAT AS obs FROM cells LEFT JOIN lead_flow USING (basin, date, lead_time) WHERE basin IN (3, 7) AND date BETWEEN DATE '1996-02-01' AND DATE '1996-05-31' AND lead_time <= 2",
)
def _(spark, d):
    store = f"{folder(spark, 'store')}/timeseries.zarr"
    save(_named(views.lead_flow(spark, d)).select("basin", "date", "lead_time", "obs"), store, ["basin", "date", "lead_time"], chunks={"basin": 1, "date": 180, "lead_time": 2})
    return spark.read.format("zarr3").load(store).where("basin IN ('r3_3', 'r2_7') AND date BETWEEN DATE '1996-02-01' AND DATE '1996-05-31' AND lead_time <= 2")


@_query("zarr_rechunk", f"{sql('lines', 'daily')}, {_CELLS} SELECT {_NAMED} AS basin, date, obs::FLOAT AS obs, sim::FLOAT AS sim FROM cells LEFT JOIN daily USING (basin, date)")
def _(spark, d):
    root = folder(spark, "store")
    save(_named(views.daily_flow(spark, d)), f"{root}/a.zarr", ["basin", "date"], ["obs", "sim"])
    rechunk(spark, f"{root}/a.zarr", f"{root}/b.zarr", {"basin": 4, "date": 365})
    return spark.read.format("zarr3").load(f"{root}/b.zarr")


@_query("metrics_csv", f"{_SKILL} SELECT basin::VARCHAR AS basin, lead_time, round(NSE, 6) AS NSE FROM skill")
def _(spark, d):
    skill, path = _round(_skill(spark, d).select("basin", "lead_time", "NSE"), "NSE"), f"{folder(spark, 'metrics')}/m"
    tables.write_metrics(skill.where("lead_time <= 3"), path)
    tables.write_metrics(skill.where("lead_time > 3"), path, append=True)
    return tables.read_metrics(spark, path)


@_query("scaler_file", f"{sql('lines', 'daily')} SELECT 'obs' AS feature, round(avg(obs), 6) AS mean, round(stddev_pop(obs), 6) AS std FROM daily")
def _(spark, d):
    path = folder(spark, "scaler")
    scaler.save(scaler.fit(views.daily_flow(spark, d), ["obs"]), path)
    return _round(scaler.load(spark, path).select("feature", "mean", "std"), "mean", "std")


@_query("scaler_exact_median", f"{sql('lines', 'daily')} SELECT 'obs' AS feature, median(obs) AS center FROM daily UNION ALL SELECT 'sim', round(median(sim), 6) FROM daily")
def _(spark, d):
    custom = {f: {"centering": "median"} for f in ("obs", "sim")}
    return _round(scaler.fit(views.daily_flow(spark, d), ["obs", "sim"], custom, folder(spark, "medians")).select("feature", "center"), "center")


# --- alignment and samples ------------------------------------------------------------------------------------------


@_query("outer_concat", f"{sql('lines', 'two')} SELECT basin, date, a, NULL::DOUBLE AS b FROM two WHERE basin < 9 UNION ALL SELECT basin, date, NULL, b FROM two WHERE basin >= 9")
def _(spark, d):
    two = views.two_products(spark, d)
    return align.outer_concat([two.where("basin < 9").select("basin", "date", "a"), two.where("basin >= 9").select("basin", "date", "b")])


@_query("concat_override", f"{sql('lines', 'two')} SELECT basin, date, CASE WHEN basin < 9 THEN a ELSE b END AS v FROM two")
def _(spark, d):
    two = views.two_products(spark, d)
    return align.concat_override([two.where("basin < 9").select("basin", "date", F.col("a").alias("v")), two.select("basin", "date", F.col("b").alias("v"))])


@_query("prefix_filter", f"{sql('lines', 'daily')} SELECT {_NAMED} AS basin, date FROM daily WHERE basin % 5 = 2")
def _(spark, d):
    return align.prefix_filter(_named(views.daily_flow(spark, d)), "r2").select("basin", "date")


@_query("sample_dates", f"{_DENSE} SELECT basin, date, first, last, n FROM (SELECT basin, date, min(date) OVER w AS first, max(date) OVER w AS last, count(*) OVER w AS n FROM dense WINDOW w AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)) WHERE n = 7")
def _(spark, d):
    dates = sequences.sample_dates(_dense(spark, d), 7, 2)
    return dates.select("basin", "date", F.array_min("dates").alias("first"), F.array_max("dates").alias("last"), F.size("dates").cast("long").alias("n"))


@_query("limit_batches", f"{sql('lines', 'daily')} SELECT basin, count(*) AS n FROM (SELECT basin, row_number() OVER (PARTITION BY basin ORDER BY date) AS k FROM daily) WHERE k <= 3 * 32 GROUP BY basin")
def _(spark, d):
    batches = sequences.basin_batches(views.daily_flow(spark, d).select("basin", "date"), 32)
    return sequences.limit_batches(batches, 3).groupBy("basin").agg(F.count("*").alias("n"))


@_query("random_basins", "SELECT n_nationkey AS basin FROM nation ORDER BY md5('5:' || n_nationkey), n_nationkey LIMIT 7")
def _(spark, d):
    return splits.random_basins(_basins(spark, d), 7, seed=5)


_FILES = "SELECT 'split' || n_regionkey || CASE WHEN n_nationkey % 5 = 0 THEN '_train.txt' WHEN n_nationkey % 5 = 1 THEN '_test.txt' ELSE '_notes.md' END AS name FROM nation"


@_query(
    "pair_files",
    f"WITH f AS ({_FILES}) SELECT split_part(name, '_', 1) AS experiment, max(name) FILTER (WHERE name LIKE '%train.txt') AS train, max(name) FILTER (WHERE name LIKE '%test.txt') AS test FROM f WHERE name LIKE '%.txt' GROUP BY 1",
)
def _(spark, d):
    kind = F.when(F.col("n_nationkey") % 5 == 0, "_train.txt").when(F.col("n_nationkey") % 5 == 1, "_test.txt").otherwise("_notes.md")
    return splits.pair_files(views.table(spark, d, "nation").select(F.concat(F.lit("split"), F.col("n_regionkey").cast("string"), kind).alias("name")))


@_query(
    "temporal_cv",
    """WITH y AS (SELECT year(min(o_orderdate)) AS lo, year(max(o_orderdate)) AS hi FROM orders), t AS (SELECT unnest(range(lo + 1, hi))::INTEGER AS test_year, lo, hi FROM y)
    SELECT test_year, 'test' AS role, make_date(test_year, 1, 1) AS start_date, make_date(test_year, 12, 31) AS end_date FROM t
    UNION ALL SELECT test_year, 'train', make_date(lo, 1, 1), make_date(test_year - 2, 12, 31) FROM t WHERE test_year - 2 >= lo
    UNION ALL SELECT test_year, 'train', make_date(test_year + 2, 1, 1), make_date(hi, 12, 31) FROM t WHERE test_year + 2 <= hi""",
)
def _(spark, d):
    y = views.table(spark, d, "orders").agg(F.year(F.min("o_orderdate")).alias("lo"), F.year(F.max("o_orderdate")).alias("hi")).first()
    return splits.temporal_cv(spark, y.lo + 1, y.hi - 1, y.lo, y.hi, 1)


# --- evaluation -----------------------------------------------------------------------------------------------------


@_query(
    "evaluated_pairs",
    f"{sql('lines', 'lead')}, sim AS (SELECT basin, date, lead_time - 1 AS time_step, sim FROM lead_flow WHERE basin < 20), obs AS (SELECT basin, date, lead_time - 1 AS time_step, obs FROM lead_flow WHERE basin > 3 AND lead_time <> 2) "
    "SELECT basin, date, time_step, obs, round(sim, 6) AS sim FROM sim FULL JOIN obs USING (basin, date, time_step) WHERE basin BETWEEN 4 AND 19 AND time_step = 4",
)
def _(spark, d):
    flow = views.lead_flow(spark, d).withColumn("time_step", F.col("lead_time") - 1)
    paired = evaluation.pair_steps(flow.where("basin < 20"), flow.where("basin > 3 AND lead_time <> 2"))
    return _round(evaluation.evaluation_step(paired, 3, 7), "sim")


@_query("time_steps", f"{sql('lines', 'daily')} SELECT basin, date, (date - DATE '1995-01-01')::INTEGER + 3 AS time_step FROM daily")
def _(spark, d):
    rows = views.daily_flow(spark, d).select("basin", "date").withColumn("last_date", F.lit("1995-01-01").cast("date"))
    return evaluation.time_steps(rows, lead_time=3).drop("last_date")


@_query(
    "targets_skill",
    f"{sql('lines', 'two', 'daily')}, wide AS (SELECT basin, date, daily.obs, daily.sim, a, b FROM two JOIN daily USING (basin, date)), {_mom('wide', 'basin')}, m1 AS (SELECT basin, {_MOMENTS['NSE']} AS x FROM mom), w2 AS (SELECT basin, a AS obs, b AS sim FROM wide), {_mom('w2', 'basin').replace('mom AS', 'mom2 AS')}, m2 AS (SELECT basin, {_MOMENTS['RMSE']} AS y, {_MOMENTS['KGE']} AS z FROM mom2) SELECT basin, round(x, 6) AS q_NSE, round(y, 6) AS p_RMSE, round(z, 6) AS p_KGE FROM m1 FULL JOIN m2 USING (basin)",
)
def _(spark, d):
    wide = views.two_products(spark, d).join(views.daily_flow(spark, d), ["basin", "date"])
    named = wide.select("basin", "date", F.col("obs").alias("q_obs"), F.col("sim").alias("q_sim"), F.col("a").alias("p_obs"), F.col("b").alias("p_sim"))
    return _round(evaluation.targets_skill(named, {"q": ["NSE"], "p": ["RMSE", "KGE"]}), "q_NSE", "p_RMSE", "p_KGE")


@_query("undefined_groups", f"{sql('lines', 'daily')} SELECT basin, 0 AS n_obs, count(sim) AS n_sim FROM daily WHERE basin % 7 = 0 GROUP BY basin")
def _(spark, d):
    return evaluation.undefined(views.daily_flow(spark, d).withColumn("obs", F.when(F.col("basin") % 7 != 0, F.col("obs"))))


@_query(
    "skill_bars",
    f"{_SKILL}, first AS (SELECT basin, NSE FROM skill WHERE lead_time = 1) SELECT (row_number() OVER (ORDER BY NSE NULLS LAST, basin))::INTEGER AS rank, basin, round(NSE, 6) AS NSE, CASE WHEN basin < 10 THEN 'train' WHEN basin < 18 THEN 'test' ELSE 'other' END AS class FROM first",
)
def _(spark, d):
    b = _basins(spark, d)
    return _round(evaluation.skill_bars(_skill(spark, d), "NSE", b.where("basin < 10"), b.where("basin BETWEEN 5 AND 17"), lead=1), "NSE")


@_query("basins_per_product", f"{sql('lines', 'two')} SELECT 'first' AS product, count(DISTINCT basin) AS basins FROM two WHERE a > 60 UNION ALL SELECT 'any', count(DISTINCT basin) FROM two WHERE a > 60 OR b > 100")
def _(spark, d):
    two = views.two_products(spark, d).withColumns({"a": F.when(F.col("a") > 60, F.col("a")), "b": F.when(F.col("b") > 100, F.col("b"))})
    return evaluation.basins_per_product(two, {"first": ["a"], "any": ["a", "b"]})


_UNIFORM = "((('0x' || substr(md5('3:{k}:' || basin || ':' || date), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"


@_query(
    "label_noise",
    f"{sql('lines', 'daily')}, fit AS (SELECT avg(obs) AS m, stddev_pop(obs) AS s FROM daily), z AS (SELECT basin, date, (obs - m) / s AS y, m / s AS ratio, sqrt(-2 * ln({_UNIFORM.format(k='obs:0')})) * cos(2 * pi() * {_UNIFORM.format(k='obs:1')}) AS e FROM daily, fit) SELECT basin, date, round(y + (y + ratio) * e * 0.1::DOUBLE, 6) AS obs FROM z",
)
def _(spark, d):
    flow = views.daily_flow(spark, d).select("basin", "date", "obs")
    fitted = scaler.fit(flow, ["obs"])
    return _round(scaler.with_noise(scaler.scale(flow, fitted, ["obs"]), fitted, ["obs"], 0.1, seed=3), "obs")


@_query("pooled_curves", f"{sql('lines', 'lead')}, {_curve('lead_flow', 'lead_time')} SELECT lead_time, round(FHV, 5) AS FHV, round(FMS, 5) AS FMS, round(FLV, 5) AS FLV FROM fhv JOIN fms USING (lead_time) JOIN flv USING (lead_time)")
def _(spark, d):
    return _round(metrics.pooled_curves(views.lead_flow(spark, d), ["lead_time"], folder(spark, "curves")), "FHV", "FMS", "FLV", digits=5)


@_query("head_points", f"WITH {views.SQL['mix']} SELECT vec_id, 20 AS drawn, 10 AS fixed FROM mix")
def _(spark, d):
    m = views.mixtures(spark, d)
    both = cmal.points(cmal.points(m, "CMAL", 20, "a", keys=["vec_id"]), "cmal_deterministic", 0, "b")
    count = lambda c: F.size(F.filter(c, lambda x: x.isNotNull()))
    return both.select("vec_id", count("a").alias("drawn"), count("b").alias("fixed"))
