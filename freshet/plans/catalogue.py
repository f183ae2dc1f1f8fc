"""One query for each operator family over the warehouse tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import schema
from freshet.functions import cmal, losses, metrics
from freshet.operators import align, scaler, sequences, splits, validate
from freshet.operators.union import union_features
from freshet.plans import evaluation, views
from freshet.plans.views import sql
from freshet.streaming.skill import windowed_skill

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PERIODS = [("1996-01-01", "1997-12-31"), ("1999-01-01", "1999-12-31")]
_IN = "(date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' OR date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31')"


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return align.densify(views.daily_flow(spark, d))


_DENSE = sql("lines", "daily", dense="daily", cols="obs, sim")


# --- alignment ------------------------------------------------------------------------------------------------------


@_query("densify_daily", f"{_DENSE} SELECT basin, date, obs, round(sim, 6) AS sim FROM dense")
def _(spark, d):
    return _round(_dense(spark, d), "sim")


@_query(
    "densify_hourly",
    """WITH e AS (SELECT event_type AS basin, date_trunc('hour', ts) AS date, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY ALL),
    cal AS (SELECT basin, unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM e GROUP BY basin)
    SELECT cal.basin, (epoch(cal.date) / 3600)::BIGINT AS hour, v FROM cal LEFT JOIN e ON e.basin = cal.basin AND e.date = cal.date""",
)
def _(spark, d):
    e = views.table(spark, d, "events").groupBy(F.col("event_type").alias("basin"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("date")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return align.densify(e, step="1 hour").select("basin", (F.unix_timestamp("date") / 3600).cast("long").alias("hour"), "v")


@_query("period_crop", f"{sql('lines', 'daily')} SELECT basin, date, obs FROM daily WHERE {_IN}")
def _(spark, d):
    return align.crop(views.daily_flow(spark, d), align.check_periods(*zip(*PERIODS, strict=True))).select("basin", "date", "obs")


@_query(
    "extended_period_halo",
    f"{sql('lines', 'daily')} SELECT basin, date, obs FROM daily WHERE date BETWEEN DATE '1996-01-01' - 30 AND DATE '1997-12-31' + 7 OR date BETWEEN DATE '1999-01-01' - 30 AND DATE '1999-12-31' + 7",
)
def _(spark, d):
    return align.crop(views.daily_flow(spark, d), PERIODS, 30, 7).select("basin", "date", "obs")


@_query("outer_merge_sources", f"{sql('lines', 'two')}, x AS (SELECT basin, date, a FROM two WHERE a IS NOT NULL), y AS (SELECT basin, date, b FROM two WHERE b IS NOT NULL) SELECT basin, date, a, b FROM x FULL JOIN y USING (basin, date)")
def _(spark, d):
    two = views.two_products(spark, d)
    return align.outer_merge([two.where("a is not null").select("basin", "date", "a"), two.where("b is not null").select("basin", "date", "b")])


@_query("attr_merge_no_conflict", f"{sql('statics')}, x AS (SELECT basin, region, balance FROM statics WHERE basin < 20), y AS (SELECT basin, region, n_suppliers FROM statics WHERE basin >= 10) SELECT basin, coalesce(x.region, y.region) AS region, round(balance, 6) AS balance, n_suppliers FROM x FULL JOIN y USING (basin)")
def _(spark, d):
    s = views.statics(spark, d)
    return _round(align.merge_no_conflict(s.where("basin < 20").select("basin", "region", "balance"), s.where("basin >= 10").select("basin", "region", "n_suppliers")), "balance")


@_query("missing_basins_anti", "SELECT n_nationkey AS basin FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 15)")
def _(spark, d):
    have = views.table(spark, d, "supplier").where("s_suppkey < 15").select(F.col("s_nationkey").alias("basin"))
    return align.missing_basins(views.table(spark, d, "nation").select(F.col("n_nationkey").alias("basin")), have)


@_query("basin_semi", f"{sql('lines', 'daily')} SELECT basin, date, obs FROM daily WHERE basin IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(spark, d):
    wanted = views.table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("basin"))
    return align.select_basins(views.daily_flow(spark, d), wanted).select("basin", "date", "obs")


_SETS = ("SELECT s_nationkey AS basin FROM supplier WHERE s_acctbal > 5000", "SELECT c_nationkey AS basin FROM customer WHERE c_acctbal > 9900")


def _sets(spark, d):
    return views.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("basin")), views.table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("basin"))


@_query("set_intersect", " INTERSECT ".join(_SETS))
def _(spark, d):
    return splits.common_basins(*_sets(spark, d))


@_query("set_difference", " EXCEPT ".join(_SETS))
def _(spark, d):
    return splits.basins_without(*_sets(spark, d))


@_query("set_union_dates", "SELECT DISTINCT unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + o_orderkey::INTEGER % 4, INTERVAL 1 DAY))::DATE AS date FROM orders WHERE o_custkey % 50 = 0")
def _(spark, d):
    o, start = views.table(spark, d, "orders").where("o_custkey % 50 = 0"), F.col("o_orderdate").cast("date")
    return splits.union_ranges(o.select(start.alias("start_date"), F.date_add(start, (F.col("o_orderkey") % 4).cast("int")).alias("end_date")))


@_query("forecast_melt", f"{sql('lines', 'lead')} SELECT k.basin, k.date, l AS lead_time, obs AS value FROM (SELECT DISTINCT basin, date FROM lead_flow) k CROSS JOIN (SELECT unnest(range(1, 8))::INTEGER AS l) LEFT JOIN lead_flow f ON f.basin = k.basin AND f.date = k.date AND f.lead_time = l")
def _(spark, d):
    wide = views.lead_flow(spark, d).groupBy("basin", "date").pivot("lead_time", list(range(1, 8))).agg(F.first("obs"))
    return align.melt_leads(wide, "value", [str(i) for i in range(1, 8)])


@_query("lead_slice", f"{sql('lines', 'lead')} SELECT basin, date, lead_time, obs FROM lead_flow WHERE lead_time BETWEEN 1 AND 4")
def _(spark, d):
    return align.lead_slice(views.lead_flow(spark, d), 4).select("basin", "date", "lead_time", "obs")


@_query("product_bands", "SELECT upper(split_part(f, '_', 1)) AS product, string_agg(DISTINCT f, ',' ORDER BY f) AS bands FROM (SELECT lower(c_mktsegment) || '_' || c_nationkey AS f FROM customer) GROUP BY 1")
def _(spark, d):
    f = views.table(spark, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string")).alias("feature"))
    return schema.band_table(f).select("product", F.array_join("bands", ",").alias("bands"))


@_query("shift_positions", f"{_DENSE} SELECT basin, date, lag(obs, 3) OVER w AS back, lead(obs, 2) OVER w AS ahead FROM dense WINDOW w AS (PARTITION BY basin ORDER BY date)")
def _(spark, d):
    return align.shift(align.shift(_dense(spark, d), "obs", 3, "back"), "obs", -2, "ahead").select("basin", "date", "back", "ahead")


@_query(
    "expand_lead_times",
    f"""{_DENSE}, a AS (SELECT basin, date, [lead(obs, 1) OVER w, lead(obs, 2) OVER w, lead(obs, 3) OVER w] AS v FROM dense WINDOW w AS (PARTITION BY basin ORDER BY date))
    SELECT basin, date, unnest([1, 2, 3])::INTEGER AS lead_time, unnest(v) AS obs FROM a""",
)
def _(spark, d):
    return align.expand_lead_times(_dense(spark, d).select("basin", "date", "obs"), "obs", [1, 2, 3])


# --- unioning -------------------------------------------------------------------------------------------------------


def _forecasts(spark, d):
    f = views.lead_flow(spark, d)
    return f.select("basin", "date", "lead_time", F.when(F.col("obs") % 5 != 0, F.col("obs")).alias("fc"))


_FC = "fc AS (SELECT basin, date, lead_time, CASE WHEN obs % 5 <> 0 THEN obs END AS fc FROM lead_flow)"


@_query("union_same_dims", f"{sql('lines', 'two')} SELECT basin, date, coalesce(a, b) AS a, b FROM two")
def _(spark, d):
    return union_features(views.two_products(spark, d), None, {"a": "b", "b": "b", "absent": "b"})[0]


@_query("union_fc_with_obs", f"{sql('lines', 'daily', 'lead')}, {_FC} SELECT f.basin, f.date, f.lead_time, coalesce(fc, obs) AS fc FROM fc f LEFT JOIN daily o ON o.basin = f.basin AND o.date = f.date + f.lead_time")
def _(spark, d):
    return union_features(views.daily_flow(spark, d).select("basin", "date", "obs"), _forecasts(spark, d), {"fc": "obs"})[1]


@_query("union_obs_with_fc", f"{sql('lines', 'daily', 'lead', dense='daily', cols='obs, sim')}, {_FC} SELECT d.basin, d.date, coalesce(obs, fc) AS obs FROM dense d LEFT JOIN fc f ON f.basin = d.basin AND f.lead_time = 1 AND f.date + 1 = d.date")
def _(spark, d):
    return union_features(_dense(spark, d).select("basin", "date", "obs"), _forecasts(spark, d), {"obs": "fc"})[0]


# --- scaler ---------------------------------------------------------------------------------------------------------

_FIT = "SELECT '{f}' AS feature, round({c}, 6) AS center, round({s}, 6) AS scale, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std FROM daily"
CUSTOM = {"obs": {"centering": "min", "scaling": "minmax"}, "sim": {"centering": "Median", "scaling": "none"}}


@_query("scaler_fit", sql("lines", "daily") + " " + " UNION ALL ".join(_FIT.format(f=f, c=f"avg({f})", s=f"stddev_pop({f})") for f in ("obs", "sim")))
def _(spark, d):
    return _round(scaler.fit(views.daily_flow(spark, d), ["obs", "sim"]), "center", "scale", "mean", "std")


@_query("scaler_custom", sql("lines", "daily") + " " + _FIT.format(f="obs", c="min(obs)", s="max(obs) - min(obs)") + " UNION ALL " + _FIT.format(f="sim", c="median(sim)", s="1.0::DOUBLE"))
def _(spark, d):
    return _round(scaler.fit(views.daily_flow(spark, d), ["obs", "sim"], CUSTOM), "center", "scale", "mean", "std")


@_query("scaler_aliases", sql("lines", "daily") + " SELECT unnest(['obs', 'obs_obs', 'obs_sim']) AS feature, round(avg(obs), 6) AS mean FROM daily")
def _(spark, d):
    return _round(scaler.with_aliases(scaler.fit(views.daily_flow(spark, d), ["obs"]), ["obs"]).select("feature", "mean"), "mean")


@_query("scale", f"{sql('lines', 'daily')} SELECT basin, date, round((obs - avg(obs) OVER ()) / stddev_pop(obs) OVER (), 6) AS obs FROM daily")
def _(spark, d):
    flow = views.daily_flow(spark, d).select("basin", "date", "obs")
    return _round(scaler.scale(flow, scaler.fit(flow, ["obs"]), ["obs"]), "obs")


@_query("unscale_roundtrip", f"{sql('lines', 'daily')} SELECT basin, date, round(obs, 6) AS obs FROM daily")
def _(spark, d):
    flow = views.daily_flow(spark, d).select("basin", "date", "obs")
    known = scaler.parameters(scaler.fit(flow, ["obs"]))
    return _round(scaler.unscale(scaler.scale(flow, known, ["obs"]), known, ["obs"]), "obs")


@_query("zero_scale_check", "SELECT 'same' AS feature")
def _(spark, d):
    return scaler.zero_scales(scaler.fit(views.daily_flow(spark, d).withColumn("same", F.lit(3.0)), ["obs", "same"])).select("feature")


@_query("normalised_zero", f"{sql('lines', 'daily')} SELECT 'obs' AS feature, round(-avg(obs) / stddev_pop(obs), 6) AS zero FROM daily")
def _(spark, d):
    return _round(scaler.normalised_zero(scaler.fit(views.daily_flow(spark, d), ["obs"])), "zero")


# --- validation -----------------------------------------------------------------------------------------------------


def _four(spark, d):
    return align.densify(views.two_products(spark, d).join(views.daily_flow(spark, d), ["basin", "date"]).withColumn("sim", F.when(F.col("sim") > 20, F.col("sim"))))


_FOUR = sql("lines", "two", "daily") + ", four AS (SELECT basin, date, a, b, obs, CASE WHEN sim > 20 THEN sim END AS sim FROM two JOIN daily USING (basin, date)), " + views.SQL["dense"].format(src="four", cols="a, b, obs, sim")

for _name, _mask, _cond in (
    ("mask_any", lambda: validate.policy("input_replacing", ["a", "b", "obs", "sim"]), "a IS NOT NULL OR b IS NOT NULL OR obs IS NOT NULL OR sim IS NOT NULL"),
    ("mask_all", lambda: validate.policy(None, ["a", "b", "obs", "sim"]), "a IS NOT NULL AND b IS NOT NULL AND obs IS NOT NULL AND sim IS NOT NULL"),
    ("mask_any_all_group", lambda: validate.policy("masked_mean", [["a", "b"], ["obs", "sim"]]), "(a IS NOT NULL AND b IS NOT NULL) OR (obs IS NOT NULL AND sim IS NOT NULL)"),
    ("mask_all_any_group", lambda: validate.policy("unioning", [["a", "b"], ["sim"]]), "(a IS NOT NULL OR b IS NOT NULL) AND sim IS NOT NULL"),
):
    QUERIES[_name] = lambda spark, d, m=_mask: _four(spark, d).select("basin", "date", m().alias("valid"))
    ORACLES[_name] = f"{_FOUR} SELECT basin, date, {_cond} AS valid FROM dense"
ORACLES["mask_allzero"] = f"{_FOUR} SELECT basin, date, coalesce(a % 3 <> 0, true) OR coalesce(b % 3 <> 0, true) AS valid FROM dense"
QUERIES["mask_allzero"] = lambda spark, d: _four(spark, d).withColumns({"a": F.col("a") % 3, "b": F.col("b") % 3}).select("basin", "date", validate.nonzero(["a", "b"]).alias("valid"))


@_query("mask_all_leads", f"{sql('lines', 'lead')} SELECT basin, date, count(DISTINCT lead_time) FILTER (WHERE lead_time <= 2) = 2 AS complete, count(*) FILTER (WHERE lead_time <= 2) > 0 AS some FROM lead_flow WHERE lead_time <= 2 GROUP BY basin, date")
def _(spark, d):
    folded = validate.over_leads(align.lead_slice(views.lead_flow(spark, d), 2), ["obs"], 2)
    return folded.select("basin", "date", validate.lead_policy(None, ["obs"]).alias("complete"), validate.lead_policy("input_replacing", ["obs"]).alias("some"))


def _seq(n: int, shift: int, agg: str) -> str:
    frame = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
    return f"{_DENSE} SELECT basin, date, CASE WHEN count(*) OVER w = {n} THEN {agg}(obs IS NOT NULL) OVER w ELSE false END AS valid FROM dense WINDOW w AS (PARTITION BY basin ORDER BY date ROWS BETWEEN {frame(-(n - 1) + shift)} AND {frame(shift)})"


for _name, _fn, _n, _shift, _agg in (("seq_all", validate.sequence_all, 5, 1, "bool_and"), ("seq_any", validate.sequence_any, 3, 7, "bool_or"), ("seq_overlap", validate.sequence_all, 4, -1, "bool_and")):
    QUERIES[_name] = lambda spark, d, f=_fn, n=_n, s=_shift: _dense(spark, d).select("basin", "date", f(F.col("obs").isNotNull(), n, s).alias("valid"))
    ORACLES[_name] = _seq(_n, _shift, _agg)


def _valid(spark, d):
    dense = align.broadcast_static(_dense(spark, d), views.statics(spark, d).select("basin", "balance"))
    return validate.masks(dense, train=True, periods=PERIODS, statics=["balance"], hindcast=["obs", "sim"], targets=["obs"], seq_length=3, predict_last_n=2, lead_time=2, skip_zero=True)


_VALID = f"""{sql('statics', 'lines', 'daily', dense='daily', cols='obs, sim')},
 checked AS (SELECT dense.basin, dense.date, obs, balance IS NOT NULL AS valid_statics,
  CASE WHEN count(*) OVER h = 3 THEN bool_and(obs IS NOT NULL AND sim IS NOT NULL) OVER h ELSE false END AS valid_hindcasts, coalesce(obs <> 0, true) AS valid_non_zero_targets,
  CASE WHEN count(*) OVER t = 2 THEN bool_or(obs IS NOT NULL) OVER t ELSE false END AS valid_targets, {_IN.replace('date BETWEEN', 'dense.date BETWEEN')} AS valid_dates
  FROM dense LEFT JOIN statics USING (basin)
  WINDOW h AS (PARTITION BY dense.basin ORDER BY dense.date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), t AS (PARTITION BY dense.basin ORDER BY dense.date ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
 valid AS (SELECT *, valid_statics AND valid_hindcasts AND valid_non_zero_targets AND valid_targets AND valid_dates AS valid FROM checked)"""


@_query("validate_samples", f"{_VALID} SELECT basin, date, valid_statics, valid_hindcasts, valid_non_zero_targets, valid_targets, valid_dates, valid FROM valid")
def _(spark, d):
    return _valid(spark, d).drop("obs", "sim", "balance")


@_query("sample_index", f"{_VALID} SELECT row_number() OVER (ORDER BY basin, date) - 1 AS sample_id, basin, date FROM valid WHERE valid")
def _(spark, d):
    return validate.sample_index(_valid(spark, d))


# --- sequences ------------------------------------------------------------------------------------------------------


def _folded(df: DataFrame, column: str = "obs") -> DataFrame:
    """A sequence as its length, ends, sum and number of values (flows are whole numbers, so sums are exact)."""
    a = F.col(column)
    return df.select("basin", "date", F.size(a).cast("long").alias("n"), F.get(a, F.lit(0)).alias("head"), F.get(a, F.size(a) - 1).alias("tail"), F.aggregate(a, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0))).alias("total"), F.size(F.filter(a, lambda x: x.isNotNull())).cast("long").alias("n_there"))


def _fold_sql(src: str, first: int, last: int, where: str = "true") -> str:
    frame = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
    n = last - first + 1
    return f"""SELECT basin, date, n, head, tail, total, n_there FROM (SELECT *, count(*) OVER w AS n, first_value(obs) OVER w AS head, last_value(obs) OVER w AS tail, coalesce(sum(obs) OVER w, 0) AS total, count(obs) OVER w AS n_there
    FROM {src} WINDOW w AS (PARTITION BY basin ORDER BY date ROWS BETWEEN {frame(first)} AND {frame(last)})) WHERE n = {n} AND {where}"""


@_query("hindcast_seq", f"{_VALID} {_fold_sql('valid', -29, 0, 'valid')}")
def _(spark, d):
    return _folded(sequences.hindcast(_valid(spark, d), ["obs"], 30, "valid"))


@_query("hindcast_seq_year", f"{_DENSE} {_fold_sql('dense', -364, 0)}")
def _(spark, d):
    return _folded(sequences.hindcast(_dense(spark, d), ["obs"], 365))


@_query("hindcast_lead_seq", f"{_DENSE} {_fold_sql('dense', -10, -1)}")
def _(spark, d):
    return _folded(sequences.hindcast_of_forecasts(_dense(spark, d), ["obs"], 10))


@_query("target_seq", f"{_DENSE} {_fold_sql('dense', -2, 7)}")
def _(spark, d):
    return _folded(sequences.target(_dense(spark, d), ["obs"], 10, 7))


@_query("forecast_seq", f"{sql('lines', 'lead')}, {_FC} SELECT basin, date, string_agg(coalesce(fc::BIGINT::VARCHAR, '-'), ',' ORDER BY lead_time) AS steps FROM fc GROUP BY basin, date")
def _(spark, d):
    s = sequences.forecast(_forecasts(spark, d), ["fc"])
    return s.select("basin", "date", F.array_join(F.transform("fc", lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("-"))), ",").alias("steps"))


@_query(
    "forecast_overlap_seq",
    f"""{sql('lines', 'daily', 'lead', dense='daily', cols='obs, sim')}, f AS (SELECT basin, date, count(*) AS n, sum(obs) AS total FROM lead_flow GROUP BY basin, date),
    o AS (SELECT basin, date, count(*) OVER w AS n, sum(obs) OVER w AS total FROM dense WINDOW w AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
    SELECT basin, date, f.n + o.n AS n, f.total + coalesce(o.total, 0) AS total FROM f JOIN o USING (basin, date) WHERE o.n = 4""",
)
def _(spark, d):
    s = sequences.with_overlap(sequences.forecast(views.lead_flow(spark, d), ["obs"]), _dense(spark, d), ["obs"], 4, 1)
    return _folded(s).select("basin", "date", "n", "total")


@_query("predict_last_n", f"{_DENSE} {_fold_sql('dense', 5, 7)} AND date - 0 >= (SELECT min(date) FROM dense x WHERE x.basin = s.basin) + 2".replace("FROM (SELECT *, count", "FROM (SELECT *, count").replace("ROWS BETWEEN 5 FOLLOWING AND 7 FOLLOWING)) WHERE", "ROWS BETWEEN 5 FOLLOWING AND 7 FOLLOWING)) s WHERE"))
def _(spark, d):
    s = sequences.target(_dense(spark, d), ["obs"], 10, 7)
    return _folded(s.withColumn("obs", sequences.last_n("obs", 3)))


@_query("basin_batches", f"{_VALID} SELECT basin, date, (row_number() OVER (PARTITION BY basin ORDER BY date) - 1) // 64 AS batch FROM valid WHERE valid")
def _(spark, d):
    return sequences.basin_batches(_valid(spark, d).where("valid").select("basin", "date"), 64)


@_query("per_basin_std", f"{sql('lines', 'daily')} SELECT basin, round(stddev_pop(obs), 6) AS obs, round(stddev_pop(sim), 6) AS sim FROM daily GROUP BY basin")
def _(spark, d):
    return _round(sequences.per_basin_std(views.daily_flow(spark, d), ["obs", "sim"]), "obs", "sim")


# --- metrics --------------------------------------------------------------------------------------------------------

_MOMENTS = {
    "NSE": "1 - sq / nullif(n * vo, 0)", "MSE": "sq / n", "RMSE": "sqrt(sq / n)",
    "KGE": "1 - sqrt((cov / nullif(so * ss, 0) - 1) ** 2 + (ss / nullif(so, 0) - 1) ** 2 + (ms / nullif(mo, 0) - 1) ** 2)",
    "Alpha-NSE": "ss / nullif(so, 0)", "Pearson-r": "cov / nullif(so * ss, 0)", "Beta-KGE": "ms / nullif(mo, 0)", "Beta-NSE": "(ms - mo) / nullif(so, 0)",
}


def _mom(src: str, keys: str) -> str:
    return f"mom AS (SELECT {keys}, count(*) AS n, avg(obs) AS mo, avg(sim) AS ms, stddev_pop(obs) AS so, stddev_pop(sim) AS ss, var_pop(obs) AS vo, covar_pop(obs, sim) AS cov, sum((sim - obs) ** 2) AS sq FROM {src} WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY {keys})"


for _metric, _sql in _MOMENTS.items():
    _key = _metric.lower().replace("-", "_")
    QUERIES[_key] = lambda spark, d, m=_metric, k=_key: _round(metrics.evaluate(views.daily_flow(spark, d), ["basin"], m).select("basin", F.col(f"`{m}`").alias(k)), k)
    ORACLES[_key] = f"{sql('lines', 'daily')}, {_mom('daily', 'basin')} SELECT basin, round({_sql}, 6) AS {_key} FROM mom"


def _curve(src: str, keys: str) -> str:
    on = " AND ".join(f"m.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    out = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    ln_o, ln_s = "ln(CASE WHEN obs = 0 THEN 1e-6 ELSE obs END)", "ln(CASE WHEN sim <= 0 THEN 1e-6 ELSE sim END)"
    return f"""complete AS (SELECT {keys}, obs, sim FROM {src} WHERE obs IS NOT NULL AND sim IS NOT NULL),
    ro AS (SELECT {keys}, obs, row_number() OVER (PARTITION BY {keys} ORDER BY obs DESC) AS k FROM complete), rs AS (SELECT {keys}, sim, row_number() OVER (PARTITION BY {keys} ORDER BY sim DESC) AS k FROM complete),
    sizes AS (SELECT {keys}, count(*) AS n FROM complete GROUP BY {keys}),
    pairs AS (SELECT {out}, r.k, obs, sim, n, {ln_o} AS lo, {ln_s} AS ls FROM ro r JOIN rs m ON {on} AND m.k = r.k JOIN sizes z ON {on.replace('m.', 'z.')}),
    fhv AS (SELECT {keys}, sum(sim - obs) FILTER (WHERE k <= round_even(0.02::DOUBLE * n, 0)) / nullif(sum(obs) FILTER (WHERE k <= round_even(0.02::DOUBLE * n, 0)), 0) * 100 AS FHV FROM pairs GROUP BY {keys}),
    points AS (SELECT {keys}, max(lo) FILTER (WHERE k - 1 = round_even(0.2::DOUBLE * n, 0)) AS ol, max(lo) FILTER (WHERE k - 1 = round_even(0.7::DOUBLE * n, 0)) AS ou, max(ls) FILTER (WHERE k - 1 = round_even(0.2::DOUBLE * n, 0)) AS sl, max(ls) FILTER (WHERE k - 1 = round_even(0.7::DOUBLE * n, 0)) AS su FROM pairs GROUP BY {keys}),
    fms AS (SELECT {keys}, ((sl - su) - (ol - ou)) / (ol - ou + 1e-6) * 100 AS FMS FROM points),
    lowest AS (SELECT * FROM pairs WHERE k > n - CASE WHEN round_even(0.3::DOUBLE * n, 0) = 0 THEN n ELSE round_even(0.3::DOUBLE * n, 0) END),
    low AS (SELECT {keys}, sum(lo) - count(*) * min(lo) AS qo, sum(ls) - count(*) * min(ls) AS qs FROM lowest GROUP BY {keys}),
    flv AS (SELECT {keys}, -(qs - qo) / (qo + 1e-6) * 100 AS FLV FROM low)"""


for _metric in ("FHV", "FMS", "FLV"):
    _key = f"fdc_{_metric.lower()}"
    QUERIES[_key] = lambda spark, d, m=_metric, k=_key: _round(metrics.evaluate(views.daily_flow(spark, d), ["basin"], [m]).select("basin", F.col(m).alias(k)), k, digits=5)
    ORACLES[_key] = f"{sql('lines', 'daily')}, {_curve('daily', 'basin')} SELECT basin, round({_metric}, 5) AS {_key} FROM {_metric.lower()}"

_FLAGSHIP = [m.replace("-", "_") for m in _MOMENTS] + ["FHV", "FMS", "FLV"]


@_query(
    "metrics_by_basin_lead",
    f"{sql('lines', 'lead')}, {_mom('lead_flow', 'basin, lead_time')}, {_curve('lead_flow', 'basin, lead_time')} SELECT basin, lead_time, mom.n AS n_pairs, "
    + ", ".join(f"round({s}, 5) AS {m.replace('-', '_')}" for m, s in _MOMENTS.items())
    + ", round(FHV, 5) AS FHV, round(FMS, 5) AS FMS, round(FLV, 5) AS FLV FROM mom JOIN fhv USING (basin, lead_time) JOIN fms USING (basin, lead_time) JOIN flv USING (basin, lead_time)",
)
def flagship(spark, d):
    table = evaluation.skill(views.lead_flow(spark, d), metrics=[*metrics.MOMENTS, *metrics.CURVES])
    return _round(table.select("basin", "lead_time", "n_pairs", *[F.col(f"`{m}`").alias(m.replace("-", "_")) for m in (*metrics.MOMENTS, *metrics.CURVES)]), *_FLAGSHIP, digits=5)


def _peaks(name: str, x: str, apart: int, height: str = "true") -> str:
    """The peaks (basin, i, x) of a column of ``series``: middles of plateaus between a rise and a fall, high enough, the highest first at their distance."""
    return f"""{name}_n AS (SELECT basin, i, {x} AS x, CASE WHEN {x} = lag({x}) OVER (PARTITION BY basin ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM series),
    {name}_r AS (SELECT basin, run, min(i) AS s, max(i) AS e, any_value(x) AS x FROM (SELECT *, sum(fresh) OVER (PARTITION BY basin ORDER BY i) AS run FROM {name}_n) GROUP BY basin, run),
    {name}_m AS (SELECT basin, (s + e) // 2 AS i, x FROM (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM {name}_r WINDOW w AS (PARTITION BY basin ORDER BY run)) JOIN levels USING (basin) WHERE x > before AND x > after AND {height}),
    {name}_g(basin, rest, kept) AS (SELECT basin, list({{'i': i, 'x': x}} ORDER BY x DESC, i DESC), list_filter([i::BIGINT], lambda k: false) FROM {name}_m GROUP BY basin, list_filter([i::BIGINT], lambda k: false)
      UNION ALL SELECT basin, list_filter(rest, lambda p: abs(p.i - rest[1].i) >= {apart}), list_append(kept, rest[1].i::BIGINT) FROM {name}_g WHERE len(rest) > 0),
    {name} AS (SELECT basin, i, series.{x} AS x FROM (SELECT basin, unnest(kept) AS i FROM {name}_g WHERE len(rest) = 0) JOIN series USING (basin, i))"""


_SERIES = f"""{_DENSE.replace('WITH ', 'WITH RECURSIVE ', 1)}, series AS (SELECT basin, date, obs, sim, row_number() OVER (PARTITION BY basin ORDER BY date) - 1 AS i FROM dense WHERE obs IS NOT NULL AND sim IS NOT NULL),
    levels AS (SELECT basin, stddev_pop(obs) AS std, quantile_cont(obs, 0.8) AS high_obs, quantile_cont(sim, 0.8) AS high_sim FROM series GROUP BY basin)"""
#: Peaks at a distance of 100 steps, of which the prominence is at least the deviation.
_PROMINENT = f"""{_peaks('far', 'obs', 100)},
    sides AS (SELECT p.basin, p.i, any_value(p.x) AS x, coalesce(max(t.i) FILTER (WHERE t.i < p.i AND t.obs > p.x), -1) AS l, coalesce(min(t.i) FILTER (WHERE t.i > p.i AND t.obs > p.x), 1000000000) AS r FROM far p JOIN series t USING (basin) GROUP BY p.basin, p.i),
    prominent AS (SELECT p.basin, p.i FROM sides p JOIN series t USING (basin) JOIN levels z USING (basin) GROUP BY p.basin, p.i
      HAVING any_value(p.x) - greatest(min(t.obs) FILTER (WHERE t.i > p.l AND t.i <= p.i), min(t.obs) FILTER (WHERE t.i < p.r AND t.i >= p.i)) >= any_value(z.std))"""


def _around(name: str, peaks: str, w: int) -> str:
    """Peaks whose window of ``w`` steps on both sides lies in the series and spans no gap, with the date of the simulation's greatest value there."""
    return f"""{name} AS (SELECT p.basin, p.i, max(t.date) FILTER (WHERE t.i = p.i) AS date, first(t.date ORDER BY t.sim DESC, t.i) AS top,
      max(t.sim) FILTER (WHERE t.i = p.i) AS here, max(t.sim) FILTER (WHERE t.i = p.i - 1) AS before, max(t.sim) FILTER (WHERE t.i = p.i + 1) AS after
      FROM {peaks} p JOIN series t ON t.basin = p.basin AND t.i BETWEEN p.i - {w} AND p.i + {w} GROUP BY p.basin, p.i HAVING count(*) = {2 * w + 1} AND max(t.date) - min(t.date) = {2 * w})"""


_PEAK_SQL = {
    "Peak-Timing": (
        f"{_around('timed', 'prominent', 3)}, peak_timing AS (SELECT basin, avg(abs(CASE WHEN here > before AND here > after THEN 0 ELSE date - top END)) AS v FROM timed GROUP BY basin)",
        "peak_timing",
    ),
    "Missed-Peaks": (
        f"""{_peaks('high_o', 'obs', 30, 'x >= high_obs')}, {_peaks('high_s', 'sim', 30, 'x >= high_sim')}, {_around('met', 'high_o', 1)},
    lost AS (SELECT basin, count(*) AS n FROM met m WHERE NOT EXISTS (SELECT 1 FROM high_s s WHERE s.basin = m.basin AND abs(s.i - m.i) <= 1) GROUP BY basin),
    missed_peaks AS (SELECT basin, coalesce(coalesce(lost.n, 0) / nullif(o.n, 0), 0) AS v FROM levels LEFT JOIN (SELECT basin, count(*) AS n FROM high_o GROUP BY basin) o USING (basin) LEFT JOIN lost USING (basin))""",
        "missed_peaks",
    ),
    "Peak-MAPE": (
        "peak_mape AS (SELECT basin, CASE WHEN min(abs(obs)) > 0 THEN sum(abs((sim - obs) / obs)) / count(*) * 100 END AS v FROM prominent JOIN series USING (basin, i) GROUP BY basin)",
        "peak_mape",
    ),
}


@_query(
    "all_metrics_by_basin",
    f"{_SERIES}, {_mom('dense', 'basin')}, {_curve('dense', 'basin')}, {_PROMINENT}, {', '.join(x for x, _ in _PEAK_SQL.values())} SELECT basin, mom.n AS n_pairs, "
    + ", ".join(f'round({s}, 5) AS "{m}"' for m, s in _MOMENTS.items())
    + ", round(FHV, 5) AS FHV, round(FMS, 5) AS FMS, round(FLV, 5) AS FLV, "
    + ", ".join(f'round({t}.v, 5) AS "{m}"' for m, (_, t) in _PEAK_SQL.items())
    + " FROM mom JOIN fhv USING (basin) JOIN fms USING (basin) JOIN flv USING (basin) "
    + " ".join(f"LEFT JOIN {t} USING (basin)" for _, t in _PEAK_SQL.values()),
)
def _(spark, d):
    table = evaluation.skill(_dense(spark, d), ["basin"])
    return table.select(*[c if c in ("basin", "n_pairs") else F.round(F.col(f"`{c}`"), 5).alias(c) for c in table.columns])


for _metric, (_with, _table) in _PEAK_SQL.items():
    QUERIES[_table] = lambda spark, d, m=_metric, k=_table: _round(metrics.evaluate(_dense(spark, d), ["basin"], [m]).select("basin", F.col(f"`{m}`").alias(k)), k)
    ORACLES[_table] = f"{_SERIES}, {_PROMINENT + ', ' if _metric != 'Missed-Peaks' else ''}{_with} SELECT basin, round(v, 6) AS {_table} FROM levels LEFT JOIN {_table} USING (basin)"


# --- reports --------------------------------------------------------------------------------------------------------


def _skill(spark, d):
    return metrics.evaluate(views.lead_flow(spark, d), ["basin", "lead_time"], ["NSE", "KGE"])


_SKILL = f"{sql('lines', 'lead')}, {_mom('lead_flow', 'basin, lead_time')}, skill AS (SELECT basin, lead_time, {_MOMENTS['NSE']} AS NSE, {_MOMENTS['KGE']} AS KGE FROM mom)"


@_query("metrics_wide", f"{_SKILL} SELECT basin, round(max(NSE) FILTER (WHERE lead_time = 1), 6) AS lead_1, round(max(NSE) FILTER (WHERE lead_time = 4), 6) AS lead_4, round(max(NSE) FILTER (WHERE lead_time = 7), 6) AS lead_7 FROM skill GROUP BY basin")
def _(spark, d):
    wide = _skill(spark, d).groupBy("basin").pivot("lead_time", [1, 4, 7]).agg(F.first("NSE"))
    return _round(wide.select("basin", *[F.col(str(i)).alias(f"lead_{i}") for i in (1, 4, 7)]), "lead_1", "lead_4", "lead_7")


@_query("metrics_long", f"{_SKILL} SELECT basin, lead_time, 'NSE' AS metric, round(NSE, 6) AS value FROM skill UNION ALL SELECT basin, lead_time, 'KGE', round(KGE, 6) FROM skill")
def _(spark, d):
    return _round(_skill(spark, d).unpivot(["basin", "lead_time"], ["NSE", "KGE"], "metric", "value"), "value")


@_query("median_skill", f"{_SKILL} SELECT lead_time, round(median(NSE), 6) AS NSE, round(median(KGE), 6) AS KGE FROM skill GROUP BY lead_time")
def _(spark, d):
    return _round(evaluation.median_skill(_skill(spark, d), ["NSE", "KGE"], ["lead_time"]), "NSE", "KGE")


@_query("mean_skill", f"{_SKILL} SELECT lead_time, round(avg(NSE), 6) AS NSE, round(avg(KGE), 6) AS KGE FROM skill GROUP BY lead_time")
def _(spark, d):
    return _round(evaluation.mean_skill(_skill(spark, d), ["NSE", "KGE"], ["lead_time"]), "NSE", "KGE")


@_query("weighted_val_loss", "SELECT l_linenumber AS lead_time, round(sum(CASE WHEN l_discount > 0.01 THEN round(l_discount * 100) * round(l_quantity) END) / sum(CASE WHEN l_discount > 0.01 THEN round(l_quantity) END), 6) AS loss FROM lineitem GROUP BY l_linenumber")
def _(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("lead_time"), F.when(F.col("l_discount") > 0.01, F.round(F.col("l_discount") * 100)).alias("loss"), F.round("l_quantity").alias("n_samples"))
    return _round(evaluation.validation_loss(rows, by=["lead_time"]), "loss")


@_query("skill_threshold", f"{_SKILL} SELECT basin, lead_time, round(NSE, 6) AS NSE FROM skill WHERE NSE > -1.9")
def _(spark, d):
    return _round(evaluation.above(_skill(spark, d), "NSE", -1.9).select("basin", "lead_time", "NSE"), "NSE")


@_query(
    "skill_compare",
    f"{sql('lines', 'lead')}, other AS (SELECT basin, date, lead_time, obs, sim * 1.1::DOUBLE AS sim FROM lead_flow), {_mom('lead_flow', 'basin, lead_time')}, {_mom('other', 'basin, lead_time').replace('mom AS', 'mom2 AS')}, x AS (SELECT basin, lead_time, {_MOMENTS['NSE']} AS NSE FROM mom), y AS (SELECT basin, lead_time, {_MOMENTS['NSE']} AS NSE FROM mom2) SELECT basin, lead_time, round(x.NSE, 6) AS NSE_base, round(y.NSE, 6) AS NSE_other, round(y.NSE - x.NSE, 6) AS NSE_gain FROM x JOIN y USING (basin, lead_time)",
)
def _(spark, d):
    flow = views.lead_flow(spark, d)
    other = metrics.evaluate(flow.withColumn("sim", F.col("sim") * 1.1), ["basin", "lead_time"], ["NSE"])
    return _round(evaluation.compare(metrics.evaluate(flow, ["basin", "lead_time"], ["NSE"]), other, ["NSE"]), "NSE_base", "NSE_other", "NSE_gain")


@_query("clip_to_zero", f"{sql('lines', 'daily')} SELECT basin, date, CASE WHEN obs - 60 < 0 THEN 0.0::DOUBLE ELSE obs - 60 END AS sim FROM daily")
def _(spark, d):
    return evaluation.clip(views.daily_flow(spark, d).select("basin", "date", (F.col("obs") - 60).alias("sim")), ["sim"])


@_query("exclude_all_nan_basins", f"{_DENSE} SELECT DISTINCT basin FROM (SELECT basin FROM dense GROUP BY basin HAVING count(obs) FILTER (WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-03-02') = 0 UNION ALL SELECT basin FROM dense GROUP BY basin HAVING count(obs) FILTER (WHERE date BETWEEN DATE '1998-05-05' AND DATE '1998-05-05') = 0)")
def _(spark, d):
    return evaluation.without_observations(_dense(spark, d), [("1996-03-01", "1996-03-02"), ("1998-05-05", "1998-05-05")])


@_query("nan_runs", f"{_DENSE}, g AS (SELECT *, count(obs) OVER (PARTITION BY basin ORDER BY date) AS there FROM dense) SELECT basin, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days FROM g WHERE obs IS NULL GROUP BY basin, there")
def _(spark, d):
    return evaluation.null_runs(_dense(spark, d))


@_query(
    "windowed_skill",
    f"{sql('lines', 'daily')}, src AS (SELECT basin, DATE '1970-01-01' + (((date - DATE '1970-01-01') // 28) * 28)::INTEGER AS start_date, obs, sim FROM daily), {_mom('src', 'start_date, basin')} SELECT start_date, basin, n AS n_pairs, round({_MOMENTS['NSE']}, 6) AS NSE, round({_MOMENTS['RMSE']}, 6) AS RMSE FROM mom",
)
def _(spark, d):
    flow = views.daily_flow(spark, d).withColumn("ts", F.col("date").cast("timestamp"))
    return _round(windowed_skill(flow, "28 days").select(F.col("window.start").cast("date").alias("start_date"), "basin", "n_pairs", "NSE", "RMSE"), "NSE", "RMSE")


# --- ensembles and mixtures -----------------------------------------------------------------------------------------

_PCT = {p: f"quantile_cont(x, {p / 100})" for p in (0, *range(5, 101, 5))}


@_query("percentile_bands", f"WITH {views.SQL['ens']} SELECT vec_id, round(avg(x), 6) AS mean, " + ", ".join(f"round({_PCT[p]}, 6) AS p{p}" for p in cmal.PERCENTILES) + " FROM (SELECT vec_id, unnest(samples) AS x FROM ens) GROUP BY vec_id")
def _(spark, d):
    names = ["mean", *[f"p{p}" for p in cmal.PERCENTILES]]
    return _round(views.ensemble(spark, d).select("vec_id", cmal.percentile_bands(F.col("samples")).alias("s")).select("vec_id", "s.*"), *names)


@_query("sample_reduction", f"WITH {views.SQL['ens']} SELECT vec_id, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM (SELECT vec_id, unnest(samples) AS x FROM ens) GROUP BY vec_id")
def _(spark, d):
    s = F.col("samples")
    return _round(views.ensemble(spark, d).select("vec_id", cmal.reduce_samples(s).alias("mean"), cmal.reduce_samples(s, "median").alias("median")), "mean", "median")


_BANDS = f"WITH {views.SQL['ens']}, q AS (SELECT vec_id, any_value(label) AS label, any_value(obs) AS obs, " + ", ".join(f"{_PCT[p]} AS q{p}" for p in sorted({*range(0, 101, 5)})) + " FROM (SELECT vec_id, label, obs, unnest(samples) AS x FROM ens) GROUP BY vec_id)"


@_query("interval_coverage", f"{_BANDS} SELECT label, " + ", ".join(f"round(avg((q{lo} < obs AND obs < q{hi})::INTEGER), 6) AS inside_{k}" for k, (lo, hi) in cmal.INTERVALS.items()) + " FROM q GROUP BY label")
def _(spark, d):
    return _round(cmal.coverage(views.ensemble(spark, d), ["label"]), *[f"inside_{k}" for k in cmal.INTERVALS])


@_query("pit_curve", f"{_BANDS} " + " UNION ALL ".join(f"SELECT {p} AS q, round(avg((obs < q{p})::INTEGER), 6) AS share FROM q" for p in range(0, 101, 5)))
def _(spark, d):
    return _round(cmal.reliability(views.ensemble(spark, d)), "share")


_MIX = f"WITH {views.SQL['mix']}, c AS (SELECT vec_id, y, unnest(mu) AS mu, unnest(b) AS b, unnest(tau) AS tau, unnest(pi) AS pi FROM mix)"
_CDF = "CASE WHEN {x} > mu THEN 1 - (1 - tau) * exp(-tau * (({x}) - mu) / b) ELSE tau * exp((1 - tau) * (({x}) - mu) / b) END"
_PDF = "tau * (1 - tau) / b * exp(CASE WHEN {x} > mu THEN -tau * (({x}) - mu) / b ELSE (1 - tau) * (({x}) - mu) / b END)"


@_query("cmal_mean", f"{_MIX} SELECT vec_id, round(sum(pi * (mu + b * (1 - 2 * tau) / (tau * (1 - tau)))), 6) AS mean FROM c GROUP BY vec_id")
def _(spark, d):
    return _round(views.mixtures(spark, d).select("vec_id", cmal.mean(cmal.components()).alias("mean")), "mean")


@_query("cmal_cdf", f"{_MIX} SELECT vec_id, round(sum(pi * ({_CDF.format(x='y')})), 6) AS cdf, round(sum(pi * ({_PDF.format(x='y')})), 6) AS pdf FROM c GROUP BY vec_id")
def _(spark, d):
    m = cmal.components()
    return _round(views.mixtures(spark, d).select("vec_id", cmal.cdf(F.col("y"), m).alias("cdf"), cmal.pdf(F.col("y"), m).alias("pdf")), "cdf", "pdf")


def _newton(q: float, name: str) -> str:
    ppf = f"CASE WHEN {q} <= tau THEN mu + b / (1 - tau) * ln({q} / tau) ELSE mu - b / tau * ln((1 - {q}) / (1 - tau)) END"
    parts = [f"{name}0 AS (SELECT vec_id, avg(p) AS k, 0.8::DOUBLE * min(p) AS low, 0.8::DOUBLE * max(p) AS high FROM (SELECT vec_id, {ppf} AS p FROM c) GROUP BY vec_id)"]
    for i in range(10):
        parts.append(
            f"{name}{i + 1} AS (SELECT vec_id, least(greatest(any_value(k) - (sum(pi * ({_CDF.format(x='k')})) - {q}) / (sum(pi * ({_PDF.format(x='k')})) + 1e-6), any_value(low)), any_value(high)) AS k, any_value(low) AS low, any_value(high) AS high FROM c JOIN {name}{i} USING (vec_id) GROUP BY vec_id)"
        )
    return ", ".join(parts)


@_query("cmal_quantiles", f"{_MIX}, {_newton(0.1, 'a')}, {_newton(0.5, 'b')}, {_newton(0.9, 'e')} SELECT vec_id, round(a10.k, 5) AS q10, round(b10.k, 5) AS q50, round(e10.k, 5) AS q90 FROM a10 JOIN b10 USING (vec_id) JOIN e10 USING (vec_id)")
def _(spark, d):
    m = views.mixtures(spark, d).select("vec_id", cmal.components().alias("m"))
    return _round(m.select("vec_id", *[cmal.quantile(q, F.col("m")).alias(n) for q, n in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))]), "q10", "q50", "q90", digits=5)


_NINE = [(i / 10, f"n{i}") for i in range(1, 10)]


@_query(
    "cmal_predictions",
    f"{_MIX}, {', '.join(_newton(q, n + '_') for q, n in _NINE)}, mean AS (SELECT vec_id, sum(pi * (mu + b * (1 - 2 * tau) / (tau * (1 - tau)))) AS k FROM c GROUP BY vec_id) "
    + " UNION ALL ".join(f"SELECT vec_id, {i} AS pos, round(k, 5) AS value FROM {t}" for i, t in enumerate(["mean", *[f"{n}_10" for _, n in _NINE]])),
)
def _(spark, d):
    m = views.mixtures(spark, d).select("vec_id", cmal.components().alias("m")).select("vec_id", F.posexplode(cmal.predictions(F.col("m"))).alias("pos", "value"))
    return _round(m, "value", digits=5)


def _uniform(turn: str, which: str) -> str:
    return f"((('0x' || substr(md5('7:' || vec_id || ':' || i || ':{turn}:{which}'), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


def _drawn(turn: int) -> str:
    return f"""(SELECT vec_id, i, CASE WHEN v < t THEN m + s / (1 - t) * ln(v / t) ELSE m - s / t * ln((1 - v) / (1 - t)) END AS x FROM
      (SELECT vec_id, i, v, mu[k] AS m, b[k] AS s, tau[k] AS t FROM (SELECT *, {_uniform(str(turn), 'v')} AS v, 1 + (u > pi[1])::INTEGER + (u > pi[1] + pi[2])::INTEGER AS k FROM (SELECT *, {_uniform(str(turn), 'u')} AS u FROM each_draw))))"""


_DRAWS = f"WITH {views.SQL['mix']}, each_draw AS (SELECT vec_id, mu, b, tau, pi, unnest(range(20)) AS i FROM mix)"


@_query("cmal_sampling", f"{_DRAWS} SELECT vec_id, i AS pos, round(greatest(x, 0), 5) AS value FROM {_drawn(0)}")
def _(spark, d):
    drawn = cmal.sample(views.mixtures(spark, d), 20, seed=7, negative="clip", keys=["vec_id"])
    return _round(drawn.select("vec_id", F.posexplode("samples").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")), "value", digits=5)


@_query("cmal_truncated_sampling", f"{_DRAWS} SELECT vec_id, i AS pos, round(CASE WHEN a.x >= 0 THEN a.x WHEN b.x >= 0 THEN b.x WHEN c.x >= 0 THEN c.x ELSE 0 END, 5) AS value FROM {_drawn(0)} a JOIN {_drawn(1)} b USING (vec_id, i) JOIN {_drawn(2)} c USING (vec_id, i)")
def _(spark, d):
    drawn = cmal.sample(views.mixtures(spark, d), 20, seed=7, negative="truncate", retries=2, keys=["vec_id"])
    return _round(drawn.select("vec_id", F.posexplode("samples").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")), "value", digits=5)


# --- losses ---------------------------------------------------------------------------------------------------------


@_query("loss_mse", f"{sql('lines', 'daily')} SELECT basin, round(0.5 * avg((sim - obs) ** 2), 6) AS loss FROM daily GROUP BY basin")
def _(spark, d):
    return _round(views.daily_flow(spark, d).groupBy("basin").agg(losses.mse(F.col("sim"), F.col("obs")).alias("loss")), "loss")


@_query("loss_rmse", f"{sql('lines', 'daily')} SELECT basin, round(sqrt(0.5 * avg((sim - obs) ** 2)), 6) AS loss FROM daily GROUP BY basin")
def _(spark, d):
    return _round(views.daily_flow(spark, d).groupBy("basin").agg(losses.rmse(F.col("sim"), F.col("obs")).alias("loss")), "loss")


@_query("loss_nse", f"{sql('lines', 'daily')}, s AS (SELECT basin, stddev_pop(obs) AS std FROM daily GROUP BY basin) SELECT round(avg((sim - obs) ** 2 / (std + 0.1) ** 2), 6) AS loss FROM daily JOIN s USING (basin)")
def _(spark, d):
    flow = views.daily_flow(spark, d)
    std = sequences.per_basin_std(flow, ["obs"]).withColumnRenamed("obs", "std")
    return _round(flow.join(std, "basin").agg(losses.nse(F.col("sim"), F.col("obs"), F.col("std")).alias("loss")), "loss")


@_query("loss_overlap", f"{sql('lines', 'two')} SELECT round(avg((a - b) ** 2), 6) AS loss FROM two")
def _(spark, d):
    return _round(views.two_products(spark, d).agg(losses.overlap(F.col("a"), F.col("b")).alias("loss")), "loss")


@_query(
    "loss_cmal",
    f"""{_MIX}, t AS (SELECT vec_id, y, ln(pi + 1e-8) + ln(tau) + ln(1 - tau) - ln(b) - greatest(tau * (y - mu) / b, (tau - 1) * (y - mu) / b) AS l FROM c),
    ll AS (SELECT vec_id, max(l) + ln(sum(exp(l - m))) AS ll FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS m FROM t) GROUP BY vec_id)
    SELECT round(-avg(s), 6) AS loss FROM (SELECT vec_id // 4 AS sample, sum(ll) AS s FROM ll GROUP BY 1)""",
)
def _(spark, d):
    m = views.mixtures(spark, d).withColumn("sample", F.floor(F.col("vec_id") / 4))
    return _round(losses.cmal(m, ["sample"], "y", cmal.components()), "loss")


@_query("loss_total", f"{sql('lines', 'two', 'daily')} SELECT round(x, 6) AS loss_obs, round(y, 6) AS loss_b, round(z, 6) AS reg, round(0.75 * x + 0.25 * y + 2 * z, 6) AS total_loss FROM (SELECT 0.5 * avg((sim - obs) ** 2) AS x, 0.5 * avg((a - b) ** 2) AS y, avg((a - obs) ** 2) AS z FROM two JOIN daily USING (basin, date))")
def _(spark, d):
    rows = views.two_products(spark, d).join(views.daily_flow(spark, d), ["basin", "date"])
    return _round(losses.total(rows, [("sim", "obs"), ("a", "b")], "mse", [0.75, 0.25], regularisers={"reg": (2.0, losses.overlap(F.col("a"), F.col("obs")))}), "loss_obs", "loss_b", "reg", "total_loss")


# --- experiment design ----------------------------------------------------------------------------------------------


def _basins(spark, d):
    return views.table(spark, d, "nation").select(F.col("n_nationkey").alias("basin"), F.col("n_regionkey").alias("region"))


@_query("kfold", "WITH f AS (SELECT n_nationkey AS basin, ('0x' || substr(md5('42:' || n_nationkey), 1, 8))::BIGINT % 5 AS fold FROM nation) SELECT basin, s::INTEGER AS split, CASE WHEN s = fold THEN 'test' ELSE 'train' END AS role FROM f, range(5) t(s)")
def _(spark, d):
    return splits.fold_rows(splits.kfold(_basins(spark, d), 5), 5)


@_query("kfold_even", "SELECT s::INTEGER AS split, (n // 5 + (s < n % 5)::INTEGER)::BIGINT AS tests FROM range(5) t(s), (SELECT count(*) AS n FROM nation)")
def _(spark, d):
    rows = splits.fold_rows(splits.kfold_even(_basins(spark, d), 5), 5)
    return rows.groupBy("split").agg(F.count_if(F.col("role") == "test").alias("tests"))


@_query("leave_group_out", "SELECT r AS left_out, n_nationkey AS basin, CASE WHEN n_regionkey = r THEN 'test' ELSE 'train' END AS role FROM nation CROSS JOIN (SELECT DISTINCT n_regionkey AS r FROM nation)")
def _(spark, d):
    return splits.leave_group_out(_basins(spark, d), F.col("region"))


@_query("gauged", "SELECT n_regionkey || '_' || n_nationkey AS basin FROM nation WHERE n_regionkey IN (0, 3)")
def _(spark, d):
    named = _basins(spark, d).select(F.concat_ws("_", F.col("region").cast("string"), F.col("basin").cast("string")).alias("basin"))
    return splits.gauged(named, ["0", "3"])


@_query("dev_sample", "SELECT n_regionkey AS grp, n_nationkey AS basin FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY (n_nationkey * 7) % 11, n_nationkey) <= 3")
def _(spark, d):
    return splits.dev_sample(_basins(spark, d), 3, group=F.col("region"), order=(F.col("basin") * 7) % 11)


@_query(
    "temporal_cv",
    """WITH y AS (SELECT unnest(range(2016, 2024))::INTEGER AS y), r AS (SELECT y AS test_year, 'test' AS role, make_date(y, 1, 1) AS start_date, make_date(y, 12, 31) AS end_date FROM y
    UNION ALL SELECT y, 'train', make_date(2016, 1, 1), make_date(y - 2, 12, 31) FROM y UNION ALL SELECT y, 'train', make_date(y + 2, 1, 1), make_date(2023, 12, 31) FROM y) SELECT * FROM r WHERE start_date <= end_date""",
)
def _(spark, d):
    return splits.temporal_cv(spark, 2016, 2023, 2016, 2023)


@_query("config_grid", "SELECT DISTINCT n_regionkey AS space, y::INTEGER AS year FROM nation CROSS JOIN range(2016, 2020) t(y)")
def _(spark, d):
    return splits.config_grid(_basins(spark, d).select(F.col("region").alias("space")).distinct(), spark.range(2016, 2020).select(F.col("id").cast("int").alias("year")))


@_query("zero_variance_screen", "SELECT DISTINCT 'region' AS feature FROM (SELECT n_regionkey AS split, var_samp(n_regionkey) AS v FROM nation GROUP BY 1) WHERE v = 0")
def _(spark, d):
    rows = views.statics(spark, d).withColumn("split", F.col("region"))
    return splits.zero_variance(rows, ["region", "balance"])


@_query("train_test_class", "SELECT n_nationkey AS basin, CASE WHEN n_nationkey < 10 THEN 'train' WHEN n_nationkey < 18 THEN 'test' ELSE 'other' END AS class FROM nation")
def _(spark, d):
    b = _basins(spark, d)
    return splits.classify(b, b.where("basin < 10"), b.where("basin between 5 and 17"))


@_query("area_histogram", "SELECT least(floor((c_acctbal - lo) * 50 / (hi - lo)), 49)::INTEGER AS bin, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) GROUP BY 1")
def _(spark, d):
    return splits.histogram(views.table(spark, d, "customer"), "c_acctbal")
