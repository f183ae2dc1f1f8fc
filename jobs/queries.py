"""The jobs as queries: each runs twice into one new folder of the shared one and returns its output as it then stands, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.sources.work import folder
from jobs import rolling_skill, training_samples
from jobs.common import settings

ARRAYS = ("near", "far", "y_flow")


def job1_training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a step of each sample: features are those of the days up to the sample's, the target those of the days up to the lead time."""
    out, config = folder(spark, "job1", keep=True), settings(training_samples.CONFIG)
    for _ in range(2):
        tables = training_samples.run(spark, sf_dir, out, config)
    steps = tables["samples"].select("split", "basin", "date", F.round("n_suppliers", 6).alias("n_suppliers"), F.round("balance", 6).alias("balance"), F.posexplode(F.arrays_zip(*ARRAYS)).alias("step", "v"))
    return steps.select("split", "basin", "date", "n_suppliers", "balance", "step", *[F.round(f"v.{a}", 6).alias(a) for a in ARRAYS])


def job2_rolling_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = folder(spark, "job2", keep=True), settings(rolling_skill.CONFIG)
    for _ in range(2):
        table = rolling_skill.run(spark, sf_dir, out, config)
    names = {m: m.replace("-", "_") for m in config["metrics"]}
    # the stream's batches depend on how the table is cut to files
    return table.select(F.col("year").cast("int").alias("year"), "basin", "lead_time", "n_pairs", *[F.round(F.col(f"`{m}`"), 6).alias(n) for m, n in names.items()])


def _split_sql(name: str, start: str, end: str, train: bool) -> str:
    """Samples of one period: sequences of 8 days, targets two days ahead, of which one of the last two has to be there in training."""
    targets = "n2 = 2 AND t2 > 0" if train else "true"
    scaled = "(near - f_near_c) / f_near_s AS near, (far - f_far_c) / f_far_s AS far, (flow - f_flow_c) / f_flow_s AS flow"
    return f"""
{name}_cut AS (SELECT basin, date, coalesce(near, far) AS near, far, flow FROM dyn WHERE date BETWEEN DATE '{start}' - 8 AND DATE '{end}' + 2),
{name}_cal AS (SELECT basin, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM {name}_cut GROUP BY basin),
{name}_dense AS (SELECT basin, date, {scaled} FROM {name}_cal LEFT JOIN {name}_cut USING (basin, date), fit),
{name}_win AS (SELECT *, count(*) OVER w AS n, count(near) OVER w AS n_near, count(far) OVER w AS n_far, list(near) OVER w AS x_near, list(far) OVER w AS x_far,
    count(*) OVER y AS n_y, list(flow) OVER y AS y_flow, count(*) OVER z AS n2, count(flow) OVER z AS t2 FROM {name}_dense
  WINDOW w AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), y AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING),
    z AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
{name}_rows AS (SELECT '{name}' AS split, basin, date, x_near, x_far, y_flow FROM {name}_win
  WHERE n = 8 AND n_near = 8 AND n_far = 8 AND n_y = 8 AND {targets} AND date BETWEEN DATE '{start}' AND DATE '{end}')"""


_SPLITS = {"train": ("1992-03-01", "1995-12-31"), "validation": ("1996-01-01", "1996-12-31"), "test": ("1997-01-01", "1998-06-30")}

ORACLE_JOB1 = f"""
WITH dyn AS (SELECT 'r' || n_regionkey AS basin, l_shipdate::DATE AS date, sum(CASE WHEN l_linenumber <= 2 THEN l_quantity::BIGINT END)::DOUBLE AS near,
    sum(CASE WHEN l_linenumber >= 3 THEN l_quantity::BIGINT END)::DOUBLE AS far, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 150000 AS flow
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
sta AS (SELECT 'r' || n_regionkey AS basin, count(*)::DOUBLE AS n_suppliers, sum(round(s_acctbal * 100)::BIGINT)::DOUBLE / 100 AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey),
fit AS (SELECT avg(near) AS f_near_c, stddev_pop(near) AS f_near_s, min(far) AS f_far_c, max(far) - min(far) AS f_far_s, avg(flow) AS f_flow_c, stddev_pop(flow) AS f_flow_s
  FROM (SELECT coalesce(near, far) AS near, far, flow FROM dyn WHERE date BETWEEN DATE '{_SPLITS["train"][0]}' - 8 AND DATE '{_SPLITS["train"][1]}' + 2)),
{",".join(_split_sql(name, *period, name == "train") for name, period in _SPLITS.items())},
samples AS ({" UNION ALL ".join(f"SELECT * FROM {name}_rows" for name in _SPLITS)}),
sta_fit AS (SELECT basin, (n_suppliers - avg(n_suppliers) OVER ()) / stddev_pop(n_suppliers) OVER () AS n_suppliers, (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS balance FROM sta)
SELECT split, basin, date, round(n_suppliers, 6) AS n_suppliers, round(balance, 6) AS balance, (k - 1)::INTEGER AS step,
  round(x_near[k], 6) AS near, round(x_far[k], 6) AS far, round(y_flow[k], 6) AS y_flow
FROM (SELECT *, unnest(range(1, 9)) AS k FROM samples) JOIN sta_fit USING (basin)
"""

ORACLE_JOB2 = """
WITH p AS (SELECT year(l_shipdate)::INTEGER AS year, s_nationkey AS basin, l_linenumber AS lead_time, (l_quantity * 1500)::DECIMAL(12, 2)::DOUBLE AS o, l_extendedprice::DECIMAL(12, 2)::DOUBLE AS s
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT year, basin, lead_time, count(*) AS n, avg(o) AS mo, avg(s) AS ms, stddev_pop(o) AS so, stddev_pop(s) AS ss, var_pop(o) AS vo, covar_pop(o, s) AS cov, sum((s - o) ** 2) AS sq
  FROM p WHERE o IS NOT NULL AND s IS NOT NULL GROUP BY ALL)
SELECT year, basin, lead_time, n AS n_pairs, round(1 - sq / nullif(n * vo, 0), 6) AS NSE,
  round(CASE WHEN n >= 2 THEN 1 - sqrt((cov / nullif(so * ss, 0) - 1) ** 2 + (ss / nullif(so, 0) - 1) ** 2 + (ms / nullif(mo, 0) - 1) ** 2) END, 6) AS KGE,
  round(sqrt(sq / n), 6) AS RMSE, round(CASE WHEN n >= 2 THEN cov / nullif(so * ss, 0) END, 6) AS Pearson_r, round(ss / nullif(so, 0), 6) AS Alpha_NSE, round((ms - mo) / nullif(so, 0), 6) AS Beta_NSE
FROM m
"""

QUERIES = {"job1_training_samples": job1_training_samples, "job2_rolling_skill": job2_rolling_skill}
ORACLES = {"job1_training_samples": ORACLE_JOB1, "job2_rolling_skill": ORACLE_JOB2}
