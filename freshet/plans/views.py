"""The warehouse tables read as hydrological data: nations are basins, ship dates are dates, line numbers are lead times.

Sums are taken over whole numbers (quantities, cents), so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the nation of their supplier; suppliers are broadcast while small."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", F.col("l_shipdate").cast("date").alias("date"))
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("basin"))
    return li.join(su, li.l_suppkey == su.s_suppkey)


def _flow():
    obs = F.sum(F.col("l_quantity").cast("long")).cast("double")
    sim = F.sum(_cents("l_extendedprice")) / F.lit(150000.0)
    return obs.alias("obs"), sim.alias("sim")


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basin, date, obs, sim), with gaps."""
    return _lines(spark, sf_dir).groupBy("basin", "date").agg(*_flow())


def lead_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basin, date, lead_time, obs, sim)."""
    return _lines(spark, sf_dir).groupBy("basin", "date", F.col("l_linenumber").alias("lead_time")).agg(*_flow())


def region_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basin, date, obs, sim) by region, nearly without gaps."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("basin"), F.col("n_regionkey").alias("region"))
    return _lines(spark, sf_dir).join(F.broadcast(n), "basin").groupBy(F.col("region").alias("basin"), "date").agg(*_flow())  # nations are a fixed list


def two_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basin, date, a, b): two forcings with gaps of their own, from two kinds of lines."""
    q = F.col("l_quantity").cast("long")
    a = F.sum(F.when(F.col("l_linenumber") <= 2, q)).cast("double")
    b = F.sum(F.when(F.col("l_linenumber") >= 3, q)).cast("double")
    return _lines(spark, sf_dir).groupBy("basin", "date").agg(a.alias("a"), b.alias("b"))


def statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basin, region, n_suppliers, balance): attributes of the nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("basin"), F.col("n_regionkey").alias("region"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("basin")).agg(F.count("*").alias("n_suppliers"), (F.sum(_cents("s_acctbal")) / F.lit(100.0)).alias("balance"))
    return n.join(s, "basin", "left")


def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, mu, b, tau, pi, y): three components a vector, from its first twelve numbers (rounded, so both engines start alike)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 4)).alias("e"))
    at = lambda i: F.get("e", F.lit(i))
    w = [at(9) + 0.1, at(10) + 0.1, at(11) + 0.1]
    return v.select(
        "vec_id",
        F.array(*[at(i) * 10 for i in range(3)]).alias("mu"),
        F.array(*[at(i) + 0.2 for i in range(3, 6)]).alias("b"),
        F.array(*[at(i) / 2 + 0.2 for i in range(6, 9)]).alias("tau"),
        F.array(*[x / (w[0] + w[1] + w[2]) for x in w]).alias("pi"),
        (at(12) * 10).alias("y"),
    )


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, obs, samples): 20 members a row."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("e"))
    return v.select("vec_id", "label", F.get("e", F.lit(40)).alias("obs"), F.slice("e", 1, 20).alias("samples"))


#: The same views for the checking engine, as common table expressions.
SQL = {
    "lines": "lines AS (SELECT s_nationkey AS basin, CAST(l_shipdate AS DATE) AS date, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
    "daily": "daily AS (SELECT basin, date, sum(q)::DOUBLE AS obs, sum(c) / 150000.0::DOUBLE AS sim FROM lines GROUP BY basin, date)",
    "lead": "lead_flow AS (SELECT basin, date, l_linenumber AS lead_time, sum(q)::DOUBLE AS obs, sum(c) / 150000.0::DOUBLE AS sim FROM lines GROUP BY basin, date, l_linenumber)",
    "region": "region AS (SELECT n_regionkey AS basin, date, sum(q)::DOUBLE AS obs, sum(c) / 150000.0::DOUBLE AS sim FROM lines JOIN nation ON basin = n_nationkey GROUP BY n_regionkey, date)",
    "two": "two AS (SELECT basin, date, (sum(q) FILTER (WHERE l_linenumber <= 2))::DOUBLE AS a, (sum(q) FILTER (WHERE l_linenumber >= 3))::DOUBLE AS b FROM lines GROUP BY basin, date)",
    "statics": "statics AS (SELECT n_nationkey AS basin, n_regionkey AS region, n_suppliers, balance FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers, sum(CAST(round(s_acctbal * 100) AS BIGINT)) / 100.0::DOUBLE AS balance FROM supplier GROUP BY s_nationkey) ON n_nationkey = s_nationkey)",
    "dense": "cal AS (SELECT basin, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM {src} GROUP BY basin), dense AS (SELECT cal.basin, cal.date, {cols} FROM cal LEFT JOIN {src} s ON s.basin = cal.basin AND s.date = cal.date)",
    "mix": "v AS (SELECT vec_id, list_transform(embedding, lambda x: round(abs(x::DOUBLE), 4)) AS e FROM embeddings), mix AS (SELECT vec_id, [e[1]*10, e[2]*10, e[3]*10] AS mu, [e[4]+0.2::DOUBLE, e[5]+0.2::DOUBLE, e[6]+0.2::DOUBLE] AS b, [e[7]/2+0.2::DOUBLE, e[8]/2+0.2::DOUBLE, e[9]/2+0.2::DOUBLE] AS tau, [(e[10]+0.1::DOUBLE)/((e[10]+0.1::DOUBLE)+(e[11]+0.1::DOUBLE)+(e[12]+0.1::DOUBLE)), (e[11]+0.1::DOUBLE)/((e[10]+0.1::DOUBLE)+(e[11]+0.1::DOUBLE)+(e[12]+0.1::DOUBLE)), (e[12]+0.1::DOUBLE)/((e[10]+0.1::DOUBLE)+(e[11]+0.1::DOUBLE)+(e[12]+0.1::DOUBLE))] AS pi, e[13]*10 AS y FROM v)",
    "ens": "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS e FROM embeddings), ens AS (SELECT vec_id, label, e[41] AS obs, e[1:20] AS samples FROM v)",
}


def sql(*names: str, dense: str = "", cols: str = "obs, sim") -> str:
    """A WITH clause of the named views; ``dense`` names the view to densify."""
    parts = [SQL[n] for n in names]
    if dense:
        parts.append(SQL["dense"].format(src=dense, cols=cols))
    return "WITH " + ", ".join(parts)
