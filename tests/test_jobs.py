"""The jobs: against their SQL, over growing input, after a broken run, and from the command line."""

import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from freshet.functions.metrics import evaluate
from freshet.streaming import incremental
from jobs import queries, rolling_skill, training_samples
from jobs.common import settings

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
plain = lambda rows: sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def by_sql(name, sf, **tables):
    con = duckdb.connect()
    for t in ("nation", "supplier", "lineitem"):
        con.sql(f"create view {t} as select * from '{tables.get(t, f'{sf}/{t}.parquet')}'")
    rows = con.sql(queries.ORACLES[name])
    return sorted(rows.columns), plain(rows.project(", ".join(sorted(rows.columns))).fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_agrees_with_sql(spark, name):
    assert __spark_entry__.queries()[name] is queries.QUERIES[name]
    cols, want = by_sql(name, SF_MORE)
    got = queries.QUERIES[name](spark, SF_MORE)
    assert sorted(got.columns) == cols and plain(got.select(*cols).collect()) == want and want


def test_samples_rerun_and_coverage(spark, tmp_path):
    config = settings(training_samples.CONFIG)
    out = f"file://{tmp_path}/out"
    first = {k: plain(v.select(*sorted(v.columns)).collect()) for k, v in training_samples.run(spark, SF_MORE, out, config).items()}
    tables = training_samples.run(spark, SF_MORE, out, config)
    assert {k: plain(v.select(*sorted(v.columns)).collect()) for k, v in tables.items()} == first
    counted = {(r.split, r.basin): r.n for r in tables["samples"].groupBy("split", "basin").agg(F.count("*").alias("n")).collect()}
    for r in tables["coverage"].collect():
        assert r.days >= r.valid >= counted.get((r.split, r.basin), 0) and r.fails_statics == 0
    assert {r.feature for r in tables["scaler"].collect()} == {"near", "far", "flow", "n_suppliers", "balance"}
    arrays = tables["samples"].select(F.size("near").alias("a"), F.size("y_flow").alias("b")).distinct().collect()
    assert [tuple(r) for r in arrays] == [(8, 8)]
    assert (tmp_path / "out/samples/split=train/basin=r0").is_dir()


@pytest.fixture
def growing(spark, tmp_path):
    """A copy of the tables whose line items are a folder that grows: grow(k) adds the k-th of four parts."""
    tables = tmp_path / "tables"
    spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{tables}/supplier.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")

    def grow(k):
        lines.where(F.pmod(F.hash("l_orderkey", "l_linenumber"), F.lit(4)) == k).coalesce(2).write.mode("append").parquet(f"{tables}/lineitem.parquet")
        return by_sql("job2_rolling_skill", SF, lineitem=f"{tables}/lineitem.parquet/*.parquet")[1]

    return str(tables), grow


def skill(table):
    names = {c: c.replace("-", "_") for c in table.columns}
    columns = [F.round(F.col(f"`{c}`"), 6).alias(n) if c not in ("year", "basin", "lead_time", "n_pairs") else F.col(c) for c, n in names.items() if c != "through_batch"]
    rows = table.select(*columns)
    return plain(rows.select(*sorted(rows.columns)).collect())


def test_growing_input(spark, growing, tmp_path):
    tables, grow = growing
    out, config = f"file://{tmp_path}/out", settings(rolling_skill.CONFIG)
    want = grow(0)
    assert skill(rolling_skill.run(spark, tables, out, config)) == want
    grow(1)
    want = grow(2)
    table = rolling_skill.run(spark, tables, out, config)
    assert skill(table) == want
    batches = {r.batch for r in spark.read.parquet(f"{out}/state").select("batch").distinct().collect()}
    assert len(batches) >= 2
    # nothing new: nothing is written
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("out/s*/**/*.parquet")}
    assert skill(rolling_skill.run(spark, tables, out, config)) == want
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("out/s*/**/*.parquet")} == files


def test_broken_runs(spark, growing, tmp_path, monkeypatch):
    tables, grow = growing
    out, config = f"file://{tmp_path}/out", settings(rolling_skill.CONFIG)
    grow(0)
    rolling_skill.run(spark, tables, out, config)
    want = grow(3)

    # the sums are written, but skill is not
    with monkeypatch.context() as m:
        m.setattr(rolling_skill, "refresh", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            rolling_skill.run(spark, tables, out, config)
    assert skill(rolling_skill.run(spark, tables, out, config)) == want

    # a batch is written, and then its number is run again
    want = grow(1)
    put = rolling_skill.into_state

    def twice(*a):
        one = put(*a)

        def both(pairs, batch):
            one(pairs, batch)
            one(pairs, batch)

        return both

    monkeypatch.setattr(rolling_skill, "into_state", twice)
    assert skill(rolling_skill.run(spark, tables, out, config)) == want


def test_no_input_yet(spark, tmp_path):
    spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rolling_skill.run(spark, str(tmp_path), f"file://{tmp_path}/out", settings(rolling_skill.CONFIG)) is None


def test_sums_give_the_moment_metrics(spark):
    rows = [("a", 1.25, 2.5), ("a", 3.0, None), ("a", 4.5, 4.0), ("a", 2.0, 2.25), ("b", 7.0, 1.0), ("b", 7.0, 2.0), ("b", None, 2.0), ("c", 5.0, 4.0), ("d", None, 1.0)]
    names = ["NSE", "MSE", "RMSE", "KGE", "Alpha-NSE", "Pearson-r", "Beta-KGE", "Beta-NSE"]
    df = spark.createDataFrame(rows, "k string, obs double, sim double")
    want = {r[0]: tuple(r)[1:] for r in evaluate(df, ["k"], names).where("n_pairs > 0").collect()}
    exact = df.withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("obs", "sim")})
    parts = [incremental.sums(exact.where(F.col("k") != "a"), ["k"]), incremental.sums(exact.where("k = 'a' AND obs < 2"), ["k"]), incremental.sums(exact.where("k = 'a' AND obs >= 2"), ["k"])]
    merged = incremental.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["k"])
    got = {r[0]: tuple(r)[1:] for r in incremental.skill_of(merged, ["k"], names).collect()}
    assert got.keys() == want.keys() == {"a", "b", "c"}
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k
    assert merged.schema["oo"].dataType.typeName() == "decimal" and merged.where("k = 'b'").first()["o"] == Decimal("14.00")
    with pytest.raises(ValueError, match="FHV"):
        incremental.skill_of(merged, ["k"], ["FHV"])


@pytest.mark.parametrize("job", ["training_samples", "rolling_skill"])
def test_command_line(job, tmp_path):
    command = [sys.executable, "-m", f"jobs.{job}", SF, f"file://{tmp_path}/out"]
    done = subprocess.run(command, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and list(tmp_path.glob("out/*/**/*.parquet"))
