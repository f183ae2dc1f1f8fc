"""What is kept between runs: growing scalers, bucketed tables, runs over range borders, epochs' orders, logs of metrics."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.functions import cmal
from freshet.operators import consecutive, epochs, scaler, scaler_state
from freshet.operators.align import outer_merge
from freshet.operators.sequences import per_basin_std
from freshet.plans import evaluation, metric_log
from freshet.sources.buckets import bucketed, together


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns).repartition(3)


def test_scaler_of_parts_is_the_scaler_of_all(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"b{i % 7}", 1e5 + rnd.random(), None if i % 11 == 0 else rnd.choice([1.0, 2.0, 5.0]), float(i % 2)) for i in range(400)]
    df = table(spark, rows, "basin string, big double, few double, flag double")
    custom = {"few": {"centering": "median", "scaling": "minmax"}, "flag": {"centering": "min", "scaling": "none"}}
    state = f"file://{tmp_path}/state"
    for k in range(7):
        scaler_state.fold(df.where(F.col("basin") == f"b{k}"), ["big", "few"], state, f"part {k}", ["few"])
    scaler_state.fold(df.where("basin = 'b3'"), ["big", "few"], state, "part 3", ["few"])  # again
    scaler_state.fold(df, ["flag"], state, "one more feature")
    scaler_state.fold(df.where("false"), ["big", "few"], state, "nothing", ["few"])
    got = {r.feature: tuple(r)[1:] for r in scaler_state.fitted(spark, state, custom, f"file://{tmp_path}/work").collect()}
    want = {r.feature: tuple(r)[1:] for r in scaler.fit(df, ["big", "few", "flag"], custom).collect()}
    assert got.keys() == want.keys()
    for f in want:
        assert got[f] == pytest.approx(want[f], rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError, match="work"):
        scaler_state.fitted(spark, state, custom)
    with pytest.raises(ValueError, match="not folded"):
        scaler_state.fold(df, ["big"], state, "x", ["few"])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    rows = [(f"b{i % 9}", i // 9, float(i)) for i in range(900)]
    a = table(spark, rows, "basin string, date int, x double")
    b = table(spark, rows[::2], "basin string, date int, y double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = per_basin_std(outer_merge([a, b]), ["x", "y"])
        ba, bb = bucketed(a, f"file://{tmp_path}/a", 5), bucketed(b, f"file://{tmp_path}/b", 5)
        setting = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
        with together(spark):
            joined = outer_merge([ba, bb])
            assert exchanges(joined) == 0
            w = Window.partitionBy("basin").orderBy("date").rowsBetween(-3, 0)
            left = ba.join(bb, ["basin", "date"], "left")
            assert exchanges(left.withColumn("s", F.sum("y").over(w))) == 0 and exchanges(per_basin_std(left, ["x", "y"])) == 0
            assert exchanges(a.join(b, ["basin", "date"], "left")) >= 2
            got = sorted(map(tuple, per_basin_std(joined, ["x", "y"]).collect()))
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == setting
        assert [r[0] for r in got] == sorted(r[0] for r in plain.collect())
        for x, y in zip(got, sorted(map(tuple, plain.collect())), strict=True):
            assert x[1:] == pytest.approx(y[1:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = list((tmp_path / "a").glob("*.parquet"))
    assert 1 <= len(files) <= 5


@pytest.mark.parametrize("keys", ["one", "few", "nulls", "every", "none"])
def test_runs_over_range_borders(spark, tmp_path, keys):
    rnd = random.Random(3)
    n = 0 if keys == "none" else 500
    make = {"one": lambda i: "k", "few": lambda i: "abc"[(i // 37) % 3], "nulls": lambda i: rnd.choice([None, "a"]), "every": str, "none": str}[keys]
    rows = [(make(i), i, i % 10) for i in range(n)]
    spread = rows[:]
    rnd.shuffle(spread)
    df = spark.createDataFrame(spread, "k string, i int, v int").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = consecutive.consecutive(df, ["k"], ["i"], {"total": F.col("v")}, f"file://{tmp_path}/w")
        got = sorted(map(tuple, got.select("run", "k", "first_i", "last_i", "n", "total").collect()))
        parts = spark.read.parquet(f"file://{tmp_path}/w/rows").select("__part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = []
    for k, run in itertools.groupby(rows, key=lambda r: r[0]):
        run = list(run)
        want.append((len(want), k, run[0][1], run[-1][1], len(run), sum(r[2] for r in run)))
    assert got == want and parts >= (3 if n else 0)


def test_ranges_of_runs_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(consecutive, "ROWS", 50)
    rows = [(i, i // 7 % 3, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, k int, v int")
    got = consecutive.consecutive(df, ["k"], ["i"], {"total": F.col("v")}, f"file://{tmp_path}/w").orderBy("run").select("run", "k", "first_i", "last_i", "n", "total").collect()
    assert [tuple(r) for r in got] == [(j, j % 3, 7 * j, min(7 * j + 6, 1999), min(7, 2000 - 7 * j), min(7, 2000 - 7 * j)) for j in range(286)]
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/w/rows").groupBy("__part").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 150


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_every_epoch_is_another_bijection(spark, n):
    df = spark.range(n)
    places = []
    for epoch in range(3):
        rows = df.select("id", epochs.permuted(F.col("id"), n, 7, epoch).alias("p"))
        found = {r.id: r.p for r in rows.collect()}
        assert sorted(found.values()) == list(range(n))
        assert {r.id: r.p for r in rows.repartition(5, "p").collect()} == found
        places.append(found)
    if n > 100:
        assert places[0] != places[1] != places[2]
        moved = sum(abs(places[0][i] - i) for i in range(n)) / n
        assert 0.25 * n < moved < 0.42 * n  # a third, for a random order
        after = sum(places[0][i + 1] == places[0][i] + 1 for i in range(n - 1))
        assert after < 10


def test_places_of_several_epochs(spark, monkeypatch):
    monkeypatch.setattr(epochs, "ROWS", 10)
    samples = spark.range(95).withColumnRenamed("id", "sample_id")
    found = epochs.places(samples, 95, 7, (0, 2))
    assert found.rdd.getNumPartitions() == 10
    want = [(e, r.p) for e in (0, 2) for r in samples.select(epochs.permuted(F.col("sample_id"), 95, 7, e).alias("p")).collect()]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_epoch_batches(spark):
    samples = spark.range(100).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("basin"))
    assert sorted(r["count"] for r in epochs.epoch_batches(samples, 100, 32, 1, 0).groupBy("batch").count().collect()) == [4, 32, 32, 32]
    assert epochs.epoch_batches(samples, 100, 32, 1, 0, most=2).count() == 64
    mixed = epochs.by_basin(samples, 100, 8, 1, 0).groupBy("basin", "batch").count().collect()
    assert sorted(r["count"] for r in mixed if r.basin == 0) == [2, 8, 8, 8, 8]


def test_figures_are_those_of_the_written_rows(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 4 != 0, F.col("id") * 1.0)).repartition(4)
    log = f"file://{tmp_path}/log"
    figures = {"mean": F.avg("x"), "rows": F.count("*"), "nothing": F.avg(F.lit(None).cast("double"))} | metric_log.null_shares(["x"])
    found = metric_log.write_logged(df, lambda d: d.write.parquet(f"file://{tmp_path}/out"), figures, log, "r", 3)
    written = spark.read.parquet(f"file://{tmp_path}/out")
    assert found == {"mean": written.agg(F.avg("x")).first()[0], "rows": 1000.0, "nothing": None, "null_x": 0.25}
    metric_log.write_logged(df.limit(10), lambda d: d.write.mode("overwrite").parquet(f"file://{tmp_path}/out"), {"rows": F.count("*")}, log, "r", 4)
    metric_log.write_logged(df.limit(20), lambda d: d.write.mode("overwrite").parquet(f"file://{tmp_path}/out"), {"rows": F.count("*")}, log, "r", 4)
    rows = {(r.step, r.name): r.value for r in spark.read.parquet(log).collect()}
    assert len(rows) == 5 and rows[4, "rows"] == 20.0 and rows[3, "null_x"] == 0.25


def test_frequency_suffixes(spark):
    t = table(spark, [("a", "1D", 1.0), ("a", "1h", 2.0), ("b", "1h", 3.0)], "basin string, freq string, NSE double")
    assert sorted(map(tuple, evaluation.by_frequency(t, ["NSE"], ["1D", "1h"]).collect())) == [("a", 1.0, 2.0), ("b", None, 3.0)]
    one = evaluation.by_frequency(t, ["NSE"], ["1h"])
    assert one.columns == ["basin", "NSE"] and sorted(map(tuple, one.collect())) == [("a", 2.0), ("b", 3.0)]


def test_curve_of_the_first_points(spark):
    rows = [(i, None if i == 1 else float(i), [float(i), float(i) + 1.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, obs double, samples array<double>")
    share = {r.q: r.share for r in cmal.reliability(df, step=50, first=3, order=["i"]).collect()}
    assert share == {0: 0.0, 50: 1.0, 100: 1.0}
    assert cmal.last_step(df, ["samples"]).where("i = 4").first().samples == 5.0
    with pytest.raises(ValueError, match="order"):
        cmal.reliability(df, first=3)
