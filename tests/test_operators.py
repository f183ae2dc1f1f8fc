"""Golden cases of unioning, alignment, scaler, sequences, splits and the name and frequency helpers."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet import schema
from freshet.functions import frequency
from freshet.operators import align, scaler, sequences, splits
from freshet.operators.union import union_features

N = None


def forecasts(spark, values, names=("fc",), leads=(1, 2, 3), start=date(2000, 1, 1)):
    """values: {basin: {day: [a value a lead]}}."""
    rows = [(b, start + timedelta(days=d - 1), lead, None if v is None else float(v)) for b, days in values.items() for d, vs in days.items() for lead, v in zip(leads, vs, strict=True)]
    return spark.createDataFrame(rows, f"basin string, date date, lead_time int, {names[0]} double")


def test_union_same_dims(series):
    df = series({"P": [[N, 0.5, N, 2.25], [7.0, 8.0, N, 9.0]], "Q": [[N, N, 1.75, N], [0.0, N, 3.5, 6.0]]}, names=("f", "m"))
    got = union_features(df, None, {"f": "m"})[0].orderBy("basin", "date").collect()
    assert [r.f for r in got] == [7, 0.5, N, 2.25, 0, N, 1.75, 6] and [r.m for r in got] == [7, 8, N, 9, 0, N, 3.5, 6]


def test_union_lead_from_obs(spark, series):
    fc = forecasts(spark, {"Q": {3: [0.25, N, N], 4: [N, 6.5, N]}})
    obs = series({"Q": [11.0, 12.0, 13.0, 14.0, 15.0]}, date(2000, 1, 1), names=("obs",))
    got = union_features(obs, fc, {"fc": "obs"})[1].orderBy("date", "lead_time").collect()
    assert [r.fc for r in got] == [0.25, 15, N, 15, 6.5, N]


def test_union_obs_from_lead(spark, series):
    fc = forecasts(spark, {"P": {1: [1.5, 2.5, 3.5], 3: [4.5, 5.5, 6.5]}, "Q": {2: [8.5, N, N]}})
    obs = series({"P": [N, N, 0.75, N, N], "Q": [N, N, N, 2.0]}, date(2000, 1, 1), names=("obs",))
    got = union_features(obs, fc, {"obs": "fc"})[0].orderBy("basin", "date").collect()
    assert [r.obs for r in got] == [N, 1.5, 0.75, 4.5, N, N, N, 8.5, 2]


def test_union_passes_over_and_fails(series):
    df = series({"A": [1.0, N]}, names=("f",))
    for mapping in ({}, {"f": "f"}, {"absent": "f"}):
        assert [r.f for r in union_features(df, None, mapping)[0].orderBy("date").collect()] == [1, N]
    with pytest.raises(ValueError, match="no column 'x' to fill 'f' from"):
        union_features(df, None, {"f": "x"})


def test_masks_are_read_before_filling(series):
    df = series({"A": [[N], [N], [7.0]]}, names=("a", "b", "c"))
    got = union_features(df, None, {"a": "b", "b": "c"})[0].collect()[0]
    assert (got.a, got.b) == (N, 7)


def test_expand_lead_times(series):
    df = series({"A": [10.0, 11, 12, 13, 14], "B": [20.0, 21, 22, 23, 24]})
    got = align.expand_lead_times(df, "v", [1, 2]).orderBy("basin", "lead_time", "date").collect()
    assert [r.v for r in got] == [11, 12, 13, 14, N, 12, 13, 14, N, N, 21, 22, 23, 24, N, 22, 23, 24, N, N]
    with pytest.raises(ValueError):
        align.expand_lead_times(df.withColumn("lead_time", F.lit(1)), "v", [1])


def test_densify_and_merge(spark, series):
    df = series({"A": [1.0, 2.0, 3.0, 4.0]}).where("v not in (2, 3)")
    assert [r.v for r in align.densify(df).orderBy("date").collect()] == [1, N, N, 4]
    a = spark.createDataFrame([("x", 1.0, N), ("y", 2.0, 5.0)], "basin string, p double, q double")
    b = spark.createDataFrame([("y", 5.0, 9.0), ("z", 6.0, 8.0)], "basin string, q double, r double")
    got = {r.basin: (r.p, r.q, r.r) for r in align.merge_no_conflict(a, b).collect()}
    assert got == {"x": (1, N, N), "y": (2, 5, 9), "z": (N, 6, 8)}
    with pytest.raises(Exception, match="conflicting values of q"):
        align.merge_no_conflict(a, b.withColumn("q", F.lit(4.0))).collect()
    with pytest.raises(ValueError):
        align.require_basins(a, b)


def test_periods():
    assert align.check_periods(["2000-01-01"], ["2000-02-01"])
    for bad in ((["2000-01-02"], ["2000-01-01"]), (["2000-01-01"], [])):
        with pytest.raises(ValueError):
            align.check_periods(*bad)


# --- scaler ---------------------------------------------------------------------------------------------------------

TEMP, PRESSURE = [[10, 20], [15, 25], [12, 22]], [[1000, 1010], [1005, 1015], [1002, 1012]]


@pytest.fixture
def weather(series):
    return series({b: [[float(r[i]) for r in TEMP], [float(r[i]) for r in PRESSURE]] for i, b in enumerate("AB")}, names=("temp", "pressure"))


def test_scaler_default_and_round_trip(weather, spark, tmp_path):
    fitted = scaler.fit(weather, ["temp", "pressure"])
    row = {r.feature: r for r in fitted.collect()}
    assert row["temp"].center == pytest.approx(np.mean(TEMP)) and row["temp"].scale == pytest.approx(np.std(TEMP))
    scaled = scaler.scale(weather, fitted, ["temp", "pressure"])
    stats = scaled.agg(F.avg("temp"), F.stddev_pop("temp"), F.avg("pressure")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and stats[2] == pytest.approx(0, abs=1e-9)
    scaler.save(fitted, f"file://{tmp_path}/scaler")
    back = scaler.unscale(scaled, scaler.load(spark, f"file://{tmp_path}/scaler"), ["temp", "pressure"])
    assert sorted(r.temp for r in back.collect()) == pytest.approx(sorted(np.ravel(TEMP)))


def test_scaler_custom_and_errors(weather):
    custom = {"temp": {"centering": "min", "scaling": "MinMax"}, "pressure": {"centering": "Median", "scaling": "none"}}
    row = {r.feature: r for r in scaler.fit(weather, ["temp", "pressure"], custom).collect()}
    assert (row["temp"].center, row["temp"].scale) == (10, 15) and (row["pressure"].center, row["pressure"].scale) == (np.median(PRESSURE), 1)
    with pytest.raises(ValueError):
        scaler.fit(weather, ["temp"], {"temp": {"centering": "mode"}})
    with pytest.raises(ValueError):
        scaler.scale(weather, scaler.fit(weather, ["temp"]), ["pressure"])
    with pytest.raises(scaler.ZeroScale, match="same"):
        scaler.check(scaler.fit(weather.withColumn("same", F.lit(1.0)), ["temp", "same"]))
    assert {r.feature for r in scaler.with_aliases(scaler.fit(weather, ["temp", "pressure"]), ["temp"]).collect()} == {"temp", "temp_obs", "temp_sim", "pressure"}


@pytest.mark.parametrize(("name", "values", "want"), [("median", [1, 5, 2], 2), ("min", [1, 2, 3], 1), ("minmax", [1, 5, 3], 4), ("std", [1, 2, 3], np.std([1, 2, 3])), ("mean", [1, None, 3], 2)])
def test_statistics(series, name, values, want):
    df = series({"A": [None if v is None else float(v) for v in values]})
    assert df.agg(scaler.statistic(name, "v")).first()[0] == pytest.approx(want)


# --- sequences ------------------------------------------------------------------------------------------------------


def test_windows(series):
    df = series({"A": [0.0, 1.0, N, 3.0, 4.0, 5.0], "B": [7.0]})
    got = {(r.basin, r.date.day): r.v for r in sequences.hindcast(df, ["v"], 3).collect()}
    assert got == {("A", 3): [0, 1, N], ("A", 4): [1, N, 3], ("A", 5): [N, 3, 4], ("A", 6): [3, 4, 5]}
    assert {r.date.day: r.v for r in sequences.target(df, ["v"], 3, 2).collect()} == {1: [0, 1, N], 2: [1, N, 3], 3: [N, 3, 4], 4: [3, 4, 5]}
    assert {r.date.day: r.v for r in sequences.hindcast_of_forecasts(df, ["v"], 2).collect()} == {3: [0, 1], 4: [1, N], 5: [N, 3], 6: [3, 4]}
    flagged = df.withColumn("ok", F.col("v") == 4)
    assert [r.date.day for r in sequences.hindcast(flagged, ["v"], 2, "ok").collect()] == [5]
    assert [x.day for x in sequences.sample_dates(flagged, 2, 1, "ok").first().dates] == [5, 6]


def test_forecast_sequences(spark, series):
    fc = forecasts(spark, {"A": {5: [50, N, 52]}})
    s = sequences.forecast(fc, ["fc"])
    assert s.first().fc == [50, N, 52]
    obs = series({"A": [1.0, 2.0, 3.0, 4.0, 5.0]}, date(2000, 1, 1), names=("fc",))
    assert sequences.with_overlap(s, obs, ["fc"], 2, 1).first().fc == [3, 4, 50, N, 52]
    assert sequences.timestep_counters(2, [1, 2], 3) == ([0, 0], [1, 1, 1, 1, 2])


def test_basin_batches(spark):
    rows = [(b, date(2000, 1, 1) + timedelta(days=i)) for b, n in (("101", 7), ("102", 6), ("103", 2)) for i in range(n)]
    got = sequences.basin_batches(spark.createDataFrame(rows, "basin string, date date"), 3).groupBy("basin", "batch").count().collect()
    assert sorted((r.basin, r["count"]) for r in got) == [("101", 1), ("101", 3), ("101", 3), ("102", 3), ("102", 3), ("103", 2)]


# --- splits ---------------------------------------------------------------------------------------------------------


def test_splits(spark):
    b = spark.createDataFrame([(f"{g}_{i}",) for g, n in (("camels", 12), ("hysets", 6), ("camelsaus", 2)) for i in range(n)], "basin string")
    folds = splits.kfold_even(b, 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [5, 5, 5, 5]
    rows = splits.fold_rows(splits.kfold(b, 4), 4)
    assert rows.where("role = 'test'").count() == 20 and rows.count() == 80
    out = splits.leave_group_out(b).where("role = 'test'").groupBy("left_out").count().collect()
    assert {r.left_out: r["count"] for r in out} == {"camels": 12, "hysets": 6, "camelsaus": 2}
    assert {r.grp: r["count"] for r in splits.dev_sample(b, 3).groupBy("grp").count().collect()} == {"camels": 3, "hysets": 3, "camelsaus": 2}
    assert align.prefix_filter(b, "camels").count() == 12 and align.prefix_filter(b, "camels", exact=False).count() == 14
    names = spark.createDataFrame([("a_train.txt",), ("a_test.txt",), ("train.txt",), ("x.csv",)], "name string")
    assert {(r.experiment, r.train, r.test) for r in splits.pair_files(names).collect()} == {("a", "a_train.txt", "a_test.txt"), ("", "train.txt", None)}


def test_random_basins_noise_and_runs(spark, weather):
    from freshet.plans.runs import schedule

    assert splits.random_basins(weather, 1).collect() == splits.random_basins(weather, 1).collect()
    fitted = scaler.fit(weather, ["temp"])
    same = scaler.with_noise(weather, fitted, ["temp"], 0.0)
    assert sorted(r.temp for r in same.collect()) == sorted(float(x) for x in np.ravel(TEMP))
    assert sorted(r.temp for r in scaler.with_noise(weather, fitted, ["temp"], 0.1).collect()) != sorted(float(x) for x in np.ravel(TEMP))
    got = schedule(spark, [("a", lambda s: s.range(5).count()), ("b", lambda s: 1 / 0), ("c", lambda s: 3)], at_once=2)
    assert got["a"] == 5 and isinstance(got["b"], ZeroDivisionError) and got["c"] == 3


# --- names and frequencies ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("low", "high", "want"), [("12h", "90min", 8), ("3W", "1D", 21), ("6h", "2D", 1 / 8), ("h", "60min", 1), ("2YE", "3ME", 8), ("2QE", "1ME", 6), ("0h", "0min", 1), ("5D", "5D", 1)])
def test_frequency_factor(low, high, want):
    assert frequency.factor(low, high) == pytest.approx(want)


@pytest.mark.parametrize(("low", "high"), [("2ME", "1W"), ("1QE", "6h"), ("YE", "2W"), ("1D", "QE"), ("1fortnight", "1D")])
def test_frequencies_that_cannot_be_compared(low, high):
    with pytest.raises(ValueError):
        frequency.factor(low, high)


def test_frequency_sort_and_infer():
    assert frequency.sort(["30min", "6h", "W", "36h"]) == ["W", "36h", "6h", "30min"]
    assert frequency.sort(["1D", "48h"]) == ["48h", "1D"] and frequency.sort([]) == []
    assert frequency.infer(days=[1, 2, 3]) == "1D" and frequency.infer(days=[0, 7, 14]) == "7D" and frequency.infer(seconds=[0, 7200]) == "2h"
    with pytest.raises(NotImplementedError):
        frequency.factor("6h", "-2h")
    with pytest.raises(ValueError):
        frequency.infer(days=[1, 2, 4])


def test_feature_lists():
    assert schema.flatten([["a"], "b", ["c", "d"]]) == ["a", "b", "c", "d"] and schema.flatten({"x": ["a"], "y": ["b"]}) == ["a", "b"] and schema.flatten(None) == []
    assert schema.group(["p_a", "q_b", "p_c"]) == [["p_a", "p_c"], ["q_b"]] and schema.group([["a", "b"], ["c"]]) == [["a", "b"], ["c"]]
    assert schema.unique(["b", "a", "b"]) == ["b", "a"]
    assert schema.product_bands(["era5land_t", "cpc_p", "era5land_p"]) == {"ERA5_LAND": ["era5land_t", "era5land_p"], "CPC": ["cpc_p"]}
