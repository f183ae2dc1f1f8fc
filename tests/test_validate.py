"""Golden vectors of validation: policies, windows, the composite check."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import validate

N = None
RAIN = {"upper": [N, 0, 7, 7, 3], "middle": [2, 2, N, 8, N], "lower": [9, 1, 0, 5, 6]}
SNOW = {"upper": [4, 0, 0, N, 1], "middle": [3, 6, 2, 0, N], "lower": [8, 8, N, 2, 2]}


def table(series, *names, **groups):
    values = {b: [[None if x is None else float(x) for x in groups[n][b]] for n in names] for b in groups[names[0]]}
    return series(values, names=names) if len(names) > 1 else series({b: v[0] for b, v in values.items()}, names=names)


def by_basin(df, column="valid"):
    out = {}
    for r in df.orderBy("basin", "date").collect():
        out.setdefault(r.basin, []).append(r[column])
    return out


T, X = True, False


@pytest.mark.parametrize(
    ("method", "want"),
    [
        ("input_replacing", {"upper": [T] * 5, "middle": [T, T, T, T, X], "lower": [T] * 5}),
        (None, {"upper": [X, T, T, X, T], "middle": [T, T, X, T, X], "lower": [T, T, X, T, T]}),
    ],
)
def test_policies_without_leads(series, method, want):
    df = table(series, "rain", "snow", rain=RAIN, snow=SNOW)
    assert by_basin(df.withColumn("valid", validate.policy(method, ["rain", "snow"]))) == want


def test_policies_with_leads(spark):
    start = date(2021, 6, 1)
    lost = {("x", 0, 3), ("x", 2, 0), ("y", 1, 0), ("y", 1, 1), ("y", 1, 2), ("y", 1, 3)}  # basin, day, lead time without rain
    rows = []
    for basin in "xy":
        for d in range(4):
            for lead in range(4):
                rain = None if (basin, d, lead) in lost else 0.5 * d + lead
                wind = None if (basin, d) == ("y", 1) or (basin, d, lead) == ("y", 3, 2) else 3.0
                rows.append((basin, start + timedelta(days=d), lead, rain, wind))
    fc = spark.createDataFrame(rows, "basin string, date date, lead_time int, rain double, wind double")
    folded = validate.over_leads(fc, ["rain", "wind"], 4)
    some = by_basin(folded.withColumn("valid", validate.lead_policy("input_replacing", ["rain", "wind"])))
    full = by_basin(folded.withColumn("valid", validate.lead_policy(None, ["rain", "wind"])))
    assert some == {"x": [T] * 4, "y": [T, X, T, T]}
    assert full == {"x": [X, T, X, T], "y": [T, X, T, X]}
    absent = validate.over_leads(fc.where("not (basin = 'x' and date = '2021-06-04' and lead_time = 1)"), ["rain"], 4)
    assert by_basin(absent.withColumn("valid", validate.lead_policy(None, ["rain"])))["x"] == [X, T, X, X]


@pytest.mark.parametrize(
    ("method", "gone", "want"),
    [("masked_mean", ("f3", "f4"), T), ("masked_mean", ("f1", "f3", "f4"), X), ("unioning", ("f2", "f4"), T), ("unioning", ("f3", "f4"), X)],
)
def test_groups(series, method, gone, want):
    values = {f: {"A": [1.0, 2.0, 3.0, None if f in gone else 4.0, 5.0]} for f in ("f1", "f2", "f3", "f4")}
    df = table(series, "f1", "f2", "f3", "f4", **values)
    got = by_basin(df.withColumn("valid", validate.policy(method, [["f1", "f2"], ["f3", "f4"]])))["A"]
    assert got == [T, T, T, want, T]


def test_policy_errors():
    with pytest.raises(ValueError):
        validate.policy("other", ["a"])
    for groups in ([], [[]], ["a"]):
        with pytest.raises(ValueError):
            validate.policy("masked_mean", groups)


@pytest.mark.parametrize(
    ("fn", "mask", "n", "shift", "want"),
    [
        (validate.sequence_all, "TTFTT", 2, 0, "FTFFT"),
        (validate.sequence_all, "TTTFT", 3, 1, "FTFFF"),
        (validate.sequence_all, "TTTFT", 2, -1, "FFTTF"),
        (validate.sequence_any, "FFTFF", 3, 0, "FFTTT"),
        (validate.sequence_any, "FFTFF", 3, 1, "FTTTF"),
    ],
)
def test_sequence_windows(series, fn, mask, n, shift, want):
    df = series({"A": [1.0 if c == "T" else None for c in mask]})
    got = by_basin(df.withColumn("valid", fn(F.col("v").isNotNull(), n, shift)))["A"]
    assert "".join("T" if x else "F" for x in got) == want


def test_all_zero_targets(series):
    df = series({"A": [0.0, 1.0, None, 0.0]})
    assert by_basin(df.withColumn("valid", validate.nonzero(["v"])))["A"] == [X, T, T, X]


def test_composite(series):
    df = series({"A": [[1.0, 1.0, 1.0, None, 1.0, 1.0], [None, None, 5.0, None, None, None]]}, names=("h", "y"))
    out = validate.masks(df, train=True, periods=[("2020-01-01", "2020-01-05")], hindcast=["h"], targets=["y"], seq_length=2, predict_last_n=2, lead_time=1)
    assert by_basin(out, "valid_hindcasts")["A"] == [X, T, T, X, X, T]
    assert by_basin(out, "valid_targets")["A"] == [X, T, T, X, X, X]
    assert by_basin(out, "valid_dates")["A"] == [T] * 5 + [X]
    assert by_basin(out)["A"] == [X, T, T, X, X, X]
    assert [tuple(r) for r in validate.sample_index(out).orderBy("sample_id").select("sample_id", "basin").collect()] == [(0, "A"), (1, "A")]
    evaluation = validate.masks(df, train=False, periods=[("2020-01-01", "2020-01-06")], hindcast=["h"], targets=["y"], seq_length=1)
    assert "valid_targets" not in evaluation.columns


def test_missing_parameters(series):
    df = series({"A": [1.0]})
    p = [("2020-01-01", "2020-01-02")]
    for kwargs in ({}, {"hindcast": ["v"]}, {"targets": ["v"]}, {"forecast": ["v"], "overlap": 2}):
        with pytest.raises(ValueError):
            validate.masks(df, train=True, periods=p, **kwargs)
    with pytest.raises(validate.NoSamples):
        validate.require_samples(validate.sample_index(df.withColumn("valid", F.lit(False))))
