"""Metrics, peaks, mixtures, losses and models against plain computations."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import cmal, losses, metrics, models, peaks


def flow(spark, obs, sim, basin="A", start=date(2000, 1, 1)):
    rows = [(basin, start + timedelta(days=i), None if o is None else float(o), None if s is None else float(s)) for i, (o, s) in enumerate(zip(obs, sim, strict=True))]
    return spark.createDataFrame(rows, "basin string, date date, obs double, sim double")


def one(df, wanted="all"):
    return metrics.evaluate(df, ["basin"], wanted).first()


def test_perfect_and_mean(spark):
    r = np.random.default_rng(0)
    o = r.gamma(2, 3, 400)
    got = one(flow(spark, o, o))
    for m in ("NSE", "KGE", "Pearson-r", "Alpha-NSE", "Beta-KGE"):
        assert got[m] == pytest.approx(1), m
    for m in ("MSE", "RMSE", "Beta-NSE", "FHV", "FMS", "FLV", "Peak-MAPE", "Peak-Timing", "Missed-Peaks"):
        assert got[m] == pytest.approx(0, abs=1e-6), m
    assert one(flow(spark, o, np.full(400, o.mean())), "nse")["NSE"] == pytest.approx(0)
    assert one(flow(spark, o, o + 1), ["Beta-NSE"])["Beta-NSE"] == pytest.approx(1 / o.std())


def test_moments_and_curves_by_numpy(spark):
    r = np.random.default_rng(1)
    o, s = r.gamma(2, 3, 333), r.gamma(2, 3, 333)
    o[5], s[7] = 0, -1
    obs, sim = [*o, None, 3.0], [*s, 2.0, None]
    got = one(flow(spark, obs, sim), [*metrics.MOMENTS, *metrics.CURVES])
    rho = np.corrcoef(o, s)[0, 1]
    want = {
        "NSE": 1 - ((s - o) ** 2).sum() / ((o - o.mean()) ** 2).sum(), "MSE": ((s - o) ** 2).mean(), "RMSE": np.sqrt(((s - o) ** 2).mean()), "Pearson-r": rho,
        "Alpha-NSE": s.std() / o.std(), "Beta-KGE": s.mean() / o.mean(), "Beta-NSE": (s.mean() - o.mean()) / o.std(),
    }
    want["KGE"] = 1 - np.sqrt((rho - 1) ** 2 + (want["Alpha-NSE"] - 1) ** 2 + (want["Beta-KGE"] - 1) ** 2)
    fo, fs = np.sort(o)[::-1], np.sort(s)[::-1]
    k = int(np.round(0.02 * 333))
    want["FHV"] = (fs[:k] - fo[:k]).sum() / fo[:k].sum() * 100
    lo, ls = np.log(np.where(fo == 0, 1e-6, fo)), np.log(np.where(fs <= 0, 1e-6, fs))
    a, b = int(np.round(0.2 * 333)), int(np.round(0.7 * 333))
    want["FMS"] = ((ls[a] - ls[b]) - (lo[a] - lo[b])) / (lo[a] - lo[b] + 1e-6) * 100
    k = int(np.round(0.3 * 333))
    qo, qs = (lo[-k:] - lo[-k:].min()).sum(), (ls[-k:] - ls[-k:].min()).sum()
    want["FLV"] = -(qs - qo) / (qo + 1e-6) * 100
    for m, w in want.items():
        assert got[m] == pytest.approx(w, rel=1e-9), m
    assert got.n_pairs == 333


def test_undefined_is_null(spark):
    constant = one(flow(spark, [2.0] * 5, [1.0, 2, 3, 4, 5]), [*metrics.MOMENTS])
    assert constant["NSE"] is None and constant["Pearson-r"] is None and constant["KGE"] is None and constant["MSE"] == pytest.approx(3)
    empty = one(flow(spark, [None, None], [1.0, 2.0]))
    assert all(empty[m] is None for m in metrics.AVAILABLE) and empty.n_pairs == 0
    assert one(flow(spark, [1.0], [2.0]), ["kge", "PEARSON-R"])["KGE"] is None


def test_names():
    assert metrics.resolve("ALL") == metrics.available() and metrics.resolve(["nse", "peak-mape"]) == ["NSE", "Peak-MAPE"]
    with pytest.raises(RuntimeError):
        metrics.resolve("skill")


# --- peaks ----------------------------------------------------------------------------------------------------------


def test_local_maxima():
    assert peaks.local_maxima(np.array([0, 1, 0, 2, 2, 2, 1, 3, 3, 0, 5.0])).tolist() == [1, 4, 7]
    assert peaks.local_maxima(np.array([1.0, 1.0, 1.0])).tolist() == [] and peaks.local_maxima(np.array([])).tolist() == []


def test_distance_prominence_height():
    x = np.zeros(60)
    x[[10, 15, 40]] = [3, 5, 2]
    assert peaks.find_peaks(x, 10).tolist() == [15, 40]
    assert peaks.find_peaks(x, 5).tolist() == [10, 15, 40]
    assert peaks.find_peaks(x, height=3).tolist() == [10, 15]
    hill = np.array([0, 5, 4, 6, 0, 3, 2, 3.5, 1.0])
    assert [peaks.prominence(hill, i) for i in (1, 3, 5, 7)] == [1, 6, 1, 2.5]
    assert peaks.find_peaks(hill, least_prominence=2).tolist() == [3, 7]


def triangles(n, *tops):
    x = np.full(n, 1.0)
    for top in tops:
        for d in range(-5, 6):
            x[top + d] = max(x[top + d], 10 - abs(d))
    return x


def test_peak_metrics(spark):
    o, s = triangles(400, 100, 250), triangles(400, 102, 252)
    got = one(flow(spark, o, s), metrics.PEAKS)
    assert got["Peak-Timing"] == pytest.approx(2) and got["Missed-Peaks"] == 1.0 and got["Peak-MAPE"] == pytest.approx(20)
    assert one(flow(spark, o, triangles(400, 101, 251)), metrics.PEAKS)["Missed-Peaks"] == 0.0
    gap = [None if 98 <= i <= 99 else v for i, v in enumerate(o)]
    assert one(flow(spark, gap, s), ["Peak-Timing"])["Peak-Timing"] == pytest.approx(2)
    edge = triangles(400, 250)
    edge[:4] = [1, 30, 1, 1]
    assert one(flow(spark, edge, edge), ["Peak-Timing"])["Peak-Timing"] == 0
    flat = one(flow(spark, np.ones(50), np.ones(50)), metrics.PEAKS)
    assert flat["Peak-Timing"] is None and flat["Missed-Peaks"] == 0.0 and flat["Peak-MAPE"] is None


# --- mixtures -------------------------------------------------------------------------------------------------------

MU, B, TAU, PI = [1.0, 2.0, 5.0], [0.5, 1.0, 0.3], [0.2, 0.5, 0.7], [0.5, 0.3, 0.2]


def cdf(x):
    z = (x - np.array(MU)) / np.array(B)
    t = np.array(TAU)
    return (np.array(PI) * np.where(x > np.array(MU), 1 - (1 - t) * np.exp(-t * z), t * np.exp((1 - t) * z))).sum()


@pytest.fixture
def mixture(spark):
    return spark.createDataFrame([(MU, B, TAU, PI)], "mu array<double>, b array<double>, tau array<double>, pi array<double>")


def test_mixture_functions(mixture):
    m = cmal.components()
    x = F.lit(1.7)
    got = mixture.select(cmal.cdf(x, m).alias("c"), cmal.pdf(x, m).alias("p"), cmal.mean(m).alias("m"), cmal.quantile(0.5, m).alias("q"), cmal.log_likelihood(x, m).alias("l"), cmal.predictions(m).alias("all")).first()
    assert got.c == pytest.approx(cdf(1.7)) and got.p == pytest.approx((cdf(1.7 + 1e-6) - cdf(1.7 - 1e-6)) / 2e-6, rel=1e-4)
    t = np.array(TAU)
    assert got.m == pytest.approx((np.array(PI) * (np.array(MU) + np.array(B) * (1 - 2 * t) / (t * (1 - t)))).sum())
    assert cdf(got.q) == pytest.approx(0.5, abs=1e-4) and got.l == pytest.approx(np.log(got.p), abs=1e-6)
    assert len(got.all) == 10 and got.all[0] == pytest.approx(got.m) and got.all[5] == pytest.approx(got.q)


def test_sampling(mixture):
    s = np.array(cmal.sample(mixture, 20_000, seed=1).first().samples)
    for q in (0.1, 0.5, 0.9):
        assert cdf(np.quantile(s, q)) == pytest.approx(q, abs=0.02)
    assert cmal.sample(mixture, 50, seed=1).first().samples == cmal.sample(mixture, 50, seed=1).first().samples
    r = np.random.default_rng(0)
    args = ([[-1.0, 0.5]], [[1.0, 1.0]], [[0.5, 0.5]], [[0.5, 0.5]], 500)
    assert cmal.draw(r, *args).min() < 0 <= min(cmal.draw(r, *args, "clip").min(), cmal.draw(r, *args, "truncate").min())
    assert (cmal.draw(r, *args, "truncate") == 0).mean() < (cmal.draw(r, *args, "clip") == 0).mean()
    assert np.isnan(cmal.draw(r, [[1.0, 2.0]], [[1.0, 1.0]], [[0.5, 0.5]], [[np.nan, 0.5]], 3)).all()
    with pytest.raises(NotImplementedError):
        cmal.draw(r, *args, "other")


def test_ensembles(spark):
    v = [3.0, None, 1.0, 2.0, 10.0]
    df = spark.createDataFrame([(1.5, v), (None, v), (9.0, [])], "obs double, samples array<double>")
    got = df.select(cmal.percentile_bands(F.col("samples")).alias("s"), cmal.reduce_samples(F.col("samples"), "median").alias("m")).collect()
    there = [x for x in v if x is not None]
    assert got[0].s["mean"] == 4 and got[0].s["p25"] == pytest.approx(np.percentile(there, 25)) and got[0].m == pytest.approx(np.median(there)) and got[2].m is None
    assert {r.q: r.share for r in cmal.reliability(df.limit(2)).collect()}[50] == 1.0


def test_losses(spark):
    df = flow(spark, [1.0, None, 3.0], [2.0, 5.0, 5.0]).withColumn("std", F.lit(0.9))
    got = df.agg(losses.mse(F.col("sim"), F.col("obs")).alias("a"), losses.rmse(F.col("sim"), F.col("obs")).alias("b"), losses.nse(F.col("sim"), F.col("obs"), F.col("std")).alias("c")).first()
    assert got.a == pytest.approx(1.25) and got.b == pytest.approx(np.sqrt(1.25)) and got.c == pytest.approx(2.5)
    with pytest.raises(ValueError):
        losses.total(df, [("sim", "obs")], weights=[1, 2])
    assert losses.total(df, [("sim", "obs")]).first().total_loss == pytest.approx(1.25)


# --- models ---------------------------------------------------------------------------------------------------------


def lstm_weights(r, name, n_in, n):
    return {f"{name}.wx": r.normal(size=(4 * n, n_in)), f"{name}.wh": r.normal(size=(4 * n, n)) * 0.3, f"{name}.b": r.normal(size=4 * n)}


def dense_weights(r, name, n_in, n):
    return {f"{name}.w": r.normal(size=(n, n_in)), f"{name}.b": r.normal(size=n)}


def test_lstm_by_hand():
    r = np.random.default_rng(0)
    w = lstm_weights(r, "l", 2, 1)
    x = r.normal(size=(1, 3, 2))
    out, _ = models.lstm(w, "l", x)
    h = c = 0.0
    for t in range(3):
        g = w["l.wx"] @ x[0, t] + w["l.wh"][:, 0] * h + w["l.b"]
        sig = lambda v: 1 / (1 + np.exp(-v))
        c = sig(g[1]) * c + sig(g[0]) * np.tanh(g[2])
        h = sig(g[3]) * np.tanh(c)
        assert out[0, t, 0] == pytest.approx(h)


def test_mean_embedding(spark):
    r = np.random.default_rng(1)
    m = models.MeanEmbedding({"a": ["a_p"], "b": ["b_p", "b_t"]}, {"a": ["a_p"], "c": ["c_p"]}, 4, 2)
    w = dense_weights(r, "statics.0", 2, 3) | dense_weights(r, "hindcast.b.0", 5, 4) | dense_weights(r, "forecast.c.0", 4, 4) | dense_weights(r, "shared.a.0", 4, 4)
    w |= lstm_weights(r, "hindcast_lstm", 7, 5) | lstm_weights(r, "forecast_lstm", 12, 5) | dense_weights(r, "head.0", 5, 6) | dense_weights(r, "head.1", 6, 12)
    h = {"b_p": r.normal(size=(3, 4)), "b_t": r.normal(size=(3, 4))}
    f = {"a_p": r.normal(size=(3, 6)), "c_p": r.normal(size=(3, 6))}
    out = m(w, r.normal(size=(3, 2)), h, f)
    assert out["mu"].shape == (3, 6, 3) and np.allclose(out["pi"].sum(axis=-1), 1, atol=1e-4) and (out["b"] > 0).all() and ((out["tau"] > 0) & (out["tau"] < 1)).all()
    h["b_p"][:, 1] = np.nan  # a gap in one group leaves the other
    assert not np.isnan(m(w, r.normal(size=(3, 2)), h, f)["mu"]).any()
    with pytest.raises(ValueError):
        models.MeanEmbedding({"a": ["a_p"]}, {"a": ["a_t"]}, 4, 2)


def test_handoff_and_predict(spark):
    r = np.random.default_rng(2)
    m = models.Handoff(["p"], ["p"], 5, 2, overlap=2)
    w = lstm_weights(r, "hindcast_lstm", 3, 4) | lstm_weights(r, "forecast_lstm", 3, 4) | dense_weights(r, "handoff.0", 8, 6) | dense_weights(r, "handoff_linear", 6, 8) | dense_weights(r, "hindcast_head", 4, 1) | dense_weights(r, "forecast_head", 4, 1)
    rows = [("A", i, 0.5, float(i), [float(x) for x in r.normal(size=5)], [float(x) for x in r.normal(size=4)]) for i in range(7)]
    df = spark.createDataFrame(rows, "basin string, date int, s1 double, s2 double, x_h array<double>, x_f array<double>")
    got = {x.date: x.y_hat for x in models.predict(df, m, w, ["s1", "s2"], {"p": "x_h"}, {"p": "x_f"}, rows=3).collect()}
    want = m(w, np.array([[x[2], x[3]] for x in rows]), {"p": np.array([x[4] for x in rows])}, {"p": np.array([x[5] for x in rows])})
    assert len(got) == 7 and all(got[i] == pytest.approx(want["y_hat"][i].ravel()) for i in range(7)) and len(got[0]) == 5
    assert want["y_hindcast_overlap"].shape == want["y_forecast_overlap"].shape == (7, 2, 1)
    assert models.get_model("Handoff_forecast_LSTM") is models.Handoff and models.positional_encoding(3, 4).shape == (3, 4)


def test_losses_by_name_and_rates():
    from freshet.functions import losses, schedules
    from freshet.operators.sequences import steps_of

    assert losses.by_name("NSE") is losses.nse and losses.by_name("CMALLoss") is losses.cmal and losses.by_name("forecast_overlap") is losses.overlap
    with pytest.raises(NotImplementedError):
        losses.by_name("other")
    assert schedules.learning_rates("ReduceLROnPlateau", 1.0, [3, 2, 2, 2, 1, 1, 1, 1], 0.1, 1) == pytest.approx([1, 1, 1, 0.1, 0.1, 0.1, 0.01, 0.01])
    with pytest.raises(ValueError):
        schedules.learning_rates("Cosine", 1.0, [])
    assert steps_of(4, None, []) == 4 and steps_of({"1D": 2, "1h": 7}, "1h", ["1D"]) == 7


def test_points_of_a_head(spark):
    m = spark.createDataFrame([([1.0], [0.5], [0.4], [1.0]), ([None], [0.5], [0.4], [1.0])], "mu array<double>, b array<double>, tau array<double>, pi array<double>")
    got = cmal.points(m, "cmal", 5).collect()
    assert None not in got[0].samples and got[1].samples == [None] * 5
    with pytest.raises(NotImplementedError):
        cmal.points(m, "regression", 5)
