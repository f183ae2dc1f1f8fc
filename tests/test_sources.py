"""Text sources, Zarr, configuration, registry, evaluation plans and the stream."""

import json
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from freshet import config
from freshet.plans import dataset, evaluation
from freshet.sources import registry, tables, zarr3
from freshet.sources.zarr3_writer import BasinsThere, rechunk, save
from freshet.streaming.skill import windowed_skill


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_attributes(spark, tmp_path):
    write(tmp_path / "attributes/camels/a.csv", "gauge_id,gauge_name,area\ncamels_1,One,10\ncamels_2,Two,20.5\n")
    write(tmp_path / "attributes/camels/b.csv", "gauge_id,frac_snow\ncamels_1,0.5\ncamels_2,\n")
    write(tmp_path / "attributes/lamah/a.csv", "gauge_id,area,frac_snow\nlamah_9,7,0.1\n")
    root = f"file://{tmp_path}"
    got = {r.basin: (r.area, r.frac_snow) for r in tables.read_attributes(spark, root, ["camels_2", "lamah_9"], ["area", "frac_snow"]).collect()}
    assert got == {"camels_2": (20.5, None), "lamah_9": (7, pytest.approx(0.1))}
    with pytest.raises(ValueError, match="camels_3"):
        tables.read_attributes(spark, root, ["camels_3"], ["area"])
    with pytest.raises(FileNotFoundError):
        tables.read_attributes(spark, root, ["other_1"], ["area"])
    with pytest.raises(KeyError):
        tables.read_attributes(spark, root, ["camels_1"], ["height"])


def test_series_and_forecasts(spark, tmp_path):
    root = f"file://{tmp_path}"
    for b, v in (("camels_1", "1.5"), ("camels_2", "NaN")):
        write(tmp_path / f"timeseries/csv/camels/{b}.csv", f"date,q,t\n2020-01-01,{v},3\n2020-01-02,,4\n")
    got = sorted(((r.basin, r.date.day, r.q) for r in tables.read_timeseries(spark, root, ["camels_1", "camels_2"], ["q"]).collect()), key=str)
    assert got == [("camels_1", 1, 1.5), ("camels_1", 2, None), ("camels_2", 1, None), ("camels_2", 2, None)]
    assert {r.lead_time for r in tables.read_hindcasts(spark, root, ["camels_1"], ["q"]).collect()} == {0}
    write(tmp_path / "p_b_1.csv", "date,1,2\n2020-01-01,5,6\n")
    write(tmp_path / "b_2.csv", "date,p\n2020-01-01,9\n")
    got = sorted((r.basin, r.lead_time, r.p) for r in tables.read_forecasts(spark, root, ["b_1", "b_2"], "p").collect())
    assert got == [("b_1", 1, 5), ("b_1", 2, 6), ("b_2", 0, 9)]
    with pytest.raises(ValueError):
        tables.read_forecasts(spark, root, ["b_3"], "p")


def test_basin_lists_and_sinks(spark, tmp_path):
    write(tmp_path / "list.txt", " b_2 \n\nb_1\n")
    assert tables.read_basins(spark, f"file://{tmp_path}/list.txt") == ["b_1", "b_2"]
    write(tmp_path / "bad.txt", "b_1_period2\n")
    with pytest.raises(ValueError):
        tables.read_basins(spark, f"file://{tmp_path}/bad.txt")
    rows = spark.createDataFrame([("b_1", date(2020, 1, 1), 0, 1.0, 2.0)], "basin string, date date, time_step int, obs double, sim double")
    for epoch in ("003", "012"):
        tables.write_results(rows.withColumn("sim", F.lit(float(epoch))), f"file://{tmp_path}/run/test/model_epoch{epoch}/results")
    assert tables.read_results(spark, f"file://{tmp_path}/run").first().sim == 12 and tables.read_results(spark, f"file://{tmp_path}/run", epoch=3).first().sim == 3
    with pytest.raises(FileNotFoundError):
        tables.read_results(spark, f"file://{tmp_path}/run", "validation")
    tables.write_metrics(spark.createDataFrame([("b_1", 0, 0.5, None)], "basin string, lead_time int, NSE double, KGE double"), f"file://{tmp_path}/m")
    assert [tuple(r) for r in tables.read_metrics(spark, f"file://{tmp_path}/m").collect()] == [("b_1", 0, 0.5, None)]


def zarr_array(root, name, values, chunks, dims, codec="zstd", **attributes):
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": str(values.dtype) if values.dtype.kind != "U" else {"name": "fixed_length_utf32", "configuration": {"length_bytes": values.dtype.itemsize}},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN" if values.dtype.kind == "f" else 0,
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": "zstd", "configuration": {"level": 0}}] if codec else [])], "dimension_names": list(dims), "attributes": attributes,
    }
    write(root / name / "zarr.json", json.dumps(meta))
    for at in np.ndindex(*[-(-s // c) for s, c in zip(values.shape, chunks)]):
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        if values.dtype.kind == "f" and np.isnan(part).all():
            continue
        full = np.zeros(chunks, values.dtype)
        full[tuple(slice(0, n) for n in part.shape)] = part
        path = root / name / "c" / "/".join(map(str, at))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(zstandard.compress(full.tobytes()) if codec else full.tobytes())


def test_zarr(spark, tmp_path):
    values = np.arange(3 * 5, dtype="float32").reshape(3, 5)
    values[1, 2] = np.nan
    values[2] = np.nan  # its chunks are absent
    root = tmp_path / "store"
    zarr_array(root, "flow", values, (1, 2), ("basin", "date"))
    zarr_array(root, "basin", np.array(["a_1", "a_2", "b_1"]), (3,), ("basin",), codec=None)
    zarr_array(root, "date", np.arange(5), (5,), ("date",), units="days since 2020-01-01")
    zarr3.register(spark)
    df = spark.read.format("zarr3").load(str(root))
    assert df.dtypes == [("basin", "string"), ("date", "date"), ("flow", "float")]
    got = {(r.basin, r.date.day - 1): r.flow for r in df.collect()}
    assert got == {(b, d): None if np.isnan(values[i, d]) else values[i, d] for i, b in enumerate(("a_1", "a_2", "b_1")) for d in range(5)}
    some = spark.read.format("zarr3").option("basins", "a_2").load(str(root))
    assert {r.basin for r in some.collect()} == {"a_2"} and some.rdd.getNumPartitions() == 3


def test_config(tmp_path):
    write(tmp_path / "c.yml", "experiment_name: 'run {seed} x'\nseed: 3\ndata_dir: /d\ntrain_basin_file: /b.txt\ntrain_start_date: ['01/10/1999', '01/10/2001']\ntrain_end_date: ['30/09/2000', '30/09/2002']\nhindcast_inputs: [[a_p, a_t], [b_p]]\nseq_length: 5\n")
    cfg = config.read(tmp_path / "c.yml")
    assert cfg.experiment_name == "run_3_x" and str(cfg.statics_data_dir) == "/d" and cfg.features("hindcast_inputs") == ["a_p", "a_t", "b_p"]
    assert cfg.periods("train")[1] == (date(2001, 10, 1), date(2002, 9, 30))
    config.dump(cfg, tmp_path / "out.yml")
    assert config.read(tmp_path / "out.yml").periods("train") == cfg.periods("train")
    with pytest.raises(FileExistsError):
        config.dump(cfg, tmp_path / "out.yml")
    with pytest.raises(ValueError):
        config.from_dict({"unknown": 1})
    assert config.from_dict({"unknown": 1, "dev_mode": True}).extra == {"unknown": 1}
    assert config.substitute({"a": ["X", {"b": "X"}]}, {"X": 5}) == {"a": [5, {"b": 5}]}


def test_registry():
    registry.register("Mine", lambda spark, cfg: (None, None, None))
    assert registry.get("mine") and "mine" in registry.names()
    with pytest.raises(NotImplementedError):
        registry.get("other")
    with pytest.raises(TypeError):
        registry.register("x", 3)


def test_prepare_samples(spark, series):
    r = np.random.default_rng(0)
    values = {b: [r.gamma(2, 1, 30).tolist(), r.gamma(2, 1, 30).tolist()] for b in ("a_1", "a_2")}
    values["a_1"][0][10] = None
    dynamics = series(values, date(2000, 1, 1), names=("p", "q"))
    statics = spark.createDataFrame([("a_1", 1.0), ("a_2", 3.0)], "basin string, area double")
    rows = [(b, date(2000, 1, 1) + timedelta(days=d), lead, float(d + lead)) for b in values for d in range(30) for lead in (1, 2)]
    forecasts = spark.createDataFrame(rows, "basin string, date date, lead_time int, f double")
    cfg = config.from_dict({"static_attributes": ["area"], "hindcast_inputs": ["p"], "forecast_inputs": ["f"], "target_variables": ["q"], "seq_length": 4, "lead_time": 2, "predict_last_n": 1, "train_start_date": "05/01/2000", "train_end_date": "20/01/2000"})
    out = dataset.prepare(spark, cfg, (statics, dynamics, forecasts))
    samples = {(r.basin, r.date.day) for r in out.samples.collect()}
    assert samples == {("a_2", d) for d in range(5, 21)} | {("a_1", d) for d in range(5, 21) if not 11 <= d <= 14}
    seq = dataset.sequences_of(cfg, out).collect()
    assert len(seq) == len(samples) and {len(x.p) for x in seq} == {4} and {len(x.y_q) for x in seq} == {4} and {len(x.x_f) for x in seq} == {2}
    with pytest.raises(ValueError):
        dataset.prepare(spark, cfg, (statics, dynamics, forecasts), "test")


def test_evaluation_tables(spark):
    rows = [(b, date(2020, 1, 1) + timedelta(days=i), float(i % 7), float(i % 5), float(i)) for b in "AB" for i in range(40)]
    df = spark.createDataFrame(rows, "basin string, date date, q_obs double, q_sim double, t_obs double").withColumn("t_sim", F.col("t_obs"))
    wide = evaluation.targets_skill(df, {"q": ["NSE"], "t": ["NSE", "RMSE"]})
    assert wide.columns == ["basin", "q_NSE", "t_NSE", "t_RMSE"] and wide.first().t_NSE == 1
    one = evaluation.targets_skill(df, {"t": ["NSE"]})
    assert one.columns == ["basin", "NSE"]
    gaps = spark.createDataFrame([("A", date(2020, 1, 1) + timedelta(days=i), v) for i, v in enumerate([1.0, None, None, 2.0, None])], "basin string, date date, obs double")
    assert sorted((r.start_date.day, r.n_days) for r in evaluation.null_runs(gaps).collect()) == [(2, 2), (5, 1)]
    assert evaluation.without_observations(gaps, [("2020-01-02", "2020-01-03")]).count() == 1


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [("A", f"2020-01-0{1 + i // 4} 0{i % 4}:00:00", float(i), float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "basin string, t string, obs double, sim double").select("basin", F.to_timestamp("t").alias("ts"), "obs", "sim")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = windowed_skill(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("skill").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.window.start), r.n_pairs, round(r.NSE, 9))
    assert sorted(map(key, spark.table("skill").collect())) == sorted(map(key, windowed_skill(df).collect()))


def csv_layout(root):
    basins = ["aa_1", "aa_2", "bb_7"]
    for b in basins:
        sub = b.partition("_")[0]
        rows = [(f"2000-01-{d:02d}", d + 0.5, d % 4, d * 2.0) for d in range(1, 31)]
        swap = b == "aa_2"  # columns in another order
        head = "date,q,p,r" if not swap else "date,r,p,q"
        write(root / f"timeseries/csv/{sub}/{b}.csv", head + "\n" + "".join(f"{d},{q if not swap else r},{p},{r if not swap else q}\n" for d, q, p, r in rows))
        write(root / f"timeseries/csv/{sub}/f_{b}.csv", "date,1,2,3\n" + "".join(f"{d},{i},{i + 1},{i + 2}\n" for i, (d, *_) in enumerate(rows)))
    write(root / "attributes/aa/x.csv", "gauge_id,area\naa_1,1\naa_2,4\n")
    write(root / "attributes/bb/x.csv", "gauge_id,area\nbb_7,9\n")
    write(root / "basins.txt", "\n".join(basins))
    return {
        "data_dir": f"file://{root}", "train_basin_file": f"file://{root}/basins.txt", "static_attributes": ["area"], "hindcast_inputs": ["p"], "forecast_inputs": ["f"], "target_variables": ["q"],
        "union_mapping": {"p": "r"}, "seq_length": 4, "lead_time": 2, "train_start_date": "05/01/2000", "train_end_date": "20/01/2000",
    }


def test_tables_of_a_configuration(spark, tmp_path):
    cfg = config.from_dict(csv_layout(tmp_path))
    cfg.data_dir = cfg.statics_data_dir = cfg.dynamics_data_dir = cfg.targets_data_dir = f"file://{tmp_path}"
    cfg.train_basin_file = f"file://{tmp_path}/basins.txt"
    statics, dynamics, forecasts = registry.load(spark, cfg)
    assert {r.basin: r.area for r in statics.collect()} == {"aa_1": 1, "aa_2": 4, "bb_7": 9}
    assert {(r.basin, r.p, r.r, r.q) for r in dynamics.where("date = DATE '2000-01-03'").collect()} == {(b, 3, 6, 3.5) for b in ("aa_1", "aa_2", "bb_7")}
    assert sorted(r.lead_time for r in forecasts.where("basin = 'bb_7' AND date = DATE '2000-01-03'").collect()) == [1, 2]
    out = dataset.prepare(spark, cfg, work=f"file://{tmp_path}/work")
    assert {(r.basin, r.date.day) for r in out.samples.collect()} == {(b, d) for b in ("aa_1", "aa_2", "bb_7") for d in range(5, 21)}
    assert {len(x.p) for x in dataset.sequences_of(cfg, out).collect()} == {4}


def test_products_of_a_configuration(spark, tmp_path):
    raw = csv_layout(tmp_path) | {"dataset": "zarr", "hindcast_inputs": ["era5land_p", "hres_t"], "forecast_inputs": ["hres_t"], "union_mapping": {}}
    cfg = config.from_dict(raw)
    cfg.data_dir = cfg.statics_data_dir = cfg.targets_data_dir = f"file://{tmp_path}"
    cfg.dynamics_data_dir, cfg.train_basin_file = str(tmp_path), f"file://{tmp_path}/basins.txt"
    names, days = np.array(["aa_1", "aa_2", "bb_7", "cc_1"]), np.arange(30)
    for product, leads in (("ERA5_LAND", None), ("HRES", np.array([0, 1, 2, 3]) * 86_400 * 10**9)):
        root = tmp_path / product / "timeseries.zarr"
        shape, dims = ((4, 30), ("basin", "date")) if leads is None else ((4, 30, 4), ("basin", "date", "lead_time"))
        zarr_array(root, "era5land_p" if leads is None else "hres_t", np.arange(np.prod(shape), dtype="float32").reshape(shape), (2, 10, 4)[: len(shape)], dims)
        zarr_array(root, "basin", names, (4,), ("basin",), codec=None)
        zarr_array(root, "date", days, (30,), ("date",), units="days since 2000-01-01")
        if leads is not None:
            zarr_array(root, "lead_time", leads, (4,), ("lead_time",))
    _, dynamics, forecasts = registry.load(spark, cfg)
    at = {(r.basin, r.date.day): r for r in dynamics.collect()}
    assert set(b for b, _ in at) == {"aa_1", "aa_2", "bb_7"} and (at["aa_2", 3].era5land_p, at["aa_2", 3].hres_t, at["aa_2", 3].q) == (32, 128, 3.5)
    assert sorted((r.lead_time, r.hres_t) for r in forecasts.where("basin = 'aa_2' AND date = DATE '2000-01-03'").collect()) == [(0, 128), (1, 129), (2, 130)]
    cfg.forecast_inputs = ["era5land_p"]
    with pytest.raises(ValueError, match="lead times"):
        registry.load(spark, cfg)


def test_steps_bars_and_products(spark):
    rows = spark.createDataFrame([("A", date(2020, 1, 1), s, float(s)) for s in range(5)] + [("B", date(2020, 1, 1), 0, 9.0)], "basin string, date date, time_step int, sim double")
    assert [r.time_step for r in evaluation.evaluation_step(rows, 2, 5).collect()] == [3] and {r.time_step for r in evaluation.evaluation_step(rows, 2).collect()} == {0}
    obs = spark.createDataFrame([("A", date(2020, 1, 1), 0, 1.0), ("A", date(2020, 1, 2), 0, 2.0), ("C", date(2020, 1, 1), 0, 1.0)], "basin string, date date, time_step int, obs double")
    got = {(r.date.day, r.time_step): (r.obs, r.sim) for r in evaluation.pair_steps(rows, obs).collect()}
    assert got == {(1, 0): (1, 0), (2, 0): (2, None)} | {(1, s): (None, s) for s in range(1, 5)}
    table = spark.createDataFrame([("A", 0, 0.5), ("B", 0, 0.1), ("C", 0, None), ("A", 1, 0.9)], "basin string, lead_time int, NSE double")
    one = lambda b: spark.createDataFrame([(b,)], "basin string")
    assert [tuple(r) for r in evaluation.skill_bars(table, "NSE", one("A"), one("B")).orderBy("rank").collect()] == [(1, "B", 0.1, "test"), (2, "A", 0.5, "train"), (3, "C", None, "other")]
    wide = spark.createDataFrame([("A", 1.0, None, None), ("A", None, None, 2.0), ("B", None, None, None)], "basin string, x_a double, x_b double, y_a double")
    assert {r["product"]: r.basins for r in evaluation.basins_per_product(wide, {"X": ["x_a", "x_b"], "Y": ["y_a"], "Z": ["x_b"]}).collect()} == {"X": 1, "Y": 1, "Z": 0}


# --- Zarr stores that Spark writes ----------------------------------------------------------------------------------


def cells(spark, basins, days=6, step=1.0):
    rows = [(b, date(2020, 1, 1 + d), k, None if (d + k) % 4 == 3 else step * (i * 100 + d * 10 + k)) for i, b in enumerate(basins) for d in range(days) for k in range(2)]
    return spark.createDataFrame(rows, "basin string, date date, lead_time long, flow float").repartition(3)


def stored(spark, path, **options):
    zarr3.register(spark)
    return spark.read.format("zarr3").options(**options).load(path)


DIMS = ["basin", "date", "lead_time"]


def plainly(df):
    return sorted((tuple(r) for r in df.select(*DIMS, "flow").collect()), key=repr)


def test_appended_basins(spark, tmp_path):
    path = f"file://{tmp_path}/results.zarr"
    first, second = cells(spark, ["b_2", "a_1"]), cells(spark, ["a_0", "c_long_name_" + "x" * 60], step=2.0)
    save(first, path, DIMS)
    save(second, path, DIMS, mode="append")
    assert plainly(stored(spark, path)) == plainly(first.unionByName(second))
    assert plainly(stored(spark, path, basins="a_0")) == plainly(second.where("basin = 'a_0'"))
    with pytest.raises(BasinsThere):
        save(second, path, DIMS, mode="append")
    with pytest.raises(ValueError, match="not in the store"):
        save(cells(spark, ["z"], days=7), path, DIMS, mode="append")
    assert plainly(stored(spark, path)) == plainly(first.unionByName(second))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["results.zarr"] and not list(tmp_path.rglob(".*-*"))


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_failing_task_leaves_the_old_store(spark, tmp_path, mode):
    path = f"file://{tmp_path}/results.zarr"
    first = cells(spark, ["a_1", "b_2"])
    save(first, path, DIMS)
    more = cells(spark, ["c_3", "d_4"])
    lost = more.withColumn("flow", F.when(F.col("basin") == "d_4", F.assert_true(F.col("lead_time") < 0).cast("float")).otherwise(F.col("flow")))
    with pytest.raises(Exception, match="is not true"):
        save(lost, path, DIMS, mode=mode, known={"basin": ["c_3", "d_4"], "date": [date(2020, 1, 1 + d) for d in range(6)], "lead_time": [0, 1]})
    assert plainly(stored(spark, path)) == plainly(first)
    save(more, path, DIMS, mode=mode)
    assert plainly(stored(spark, path)) == plainly(first.unionByName(more) if mode == "append" else more)


def test_filters_choose_chunks(spark, tmp_path):
    path = f"file://{tmp_path}/store.zarr"
    df = cells(spark, ["a", "b", "c", "d"], days=9)
    save(df, path, DIMS, chunks={"basin": 2, "date": 3, "lead_time": 1})
    assert plainly(stored(spark, path)) == plainly(df)
    chunks = {p.relative_to(tmp_path / "store.zarr/flow/c"): p for p in (tmp_path / "store.zarr/flow/c").rglob("*") if p.is_file()}
    assert len(chunks) == 2 * 3 * 2
    wanted = {Path("1/1/0"), Path("1/2/0")}
    for at, p in chunks.items():
        if at not in wanted:
            p.write_bytes(b"not a chunk")
    test = "basin IN ('c', 'd') AND date >= DATE '2020-01-05' AND date < DATE '2020-01-09' AND lead_time = 0"
    assert plainly(stored(spark, path).where(test)) == plainly(df.where(test))
    with pytest.raises(Exception, match="[Zz]std"):
        stored(spark, path).where("basin = 'a'").collect()
    # what is not understood is left to Spark
    assert plainly(stored(spark, path).where(f"{test} AND basin LIKE '%d' AND flow > 350")) == plainly(df.where(f"{test} AND basin LIKE '%d' AND flow > 350"))


def test_rechunk(spark, tmp_path):
    source, target = f"file://{tmp_path}/a.zarr", f"file://{tmp_path}/b.zarr"
    df = cells(spark, ["a", "b", "c"], days=7)
    save(df, source, DIMS)
    rechunk(spark, source, target, {"basin": 2, "date": 4})
    assert plainly(stored(spark, target)) == plainly(df)
    assert {str(p.relative_to(tmp_path / "b.zarr/flow/c")) for p in (tmp_path / "b.zarr/flow/c").rglob("*") if p.is_file()} == {"0/0/0", "0/1/0", "1/0/0", "1/1/0"}
    with pytest.raises(ValueError, match="rechunk"):
        save(cells(spark, ["d"], days=7), target, DIMS, mode="append")
    rechunk(spark, target, source, {"basin": 1, "date": 7})
    save(cells(spark, ["d"], days=7), source, DIMS, mode="append")
    assert plainly(stored(spark, source)) == plainly(df.unionByName(cells(spark, ["d"], days=7)))


def test_empty_results(spark, tmp_path):
    path = f"file://{tmp_path}/none.zarr"
    save(cells(spark, ["a"]).where("false"), path, DIMS)
    assert stored(spark, path).collect() == [] and stored(spark, path).columns == [*DIMS, "flow"]


def test_results_with_frequencies(spark, tmp_path):
    rows = [("a", "1D", date(2020, 1, 1), 0, 1.0, 2.0), ("a", "1h", date(2020, 1, 1), 0, 3.0, 4.0), ("b", "1D", date(2020, 1, 2), 0, 5.0, None)]
    df = spark.createDataFrame(rows, "basin string, freq string, date date, time_step int, flow_obs float, flow_sim float")
    run = f"file://{tmp_path}/run"
    tables.write_results(df.where("basin = 'a'").unionByName(df.where("basin = 'b'").withColumn("basin", F.lit("c"))), f"{run}/test/model_epoch001/results.zarr", "zarr")
    tables.write_results(df.where("basin = 'b'"), f"{run}/test/model_epoch001/results.zarr", "zarr", append=True)
    got = tables.read_results(spark, run).where("flow_obs IS NOT NULL")
    assert sorted(tuple(r) for r in got.select("basin", "freq", "flow_obs").collect()) == [("a", "1D", 1.0), ("a", "1h", 3.0), ("b", "1D", 5.0), ("c", "1D", 5.0)]


# --- command line over results --------------------------------------------------------------------------------------


def test_evaluate_stored_results(spark, tmp_path):
    from freshet import cli

    rows = [(b, date(2020, 1, 1 + d), s, None if b == "c" else float(d * (s + 1)), float(d) + 0.5 * s - 1.0) for b in "abc" for d in range(9) for s in range(2)]
    df = spark.createDataFrame(rows, "basin string, date date, time_step int, flow_obs float, flow_sim float")
    run = f"file://{tmp_path}/run"
    tables.write_results(df.where("basin <> 'b'").withColumn("flow_sim", F.lit(0.0).cast("float")), f"{run}/test/model_epoch001/results.zarr", "zarr")
    tables.write_results(df.where("basin <> 'b'"), f"{run}/test/model_epoch002/results.zarr", "zarr")
    tables.write_results(df.where("basin = 'b'"), f"{run}/test/model_epoch002/results.zarr", "zarr", append=True)
    for _ in range(2):
        found = cli.evaluate(spark, run, f"file://{tmp_path}/out", ["NSE", "RMSE"], target="flow", clipped=True)
    clipped = evaluation.clip(df.selectExpr("basin", "date", "time_step AS lead_time", "flow_obs AS obs", "flow_sim AS sim"), ["sim"])
    want = {(r.basin, r.lead_time): (r.NSE, r.RMSE) for r in evaluation.skill(clipped, ["basin", "lead_time"], ["NSE", "RMSE"]).collect()}
    got = {(r.basin, r.lead_time): (r.NSE, r.RMSE) for r in found["metrics"].collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k, values in want.items():
        assert got[k] == (values if None in values else pytest.approx(values, rel=1e-6))
    assert {(r.lead_time, r.NSE) for r in found["summary"].where("statistic = 'basins'").collect()} == {(0, 2.0), (1, 2.0)}
    assert {(r.basin, r.lead_time) for r in found["undefined"].collect()} == {("c", 0), ("c", 1)}
