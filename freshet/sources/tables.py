"""Text sources and sinks: attribute files, time series, forecasts, basin lists, results, metrics.

Every reader takes an explicit feature list and builds the schema from it; nothing is inferred.  Basin ids are
``<subdataset>_<gauge>`` and name files and folders, so only the folders of the wanted subdatasets are listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.align import melt_leads, merge_no_conflict, require_basins, select_basins
from freshet.schema import BASIN, DATE, LEAD, nan_to_null
from freshet.sources import zarr3
from freshet.sources.zarr3_writer import save


def subdatasets(basins: Iterable[str]) -> list[str]:
    return sorted({b.partition("_")[0] for b in basins})


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob, through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath()) for s in found or [])


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: its first line, read through Spark's own file systems without a job."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at), "UTF-8"))
    try:
        return [c.strip().strip('"') for c in (reader.readLine() or "").lstrip("\ufeff").split(",")]
    finally:
        reader.close()


def _by_header(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files of equal columns together, so that each kind is one scan."""
    with ThreadPoolExecutor(16) as pool:
        headers = pool.map(lambda p: tuple(_header(spark, p)), paths)
        found: dict[tuple[str, ...], list[str]] = {}
        for path, header in zip(paths, headers, strict=True):
            found.setdefault(header, []).append(path)
    return found


def read_attributes(spark: SparkSession, root: str, basins: Sequence[str], features: Sequence[str], subdataset: str | None = None) -> DataFrame:
    """Static attributes ``root/attributes/<sub>/*.csv`` of the basins: files of a subdataset are merged on the gauge id, which must not conflict.

    An error names basins without attributes, features that no file has, and subdatasets without a folder.
    """
    basins = list(basins)
    wanted = subdatasets(basins)
    if subdataset is not None:
        wanted = [s for s in wanted if s == subdataset]
    parts = []
    for sub in wanted:
        files = _files(spark, f"{root}/attributes/{sub}/*.csv")
        if not files:
            raise FileNotFoundError(f"no attributes of subdataset {sub!r} below {root}")
        table = None
        for f in files:
            header = _header(spark, next(iter(_files(spark, f"{f}/part-*")), f))  # a file, or a folder of parts
            keep = [c for c in header if c in features]
            if not keep:
                continue
            schema = T.StructType([T.StructField(c, T.FloatType() if c in keep else T.StringType()) for c in header])
            one = nan_to_null(spark.read.csv(f, schema=schema, header=True, mode="FAILFAST").select(F.col("gauge_id").alias(BASIN), *keep))
            table = one if table is None else merge_no_conflict(table, one)
        if table is not None:
            absent = [f for f in features if f not in table.columns]
            parts.append(table.select(BASIN, *[F.col(f) if f not in absent else F.lit(None).cast("float").alias(f) for f in features]))
            if len(absent) == len(features):
                raise KeyError(f"attributes not found: {absent}")
    if not parts:
        raise KeyError(f"attributes not found: {list(features)}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    asked = spark.createDataFrame([(b,) for b in basins], f"{BASIN} string")
    require_basins(asked, out)
    return select_basins(out, asked)


def _basin_of_file(pattern: str) -> F.Column:
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def read_timeseries(spark: SparkSession, root: str, basins: Sequence[str], features: Sequence[str], kind: str = "csv") -> DataFrame:
    """Daily series ``root/timeseries/csv/<sub>/<basin>.csv`` (a date and a column a feature)."""
    if kind == "netcdf":
        return read_netcdf(spark, root, basins, features)
    paths = [f"{root}/timeseries/{kind}/{b.partition('_')[0]}/{b}.csv" for b in basins]
    return _read_series(spark, paths, features, r"([^/]+)\.csv$")


def read_netcdf(spark: SparkSession, root: str, basins: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Daily series ``root/timeseries/netcdf/<sub>/<basin>.nc``; needs the netCDF4 package on the executors and files they can open.

    One task opens a group of files; only the wanted variables are read.
    """
    import importlib.util

    if importlib.util.find_spec("netCDF4") is None:
        raise ImportError("reading NetCDF needs the package netCDF4; the CSV and Zarr layouts do not")
    names = list(features)

    def run(batches):
        import netCDF4
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for basin, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with netCDF4.Dataset(path) as d:
                    days = netCDF4.num2date(d["date"][:], d["date"].units, only_use_cftime_datetimes=False, only_use_python_datetimes=True)
                    cols = [np.ma.filled(d[f][:].astype("float32"), np.nan) for f in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([basin] * len(days)), pa.array([x.date() for x in days]), *(pa.array(c, mask=np.isnan(c)) for c in cols)], names=[BASIN, DATE, *names]
                )

    files = spark.createDataFrame([(b, f"{root}/timeseries/netcdf/{b.partition('_')[0]}/{b}.nc") for b in basins], "basin string, path string")
    schema = T.StructType([T.StructField(BASIN, T.StringType()), T.StructField(DATE, T.DateType()), *(T.StructField(f, T.FloatType()) for f in names)])
    return files.repartition(max(1, len(basins) // 16)).mapInArrow(run, schema)


def _read_series(spark: SparkSession, paths: Sequence[str], features: Sequence[str], pattern: str) -> DataFrame:
    """Series files; columns are found by name, whatever their order in a file."""
    out = None
    for header, files in _by_header(spark, paths).items():
        gone = [f for f in features if f not in header]
        if gone:
            raise KeyError(f"features not in {files[0]}: {gone}")
        schema = T.StructType([T.StructField(c, T.DateType() if c == DATE else T.FloatType() if c in features else T.StringType()) for c in header])
        raw = spark.read.csv(files, schema=schema, header=True, enforceSchema=False)
        one = nan_to_null(raw.select(_basin_of_file(pattern).alias(BASIN), DATE, *features))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no files to read")
    return out


def read_hindcasts(spark: SparkSession, root: str, basins: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Time series with a lead time of 0 on every row."""
    return read_timeseries(spark, root, basins, features).withColumn(LEAD, F.lit(0))


def read_forecasts(spark: SparkSession, root: str, basins: Sequence[str], feature: str) -> DataFrame:
    """Forecasts of one feature: ``{feature}_{basin}.csv`` (issue date, a column a lead day), else ``{basin}.csv`` with lead time 0, else an error."""
    there = {p.rpartition("/")[2]: p for p in _files(spark, f"{root}/*.csv")}
    own = {b: there.get(f"{feature}_{b}.csv") for b in basins}
    spare = {b: there.get(f"{b}.csv") for b in basins if own[b] is None}
    gone = [b for b, p in spare.items() if p is None]
    if gone:
        raise ValueError(f"no forecasts of {feature} for {gone[:20]}")
    wide, plain = [p for p in own.values() if p], list(spare.values())
    parts = []
    for header, paths in _by_header(spark, wide).items():
        leads = [c for c in header if c != DATE]
        table = _read_series(spark, paths, leads, rf"{re.escape(feature)}_([^/]+)\.csv$")
        parts.append(melt_leads(table, feature, leads))
    if plain:
        parts.append(_read_series(spark, plain, [feature], r"([^/]+)\.csv$").withColumn(LEAD, F.lit(0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(BASIN, DATE, LEAD, feature)


def read_basins(spark: SparkSession, path: str) -> list[str]:
    """A basin list, a name a line: trimmed, blank lines dropped, sorted; names that end in a period token are refused."""
    names = sorted(r[0] for r in spark.read.text(path).select(F.trim("value")).where(F.trim("value") != "").distinct().collect())
    bad = [n for n in names if n.rsplit("_", 1)[-1].startswith("period")]
    if bad:
        raise ValueError(f"basin names with a period: {bad}")
    return names


def write_basins(df: DataFrame, path: str) -> None:
    df.select(BASIN).coalesce(1).sortWithinPartitions(BASIN).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str, kind: str = "parquet", append: bool = False) -> None:
    """Results by basin, as Parquet or (``zarr``) as one array a variable over basin, the frequency if there is one, date and time step.

    An earlier store of the same run is replaced; with ``append`` the basins, which must be new, are added to it.
    """
    if kind == "zarr":
        dims = [BASIN, *(c for c in ("freq", DATE, "time_step") if c in results.columns)]
        save(results, path, dims, [f.name for f in results.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))], "append" if append else "overwrite")
        return
    results.repartition(BASIN).write.mode("append" if append else "overwrite").partitionBy(BASIN).parquet(path)


def read_results(spark: SparkSession, run: str, period: str = "test", epoch: int | None = None) -> DataFrame:
    """Results of a run's given or newest epoch, of either kind."""
    found = {int(m[1]): p for p in _files(spark, f"{run}/{period}/model_epoch*") if (m := re.search(r"model_epoch(\d+)$", p))}
    if not found or (epoch is not None and epoch not in found):
        raise FileNotFoundError(f"no results of {period} in {run}")
    path = found[epoch if epoch is not None else max(found)]
    if _files(spark, f"{path}/results.zarr/zarr.json"):
        zarr3.register(spark)
        return spark.read.format("zarr3").load(f"{path}/results.zarr")
    return spark.read.parquet(f"{path}/results")


def _write_csv(df: DataFrame, name) -> None:
    """One CSV file for each basin, written by the task that has it; ``name(basin)`` is its path."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.csv as pc
        import pyarrow.fs as pafs

        basin = table.column(BASIN)[0].as_py()
        fs, path = pafs.FileSystem.from_uri(name(basin))
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as out:
            pc.write_csv(table.drop_columns([BASIN]).sort_by(DATE), out, pc.WriteOptions(quoting_style="none"))
        return pa.table({"rows": pa.array([table.num_rows], pa.int64())})

    df.groupBy(BASIN).applyInArrow(run, "rows long").write.format("noop").mode("overwrite").save()


def write_timeseries(series: DataFrame, root: str) -> None:
    """(basin, date, a column a feature) as ``root/timeseries/csv/<sub>/<basin>.csv``; ``root`` is a URI all executors can write to."""
    _write_csv(series, lambda b: f"{root}/timeseries/csv/{b.partition('_')[0]}/{b}.csv")


def write_forecasts(wide: DataFrame, root: str, feature: str) -> None:
    """Wide forecasts of one feature (basin, date, a column a lead day) as ``root/{feature}_{basin}.csv``."""
    _write_csv(wide, lambda b: f"{root}/{feature}_{b}.csv")


def write_attributes(statics: DataFrame, root: str, name: str = "attributes") -> None:
    """Static attributes as one CSV file for each subdataset, ``root/attributes/<sub>/<name>.csv`` (a folder, as Spark writes them)."""
    for sub in subdatasets(r[0] for r in statics.select(BASIN).distinct().collect()):
        rows = statics.where(F.col(BASIN).startswith(f"{sub}_")).withColumnRenamed(BASIN, "gauge_id").coalesce(1)
        rows.write.mode("overwrite").option("header", True).csv(f"{root}/attributes/{sub}/{name}.csv")


def write_metrics(metrics: DataFrame, path: str, append: bool = False) -> None:
    """Metrics as CSV with a header; ``append`` adds to what is there."""
    metrics.coalesce(1).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, keys: Sequence[str] = ("basin",), metrics: Sequence[str] = ()) -> DataFrame:
    first = next(p for p in _files(spark, f"{path}/*.csv") or _files(spark, path))
    header = _header(spark, first)
    schema = T.StructType([T.StructField(c, T.IntegerType() if c in (LEAD, "time_step") else T.StringType() if c in keys or c in ("basin", "basin_id") else T.DoubleType()) for c in header])
    return nan_to_null(spark.read.csv(path, schema=schema, header=True))


def latest_checkpoint(spark: SparkSession, run: str, epoch: int | None = None) -> str:
    found = _files(spark, f"{run}/model_epoch{'*' if epoch is None else f'{epoch:03d}'}.pt")
    if not found:
        raise FileNotFoundError(f"no checkpoint in {run}")
    return found[-1]
