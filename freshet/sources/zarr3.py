"""Zarr version 3 arrays as a Spark data source: ``spark.read.format("zarr3").load(path)``.

A store is a folder with one sub-folder an array, each with a ``zarr.json`` and chunks ``c/i/j/...``.  Arrays that share dimensions
become columns of one table with a row a cell; coordinate arrays (one dimension of their own name) give the key columns.  One partition reads
the chunks at one place of the chunk grid, so a chunk is read once.  Filters of a query on key columns (equal, in, less, greater), and a list of basins (option
``basins``, comma-separated), leave out chunks before anything is read.  Codecs: bytes, zstd, gzip, transpose and crc32c are understood (sharding is not).
:mod:`freshet.sources.zarr3_writer` makes such stores.
"""

from __future__ import annotations

import gzip
import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:  # a plain path, or a scheme with one slash as Hadoop and path objects write it
        scheme, colon, rest = path.partition(":")
        path = f"{scheme}://{rest if scheme == 'file' else rest.lstrip('/')}" if colon and "/" not in scheme else f"file://{path}"
    return pafs.FileSystem.from_uri(path)


class Array:
    """One array: its metadata and chunks."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path = fs, path
        with fs.open_input_stream(f"{path}/zarr.json") as f:
            meta = json.loads(f.read())
        self.shape = tuple(meta["shape"])
        self.chunks = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
        self.kind = meta["data_type"]
        self.codecs = meta["codecs"]
        self.fill = meta.get("fill_value")
        self.dims = tuple(meta.get("dimension_names") or ())
        self.separator = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        self.attributes = meta.get("attributes", {})

    @property
    def dtype(self) -> np.dtype:
        if isinstance(self.kind, dict):
            n = self.kind["configuration"]["length_bytes"]
            return np.dtype(f"U{n // 4}") if "utf32" in self.kind["name"] else np.dtype(f"S{n}")
        return np.dtype("bool" if self.kind == "bool" else self.kind)

    def grid(self) -> list[int]:
        return [-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True)]

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """One chunk, cut to the array's shape; an absent one is all fill values."""
        key = "c" + "".join(f"{self.separator}{i}" for i in at)
        order = list(range(len(self.shape)))
        for codec in self.codecs:
            if codec["name"] == "transpose":
                order = [order[i] for i in codec["configuration"]["order"]]
        try:
            with self.fs.open_input_stream(f"{self.path}/{key}") as f:
                data = f.read()
            values = self._decode(data).reshape([self.chunks[i] for i in order]).transpose(np.argsort(order))
        except FileNotFoundError:
            fill = np.nan if self.fill == "NaN" else self.fill
            values = np.full(self.chunks, fill if fill is not None else 0, self.dtype)
        return values[tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(at, self.chunks, self.shape, strict=True))]

    def _decode(self, data: bytes) -> np.ndarray:
        order = "<"
        size = int(np.prod(self.chunks)) * self.dtype.itemsize
        for codec in reversed(self.codecs):
            name = codec["name"]
            if name == "zstd":
                # the frame does not always state its size
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif name == "gzip":
                data = gzip.decompress(data)
            elif name == "crc32c":
                data = data[:-4]
            elif name == "bytes":
                order = ">" if codec.get("configuration", {}).get("endian") == "big" else "<"
            elif name != "transpose":
                raise NotImplementedError(f"zarr codec {name!r}")
        return np.frombuffer(data[:size], self.dtype.newbyteorder(order)).astype(self.dtype)

    def all(self) -> np.ndarray:
        out = np.empty(self.shape, self.dtype)
        for at in itertools.product(*map(range, self.grid())):
            out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, self.chunks, strict=True))] = self.chunk(at)
        return out


def _arrays(path: str) -> dict[str, Array]:
    fs, root = _fs(path)
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.type == pafs.FileType.Directory and fs.get_file_info(f"{info.path}/zarr.json").type == pafs.FileType.File:
            found[info.base_name] = Array(fs, info.path)
    return found


def _spark_type(a: Array) -> str:
    if "date" in str(a.attributes.get("units", "")) or "since" in str(a.attributes.get("units", "")):
        return "date" if a.attributes["units"].startswith("days since") else "timestamp"
    return {"f": "float" if a.dtype.itemsize <= 4 else "double", "i": "bigint", "u": "bigint", "b": "boolean"}.get(a.dtype.kind, "string")


def _coordinate(a: Array) -> list:
    values = a.all()
    units = str(a.attributes.get("units", ""))
    if "since" in units:
        step, _, origin = units.partition(" since ")
        unit = {"days": "D", "hours": "h", "minutes": "m", "seconds": "s", "nanoseconds": "ns"}[step]
        moments = np.datetime64(origin.strip().replace(" ", "T")) + values.astype(f"timedelta64[{unit}]")
        return moments.astype("datetime64[D]" if unit == "D" else "datetime64[us]").tolist()
    if values.dtype.kind == "S":
        return [v.decode("utf-8") for v in values.tolist()]
    return values.tolist()


class Part(InputPartition):
    def __init__(self, at: tuple[int, ...]):
        self.at = at


class Zarr3(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr3"

    def _layout(self) -> tuple[list[str], list[str]]:
        arrays = _arrays(self.options["path"])
        variables = [v for v in self.options.get("variables", "").split(",") if v] or sorted(n for n, a in arrays.items() if a.dims and a.dims != (n,))
        if not variables:
            raise ValueError("the store has no data variables")
        dims = arrays[variables[0]].dims
        if any(arrays[v].dims != dims or arrays[v].chunks != arrays[variables[0]].chunks for v in variables):
            raise ValueError("variables of one table must share dimensions and chunks; choose them with the option variables")
        return list(dims), variables

    def schema(self) -> str:
        arrays = _arrays(self.options["path"])
        dims, variables = self._layout()
        keys = [f"`{d}` {_spark_type(arrays[d]) if d in arrays else 'bigint'}" for d in dims]
        return ", ".join(keys + [f"`{v}` {_spark_type(arrays[v])}" for v in variables])

    def reader(self, schema: StructType) -> DataSourceReader:
        dims, variables = self._layout()
        return Zarr3Reader(self.options["path"], dims, variables, schema, [b for b in self.options.get("basins", "").split(",") if b])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        from freshet.sources.zarr3_writer import Zarr3Writer

        if overwrite or "grid" not in self.options:
            raise ValueError("stores are written by freshet.sources.zarr3_writer.save, which lays out their grid")
        return Zarr3Writer(self.options["grid"])


def _holds(f: Filter, values: Sequence) -> np.ndarray | None:
    """Which coordinate values a filter of a query lets pass; None if that is not known."""
    test = {
        EqualTo: lambda v: v == f.value, In: lambda v: v in f.value, GreaterThan: lambda v: v > f.value, GreaterThanOrEqual: lambda v: v >= f.value,
        LessThan: lambda v: v < f.value, LessThanOrEqual: lambda v: v <= f.value,
    }.get(type(f))
    try:
        return None if test is None else np.array([bool(test(v)) for v in values], bool)
    except TypeError:  # a value of another type than the coordinate's
        return None


class Zarr3Reader(DataSourceReader):
    def __init__(self, path: str, dims: list[str], variables: list[str], schema: StructType, basins: list[str]):
        self.path, self.dims, self.variables, self.schema, self.basins = path, dims, variables, schema, basins
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on key columns choose chunks; Spark evaluates all of them on the rows that are read."""
        self.filters = [f for f in filters if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.dims]
        yield from filters

    def partitions(self) -> list[Part]:
        arrays = _arrays(self.path)
        a = arrays[self.variables[0]]
        sizes = [min(n) for n in zip(*(arrays[v].shape for v in self.variables), strict=True)]  # a store may be growing
        places = []
        for name, n, c in zip(self.dims, sizes, a.chunks, strict=True):
            asked = [f for f in self.filters if f.attribute[0] == name]
            wanted = np.ones(n, bool)
            if asked or (self.basins and name == "basin"):
                values = _coordinate(arrays[name])[:n] if name in arrays else list(range(n))
                for f in asked:
                    holds = _holds(f, values)
                    wanted &= True if holds is None else holds
                if self.basins and name == "basin":
                    wanted &= np.isin(np.array(values), self.basins)
            places.append(np.unique(np.flatnonzero(wanted) // c).tolist())
        return [Part(at) for at in itertools.product(*places)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no chunk is wanted
            return
        arrays = _arrays(self.path)
        a = arrays[self.variables[0]]
        origin = [i * c for i, c in zip(partition.at, a.chunks, strict=True)]
        data = {v: arrays[v].chunk(partition.at) for v in self.variables}
        shape = data[self.variables[0]].shape
        columns = {}
        for d, (name, start, n) in enumerate(zip(self.dims, origin, shape, strict=True)):
            values = _coordinate(arrays[name])[start : start + n] if name in arrays else list(range(start, start + n))
            index = np.broadcast_to(np.arange(n).reshape([-1 if i == d else 1 for i in range(len(shape))]), shape).ravel()
            columns[name] = pa.array(values).take(pa.array(index))
        for v, x in data.items():
            flat = x.ravel()
            columns[v] = pa.array(flat, mask=np.isnan(flat)) if flat.dtype.kind == "f" else pa.array(flat.tolist())
        table = pa.table(columns).select([f.name for f in self.schema]).cast(to_arrow_schema(self.schema))
        if self.basins and "basin" in columns:
            table = table.filter(pa.compute.is_in(table.column("basin"), pa.array(self.basins)))
        yield from table.to_batches(max_chunksize=65_536)


def write(df, path: str, dims: Sequence[str], variables: Sequence[str]) -> None:
    """``df`` as a new store in place of one that is there; see :func:`freshet.sources.zarr3_writer.save`."""
    from freshet.sources.zarr3_writer import save

    save(df, path, dims, variables)


def register(spark) -> None:
    """The format "zarr3", and Spark's setting that hands a Python source the filters of a query."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Zarr3)
