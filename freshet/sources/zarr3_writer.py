"""Writing Zarr version 3 stores with Spark: new stores, basins appended to one that is there, and stores in another grid of chunks.

:func:`save` numbers each row's chunk, deals rows by it and writes with ``format("zarr3")``; every task builds the chunks of its rows, one at a time, so memory
holds one chunk of each variable.  A chunk is written beside its place and then moved there, so an attempt that is lost or repeated leaves no half chunk.

A new store is built in a folder of its own and takes the old one's place when all tasks are done: until then, and if the job fails, the old store is what it was.
Appended basins get the numbers behind those that are there; chunks beyond an array's shape belong to no one until the commit writes the new shapes, coordinates first,
so a reader sees the store without them or, once its variable's shape has grown, with them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from freshet.sources.zarr3 import Array, _arrays, _coordinate, _fs

PLACE = "__place"
#: Widths of stored names are multiples of this, so that names of later basins mostly fit.
WIDTH = 32


class BasinsThere(ValueError):
    """Basins to append are in the store already."""


def _meta(shape: Sequence[int], chunks: Sequence[int], kind, dims: Sequence[str], fill, **attributes) -> bytes:
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill,
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}], "dimension_names": list(dims), "attributes": attributes,
    }
    return json.dumps(meta).encode()


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write one object under a name of its own and move it to its place."""
    parent, _, name = path.rpartition("/")
    fs.create_dir(parent, recursive=True)
    own = f"{parent}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(data)
    fs.move(own, path)


def _put_coordinate(fs: pafs.FileSystem, root: str, name: str, values: list, width: int = 0) -> None:
    """A coordinate array of strings, dates or whole numbers, in one chunk: first the chunk, then the shape that goes with it."""
    import zstandard

    attributes: dict = {}
    if values and isinstance(values[0], str):
        longest = max(width, *map(len, values))
        data = np.array(values, f"<U{-(-longest // WIDTH) * WIDTH}")
        kind, fill = {"name": "fixed_length_utf32", "configuration": {"length_bytes": data.dtype.itemsize}}, ""
    else:
        if values and isinstance(values[0], date):
            attributes = {"units": f"days since {values[0].isoformat()}"}
            values = [(v - values[0]).days for v in values]
        data, kind, fill = np.array(values, "<i8"), "int64", 0
    _put(fs, f"{root}/{name}/c/0", zstandard.compress(np.ascontiguousarray(data).tobytes()))
    _put(fs, f"{root}/{name}/zarr.json", _meta(data.shape, data.shape, kind, [name], fill, **attributes))


@dataclass
class Grid:
    """Where a job's cells go: the store, its dimensions with all coordinates, the chunk shape, and where the first dimension's new values begin."""

    path: str
    variables: list[str]
    coordinates: dict[str, list]
    chunks: list[int]
    first: int = 0
    replaces: str | None = None

    @property
    def dims(self) -> list[str]:
        return list(self.coordinates)

    @property
    def shape(self) -> list[int]:
        return [len(c) for c in self.coordinates.values()]

    def grid(self) -> list[int]:
        return [-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True)]

    def store(self, uri: str) -> None:
        plain = {d: [v.isoformat() if isinstance(v, date) else v for v in c] for d, c in self.coordinates.items()}
        dated = [d for d, c in self.coordinates.items() if c and isinstance(c[0], date)]
        fs, at = _fs(uri)
        _put(fs, at, json.dumps(vars(self) | {"coordinates": plain, "dated": dated}).encode())

    @classmethod
    def load(cls, uri: str) -> Grid:
        fs, at = _fs(uri)
        with fs.open_input_stream(at) as f:
            x = json.loads(f.read())
        for d in x.pop("dated"):
            x["coordinates"][d] = [date.fromisoformat(v) for v in x["coordinates"][d]]
        return cls(**x)

    def positions(self, table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
        """Each row's place along each dimension."""
        where = [{v: i for i, v in enumerate(c)} for c in self.coordinates.values()]
        return [np.array([w[v] for v in table.column(d).to_pylist()], np.int64) for d, w in zip(self.dims, where, strict=True)]


class Zarr3Writer(DataSourceArrowWriter):
    """Chunks of the rows each task has, which come ordered by chunk (column :data:`PLACE`)."""

    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import zstandard

        grid = Grid.load(self.uri)
        fs, root = _fs(grid.path)
        where = [{v: i for i, v in enumerate(c)} for c in grid.coordinates.values()]
        place, held = None, {}

        def flush() -> None:
            if place is None:
                return
            key = "/".join(map(str, np.unravel_index(place, grid.grid())))
            for v, cells in held.items():
                _put(fs, f"{root}/{v}/c/{key}", zstandard.compress(cells.tobytes()))

        for batch in iterator:
            places = batch.column(batch.schema.get_field_index(PLACE)).to_numpy()
            edges = np.flatnonzero(np.diff(places)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(places)], strict=True):
                if start == end:
                    continue
                if places[start] != place:
                    flush()
                    place = int(places[start])
                    held = {v: np.full(grid.chunks, np.nan, "<f4") for v in grid.variables}
                part = batch.slice(start, end - start)
                at = tuple(np.array([w[x] for x in part.column(d).to_pylist()], np.int64) % c for d, w, c in zip(grid.dims, where, grid.chunks, strict=True))
                for v, cells in held.items():
                    cells[at] = part.column(v).cast(pa.float32()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        flush()
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        grid = Grid.load(self.uri)
        fs, root = _fs(grid.path)
        if grid.replaces is None:
            _grow(fs, root, grid)
        else:
            _publish(fs, root, grid)
        fs.delete_file(_fs(self.uri)[1])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing that a reader sees has changed; what was written goes."""
        grid = Grid.load(self.uri)
        fs, root = _fs(grid.path)
        if grid.replaces is not None:
            fs.delete_dir(root)
        else:
            for v in grid.variables:
                for i in range(grid.first // grid.chunks[0], grid.grid()[0]):
                    if fs.get_file_info(f"{root}/{v}/c/{i}").type == pafs.FileType.Directory:
                        fs.delete_dir(f"{root}/{v}/c/{i}")
        fs.delete_file(_fs(self.uri)[1])


def _describe(fs: pafs.FileSystem, root: str, grid: Grid) -> None:
    _put(fs, f"{root}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}).encode())
    for d, values in grid.coordinates.items():
        _put_coordinate(fs, root, d, values)
    for v in grid.variables:
        _put(fs, f"{root}/{v}/zarr.json", _meta(grid.shape, grid.chunks, "float32", grid.dims, "NaN"))


def _publish(fs: pafs.FileSystem, root: str, grid: Grid) -> None:
    """The new store takes the place of the old one, which goes only then."""
    _describe(fs, root, grid)
    _, final = _fs(grid.replaces)
    old = f"{final}-old-{uuid.uuid4().hex}"
    there = fs.get_file_info(final).type == pafs.FileType.Directory
    if there:
        fs.move(final, old)
    fs.move(root, final)
    if there:
        fs.delete_dir(old)


def _grow(fs: pafs.FileSystem, root: str, grid: Grid) -> None:
    """Appended basins come to be seen: their names, then each variable's shape."""
    name = grid.dims[0]
    before = Array(fs, f"{root}/{name}")
    _put_coordinate(fs, root, name, grid.coordinates[name], before.dtype.itemsize // 4 if before.dtype.kind == "U" else 0)
    for v in grid.variables:
        with fs.open_input_stream(f"{root}/{v}/zarr.json") as f:
            meta = json.loads(f.read())
        meta["shape"] = grid.shape
        _put(fs, f"{root}/{v}/zarr.json", json.dumps(meta).encode())


def coordinates(df: DataFrame, dims: Sequence[str]) -> dict[str, list]:
    """The sorted values of each dimension, in one job: as many as basins, dates or steps there are."""
    r = df.agg(*[F.array_sort(F.collect_set(d)).alias(d) for d in dims]).first()
    return {d: r[d] for d in dims}


def _placed(df: DataFrame, uri: str, variables: Sequence[str], grid: Grid) -> DataFrame:
    """Rows with the number of their chunk, dealt and ordered by it."""
    schema = T.StructType([*df.select(*grid.dims, *variables).schema.fields, T.StructField(PLACE, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grid.load(uri)
        for batch in batches:
            at = [p // c for p, c in zip(g.positions(batch), g.chunks, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ravel_multi_index(at, g.grid()), pa.int64())], [*batch.schema.names, PLACE])

    rows = df.select(*grid.dims, *variables).where(" AND ".join(f"`{d}` IS NOT NULL" for d in grid.dims))
    return rows.mapInArrow(run, schema).repartition(PLACE).sortWithinPartitions(PLACE)


def save(
    df: DataFrame, path: str, dims: Sequence[str], variables: Sequence[str] | None = None, mode: str = "overwrite", chunks: Mapping[str, int] | None = None, known: Mapping[str, list] | None = None
) -> None:
    """``df`` (a row a cell: the columns ``dims``, then ``variables``) as float32 arrays of a Zarr store; cells without a row, and NULLs, are NaN.

    ``chunks`` gives cells a chunk along dimensions; else a chunk is one value of the first dimension with all of the others.  ``mode`` "append" adds the values of the first
    dimension to a store that is there: they must be new, the other coordinates the store's.  ``known`` spares the search for coordinates.
    """
    from freshet.sources.zarr3 import register

    dims = list(dims)
    variables = list(variables) if variables is not None else [c for c in df.columns if c not in dims]
    found = dict(known) if known is not None else coordinates(df, dims)
    register(df.sparkSession)
    if mode == "append":
        grid = _appended(path, dims, variables, found)
    elif mode == "overwrite":
        shape = [(chunks or {}).get(d, 1 if d == dims[0] else len(found[d])) for d in dims]
        new = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
        grid = Grid(new, variables, found, [max(1, min(c, len(found[d]) or 1)) for c, d in zip(shape, dims, strict=True)], 0, path.rstrip("/"))
        fs, root = _fs(new)
        fs.create_dir(root, recursive=True)
    else:
        raise ValueError(f"mode {mode!r}: overwrite or append")
    uri = f"{path.rstrip('/')}-grid-{uuid.uuid4().hex}.json"
    grid.store(uri)
    _placed(df, uri, variables, grid).write.format("zarr3").mode("append").option("grid", uri).save(path)


def _appended(path: str, dims: list[str], variables: list[str], found: Mapping[str, list]) -> Grid:
    there = _arrays(path)
    first = there[variables[0]]
    if [list(there[v].dims) for v in variables] != [dims] * len(variables):
        raise ValueError(f"the store's variables have dimensions {first.dims}, not {dims}")
    old = {d: _coordinate(there[d]) for d in dims}
    n = first.shape[0]
    old[dims[0]] = old[dims[0]][:n]
    if again := sorted(set(found[dims[0]]) & set(old[dims[0]])):
        raise BasinsThere(f"in the store already: {again[:10]}")
    for d in dims[1:]:
        if extra := set(found[d]) - set(old[d]):
            raise ValueError(f"{len(extra)} values of {d} are not in the store")
    if n % first.chunks[0]:
        raise ValueError("the last chunk along the first dimension is not full; rechunk the store before appending to it")
    return Grid(path.rstrip("/"), variables, old | {dims[0]: old[dims[0]] + list(found[dims[0]])}, list(first.chunks), n)


def rechunk(spark, source: str, target: str, chunks: Mapping[str, int], variables: Sequence[str] | None = None) -> None:
    """A store again, in chunks of other shapes: each source chunk is read once, its cells are dealt to the chunks they belong to."""
    from freshet.sources.zarr3 import register

    register(spark)
    reader = spark.read.format("zarr3")
    df = (reader.option("variables", ",".join(variables)) if variables else reader).load(source)
    arrays = _arrays(source)
    dims = [c for c in df.columns if c in arrays and arrays[c].dims == (c,)]
    save(df, target, dims, [c for c in df.columns if c not in dims], "overwrite", chunks, {d: _coordinate(arrays[d]) for d in dims})
