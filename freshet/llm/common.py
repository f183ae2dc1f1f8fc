"""Shared plumbing of the training-data operators: the shared work folder, staged tables and block files.

Executors and driver share only the folder named in ``spark.checkpoint.dir`` (and the warehouse and
inputs).  Everything that has to outlive a task is written there under attempt-unique names and becomes
visible only through the rows that a *successful* task returns, so a lost executor or a second task
attempt never leaves a half-written file in a result.
"""

from __future__ import annotations

import atexit
import ctypes
import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of column data in one block file; one block is the unit of work of a follow-up pass.
BLOCK_BYTES = 4 << 20

_LIBC = ctypes.CDLL(None)
_TRIM, _MALLOPT = getattr(_LIBC, "malloc_trim", None), getattr(_LIBC, "mallopt", None)
#: Fixed values of the C library: the parameters for what is given back when the heap's top is free, and what gets pages of its own.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What holds while a staged table is written.  A batch of rows stands in the JVM, on its way and in Python at the same time.
_STAGING = {_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Work folder -> who asked for it (None: a caller of an operator).
_SCRATCH: dict[str, str | None] = {}
_OWNER: list[str | None] = [None]
_RESULTS: list[str] = []
_KEEP_AT_EXIT: list[SparkSession] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the folder all executors share, as the session names it; a temporary one where it is unset in local mode (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='freshet-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared root; its owner's :func:`release` or the end of the process deletes it."""
    uri = f"{shared_root(spark)}/freshet-{name}-{uuid.uuid4().hex}"
    _SCRATCH[uri] = _OWNER[-1]
    _watch_exit(spark)
    return uri


def delete_at_exit(spark: SparkSession, uri: str) -> None:
    """Delete a result's folder when the process ends, not before."""
    _RESULTS.append(uri)
    _watch_exit(spark)


def _watch_exit(spark: SparkSession) -> None:
    if not _KEEP_AT_EXIT:
        _KEEP_AT_EXIT.append(spark)
        atexit.register(_at_exit)


def delete(spark: SparkSession, uri: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _SCRATCH.pop(uri, None)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Work folders made inside belong to ``owner``, who may release them."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def release(spark: SparkSession, owner: str) -> None:
    """Delete the work folders of ``owner``, who vouches that all results built on them are written."""
    for uri in [u for u, o in _SCRATCH.items() if o == owner]:
        delete(spark, uri)


def _at_exit() -> None:
    for spark in _KEEP_AT_EXIT:
        try:
            if spark.sparkContext._jsc is not None:
                for uri in [*_SCRATCH, *_RESULTS]:
                    delete(spark, uri)
        except Exception:  # the JVM is gone already; nothing is left to delete through
            return


def stage(spark: SparkSession, df: DataFrame, uri: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: lineage ends at reliable files, and every consumer sees the same rows.

    Its shuffle files go when it is written, where Spark knows the setting: nothing reads them again.  Batches for Python are kept small.
    """
    before = {k: spark.conf.get(k, None) for k in _STAGING}
    for k, v in _STAGING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(uri)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(uri)


def fs_path(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def put(uri: str, data: bytes | pa.Buffer) -> None:
    """Write one object; its name must be attempt-unique."""
    fs, path = fs_path(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:  # names do not say how to compress
        out.write(data)


def get(uri: str) -> bytes:
    fs, path = fs_path(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def unique_name(suffix: str) -> str:
    return f"{uuid.uuid4().hex}{suffix}"


def trim() -> None:
    """Give memory that is free back to the system: workers outlive their tasks, and share an executor's memory with those that come."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: What gives back what encoders remember, for workers that go on to other work.
FORGET: list[Callable[[], None]] = []


def make_room() -> None:
    """At the start of work that encodes nothing: what encoders of earlier tasks left in this worker goes."""
    lean()
    for forget in FORGET:
        forget()


@lru_cache(maxsize=1)
def lean() -> None:
    """Large buffers of this worker go back to the system as soon as they are free, instead of staying in a pool."""
    pa.set_memory_pool(pa.system_memory_pool())
    if _MALLOPT is not None:
        _MALLOPT(_MMAP_THRESHOLD, 2 << 20)
        _MALLOPT(_TRIM_THRESHOLD, 8 << 20)


# --- blocks -------------------------------------------------------------------------------------------------------


def write_block(root: str, batches: list[pa.RecordBatch]) -> int:
    """Write record batches as one compressed Arrow file below ``root``; returns the block's number, which names the file."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    block = uuid.uuid4().int >> 65
    put(f"{root}/{block:016x}.arrow", sink.getvalue())
    return block


def read_block(root: str, block: int) -> pa.Table:
    with pa.ipc.open_stream(get(f"{root}/{block:016x}.arrow")) as r:
        return r.read_all()


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Regroup a task's record batches to lists of at most ``limit`` bytes (one row may exceed it alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * min(1.0, limit / 4 / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            n = part.nbytes
            if held and size + n > limit:
                yield held
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield held


def block_pass(
    docs: DataFrame, root: str, features: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """One pass over ``docs``: each run of about :data:`BLOCK_BYTES` is written as a block file below ``root`` and handed to ``features``.

    ``features(block, table)`` yields Arrow batches of ``schema``.  The result has side effects, so stage it
    before using it: only blocks named in staged rows exist for later passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for held in sliced(batches):
            yield from features(write_block(root, held), pa.Table.from_batches(held))
            trim()

    return docs.mapInArrow(run, schema)


def apply_blocks(decisions: DataFrame, root: str, apply: Callable[[pa.Table, pa.Table], pa.Table], schema, blocks: int) -> DataFrame:
    """Second pass: for each block (column ``block``) read its file and call ``apply(block_table, decisions_of_block)``.

    No document text is shuffled; what is shuffled is one short row per decision.  Every block needs at least one (marker) row in
    ``decisions``.  ``blocks`` is their number: tasks are made for the bytes of the blocks, about 16 of them each on large inputs,
    because adaptive execution would coalesce by the size of the short rows.
    """
    tasks = max(1, blocks // 16, min(blocks, 4 * decisions.sparkSession.sparkContext.defaultParallelism))

    def run(table: pa.Table) -> pa.Table:
        make_room()
        try:
            return apply(read_block(root, table.column("block")[0].as_py()), table)
        finally:
            trim()

    return decisions.repartition(tasks, "block").groupBy("block").applyInArrow(run, schema)


def text_column(df: DataFrame, name: str) -> F.Column:
    """The column as string, null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
