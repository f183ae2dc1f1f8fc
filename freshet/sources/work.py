"""A work folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``; in local mode below a temporary one if that is unset.  It goes when the process ends, unless it is to ``keep``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="freshet-")
    uri = f"{root if '://' in root else 'file://' + root.removeprefix('file:')}".rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
    if keep:
        return uri
    if not _MADE:
        atexit.register(_clear)
    _MADE.append((spark, uri))
    return uri


def _clear() -> None:
    for spark, uri in _MADE:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM is gone already; nothing is left to delete through
            return
