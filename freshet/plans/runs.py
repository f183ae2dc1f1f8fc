"""Many runs of one driver: jobs of a session side by side, each in a scheduler pool of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import Any

from pyspark.sql import SparkSession


def schedule(spark: SparkSession, jobs: Iterable[tuple[str, Callable[[SparkSession], Any]]], at_once: int = 4) -> dict[str, Any]:
    """Runs named functions of the session, ``at_once`` at a time; a finished one makes room for the next.  A failure is its job's result, not the others'."""

    def one(name: str, job: Callable[[SparkSession], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        spark.sparkContext.setJobDescription(name)
        return job(spark)

    out: dict[str, Any] = {}
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        running = {pool.submit(one, n, j): n for n, j in jobs}
        for done in as_completed(running):
            out[running[done]] = done.exception() or done.result()
    return out
