"""Job: skill by year, basin and lead time, kept up to date as result files arrive.

Reads the new Parquet files of a folder as a stream until none is left (``availableNow``), with its progress in a checkpoint; below the output folder it keeps

* ``state``: sums of pairs of each key, partitioned by ``batch``: a batch that is run again replaces itself;
* ``skill``: metrics of each key, partitioned by the year; only years that new batches touch are written again. ``through_batch`` is the newest batch a year holds;
* ``checkpoint``: what has been read.

A run without new files changes nothing.  A run that was broken off is made good by the next one: the stream repeats its last batch, and skill is compared with the state.

    python -m jobs.rolling_skill TABLES OUTPUT [--config FILE]
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from freshet.streaming.incremental import existing, into_state, refresh
from jobs.common import log, settings, start

CONFIG = Path(__file__).with_suffix(".yaml")


def run(spark: SparkSession, tables: str, output: str, settings: Mapping) -> DataFrame | None:
    """Takes in what is new and returns the table of skill (None before the first result)."""
    source, pairs, keys, part = settings["stream"], settings["pairs"], settings["keys"], settings["partition"]
    path = f"{tables}/{source['table']}.parquet"
    put = into_state(f"{output}/state", keys, log.info)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession  # the stream's own, which does not see views of others
        fixed = {t: session.read.parquet(f"{tables}/{t}.parquet") for t in pairs["tables"]}
        put(session.sql(pairs["sql"], batch=batch, **fixed), number)

    schema = spark.read.parquet(path).schema
    anywhere = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the table may be one file or a folder of them
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", source["files_per_batch"]).parquet(anywhere)
    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{output}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    log.info("read %d new rows of %s", sum(x["numInputRows"] for x in query.recentProgress), path)
    touched = refresh(spark, f"{output}/state", f"{output}/skill", keys, part, settings["metrics"])
    log.info("wrote %s/skill: %s", output, ", ".join(f"{part} {p} through batch {b}" for p, b in sorted(touched.items())) or "nothing new")
    return existing(spark, f"{output}/skill")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("tables", help="folder of the Parquet tables; the streamed one is a folder that files are added to")
    args.add_argument("output", help="folder for state, skill and checkpoint; all executors have to reach it")
    args.add_argument("--config", default=str(CONFIG))
    a = args.parse_args()
    spark = start("rolling skill")
    try:
        run(spark, a.tables, a.output, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
