"""Corpus pipeline: quality rules, line deduplication, near-duplicate removal, suffix-array deduplication, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; it is written
as Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Defined results, of every stage: null and blank texts fail the quality rules, so later stages of :func:`run` see none; called alone, they keep such
rows and pack them as their end id.  Repeated rows and ids are documents of their own; near duplicates of one another are judged by text,
the smallest id stays (null first).  Other columns, whatever their names, pass through all stages but the last.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.lines import drop_recurring
from freshet.llm.packing import pack
from freshet.llm.quality import RULES, compile_rules, judge, rows_where, spare
from freshet.llm.simhash import drop_near_duplicates
from freshet.llm.suffix import drop_repeats

PIPELINE = "pipeline"


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage: the stages before it are written when it starts, so their work files can go."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, PIPELINE)
        with common.owned(PIPELINE):
            return work(spark, docs, sf_dir)

    return run


#: The rules of op10 that all texts are judged by.
PIPELINE_RULES = tuple(r for r in RULES if r[0] != "some stop words")
#: The rule that only texts in a language with stop words are judged by, and these languages.
STOP_RULE = tuple(r for r in RULES if r[0] == "some stop words")
STOP_LANGUAGES = ("en", "fr", "es", "de")


def _stops_judged(docs: DataFrame) -> Column:
    """The text's language is one with stop words, or not given."""
    if "lang" not in docs.columns:
        return F.lit(True)
    lang = F.lower(F.substring_index(F.regexp_replace(F.btrim(F.coalesce(docs["lang"], F.lit(""))), "_", "-"), "-", 1))
    return lang.isin("", *STOP_LANGUAGES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    into = spare(docs, "quality")
    stops = ~_stops_judged(docs) | compile_rules(STOP_RULE, into)
    return rows_where(judge(docs, into=into, rules=PIPELINE_RULES), F.col(f"{into}.kept") & stops, docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; those left without a word go."""
    return drop_recurring(spark, docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(spark, docs)


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that an earlier one has."""
    return drop_repeats(spark, docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("suffix dedup", suffix_dedup),
    ("packing", packing),
]

#: Templates, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{common.shared_root(spark)}/freshet-pipeline-{common.unique_name('')}"
    for i, (_, stage) in enumerate(STAGES):
        docs = common.stage(spark, stage(spark, docs, sf_dir), f"{root}/{i}")
        if i:
            common.delete(spark, f"{root}/{i - 1}")
    common.delete_at_exit(spark, root)
    return docs
