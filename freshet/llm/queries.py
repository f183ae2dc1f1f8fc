"""Queries of the training-data operators: each applies its operator to its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.castore import op3_token_store
from freshet.llm.forest import op12_lsh_forest
from freshet.llm.lines import op4_line_dedup
from freshet.llm.mincut import op9_html_mincut
from freshet.llm.packing import op5_packing
from freshet.llm.pieces import op6_sentencepiece
from freshet.llm.quality import ORACLE_OP10, op10_quality_rules
from freshet.llm.runs import op11_periodic_runs
from freshet.llm.simhash import op7_simhash
from freshet.llm.suffix import op8_suffix_array
from freshet.llm.topk import ORACLE_OP1, op1_topk_search
from freshet.llm.warc import ORACLE_OP2, op2_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": lambda spark, d: op1_topk_search(spark, _table(spark, d, "embeddings")),
        "op2_warc": lambda spark, d: op2_warc(spark, _table(spark, d, "pages")),
        "op3_token_store": lambda spark, d: op3_token_store(spark, _table(spark, d, "documents")),
        "op4_line_dedup": lambda spark, d: op4_line_dedup(spark, _table(spark, d, "documents")),
        "op5_packing": lambda spark, d: op5_packing(spark, _table(spark, d, "documents")),
        "op6_sentencepiece": lambda spark, d: op6_sentencepiece(_table(spark, d, "documents")),
        "op7_simhash": lambda spark, d: op7_simhash(spark, _table(spark, d, "documents")),
        "op8_suffix_array": lambda spark, d: op8_suffix_array(spark, _table(spark, d, "documents")),
        "op9_html_mincut": lambda spark, d: op9_html_mincut(_table(spark, d, "pages")),
        "op10_quality_rules": lambda spark, d: op10_quality_rules(_table(spark, d, "documents")),
        "op11_periodic_runs": lambda spark, d: op11_periodic_runs(_table(spark, d, "documents")),
        "op12_lsh_forest": lambda spark, d: op12_lsh_forest(spark, _table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": ORACLE_OP1, "op2_warc": ORACLE_OP2, "op10_quality_rules": ORACLE_OP10}
