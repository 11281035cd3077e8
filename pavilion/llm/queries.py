"""Queries of the operators in this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pavilion.llm import chat_tools, decontam, html_extract, near_dedup, packing, sharding, substring_dedup, token_counts, topk_search, toxicity
from pavilion.llm.sql import ORACLES


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tag_path_ratios": lambda s, d: html_extract.extracted(_table(s, d, "pages")),
        "op2_separator_scan": _documents(token_counts.digest),
        "op3_histogram_sort": _documents(sharding.assigned),
        "op4_classifier_chain": lambda s, d: toxicity.digest(_table(s, d, "documents"), _table(s, d, "labels")),
        "op5_tool_call_linking": lambda s, d: chat_tools.digest(_table(s, d, "conversations")),
        "op6_fast_similarity_sketch": _documents(near_dedup.digest),
        "op7_fixed_block_anchors": _documents(substring_dedup.digest),
        "op8_maxscore_top_k": lambda s, d: topk_search.digest(_table(s, d, "embeddings")),
        "op9_ngram_decontamination": lambda s, d: decontam.digest(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op10_ffd_packing": _documents(packing.packed),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
