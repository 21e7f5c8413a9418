"""All registered queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.plans import empirical_queries, evidence_queries, mapping_queries, ranking_queries, retrieval_queries, stream_queries, text_queries

MODULES = [text_queries, empirical_queries, ranking_queries, retrieval_queries, evidence_queries, mapping_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target files of every source change, ranked, fused over methods and held against the judgements."""
    return ranking_queries.hit_table(spark, sf_dir)
