"""Imports every module that registers queries and hands out the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import coverage_queries, incremental_queries, more_queries, project_queries, registry, report_queries, search_queries, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["bm25_topk"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
