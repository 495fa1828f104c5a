"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans import access_queries, catalog, context_queries, event_queries, graph_queries, stream_queries, text_queries  # noqa: F401  they register themselves


def queries() -> dict:
    return catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.retrieve_context(spark, sf_dir)
