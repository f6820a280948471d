"""Every query of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmere.plans import engine_queries, registry, retrieval, search_queries, store_queries, text_queries  # noqa: F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for several questions at once: search, fuse, expand, re-rank, score, filter."""
    best = retrieval.passing(search_queries.pool(spark, sf_dir))
    return best.select("question_id", "position", "id", "type", "name", "role", "vector_score", "rerank_score", "final_score", "source_sub_queries", "provenance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
