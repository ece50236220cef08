"""All queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import manifests, measures  # noqa: F401  they register their queries
from tessera.plans import curation, drawn, numbers, probing, remembered, streams  # noqa: F401  build on theirs
from tessera.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner event of each chunk: a range join of chunks and events."""
    return QUERIES["JN13_interval_owner"](spark, sf_dir)
