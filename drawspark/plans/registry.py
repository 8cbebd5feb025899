"""All queries of the engine with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analysis, lottery  # noqa: F401  (analysis adds its queries to the list)


def queries() -> dict:
    return {q.name: q.run for q in lottery.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in lottery.QUERIES if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["evaluation_summary"](spark, sf_dir)
