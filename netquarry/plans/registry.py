"""All queries of the core with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquarry.plans import activity_queries, format_queries, geometry_queries, library_queries, problems

MODULES = (problems, activity_queries, library_queries, geometry_queries, format_queries)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_queries.QUERIES["toggle_sweep_hopping"](spark, sf_dir)
