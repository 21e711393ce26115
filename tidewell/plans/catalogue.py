"""The catalogue of registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import clinical_queries, evaluation_queries, flow_queries, model_queries, panel_queries, record_queries, statistics_queries

MODULES = (panel_queries, model_queries, evaluation_queries, clinical_queries, flow_queries, record_queries, statistics_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
