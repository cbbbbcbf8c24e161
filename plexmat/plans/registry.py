"""Registry of the queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plexmat.plans import basket, certificates, fitted, points

PLANS = [basket, points, fitted, certificates]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region-by-region cosine similarity of the basket matrices."""
    return queries()["sim1_cosine"](spark, sf_dir)
