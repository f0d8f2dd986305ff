"""Registered queries: one per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its row count can be checked."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def prepare(spark: SparkSession) -> None:
    """Session settings the plans rely on: one time zone; joins that accept a partitioning on a
    subset of their keys, so that work on one capture shares a single exchange; and no fused stage
    whose method is longer than the JVM compiles, for it would be interpreted row by row."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def load() -> None:
    """Import the modules that register queries."""
    from . import (  # noqa: F401
        catalog_changes, catalog_forms, catalog_layers, catalog_logs, catalog_pages, catalog_query,
        catalog_text,
    )
    from . import catalog_markup  # noqa: F401  (after those whose SQL it builds on)
