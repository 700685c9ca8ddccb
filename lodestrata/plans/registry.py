"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans.proxies import Source, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, *needs: str, name: str | None = None):
    """Registers a function of a Source; needs: the relations that the SQL reads."""
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if oracle:
            ORACLE[key] = sql(oracle, *needs)
        return f
    return add
