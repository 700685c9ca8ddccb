"""Queries across projects: one table for each relation, partitioned by app."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.metrics import dominant, language_summary

KEY = ("kind", "name", "method")


def find_surface(surface: DataFrame, pattern: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """Items whose name is like a pattern (a part of it, unless % stands in it), in any case."""
    out = surface.where(F.col("kind") == kind) if kind else surface
    if pattern:
        out = out.where(F.col("name").ilike(pattern if "%" in pattern else f"%{pattern}%"))
    return out.orderBy("kind", "app", "file", "line", "name").limit(limit)


def top_test_gaps(complexity: DataFrame, mapping: DataFrame, limit: int | None = 25) -> DataFrame:
    """Files that no test of their app maps to, the most complex first."""
    out = complexity.join(mapping.select("app", F.col("source").alias("file")), ["app", "file"], "left_anti")
    return out if limit is None else out.orderBy(F.desc("total_cyclomatic"), F.desc("loc"), "app", "file").limit(limit)


def top_hotspots(hotspots: DataFrame, limit: int = 25) -> DataFrame:
    return hotspots.orderBy(F.desc("score"), "app", "path").limit(limit)


def surface_diff(surface: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
    """Rows that only one of two apps has, by (kind, name, method), and the number of keys that both have."""
    key = [F.coalesce(F.col(k), F.lit("")).alias(f"_{k}") for k in KEY]
    names = [f"_{k}" for k in KEY]
    left, right = (surface.where(F.col("app") == x).select("*", *key) for x in (a, b))
    return {
        "only_a": left.join(right.select(*names).distinct(), names, "left_anti").drop(*names),
        "only_b": right.join(left.select(*names).distinct(), names, "left_anti").drop(*names),
        "common": left.select(*names).intersect(right.select(*names)).agg(F.count("*").alias("common")),
    }


def app_summary(files: DataFrame) -> DataFrame:
    """(app, files, loc, primary_language) of files with an app column."""
    size = files.groupBy("app").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return size.join(dominant(files, ["app"], "language", "loc").withColumnRenamed("language", "primary_language"), "app")


def languages(files: DataFrame) -> DataFrame:
    return language_summary(files)
