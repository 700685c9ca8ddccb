"""Which files tests cover, by imports and by tests inside the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import is_test_file


def mappings(edges: DataFrame, inline: DataFrame | None = None) -> DataFrame:
    """(source, tests): tests that import a file, sorted; a file with tests inside counts as its own."""
    pairs = edges.where(is_test_file(F.col("from")) & ~is_test_file(F.col("to"))).select(F.col("to").alias("source"), F.col("from").alias("test"))
    if inline is not None:
        pairs = pairs.unionByName(inline.select(F.col("path").alias("source"), F.col("path").alias("test")))
    return pairs.groupBy("source").agg(F.array_sort(F.collect_set("test")).alias("tests"))


def gaps(files: DataFrame, covered: DataFrame, metrics: DataFrame) -> DataFrame:
    """Files that aren't tests and that none covers, with their metrics."""
    left = files.where(~is_test_file(F.col("path"))).join(covered.select(F.col("source").alias("path")), "path", "left_anti")
    return (
        left.join(metrics.select("path", "total_cyclomatic", "function_count"), "path", "left")
        .select(F.col("path").alias("source"), "language", "loc", F.coalesce("total_cyclomatic", F.lit(0)).alias("total_cyclomatic"), F.coalesce("function_count", F.lit(0)).alias("function_count"))
    )


def top_gaps(found: DataFrame, limit: int = 25) -> DataFrame:
    return found.orderBy(F.desc("total_cyclomatic"), F.desc("loc"), "source").limit(limit)


def summary(files: DataFrame, covered: DataFrame) -> DataFrame:
    test = is_test_file(F.col("path"))
    hit = files.where(~test).join(covered.select(F.col("source").alias("path")), "path", "left_semi").agg(F.count("*").alias("covered"))
    both = files.agg(F.count_if(~test).alias("source_files"), F.count_if(test).alias("test_files")).crossJoin(hit)  # one row each
    return both.select("source_files", "test_files", "covered", (F.col("source_files") - F.col("covered")).alias("gaps"), F.when(F.col("source_files") > 0, 100 * F.col("covered") / F.col("source_files")).otherwise(F.lit(0.0)).alias("coverage_pct"))
