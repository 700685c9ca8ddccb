"""Git history: file statistics, hotspots, owners, recent changes and diff overlays."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.paths import owner_key, owner_keys, owner_regex
from lodestrata.functions.scores import hotspot_score


def file_stats(commits: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """For each path: commits in the window and in all, first and last edit, last author."""
    inside = F.col("ts") >= F.lit(as_of - timedelta(days=days))
    return commits.groupBy("path").agg(
        F.count_if(inside).alias("commits_in_window"),
        F.count("*").alias("total_commits"),
        F.max("ts").alias("last_edited"),
        F.min("ts").alias("first_edited"),
        F.max_by("author", F.struct("ts", "commit")).alias("last_author"),
    )


def top_authors(commits: DataFrame, as_of: datetime, days: int = 90, k: int = 3) -> DataFrame:
    """(path, top_authors): the k most frequent of the window, or of all time for paths without commits in it."""
    inside = (F.col("ts") >= F.lit(as_of - timedelta(days=days))).cast("int")
    n = commits.groupBy("path", "author").agg(F.sum(inside).alias("recent"), F.count("*").alias("ever"))
    any_recent = F.max("recent").over(W.partitionBy("path")) > 0
    counted = n.withColumn("commits", F.when(any_recent, F.col("recent")).otherwise(F.col("ever"))).where("commits > 0")
    best = counted.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("commits"), "author"))).where(F.col("r") <= k)
    return best.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "author", "commits"))), lambda x: F.struct(x["author"].alias("name"), x["commits"].alias("commits"))).alias("top_authors"))


def hotspots(stats: DataFrame, metrics: DataFrame, limit: int | None = 40) -> DataFrame:
    """Churn by complexity; files without metrics count as complexity 0 (1 in the score)."""
    joined = stats.join(metrics.select("path", "total_cyclomatic", "function_count"), "path", "left")
    out = joined.select(
        "path", F.col("commits_in_window").alias("churn"), "total_commits", F.coalesce("total_cyclomatic", F.lit(0)).alias("complexity"),
        F.coalesce("function_count", F.lit(0)).alias("function_count"), "last_edited", "last_author",
    ).withColumn("score", hotspot_score(F.col("churn"), F.col("complexity")))
    return out if limit is None else out.orderBy(F.desc("score"), F.desc("churn"), "path").limit(limit)


def owners_of(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owners) of the last rule that matches. Rules are joined by a key that each path they match has (a folder, a part,
    an ending), so a path meets few of them, and the plan is the same for any number."""
    rows = [(r.ordinal, owner_key(r.pattern), owner_regex(r.pattern), r.owners) for r in rules.collect()]  # the lines of a file
    keyed = rules.sparkSession.createDataFrame(rows, "ordinal int, key string, pattern string, owners array<string>")
    each = paths.select("path").distinct().withColumn("p", F.regexp_replace("path", r"^(?:\./)+", "")).select("path", "p", F.explode(owner_keys(F.col("p"))).alias("key"))
    hit = each.join(F.broadcast(keyed), "key").where(F.expr("p RLIKE pattern")).groupBy("path").agg(F.max_by("owners", "ordinal").alias("owners"))
    # A row for each path: it is never sent whole to the driver, as it would be for a broadcast if it looks small.
    return paths.select("path").join(hit.hint("merge"), "path", "left").select("path", F.coalesce("owners", F.expr("CAST(array() AS array<string>)")).alias("owners"))


def recent_changes(stats: DataFrame, hot: DataFrame, tested: DataFrame, prefix: str | None = None, limit: int = 50) -> DataFrame:
    """Files with commits in the window, flagged as hotspots and as tested."""
    out = stats.where("commits_in_window > 0")
    out = out.where(F.col("path").startswith(prefix)) if prefix else out
    flagged = out.join(hot.select("path", F.lit(True).alias("is_hotspot")).distinct(), "path", "left").join(tested.select(F.col("source").alias("path"), F.lit(True).alias("has_tests")).distinct(), "path", "left")
    return flagged.fillna(False, ["is_hotspot", "has_tests"]).orderBy(F.desc("commits_in_window"), "path").limit(limit)


def overlay(changed: DataFrame, hot: DataFrame, gaps: DataFrame, surface: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Of changed files: the hotspots, test gaps and public items among them, and their owners."""
    paths = changed.select("path").distinct()
    out = {
        "hotspots": hot.join(paths, "path", "left_semi"),
        "gaps": gaps.join(paths.withColumnRenamed("path", "source"), "source", "left_semi"),
        "surface": surface.join(paths.withColumnRenamed("path", "file"), "file", "left_semi"),
    }
    if rules is not None:
        out["owners"] = owners_of(paths, rules).select(F.explode("owners").alias("owner")).distinct().orderBy("owner")
    return out


def explain(changed: DataFrame, hot: DataFrame, gaps: DataFrame, limit: int = 10) -> DataFrame:
    """Changed files, hotspots first, then those without tests."""
    flagged = changed.join(hot.select("path", F.lit(True).alias("is_hotspot")).distinct(), "path", "left").join(gaps.select(F.col("source").alias("path"), F.lit(True).alias("is_gap")).distinct(), "path", "left")
    flagged = flagged.fillna(False, ["is_hotspot", "is_gap"])
    return flagged.orderBy(F.desc("is_hotspot"), F.desc("is_gap"), F.desc(F.col("additions") + F.col("deletions")), "path").limit(limit)
