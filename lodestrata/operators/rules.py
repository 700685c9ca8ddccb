"""Architecture rules: each returns violations (rule, summary, file, line, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import glob_regex
from lodestrata.operators.metrics import unused_files

FIELDS = ("rule", "summary", "file", "line", "detail")


def _layer(path: Column, layers: dict[str, list[str]]) -> Column:
    """The first layer by name that a path is in."""
    out = F.lit(None).cast("string")
    for name in sorted(layers, reverse=True):
        out = F.when(path.rlike("|".join(f"(?:{glob_regex(g)})" for g in layers[name])), name).otherwise(out)
    return out


def layer_forbid(edges: DataFrame, layers: dict[str, list[str]], forbidden: list[dict]) -> DataFrame:
    placed = edges.withColumn("a", _layer(F.col("from"), layers)).withColumn("b", _layer(F.col("to"), layers)).where("a <> b")
    detail = F.lit(None).cast("string")
    for r in reversed(forbidden):
        why = F.lit(r.get("reason") or f"layer `{r['from']}` may not depend on `{r['to']}`")
        detail = F.when((F.col("a") == r["from"]) & (F.col("b") == r["to"]), why).otherwise(detail)
    return placed.withColumn("detail", detail).where("detail IS NOT NULL").select(
        F.lit("layer_forbid").alias("rule"), F.format_string("`%s` → `%s` (%s → %s)", "from", "to", "a", "b").alias("summary"), F.col("from").alias("file"),
        F.when(F.col("line") != 0, F.col("line")).cast("int").alias("line"), "detail",
    )


def complexity_cap(functions: DataFrame, caps: list[dict]) -> DataFrame:
    def one(cap: dict) -> DataFrame:
        cc, cog = cap.get("max_cyclomatic"), cap.get("max_cognitive")
        parts = [F.when(F.col(c) > m, F.format_string(f"{short} %d > {m}", c)) for c, m, short in (("cyclomatic", cc, "cc"), ("cognitive", cog, "cog")) if m is not None]
        breach = F.concat_ws(", ", *parts) if parts else F.lit("")
        return functions.where(F.col("file").rlike(glob_regex(cap["glob"]))).withColumn("breach", breach).where("breach <> ''").select(
            F.lit("complexity_cap").alias("rule"), F.format_string("`%s::%s` — %s", "file", "name", "breach").alias("summary"), "file", F.col("start_line").cast("int").alias("line"),
            F.lit(f"under glob `{cap['glob']}`").alias("detail"),
        )
    return _union([one(c) for c in caps], functions)


def surface_forbid(surface: DataFrame, rules: list[dict]) -> DataFrame:
    def one(r: dict) -> DataFrame:
        hit = surface.where(F.col("file").rlike(glob_regex(r["glob"])) & F.col("name").rlike(r["pattern"]))
        hit = hit.where(F.regexp_replace("kind", "_", "") == r["kind"].replace("_", "").replace("-", "")) if r.get("kind") else hit
        return hit.select(
            F.lit("surface_forbid").alias("rule"), F.format_string("`%s::%s` matches forbidden pattern", "file", "name").alias("summary"), "file", F.col("line").cast("int").alias("line"),
            F.lit(f"pattern `{r['pattern']}` under glob `{r['glob']}`").alias("detail"),
        )
    return _union([one(r) for r in rules], surface)


def dead_code(nodes: DataFrame, max_files: int) -> DataFrame:
    """One row if more files are unused than the cap allows, with the first eight."""
    dead = unused_files(nodes)
    n = dead.agg(F.count("*").alias("n"))
    first = dead.orderBy("id").limit(8).agg(F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("sample"))
    return n.crossJoin(first).where(F.col("n") > max_files).select(  # one row each
        F.lit("dead_code").alias("rule"), F.format_string(f"%d dead files (cap {max_files})", "n").alias("summary"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"),
        F.concat(F.lit("sample: "), "sample").alias("detail"),
    )


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], "rule string, summary string, file string, line int, detail string")
    return reduce(DataFrame.unionByName, parts)


def evaluate(config: dict, edges: DataFrame, functions: DataFrame, nodes: DataFrame, surface: DataFrame) -> DataFrame:
    """All violations of a rules file (layers, layer_forbid, complexity_cap, surface_forbid, dead_code)."""
    parts = []
    if config.get("layer_forbid"):
        parts.append(layer_forbid(edges, config.get("layers", {}), config["layer_forbid"]))
    if config.get("complexity_cap"):
        parts.append(complexity_cap(functions, config["complexity_cap"]))
    if config.get("surface_forbid"):
        parts.append(surface_forbid(surface, config["surface_forbid"]))
    if config.get("dead_code"):
        parts.append(dead_code(nodes, config["dead_code"]["max_files"]))
    return _union(parts, nodes)


def counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("n"))
