"""Inventory, file metrics and the quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import PARSED, is_dead_code_exempt
from lodestrata.functions.scores import ramp

WEIGHTS = {"complexity": 0.40, "acyclicity": 0.30, "dead_code": 0.15, "coupling": 0.15}


def language_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("bytes").alias("bytes"))


def dominant(df: DataFrame, keys: list[str], value: str, weight=None) -> DataFrame:
    """The value with the most rows (or weight) of each key; the greatest of those that tie."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys, value).agg(n.alias("_n")).groupBy(*keys).agg(F.max(F.struct("_n", value)).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(value))


def file_metrics(functions: DataFrame) -> DataFrame:
    return functions.groupBy(F.col("file").alias("path")).agg(
        F.count("*").alias("function_count"),
        F.max("cyclomatic").alias("max_cyclomatic"),
        F.sum("cyclomatic").alias("total_cyclomatic"),
        F.max("cognitive").alias("max_cognitive"),
        F.max("loc").alias("longest_function_loc"),
        F.avg("cyclomatic").alias("avg_cyclomatic"),
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with in_degree and out_degree."""
    into = edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.drop("in_degree", "out_degree").join(into, "id", "left").join(out, "id", "left").fillna(0, ["in_degree", "out_degree"])


def complexity_axis(functions: DataFrame) -> DataFrame:
    each = F.least(ramp(F.col("cyclomatic"), 10, 30), ramp(F.col("cognitive"), 15, 50))
    return functions.agg((F.avg(each) * 100).alias("complexity"))


def acyclicity_axis(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Null without nodes of parsed languages."""
    n = nodes.agg(F.count_if(F.col("language").isin(*PARSED)).alias("n"))
    tangle = cycles.agg(F.coalesce(F.sum(F.when(F.col("size") > 1, F.log2(F.col("size") + F.lit(1.0)))), F.lit(0.0)).alias("t"))
    value = 100 * F.exp(-(F.col("t") / (F.sqrt(F.col("n").cast("double")) + 1)) / 0.7)
    return n.crossJoin(tangle).select(F.when(F.col("n") > 0, value).alias("acyclicity"))  # one row each


def dead_files(nodes: DataFrame) -> DataFrame:
    """By the score's definition: parsed, not imported, no entry point and not exempt."""
    return nodes.where(F.col("language").isin(*PARSED) & (F.col("in_degree") == 0) & ~F.col("is_entry_point") & ~is_dead_code_exempt(F.col("id")))


def unused_files(nodes: DataFrame, languages: tuple[str, ...] = PARSED) -> DataFrame:
    """By the rules' definition, without exemptions (the browser's view leaves go out of languages)."""
    return nodes.where(F.col("language").isin(*languages) & (F.col("in_degree") == 0) & ~F.col("is_entry_point"))


def dead_code_axis(nodes: DataFrame) -> DataFrame:
    dead = (F.col("in_degree") == 0) & ~F.col("is_entry_point") & ~is_dead_code_exempt(F.col("id"))
    code = nodes.where(F.col("language").isin(*PARSED))
    return code.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 500 * F.avg(dead.cast("int")))).alias("v"), F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.col("v")).alias("dead_code"))


def coupling_axis(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("language").isin(*PARSED)).agg((F.avg(ramp(F.col("out_degree"), 15, 40)) * 100).alias("coupling"))


def compose(axes: DataFrame) -> DataFrame:
    """axes with their weighted geometric mean: null axes don't count, weights of the others are scaled up."""
    total = sum((F.when(F.col(a).isNotNull(), w).otherwise(0.0) for a, w in WEIGHTS.items()), F.lit(0.0))
    logs = sum((F.when(F.col(a).isNotNull(), w * F.ln(F.greatest(F.col(a), F.lit(1.0)))).otherwise(0.0) for a, w in WEIGHTS.items()), F.lit(0.0))
    return axes.withColumn("score", F.when(total > 0, F.exp(logs / total)))


def quality(functions: DataFrame, nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row: score and the four axes."""
    axes = complexity_axis(functions).crossJoin(acyclicity_axis(nodes, cycles)).crossJoin(dead_code_axis(nodes)).crossJoin(coupling_axis(nodes))  # one row each
    return compose(axes).select("score", *WEIGHTS)


def top_issues(functions: DataFrame, cycles: DataFrame, nodes: DataFrame) -> DataFrame:
    """At most 10 hot functions, 5 cycles and 5 dead files, in that order."""
    text, number, none = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    hot = functions.where("cyclomatic > 10").orderBy(F.desc("cyclomatic"), F.desc("cognitive"), "file", "start_line").limit(10)
    loops = cycles.where("size > 1").orderBy(F.desc("size"), "nodes").limit(5)
    dead = dead_files(nodes).orderBy("id").limit(5)
    return (
        hot.select(F.lit(1).alias("section"), F.lit("hot_function").alias("kind"), "file", "name", "start_line", "cyclomatic", "cognitive", none.alias("nodes"), text.alias("path"))
        .unionByName(loops.select(F.lit(2).alias("section"), F.lit("cycle").alias("kind"), text.alias("file"), text.alias("name"), number.alias("start_line"), number.alias("cyclomatic"), number.alias("cognitive"), "nodes", text.alias("path")))
        .unionByName(dead.select(F.lit(3).alias("section"), F.lit("dead_file").alias("kind"), text.alias("file"), text.alias("name"), number.alias("start_line"), number.alias("cyclomatic"), number.alias("cognitive"), none.alias("nodes"), F.col("id").alias("path")))
    )


def top_functions(functions: DataFrame, by: str = "cyclomatic", limit: int = 200, min_cc: int = 0, file: str | None = None) -> DataFrame:
    out = functions.where(F.col("cyclomatic") >= min_cc)
    out = out.where(F.col("file") == file) if file else out
    return out.orderBy(F.desc(by), "file", "start_line", "name").limit(limit)


def page(df: DataFrame, limit: int, *order) -> dict:
    """A page of rows with total_count, returned and truncated."""
    rows = [r.asDict(True) for r in df.orderBy(*order).limit(limit).collect()]
    total = df.count()
    return {"rows": rows, "total_count": total, "returned": len(rows), "truncated": total > len(rows)}


def loc_tree(files: DataFrame) -> DataFrame:
    """Lines and files of every directory prefix (empty: all)."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(up).alias("dir"), "loc").groupBy("dir").agg(F.sum("loc").alias("loc"), F.count("*").alias("files"))
