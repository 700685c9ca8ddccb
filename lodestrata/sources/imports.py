"""Import edges of source lines by patterns, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.sources.files import lines

# Fixed patterns.
TS = {
    "import": r"""^\s*import\s+(?:[^'"`]*?from\s+)?['"]([^'"]+)['"]""",
    "require": r"""require\(\s*['"]([^'"]+)['"]\s*\)""",
    "dynamic": r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)""",
    "export": r"""^\s*export\s+(?:type\s+)?(?:\*|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""",
}
PY_FROM, PY_IMPORT = r"^\s*from\s+([a-zA-Z0-9_.]+)\s+import\s+", r"^\s*import\s+([a-zA-Z0-9_.]+)"
RUST_USE, RUST_MOD = r"^\s*use\s+([a-zA-Z0-9_:{}*,\s]+);", r"^\s*(?:pub\s+(?:\([^)]+\)\s+)?)?mod\s+([a-zA-Z0-9_]+)\s*;"
GO_ONE = r"""^\s*import\s+(?:(?:[a-zA-Z_][a-zA-Z0-9_]*|\.|_)\s+)?"([^"]+)\""""
GO_OPEN, GO_LINE = r"^\s*import\s*\(", r"""^\s*(?:(?:[a-zA-Z_][a-zA-Z0-9_]*|\.|_)\s+)?"([^"]+)\""""


def _found(pattern: str) -> Column:
    """The first match's group as an array of one or none."""
    return F.filter(F.array(F.regexp_extract("text", pattern, 1)), lambda x: x != "")


def _edges(rows: DataFrame, kind: Column, to: Column) -> DataFrame:
    return rows.select(F.col("path").alias("from"), F.posexplode(to).alias("k", "to"), kind.alias("kind"), "line")


def import_edges(files: DataFrame) -> DataFrame:
    """(from, to, kind, line) of files (path, language, content); k orders the edges of a line."""
    rows = lines(files.where(F.col("language").isin("typescript", "javascript", "python", "rust", "go")))
    ts = rows.where(F.col("language").isin("typescript", "javascript"))
    py, rust = rows.where("language = 'python'"), rows.where("language = 'rust'")
    all_dynamic = F.regexp_extract_all("text", F.lit(TS["dynamic"]), F.lit(1))
    parts = [
        _edges(ts, F.lit("import"), F.concat(_found(TS["import"]), _found(TS["require"]), all_dynamic, _found(TS["export"]))),
        _edges(py, F.lit("from"), _found(PY_FROM)),
        _edges(py, F.lit("import"), _found(PY_IMPORT)),
        _edges(rust, F.lit("use"), F.transform(_found(RUST_USE), lambda x: F.regexp_replace(x, r"\s+", ""))),
        _edges(rust, F.lit("use"), F.transform(_found(RUST_MOD), lambda x: F.concat(F.lit("self::"), x))),
        _edges(_go(rows.where("language = 'go'")), F.lit("import"), F.col("found")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _go(rows: DataFrame) -> DataFrame:
    """Go lines with what they import: one by one, or inside a block that the last opening or closing line decides."""
    mark = F.when(F.col("text").rlike(r"^\s*\)"), F.lit(0)).when(F.col("text").rlike(GO_OPEN), F.lit(1))
    before = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(0)) == 1
    return rows.withColumn("inside", inside).withColumn(
        "found", F.when(F.col("inside"), F.when(F.col("text").rlike(r"^\s*(?:\)|//|$)"), F.array().cast("array<string>")).otherwise(_found(GO_LINE))).otherwise(_found(GO_ONE))
    )
