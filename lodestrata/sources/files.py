"""Files of a source tree, their lines, markers, snippets, functions and public items."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.paths import has_parser, language
from lodestrata.operators.search import lines_of
from lodestrata.schemas import RELATIONS
from lodestrata.sources import ignore, parse
from lodestrata.storage import saved

# Fixed value: the pattern of a mark.
MARKER = r"(?i)\b(TODO|FIXME|HACK|XXX|NOTE)\b[:\s]*(.*)$"


def read_tree(spark: SparkSession, root: str, respect_ignores: bool = True) -> DataFrame:
    """(path, language, content, bytes, modified) of the files of known languages below root, without hidden ones and those
    that ignore files pass over."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    at = F.instr("path", base.split("://")[-1]) + len(base.split("://")[-1])
    out = raw.select(
        F.expr("url_decode(replace(path, '+', '%2B'))").alias("path"), F.col("content").alias("_raw"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    ).withColumn("path", F.substring("path", at, F.length("path")))
    out = out.where(~F.exists(F.split("path", "/"), lambda p: p.startswith("."))).withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
    rules = ignore.rules_below(spark, root) if respect_ignores else []
    if rules:
        out = out.join(saved(ignore.ignored(out.select("path"), rules), "ignored"), "path", "left_anti")
    return out.select("path", "language", F.decode("_raw", "UTF-8").alias("content"), "bytes", "modified")


def loc(lang: Column, content: Column) -> Column:
    """Lines that are neither blank nor comments; lines that aren't blank where comments aren't known."""
    @F.pandas_udf("int")
    def count(ls: pd.Series, cs: pd.Series) -> pd.Series:
        def one(lang, text):
            text = text or ""
            if lang in parse.BRACES:
                text = re.sub(r"^[ \t]*//[^\n]*", "", re.sub(r"/\*.*?(?:\*/|\Z)", lambda m: "\n" * m[0].count("\n"), text, flags=re.S), flags=re.M)
            elif lang in ("python", "ruby", "toml"):
                text = re.sub(r"^[ \t]*#[^\n]*", "", text, flags=re.M)
            elif lang in ("html", "markdown"):
                text = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
            elif lang in ("css", "java"):
                text = re.sub(r"^[ \t]*//[^\n]*", "", re.sub(r"/\*.*?(?:\*/|\Z)", lambda m: "\n" * m[0].count("\n"), text, flags=re.S), flags=re.M) if lang == "java" else re.sub(r"/\*.*?(?:\*/|\Z)", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
            return sum(bool(x.strip()) for x in text.splitlines())
        return pd.Series([one(a, b) for a, b in zip(ls, cs)], dtype="int32")

    return count(lang, content)


def inventory(tree: DataFrame) -> DataFrame:
    return tree.select("path", "language", loc(F.col("language"), F.col("content")).alias("loc"), "bytes")


def lines(files: DataFrame) -> DataFrame:
    """(path, language, line from 1, text)."""
    return files.select("path", "language", F.posexplode(lines_of(F.col("content"))).alias("i", "text")).select("path", "language", (F.col("i") + 1).alias("line"), "text")


def markers(files: DataFrame, limit: int | None = 500) -> DataFrame:
    """The first mark of each line that has one."""
    rows = lines(files).withColumn("kind", F.upper(F.regexp_extract("text", MARKER, 1))).where("kind <> ''")
    out = rows.select(F.col("path").alias("file"), "line", "kind", F.trim(F.regexp_extract("text", MARKER, 2)).alias("text"))
    return out if limit is None else out.orderBy("file", "line").limit(limit)


def snippet_at(files: DataFrame, path: str, line: int, radius: int = 25) -> DataFrame:
    """(start, end, text) around a line; radius at most 500."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"outside the tree: {path!r}")
    r = min(radius, 500)
    ls = lines_of(F.col("content"))
    start = F.lit(max(1, line - r))
    n = F.greatest(F.least(F.size(ls), F.lit(line + r)) - start + 1, F.lit(0))
    return files.where(F.col("path") == path).select(start.alias("start"), (start + n - 1).alias("end"), F.array_join(F.slice(ls, start, n), "\n").alias("text"))


def _rows(frames, extract, columns):
    for f in frames:
        out = [(p, lang, *r) for p, lang, c in zip(f["path"], f["language"], f["content"]) for r in extract(lang, c or "", p)]
        if out:
            yield pd.DataFrame(out, columns=columns)


def functions_of(files: DataFrame) -> DataFrame:
    """The relation functions, one file after the other."""
    names = ["file", "lang", "name", "start_line", "end_line", "loc", "params", "cyclomatic", "cognitive", "body_hash"]
    code = files.where(has_parser(F.col("language"))).select("path", "language", "content")
    return code.mapInPandas(lambda frames: (x.drop(columns="lang") for x in _rows(frames, parse.functions, names)), RELATIONS["functions"])


def surface_of(files: DataFrame) -> DataFrame:
    names = ["file", "language", "kind", "name", "signature", "line", "method"]
    code = files.where(has_parser(F.col("language"))).select("path", "language", "content")
    return code.mapInPandas(lambda frames: _rows(frames, parse.surface, names), RELATIONS["surface_items"])


def surface_counts(items: DataFrame) -> DataFrame:
    """Counts by kind and by language in one pass."""
    return items.groupingSets([["kind"], ["language"]], "kind", "language").agg(F.count("*").alias("n"))
