"""Ignore files of a tree as rules that its paths are joined with.

A rule holds below the folder of its file. Of all rules that match a file or one of the folders that it lies in, the last
counts: files of .ignore before those of .gitignore, these before the repository's own list, deeper folders before higher
ones, later lines before earlier ones. What lies in an ignored folder is ignored, whatever else is said of it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.paths import glob_regex, owner_key, owner_keys, prefixes

# Names of ignore files, the weakest first.
REPOSITORY, NAMES = ".git/info/exclude", (".gitignore", ".ignore")


class Rule(NamedTuple):
    scope: str  # folder, empty for the root
    rank: int
    key: str
    pattern: str  # of paths below the scope
    negated: bool
    folders: bool  # matches folders only


def parse_rules(files: list[tuple[str, int, str]]) -> list[Rule]:
    """Rules of (scope, kind, text), of which later kinds and deeper scopes rank higher."""
    out: list[Rule] = []
    for scope, _, text in sorted(files, key=lambda f: (f[1], f[0].count("/") + bool(f[0]), f[0])):
        for line in text.splitlines():
            line = line.rstrip("\r\n")
            while line.endswith(" ") and not line.endswith("\\ "):
                line = line[:-1]
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            body = line[1:] if negated or line.startswith(("\\#", "\\!")) else line
            body, folders = body.replace("\\ ", " ").rstrip("/"), body.endswith("/")
            if not body:
                continue
            anchored = "/" in body
            body = body.removeprefix("/")
            out.append(Rule(scope, len(out), owner_key(("/" if anchored else "") + body), glob_regex(body if anchored else f"**/{body}", separator=True), negated, folders))
    return out


def rules_below(spark: SparkSession, root: str) -> list[Rule]:
    """The rules of all ignore files below root. Spark's readers pass hidden files over, so these few are read by the driver;
    a level of folders is listed at a time."""
    jvm, base = spark._jvm, root.rstrip("/")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def text(p) -> str:
        stream = fs.open(p)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    found = []
    own = path(f"{base}/{REPOSITORY}")
    if fs.exists(own):
        found.append(("", 0, text(own)))
    above, stars = len(fs.makeQualified(path(base)).toString()) + 1, ""
    while True:
        for kind, name in enumerate(NAMES, 1):
            for s in fs.globStatus(path(f"{base}{stars}/{name}")) or ():
                if s.isFile():
                    found.append((s.getPath().toString()[above:].removesuffix(name).rstrip("/"), kind, text(s.getPath())))
        stars += "/[!.]*"
        if not any(s.isDirectory() for s in fs.globStatus(path(f"{base}{stars}")) or ()):
            return parse_rules(found)


def ignored(paths: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path) of the paths that the rules pass over. Rules are joined by their scope and a key that what they match has, so
    the plan is the same for any number of them."""
    spark = paths.sparkSession
    table = spark.createDataFrame(rules, "scope string, rank int, key string, pattern string, negated boolean, folders boolean")
    scopes = spark.createDataFrame([(s,) for s in sorted({r.scope for r in rules})], "scope string")
    within = paths.select("path", F.explode(prefixes(F.col("path"))).alias("node"))
    nodes = within.select("node", (F.col("node") != F.col("path")).alias("folder")).distinct()
    above = F.concat(F.array(F.lit("")), F.slice(prefixes(F.col("node")), F.lit(1), F.size(F.split("node", "/")) - 1))
    scoped = nodes.select("node", "folder", F.explode(above).alias("scope")).join(scopes, "scope")
    below = scoped.withColumn("rel", F.when(F.col("scope") == "", F.col("node")).otherwise(F.substring("node", F.length("scope") + 2, F.length("node"))))
    hit = below.withColumn("key", F.explode(owner_keys(F.col("rel")))).join(table, ["scope", "key"]).where("rel RLIKE pattern AND (folder OR NOT folders)")
    out = hit.groupBy("node").agg(F.max_by("negated", "rank").alias("negated")).where("NOT negated").select("node")
    return within.join(out, "node", "left_semi").select("path").distinct()
