"""Specifiers to files: every edge gets its candidates in order, the first that exists wins.

Aliases, modules and crates are tables that specifiers are joined with by the folders that they begin with, so a plan is the
same for any number of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import is_entry_point, normalize, parent, prefixes
from lodestrata.operators.metrics import degrees

# Extensions in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
DEFAULT_ALIASES = [("@/*", ["./src/*"])]
EXTERNAL = ("std", "core", "alloc", "proc_macro")


def _ts_paths(stem: Column) -> Column:
    return F.array(stem, *[F.concat(stem, F.lit(e)) for e in EXTENSIONS], *[F.concat(stem, F.lit("/index" + e)) for e in EXTENSIONS])


def _joined(base: Column, rest: Column) -> Column:
    return normalize(F.concat_ws("/", F.when(base != "", base), rest))


ROOTS = "lang string, prefix string, place int, whole boolean, base string"


def roots(spark, aliases=None, modules: dict[str, str] | None = None) -> DataFrame:
    """What stands for a folder at the beginning of a specifier: aliases in their order, modules from the longest on. whole:
    only the specifier that is the prefix itself counts."""
    rows = []
    for pattern, replacements in aliases or DEFAULT_ALIASES:
        star = pattern.endswith("/*")
        for r in replacements:
            rows.append(("script", pattern.removesuffix("/*") if star else pattern, len(rows), not star, r.removeprefix("./").removesuffix("/*") if star else r.removeprefix("./")))
    for module, folder in sorted((modules or {}).items(), key=lambda m: -len(m[0])):
        rows.append(("go", module, len(rows), False, folder))
    return spark.createDataFrame(rows, ROOTS)


def under_roots(edges: DataFrame, table: DataFrame) -> DataFrame:
    """(eid, roots): for each edge the roots that its specifier lies under, in order, with what follows (sub)."""
    mine = edges.where(F.col("language").isin("typescript", "javascript", "go") & ~F.col("to").startswith("."))
    each = mine.select("eid", "to", F.when(F.col("language") == "go", "go").otherwise("script").alias("lang"), F.explode(prefixes(F.col("to"))).alias("prefix"))
    hit = each.join(table, ["lang", "prefix"]).where(~F.col("whole") | (F.col("prefix") == F.col("to")))
    sub = F.substring("to", F.length("prefix") + 2, F.length("to")).alias("sub")
    return hit.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("place", "base", "whole", sub))).alias("roots"))


def ts_candidates(source: Column, raw: Column, found: Column) -> Column:
    """found: the roots that the specifier lies under."""
    under = lambda r: _ts_paths(normalize(F.when(r["whole"] | (r["sub"] == "") & ~raw.endswith("/"), r["base"]).otherwise(F.concat(r["base"], F.lit("/"), r["sub"]))))
    return F.when(raw.startswith("."), _ts_paths(_joined(parent(source), raw))).otherwise(F.flatten(F.transform(found, under)))


def _rust_parts(raw: Column) -> Column:
    clean = F.transform(F.split(F.regexp_replace(raw, r"^(?:pub)+", ""), "::"), lambda s: F.regexp_replace(s, r"^[{},\s]+|[{},\s]+$", ""))
    return F.filter(clean, lambda s: (s != "") & ~s.rlike("[,{}]"))


def _rust_paths(base: Column, parts: Column) -> Column:
    """a/b.rs, a/b/mod.rs, a.rs, a/mod.rs below base."""
    lengths = F.when(F.size(parts) > 0, F.sequence(F.size(parts), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    join = lambda n, tail: F.concat(F.when(base != "", F.concat(base, F.lit("/"))).otherwise(F.lit("")), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit(tail))
    return F.flatten(F.transform(lengths, lambda n: F.array(join(n, ".rs"), join(n, "/mod.rs"))))


def crate_name(raw: Column) -> Column:
    return F.translate(F.try_element_at(_rust_parts(raw), F.lit(1)), "-", "_")


def rust_candidates(source: Column, raw: Column, crate: Column) -> Column:
    """crate: the folder of the crate that the specifier begins with, or null."""
    parts = _rust_parts(raw)
    first = F.try_element_at(parts, F.lit(1))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    folder = parent(source)
    root = F.regexp_extract(folder, r"^(?:.*/)?src(?=/|$)(?!.*/src(?:/|$))", 0)
    supers = F.size(F.split(F.regexp_extract(F.array_join(parts, "::"), r"^super(?:::super)*", 0), "::"))
    up = F.aggregate(F.sequence(F.lit(1), supers), folder, lambda p, _: parent(p))
    after = F.slice(parts, supers + 1, F.greatest(F.size(parts), F.lit(1)))
    none = F.array().cast("array<string>")
    other = F.when(crate.isNotNull(), F.array(F.concat(crate, F.lit("/lib.rs")), F.concat(crate, F.lit("/main.rs")))).otherwise(none)
    found = (
        F.when(first == "crate", _rust_paths(root, rest)).when(first == "super", _rust_paths(up, after)).when(first == "self", _rust_paths(folder, rest))
        .when(first.isin(*EXTERNAL), none).otherwise(other)
    )
    return F.when(root != "", found).otherwise(none)


def python_candidates(source: Column, raw: Column, relative: bool = True) -> Column:
    """Absolute, then beside the importer; with relative, leading dots go up from its directory."""
    form = F.translate(raw, ".", "/")
    folder = parent(source)
    both = lambda p: [F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py"))]
    plain = F.concat(F.array(*both(form)), F.when(folder != "", F.array(*both(F.concat(folder, F.lit("/"), form)))).otherwise(F.array().cast("array<string>")))
    if not relative:
        return plain
    dots = F.length(F.regexp_extract(raw, r"^\.+", 0))
    base = F.when(dots > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(dots, F.lit(2))), folder, lambda p, _: parent(p))).otherwise(folder)
    tail = F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
    at = F.concat_ws("/", F.when(base != "", base), F.when(tail != "", tail))
    return F.when(dots > 0, F.array(*both(at))).otherwise(plain)


def go_candidates(found: Column) -> Column:
    """By the longest module that fits: base.go, base/last.go, then the first file of the directory."""
    def under(r: Column) -> Column:
        base = F.concat_ws("/", F.when(r["base"] != "", r["base"]), F.when(r["sub"] != "", r["sub"]))
        own = F.array(F.concat(base, F.lit(".go")), F.concat(base, F.lit("/"), F.element_at(F.split(base, "/"), -1), F.lit(".go")), F.concat(base, F.lit("/*.go")))
        return F.when(base != "", own).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(found, under))


def resolve_edges(files: DataFrame, raw: DataFrame, aliases=None, crates=None, modules=None, relative_python: bool = True) -> DataFrame:
    """raw edges with `target`, the file that each means, or null."""
    lang = files.select(F.col("path").alias("from"), "language")
    edges = raw.join(lang, "from").withColumn("eid", F.xxhash64("from", "line", "k", "to", "kind"))
    src, to, found = F.col("from"), F.col("to"), F.coalesce("roots", F.expr("cast(array() as array<struct<place: int, base: string, whole: boolean, sub: string>>)"))
    spark = files.sparkSession
    folders = spark.createDataFrame(list((crates or {}).items()), "crate string, crate_folder string")
    named = edges.join(under_roots(edges, roots(spark, aliases, modules)), "eid", "left").withColumn("crate", F.when(F.col("language") == "rust", crate_name(to))).join(folders, "crate", "left")
    candidates = (
        F.when(F.col("language").isin("typescript", "javascript"), ts_candidates(src, to, found))
        .when(F.col("language") == "rust", rust_candidates(src, to, F.col("crate_folder")))
        .when(F.col("language") == "python", python_candidates(src, to, relative_python))
        .when(F.col("language") == "go", go_candidates(found))
    )
    # A directory of Go files stands for its first file in name order.
    go = files.where("language = 'go'").where(~F.col("path").endswith("_test.go")).groupBy(F.concat(parent(F.col("path")), F.lit("/*.go")).alias("candidate")).agg(F.min("path").alias("target"))
    known = files.select(F.col("path").alias("candidate"), F.col("path").alias("target")).unionByName(go)
    tried = named.select("eid", F.posexplode(candidates).alias("prio", "candidate"))
    best = tried.join(known, "candidate").groupBy("eid").agg(F.min_by("target", "prio").alias("target"))
    return edges.join(best, "eid", "left")


def build_graph(files: DataFrame, raw: DataFrame, **config) -> dict:
    """nodes and edges (deduplicated, without edges to oneself, the first line kept) and a frame with the unresolved."""
    found = resolve_edges(files, raw, **config)
    edges = found.where("target IS NOT NULL AND target <> `from`").groupBy("from", F.col("target").alias("to")).agg(F.min("line").alias("line"))
    nodes = files.select(F.col("path").alias("id"), "language", "loc", is_entry_point(F.col("path")).alias("is_entry_point"))
    return {"nodes": degrees(nodes, edges), "edges": edges, "unresolved": found.where("target IS NULL").select("from", "to", "kind", "line")}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
