"""Queries over a source tree made of the driver's tables: scanners, imports and their resolution, chunks, public items,
diagnostics, storage and the composed answers. Each has SQL that gives the same rows without reading any source text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import paths, scores
from lodestrata.functions.text import tokens
from lodestrata.operators import fleet, graph, history, metrics, resolve, rules, search, state, symbols
from lodestrata.plans.proxies import path
from lodestrata.plans.queries import AS_OF, COS, HOT, PLACED, IS_TEST, TESTMAP, CLOSURE, CYCLES, MODULE, PARSED, r6
from lodestrata.plans.registry import query
from lodestrata.sources import configs, files, imports, tools
from lodestrata.storage import last_of_key, remove, replace_partition, replace_table, saved, shared_dir, upsert
from lodestrata.streaming import watch

FROM, TO = '"from"', '"to"'


# --- sources

@query("SELECT path, language FROM units", "units")
def s2_languages(s):
    return s.code.select("path", paths.language(F.col("path")).alias("language"))


@query("SELECT path, language, CASE WHEN code THEN n + CAST(test AS INT) + size ELSE 1 END AS loc FROM units", "units")
def s4_lines_of_code(s):
    return files.inventory(s.code.withColumn("bytes", F.octet_length("content"))).select("path", "language", "loc")


@query("SELECT path, CASE WHEN code THEN first + size - 1 ELSE 1 END AS lines FROM units", "units")
def s5_lines(s):
    return files.lines(s.code).groupBy("path").agg(F.max("line").alias("lines"))


@query(f"SELECT path AS {FROM}, spec AS {TO}, CASE WHEN f % 7 = 0 THEN 'use' WHEN f % 7 = 3 AND t % 2 = 0 THEN 'from' ELSE 'import' END AS kind, line FROM imports", "imports")
def s6_imports(s):
    return imports.import_edges(s.code).select("from", "to", "kind", "line")


@query("SELECT path AS file, 'f' || k AS name, first AS start_line, first + size - 1 AS end_line, size AS loc, 2 AS params, 1 + branches AS cyclomatic, branches AS cognitive FROM units WHERE parses", "units")
def s7_functions(s):
    return files.functions_of(s.code).drop("body_hash")


@query("SELECT path AS file, first - 1 - CAST(test AS INT) AS line, 'TODO' AS kind, 'check f' || k AS text FROM units WHERE mark", "units")
def s9_markers(s):
    return files.markers(s.code, None)


@query("SELECT 'TODO' AS kind, count(*) AS n FROM units WHERE mark", "units")
def a21_marker_counts(s):
    return files.markers(s.code, None).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS text, 2 AS start, least(4, len(string_split(text, chr(10)))) AS \"end\" FROM documents WHERE doc_id = 5")
def s20_snippet(s):
    return files.snippet_at(s.chunk_files, "doc/5.md", 3, 1)


@query("SELECT path, test AS inline FROM units", "units")
def p5_inline_tests(s):
    return s.code.select("path", paths.has_inline_tests(F.col("language"), F.col("content")).alias("inline"))


ITEMS = (
    "items AS (SELECT path AS file, language, 'function' AS kind, 'f' || k AS name, first AS line FROM units WHERE k % 7 = 1 OR (k % 7 = 0 AND k % 2 = 0) "
    "UNION ALL SELECT path, CASE WHEN f % 7 = 1 THEN 'typescript' ELSE 'javascript' END, 're_export', substr('export * from ''' || spec || ''';', 1, 64), line FROM imports WHERE f % 7 IN (1, 2) AND t % 3 = 2)"
)


@query(f"+ {ITEMS} SELECT file, kind, name, line FROM items", "units")
def y1_public_items(s):
    return files.surface_of(s.code).select("file", "kind", "name", "line")


@query(f"+ {ITEMS} SELECT kind, NULL AS language, count(*) AS n FROM items GROUP BY kind UNION ALL SELECT NULL, language, count(*) FROM items GROUP BY language", "units")
def y4_item_counts(s):
    return files.surface_counts(files.surface_of(s.code))


# --- resolution

def _graph(s) -> dict:
    tree = s.code.select("path", "language", F.lit(1).alias("loc"))
    aliases = configs.ts_aliases('{"compilerOptions": {"paths": {"~/*": ["./web/src/*"], /* none */ "x/*": ["node_modules/x/*"]}}}  // a comment')
    crates = configs.rust_crates({"web/Cargo.toml": '[package]\nname = "web-app"\n', "bad/Cargo.toml": "["})
    return resolve.build_graph(tree, imports.import_edges(s.code), aliases=aliases, crates=crates, modules=configs.go_modules({"go.mod": "// it\nmodule mod\n"}))


@query(f"SELECT path AS {FROM}, {path('t')} AS {TO}, line FROM imports WHERE hit", "imports")
def r1_resolved_edges(s):
    return _graph(s)["edges"]


@query(f"SELECT path AS {FROM}, spec AS {TO}, line FROM imports WHERE NOT hit", "imports")
def r1_unresolved(s):
    return _graph(s)["unresolved"].select("from", "to", "line")


@query(
    "+ o AS (SELECT f, count(*) AS n FROM imports WHERE hit GROUP BY f), i AS (SELECT t, count(*) AS n FROM imports WHERE hit GROUP BY t) "
    "SELECT path AS id, language, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM units LEFT JOIN o ON o.f = k LEFT JOIN i ON i.t = k",
    "units",
)
def r1_nodes(s):
    return _graph(s)["nodes"].select("id", "language", "in_degree", "out_degree")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'b/y' ELSE 'a/b/y' END AS path FROM part")
def r9_normalized(s):
    p = F.when(F.col("p_partkey") % 3 == 0, "a/../b/./x/../y").otherwise("./a//b/c/../y")
    return s.part.select(F.col("p_partkey").alias("id"), paths.normalize(p).alias("path"))


@query("SELECT path, CASE WHEN path LIKE 'part/%' THEN substr(path, 6) END AS inside FROM files", "files")
def p15_delta_paths(s):
    return s.files.select("path", paths.normalize_delta_path(F.translate("path", "/", "\\"), "part/").alias("inside"))


DIRS = "CASE p_partkey % 6 WHEN 0 THEN 'target/' WHEN 1 THEN 'a/node_modules/b/' WHEN 2 THEN '.git/' ELSE 'src/targets/' END"
ENDS = "CASE p_partkey % 5 WHEN 0 THEN 'rs' WHEN 1 THEN 'PY' WHEN 2 THEN 'lock' ELSE 'md' END"


@query(f"SELECT p_partkey AS id FROM part WHERE p_partkey % 6 > 2 AND p_partkey % 5 <> 2")
def z2_relevant_events(s):
    return watch.relevant(s.part.selectExpr("p_partkey AS id", f"concat({DIRS}, CAST(p_partkey AS STRING), '.', {ENDS}) AS path")).select("id")


@query(
    f"SELECT side, other, line FROM (SELECT 'in' AS side, f.path AS other, line, t AS k FROM imports f WHERE hit UNION ALL SELECT 'out', {path('t')}, line, f FROM imports WHERE hit "
    "UNION ALL SELECT 'external', spec, line, f FROM imports WHERE NOT hit UNION ALL SELECT 'function', 'f' || k, first, k FROM units WHERE parses) "
    "WHERE k = (SELECT f FROM (SELECT f, count(*) AS n FROM imports GROUP BY f) ORDER BY n DESC, f LIMIT 1)",
    "units",
)
def q10_file_dsm(s):
    top = s.imports.groupBy("f", "path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "f").first()
    if top is None:
        return s.spark.createDataFrame([], "side string, other string, line int")
    g = _graph(s)
    d = graph.file_dsm(top.path, g["nodes"], saved(g["edges"], "edges"), imports.import_edges(s.code), files.functions_of(s.code))
    side = lambda df, name, other, line="line": df.select(F.lit(name).alias("side"), F.col(other).alias("other"), F.col(line).alias("line"))
    out = side(d["inbound"], "in", "from").unionByName(side(d["outbound"], "out", "to"))
    return out.unionByName(side(d["externals"], "external", "to")).unionByName(side(d["functions"], "function", "name", "start_line"))


# --- chunks and search

@query(
    "+ u AS (SELECT *, CASE WHEN code THEN first + size - 1 ELSE 1 END AS last FROM units) SELECT path AS file, CASE WHEN parses THEN 'function' ELSE 'window' END AS kind, CASE WHEN parses THEN 'f' || k ELSE 'L1-' || last END AS name, "
    "CASE WHEN parses THEN first ELSE 1 END AS start_line, last AS end_line FROM u",
    "units",
)
def x3_chunks(s):
    return search.chunk_files(s.code, files.functions_of(s.code)).select("file", "kind", "name", "start_line", "end_line")


@query("SELECT path AS file, CASE k % 7 WHEN 5 THEN '{\"k\": ' || k || '}' ELSE 'text of ' || k END AS content FROM units WHERE NOT code UNION ALL SELECT path, 'def f' || k || '(a, b):' || chr(10) || '    return a' FROM units WHERE k % 7 = 3 AND branches = 0 AND parses", "units")
def x1_chunk_texts(s):
    chunks = search.chunk_files(s.code, files.functions_of(s.code))
    return chunks.where("(kind = 'window' AND file RLIKE '(json|md)$') OR (kind = 'function' AND file LIKE '%.py' AND end_line = start_line + 1)").select("file", "content")


@query("SELECT 'doc/' || doc_id || '.md' AS path, 'new' AS state FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 UNION ALL SELECT 'gone/' || doc_id, 'gone' FROM documents WHERE doc_id % 11 = 0")
def x9_changed_files(s):
    known = s.chunk_files.join(s.documents.selectExpr("concat('doc/', CAST(doc_id AS STRING), '.md') AS path", "doc_id"), "path").where("doc_id % 5 <> 0")
    known = known.select("path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(scores.content_hash(F.col("content"))).alias("hash"))
    known = known.unionByName(s.documents.where("doc_id % 11 = 0").selectExpr("concat('gone/', CAST(doc_id AS STRING)) AS path", "'x' AS hash"))
    new, gone = search.changed_files(s.chunk_files, known)
    return new.select("path", F.lit("new").alias("state")).unionByName(gone.select("path", F.lit("gone").alias("state")))


@query("SELECT 'doc/' || doc_id || '.md' AS file, 'guide' AS name, md5('# guide' || chr(10) || 'for readers' || chr(10) || chr(10) || text) AS hash FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '1%' AND text IS NOT NULL")
def x11_artifact_chunks(s):
    known = s.spark.createDataFrame([("guide", "for readers", ["doc/1*.md"], None)], "name string, description string, paths array<string>, `when` string")
    return search.artifact_chunks(known, s.chunk_files).select("file", "name", F.md5(F.col("content").cast("binary")).alias("hash"))


@query(f"WITH {COS} SELECT id, round(score, 6) AS score FROM dn ORDER BY dn.score DESC, id LIMIT 30")
def x13_recall_dense(s):
    notes = s.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return state.recall_dense(notes, s.embeddings.where("vec_id = 0").first().embedding, 30).select("id", r6("score").alias("score"))


@query(f"WITH {COS} SELECT 'dense' AS mode, id FROM (SELECT id FROM dn ORDER BY score DESC, id LIMIT 20)")
def x14_recall_best(s):
    notes = s.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.lit("").alias("content"))
    mode, found = state.recall_best(notes, "a word", s.embeddings.where("vec_id = 0").first().embedding, 20)
    return found.select(F.lit(mode).alias("mode"), "id")


@query(
    f"WITH {COS}, b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM dn WHERE score IS NOT NULL), "
    "f AS (SELECT coalesce(b.id, v.id) AS id, coalesce(1.0 / (60 + b.r), 0) + coalesce(1.0 / (60 + v.r), 0) AS score, b.r AS bm25_rank, v.r AS dense_rank FROM (FROM b WHERE r < 50) b FULL JOIN (FROM v WHERE r < 50) v ON b.id = v.id) "
    "SELECT id, round(score, 9) AS score, bm25_rank, dense_rank, lang FROM f JOIN documents ON doc_id = id WHERE lang = 'en' ORDER BY f.score DESC, id LIMIT 20"
)
def t17_search_hits(s):
    hits = s.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    near = search.dense(s.embeddings, s.embeddings.where("vec_id = 0").first().embedding, 50, "vec_id")
    chunks = s.documents.select(F.col("doc_id").alias("id"), F.lit("f").alias("file"), "lang", F.lit("window").alias("kind"), F.lit("n").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("text").alias("content"))
    found = search.hydrate(search.fuse(hits, near), chunks, 20, "en", "window")
    return found.select("id", F.round("score", 9).alias("score"), "bm25_rank", "dense_rank", "lang")


# --- storage

@query("SELECT p_partkey AS file, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1000 ELSE p_size END AS value FROM part UNION ALL SELECT -p_partkey, 7 FROM part WHERE p_partkey % 10 = 0")
def k1_upsert(s):
    old = s.part.selectExpr("p_partkey AS file", "p_size AS value")
    new = s.part.where("p_partkey % 3 = 0").selectExpr("p_partkey AS file", "p_size + 1000 AS value").unionByName(s.part.where("p_partkey % 10 = 0").selectExpr("-p_partkey AS file", "7 AS value"))
    return upsert(old, new, ["file"])


@query("SELECT p_partkey AS file, p_size AS value FROM part WHERE p_size >= 20")
def k2_remove(s):
    rows = s.part.selectExpr("p_partkey AS file", "p_size AS value")
    return remove(rows, rows.where("value < 20"), ["file"])


@query("SELECT user_id AS key, max(event_id) AS last, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def k5_last_of_key(s):
    return last_of_key(s.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("last"), F.col("event_type").alias("value")), ["key"], "last")


@query("SELECT file, name, cyclomatic FROM functions WHERE cyclomatic >= 8 ORDER BY cyclomatic DESC, file, name LIMIT 50", "functions")
def k9_snapshot_functions(s):
    return state.hot_functions(s.functions).select(F.explode("hot_functions").alias("h")).select("h.file", "h.name", "h.cyclomatic")


@query("SELECT conv_id AS from_id, turn AS to_id, role AS kind FROM conversations GROUP BY ALL UNION SELECT 3, 4, 'blocks'")
def k10_link(s):
    edges = s.conversations.select(F.col("conv_id").alias("from_id"), F.col("turn").alias("to_id"), F.col("role").alias("kind"))
    return state.link(state.link(edges, 3, 4, "blocks"), 3, 4, "blocks")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 OR doc_id % 10 = 0 THEN 'new' ELSE 'old' END AS hash FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 10 = 0")
def k11_commit_delta(s):
    known = s.documents.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.lit("old").alias("hash"))
    now = s.documents.where("doc_id % 9 <> 0 OR doc_id % 10 = 0").select(F.col("doc_id").alias("path"), F.when((F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 10 == 0), "new").otherwise("old").alias("hash"))
    return state.commit_delta(known, state.scan_delta(known, now))


@query("SELECT 'out' AS direction, turn AS other, role AS kind FROM conversations WHERE conv_id = 2 UNION ALL SELECT 'in', conv_id, role FROM conversations WHERE turn = 2")
def q9_note_links(s):
    edges = s.conversations.select(F.col("conv_id").alias("from_id"), F.col("turn").alias("to_id"), F.col("role").alias("kind"))
    return state.note_links(edges, 2)


# --- symbols

ROOT = "root AS (SELECT min(callee) AS r FROM calls WHERE callee LIKE 'order%')"


def _calls(s) -> tuple[DataFrame, str | None]:
    calls = saved(symbols.call_edges(symbols.enclosing(s.occurrences)), "calls")
    return calls, calls.where("callee LIKE 'order%'").agg(F.min("callee")).first()[0]


@query(
    f"RECURSIVE +{PLACED}, {ROOT}, up AS (SELECT r AS symbol, 0 AS d FROM root UNION SELECT caller, d + 1 FROM up JOIN calls ON callee = symbol WHERE d < 2), "
    "down AS (SELECT r AS symbol, 0 AS d FROM root UNION SELECT callee, d + 1 FROM down JOIN calls ON caller = symbol WHERE d < 2), "
    "n AS (SELECT symbol FROM up UNION SELECT symbol FROM down) SELECT caller, callee, sites FROM calls WHERE caller IN (SELECT symbol FROM n) AND callee IN (SELECT symbol FROM n)",
    "occurrences",
)
def q5_trace(s):
    calls, root = _calls(s)
    roots = s.spark.createDataFrame([(root,)] if root else [], "symbol string")
    return symbols.among(calls, symbols.reach(calls, roots, True, 2).unionByName(symbols.reach(calls, roots, False, 2)))


@query(
    f"+ {PLACED} SELECT count(*) FILTER (is_def) AS definitions, count(*) AS occurrences, (SELECT count(*) FROM calls WHERE callee = 'part 7') AS callers FROM occurrences WHERE symbol = 'part 7'", "occurrences")
def q6_symbol_360(s):
    calls, _ = _calls(s)
    x = symbols.symbol_360(s.occurrences, calls, "part 7")
    return s.spark.createDataFrame([(x["n_definitions"], x["occurrences"], x["n_callers"])], "definitions long, occurrences long, callers long")


@query(
    f"RECURSIVE +{PLACED}, {ROOT}, up AS (SELECT r AS symbol, 0 AS d FROM root UNION SELECT caller, d + 1 FROM up JOIN calls ON callee = symbol WHERE d < 3) "
    "SELECT DISTINCT doc FROM occurrences WHERE is_def AND symbol IN (SELECT symbol FROM up WHERE d > 0) AND symbol <> (SELECT r FROM root)",
    "occurrences",
)
def u4_impact_files(s):
    calls, root = _calls(s)
    roots = s.spark.createDataFrame([(root,)] if root else [], "symbol string")
    return symbols.defining(s.occurrences, symbols.reach(calls, roots, True, 3).where("depth > 0"))


INFO = "p_brand AS symbol, p_type AS display_name, p_size % 3 AS kind, p_partkey % 2 = 0 AS external"


@query("SELECT p_brand AS symbol, arg_min(p_type, ((p_partkey % 2 = 0)::INT, p_type)) AS display_name FROM part GROUP BY p_brand")
def j22_symbol_info(s):
    return symbols.info(s.part.selectExpr(*INFO.split(", "))).select("symbol", "display_name")


@query("WITH i AS (SELECT p_brand AS symbol, arg_min(p_type, ((p_partkey % 2 = 0)::INT, p_type)) AS name FROM part GROUP BY p_brand) SELECT symbol FROM i WHERE name = (SELECT max(name) FROM i) AND symbol IN (SELECT p_brand FROM part WHERE p_size < 40)")
def j20_symbol_of_function(s):
    info = s.part.selectExpr(*INFO.split(", "))
    name = symbols.info(info).agg(F.max("display_name")).first()[0]
    own = s.part.selectExpr("p_brand AS symbol", "CASE WHEN p_size < 40 THEN 'a.rs' ELSE 'b.rs' END AS doc", "true AS is_def")
    return symbols.symbol_of_function(own, info, "a.rs", name or "").select("symbol")


# --- history, rules, fleet, tools

@query("SELECT DISTINCT unnest(CASE WHEN path LIKE 'web/%' THEN ['@frontend', '@design'] WHEN path LIKE 'tests/%' THEN ['@qa'] ELSE ['@all'] END) AS owner FROM files WHERE loc > 48", "files")
def j9_owner_set(s):
    own = configs.owner_rules(s.spark, "# owners\n* @all\n/web/ @frontend @design  # the browser\n!no @x\nalone\n/tests/ @qa\n")
    changed = s.files.where("loc > 48")
    none = s.files.limit(0)
    return history.overlay(changed, none, none.withColumnRenamed("path", "source"), none.withColumnRenamed("path", "file"), own)["owners"]


@query(
    "+ " + HOT + f", {TESTMAP}, h AS (SELECT path FROM hot ORDER BY score DESC, churn DESC, path LIMIT 40) SELECT path, path IN (SELECT path FROM h) AS is_hotspot, path NOT IN (SELECT source FROM tm) AND NOT {IS_TEST.format(c='path')} AS is_gap, loc AS additions FROM files "
    "WHERE path LIKE 'part/%' ORDER BY 2 DESC, 3 DESC, loc DESC, path LIMIT 60",
    "commits", "functions", "edges", "files",
)
def t15_explain(s):
    from lodestrata.operators import testmap

    mets = metrics.file_metrics(s.functions)
    hot = history.hotspots(history.file_stats(s.commits, AS_OF), mets)
    changed = s.files.where("path LIKE 'part/%'").select("path", F.col("loc").alias("additions"), F.lit(0).alias("deletions"))
    return history.explain(changed, hot, testmap.gaps(s.files, testmap.mappings(s.edges), mets), 60).select("path", "is_hotspot", "is_gap", "additions")


@query(f"RECURSIVE +{CLOSURE}, {CYCLES}, named AS (SELECT root, {path('a')} AS id FROM cyc), g AS (SELECT list(id ORDER BY id) AS ids, count(*) AS size FROM named GROUP BY root HAVING count(*) > 1) SELECT array_to_string(ids, ',') AS nodes, size FROM g ORDER BY size, ids LIMIT 1", "pairs")
def a29_smallest_cycle(s):
    return graph.find_cycles(s.edges).orderBy("size", "nodes").limit(1).select(F.array_join("nodes", ",").alias("nodes"), "size")


TOML = """
[layers]
ui = ["web/**"]
core = ["part/*/p*"]
tests = ["tests/**"]

[[layer_forbid]]
from = "core"
to = "ui"

[[layer_forbid]]
from = "ui"
to = "tests"
reason = "no tests in the browser"

[[complexity_cap]]
glob = "part/1/**"
max_cyclomatic = 48
max_cognitive = 45

[[surface_forbid]]
glob = "*.rs"
pattern = "ring$"

[dead_code]
max_files = 3
"""


@query(
    "SELECT 'complexity_cap' AS rule, count(*) AS n FROM functions WHERE file LIKE 'part/1/%' AND (cyclomatic > 48 OR cognitive > 45) HAVING count(*) > 0 "
    f"UNION ALL SELECT 'dead_code', 1 FROM (SELECT count(*) AS n FROM nodes WHERE language IN {PARSED} AND in_degree = 0 AND NOT is_entry_point) WHERE n > 3 "
    "UNION ALL SELECT 'layer_forbid', count(*) FROM edges WHERE (\"from\" LIKE 'part/%/p%' AND \"to\" LIKE 'web/%') OR (\"from\" LIKE 'web/%' AND \"to\" LIKE 'tests/%') HAVING count(*) > 0 "
    "UNION ALL SELECT 'surface_forbid', count(*) FROM surface WHERE regexp_matches(name, 'ring$') HAVING count(*) > 0",
    "functions", "nodes", "edges", "surface",
)
def v5_evaluate(s):
    config = configs.load_toml(TOML)
    return rules.counts(rules.evaluate(config, s.edges, s.functions, s.nodes, s.surface))


@query("SELECT DISTINCT 'app' || (p_partkey % 5) AS app, p_name AS path, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, app, path LIMIT 25")
def t5_fleet_hotspots(s):
    rows = s.part.selectExpr("concat('app', CAST(p_partkey % 5 AS STRING)) AS app", "p_name AS path", "p_retailprice AS score").distinct()
    return fleet.top_hotspots(rows)


RAW = "CASE event_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'warn' WHEN 2 THEN 'note' WHEN 3 THEN '2' WHEN 4 THEN 'error' ELSE 'other' END"
TOOL = "CASE event_id % 5 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'dependency-cruiser' WHEN 2 THEN 'clippy' WHEN 3 THEN 'eslint' ELSE 'ruff' END"
SEVERITY = (
    f"f AS (SELECT event_id, user_id, {TOOL} AS tool, {RAW} AS raw FROM events), d AS (SELECT event_id, user_id, tool, CASE WHEN tool = 'semgrep' AND raw = 'ERROR' THEN 'error' WHEN tool = 'dependency-cruiser' AND raw = 'error' THEN 'error' "
    "WHEN tool = 'clippy' AND raw = 'error' THEN 'error' WHEN tool = 'clippy' AND raw = 'note' THEN 'info' WHEN tool = 'eslint' AND raw = '2' THEN 'error' WHEN tool = 'ruff' AND raw = 'error' THEN 'error' ELSE 'warning' END AS severity FROM f)"
)


def _diagnostics(s) -> DataFrame:
    rows = s.events.selectExpr("event_id", "user_id", f"{TOOL} AS tool", f"{RAW} AS raw")
    return rows.select(
        "tool", F.lit("r").alias("rule"), scores.severity(F.col("tool"), F.col("raw")).alias("severity"), F.concat(F.lit("file"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").cast("int").alias("line")
    )


@query(f"WITH {SEVERITY} SELECT tool, severity, count(*) AS n FROM d GROUP BY 1, 2")
def p22_severities(s):
    return _diagnostics(s).groupBy("tool", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {SEVERITY} SELECT tool, NULL AS severity, count(*) AS n FROM d GROUP BY tool UNION ALL SELECT NULL, severity, count(*) FROM d GROUP BY severity")
def a16_diagnostic_counts(s):
    return tools.diagnostic_counts(_diagnostics(s))


@query(f"WITH {SEVERITY} SELECT tool, 'file' || user_id AS file, CAST(event_id AS INT) AS line FROM d WHERE tool = 'clippy' AND severity = 'info' ORDER BY file, line LIMIT 100")
def p13_filtered_diagnostics(s):
    return tools.filtered(_diagnostics(s), "clippy", "info", None, 100).select("tool", "file", "line")


SOURCES = "CASE p_partkey % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'just' WHEN 2 THEN 'make' WHEN 3 THEN 'cargo' ELSE 'github' END"
PURPOSES = "CASE p_size % 7 WHEN 0 THEN 'dev' WHEN 1 THEN 'run' WHEN 2 THEN 'build' WHEN 3 THEN 'test' WHEN 4 THEN 'lint' WHEN 5 THEN 'ci' ELSE 'format' END"


@query(
    f"WITH c AS (SELECT p_name AS name, p_partkey AS k, {SOURCES} AS source, {PURPOSES} AS purpose FROM part), f AS (SELECT purpose, arg_min('run ' || k, (CASE source WHEN 'package.json' THEN 1 WHEN 'just' THEN 2 WHEN 'make' THEN 3 ELSE 4 END, name, k)) AS command FROM c "
    "WHERE source <> 'github' AND purpose <> 'ci' GROUP BY purpose) SELECT CASE WHEN purpose = 'dev' THEN 'run' ELSE purpose END AS slot, command FROM f WHERE purpose <> 'run' OR NOT EXISTS (SELECT 1 FROM f g WHERE g.purpose = 'dev')"
)
def u7_suggested(s):
    found = s.part.selectExpr("concat(p_name, ' ', lpad(CAST(p_partkey AS STRING), 12, '0')) AS name", "concat('run ', CAST(p_partkey AS STRING)) AS command", f"{SOURCES} AS source", f"{PURPOSES} AS purpose")
    return configs.suggested(found)


# --- tokens, configurations, stores and streams

@query("SELECT p_partkey AS id, unnest(['getpart' || p_partkey || '_xy', 'get', 'part', '' || p_partkey, 'xy', 'next']) AS term FROM part")
def x4_code_tokens(s):
    text = F.concat(F.lit("getPart"), F.col("p_partkey").cast("string"), F.lit("_xy (next)"))
    return s.part.select(F.col("p_partkey").alias("id"), F.explode(tokens(text)).alias("term"))


COMMANDS = (
    "SELECT 'check' || p_partkey AS name, 'npm run check' || p_partkey AS command, 'package.json' AS source, 'run' AS purpose, p_partkey % 4 AS kind FROM part WHERE p_partkey % 4 = 0 "
    "UNION ALL SELECT 'build' || p_partkey, 'just build' || p_partkey, 'just', 'build', 1 FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'test' || p_partkey, 'make test' || p_partkey, 'make', 'test', 2 FROM part WHERE p_partkey % 4 = 2 "
    "UNION ALL SELECT 'serve' || p_partkey, 'serve' || p_partkey, 'python', 'dev', 3 FROM part WHERE p_partkey % 4 = 3"
)


@query(f"SELECT name, command, source, purpose FROM ({COMMANDS})")
def s19_commands(s):
    k = F.col("p_partkey").cast("string")
    by = lambda *options: F.element_at(F.array(*options), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = by(
        F.concat(F.lit('{"scripts": {"check'), k, F.lit('": "x"}}')), F.concat(F.lit("set x := 1\nbuild"), k, F.lit(" a:\n  echo\n")), F.concat(F.lit("X := 1\ntest"), k, F.lit(": dep\n\techo\n")),
        F.concat(F.lit('[project.scripts]\nserve'), k, F.lit(' = "a:b"\n')),
    )
    file = by(*map(F.lit, ("package.json", "justfile", "Makefile", "pyproject.toml")))
    return configs.commands(s.part.select(F.concat(F.lit("d"), k, F.lit("/"), file).alias("path"), text.alias("content"))).select("name", "command", "source", "purpose")


@query("SELECT 'doc/' || doc_id || '.md' AS path, length(text) AS n FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '2%' OR doc_id = 7")
def s21_artifact_files(s):
    return configs.resolve_artifact(s.chunk_files, ["doc/2*.md", "doc/7.md"]).select("path", F.length("content").alias("n"))


def _place(s, name: str) -> str:
    return f"{shared_dir(s.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'hint' END AS severity, 'u' || user_id || '.rs' AS file, count(*) AS n, min(event_id) AS first FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2")
def s17_clippy_report(s):
    spot = lambda main, line: f"named_struct('file_name', concat('u', CAST(user_id AS STRING), '.rs'), 'line_start', {line}, 'line_end', 1, 'column_start', 1, 'column_end', 2, 'is_primary', {main})"
    rows = s.events.selectExpr(
        "CASE WHEN event_id % 5 = 0 THEN 'build-finished' ELSE 'compiler-message' END AS reason",
        f"named_struct('level', CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' ELSE 'help' END, 'message', 'm', 'code', named_struct('code', 'c'), 'spans', array({spot('false', 0)}, {spot('true', 'CAST(event_id AS INT)')})) AS message",
    )
    at = _place(s, "clippy")
    rows.write.json(at)
    return tools.clippy(s.spark, at).groupBy("severity", "file").agg(F.count("*").alias("n"), F.min("line").alias("first"))


@query("SELECT CAST(p_partkey % 5 AS INT) AS app, p_partkey AS k, CASE WHEN p_partkey % 5 IN (1, 3) THEN 'new' ELSE 'old' END AS value FROM part WHERE p_partkey % 5 NOT IN (1, 3) OR p_size < 20")
def k7_replace_by_app(s):
    at = _place(s, "apps")
    rows = s.part.select((F.col("p_partkey") % 5).cast("int").alias("app"), F.col("p_partkey").alias("k"), F.lit("old").alias("value"), "p_size")
    replace_partition(rows.drop("p_size"), at, "app")
    replace_partition(rows.where("app IN (1, 3) AND p_size < 20").withColumn("value", F.lit("new")).drop("p_size"), at, "app")
    return s.spark.read.schema("app int, k long, value string").parquet(at).select("app", "k", "value")


@query("SELECT p_partkey AS k, p_size + 1 AS v FROM part WHERE p_size > 25")
def k8_replaced_table(s):
    at = _place(s, "table")
    replace_table(s.part.selectExpr("p_partkey AS k", "p_size AS v"), at)
    replace_table(s.spark.read.parquet(at).where("v > 25").selectExpr("k", "v + 1 AS v"), at)
    return s.spark.read.parquet(at)


@query(
    "+ b AS (SELECT min(day) AS x, max(day) AS y FROM daily), o AS (SELECT user_key, n, total FROM daily, b WHERE day = x), p AS (SELECT user_key, n, total FROM daily, b WHERE day = y) "
    "SELECT round((SELECT sum(total) FROM p) - (SELECT sum(total) FROM o), 4) AS score_delta, (SELECT count(*) FROM o FULL JOIN p ON o.user_key = p.user_key WHERE o.n IS NULL OR p.n IS NULL OR p.n > o.n) AS changes",
    "daily",
)
def c11_drift(s):
    ends = s.daily.agg(F.min("day").alias("x"), F.max("day").alias("y"))
    shots = s.daily.groupBy("day").agg(F.sum("total").alias("score"), F.collect_list(F.struct(F.lit("f").alias("file"), F.col("user_key").cast("string").alias("name"), F.col("n").cast("int").alias("cyclomatic"))).alias("hot_functions"))
    shots = shots.select(F.unix_date(F.to_date("day")).cast("long").alias("id"), F.col("day").alias("ts"), "score", *[F.lit(0.0).alias(a) for a in ("complexity", "acyclicity", "dead_code", "coupling")], "hot_functions")
    first, last = ends.first()
    d = state.drift(state.as_of(shots, F.lit(first)), state.as_of(shots, F.lit(last)))
    return d["scores"].crossJoin(d["functions"].agg(F.count("*").alias("changes"))).select(F.round("score_delta", 4).alias("score_delta"), "changes")  # one row each


@query(
    f"+ k AS (SELECT {MODULE.format(c='id')} AS module, count(*) AS n FROM nodes GROUP BY 1), m AS (SELECT module, n, 'm' || (row_number() OVER (ORDER BY module) - 1) AS id FROM k), "
    f"e AS (SELECT {MODULE.format(c=FROM)} AS a, {MODULE.format(c=TO)} AS b FROM edges), w AS (SELECT a, b, count(*) AS n FROM e WHERE a <> b GROUP BY 1, 2) "
    "SELECT 'graph LR' AS line UNION ALL SELECT '  ' || id || '[\"' || module || ' (' || n || ')\"]' FROM m UNION ALL SELECT '  ' || x.id || CASE WHEN w.n = 1 THEN ' --> ' ELSE ' -->|' || w.n || '| ' END || y.id FROM w JOIN m x ON x.module = a JOIN m y ON y.module = b",
    "nodes", "edges",
)
def c16_architecture(s):
    from lodestrata.plans.engine import mermaid

    nodes, edges = graph.module_graph(s.nodes, s.edges)
    rows = nodes.orderBy("module").collect()  # modules are few
    name = {r.module: r.id for r in rows}
    text = mermaid([(r.id, f"{r.module} ({r.file_count})") for r in rows], [(name[e.source], name[e.target], e.weight) for e in edges.orderBy("source", "target").collect()])
    return s.spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query(
    "WITH e AS (SELECT 'u' || (user_id % 50) AS project, event_type AS path, substr(props, 1, 7) AS hash, min(event_id) AS k FROM events GROUP BY user_id % 50, event_type, substr(props, 1, 7), ts), l AS (SELECT *, lag(hash) OVER (PARTITION BY project, path ORDER BY k) AS old FROM e) "
    "SELECT project, path, CASE WHEN old IS NULL THEN 'added' ELSE 'changed' END AS change, count(*) AS n FROM l WHERE old IS NULL OR old <> hash GROUP BY 1, 2, 3"
)
def z3_stream_of_changes(s):
    """The stateful stream over a folder of events, until all that is there is read."""
    e = s.events.groupBy((F.col("user_id") % 50).alias("u"), "event_type", F.substring("props", 1, 7).alias("hash"), "ts").agg(F.min("event_id").alias("k"))
    rows = e.select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("project"), F.col("event_type").alias("path"), "hash", F.timestamp_seconds("k").alias("ts"))
    at = _place(s, "events")
    rows.write.parquet(f"{at}/in")
    stream = s.spark.readStream.schema(watch.EVENTS).parquet(f"{at}/in")
    sink = watch.changes(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    sink.awaitTermination()
    out = s.spark.read.schema("project string, path string, change string, hash string, ts timestamp").parquet(f"{at}/out")
    return out.groupBy("project", "path", "change").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT language FROM units WHERE code OR language IN ('json', 'markdown')", "units")
def z5_languages_of_a_batch(s):
    seen: list[str] = []
    watch.languages_batch(seen.extend)(s.code.select("path"), 0)
    return s.spark.createDataFrame([(x,) for x in seen], "language string")
