"""The engine over one source tree (and over a fleet of them): the operators put together.

Relations are lazy frames, written once where several answers read them; only what is rendered comes to the driver, a
page at a time.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions import paths, scores
from lodestrata.functions.text import code_tokens, tokens
from lodestrata.operators import fleet, graph, history, metrics, resolve, rules, search, state, symbols, testmap
from lodestrata.operators.segments import Index
from lodestrata.schemas import RELATIONS
from lodestrata.sources import configs, files as file_source, git, imports, scip, tools
from lodestrata.storage import discard, exists, read_or_empty, replace_partition, replace_table, saved

# Endings of suggested tests, budgets of a pack in tokens, its sections, and below the titles of next actions.
SUFFIXES = ("_happy_path", "_handles_empty_input", "_returns_error_on_invalid_input")
MIN_BUDGET, BUDGET, RESERVE = 500, 4000, 200
FOCUS = ("hot", "untested", "recent_changes", "architecture")


def next_actions(violations: DataFrame | None, gaps: DataFrame, hot: DataFrame, todos: DataFrame | None, limit: int = 8) -> DataFrame:
    """(category, target, score, title): rule violations, test gaps, hotspots and open notes, the most urgent first."""
    parts = []
    if violations is not None:
        parts.append(violations.limit(5).select(F.lit("rules_violation").alias("category"), F.coalesce("file", F.lit("")).alias("target"), F.lit(0.95).alias("score"), F.format_string("Fix `%s` violation: %s", "rule", "summary").alias("title"), F.lit(1).alias("k")))
    five = gaps.orderBy(F.desc("total_cyclomatic"), F.desc("loc"), "source").limit(5)
    parts.append(five.select(F.lit("test_gap").alias("category"), F.col("source").alias("target"), F.least(F.lit(0.9), 0.4 + F.least(F.lit(0.5), F.col("total_cyclomatic") / 200)).alias("score"), F.format_string("Add tests for `%s` (cc=%d, %d fns, untested)", "source", "total_cyclomatic", "function_count").alias("title"), F.lit(2).alias("k")))
    three = hot.orderBy(F.desc("score"), F.desc("churn"), "path").limit(3)
    parts.append(three.select(F.lit("hotspot").alias("category"), F.col("path").alias("target"), F.least(F.lit(0.85), 0.3 + F.least(F.lit(0.4), F.col("churn") / 100)).alias("score"), F.format_string("Review hotspot `%s` (%d commits × cc %d)", "path", "churn", "complexity").alias("title"), F.lit(3).alias("k")))
    if todos is not None:
        parts.append(todos.limit(5).select(F.lit("pinned_todo").alias("category"), F.col("id").cast("string").alias("target"), F.lit(0.5).alias("score"), F.concat(F.lit("Resolve pinned todo: "), F.substring("content", 1, 70)).alias("title"), F.lit(4).alias("k")))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "k", "target").limit(limit).drop("k")


#: Functions of a file that tests are suggested for.
SUGGESTED = 8


def first_functions(functions: DataFrame, n: int = SUGGESTED) -> DataFrame:
    """The first n functions of each file."""
    place = F.row_number().over(W.partitionBy("file").orderBy("start_line", "name"))
    return functions.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def test_names(functions: DataFrame) -> DataFrame:
    """(file, test): three suggested tests for each function."""
    base = F.lower(F.regexp_replace("name", "^_+", ""))
    return functions.select("file", F.explode(F.array(*[F.concat(base, F.lit(x)) for x in SUFFIXES])).alias("test"))


def mermaid(nodes: list[tuple[str, str]], edges: list[tuple[str, str, int | None]]) -> str:
    """A flow chart of (id, label) and (from, to, weight)."""
    out = ["graph LR"]
    out += [f'  {i}["{label.replace(chr(34), chr(39))}"]' for i, label in nodes]
    out += [f"  {a} --> {b}" if w in (None, 1) else f"  {a} -->|{w}| {b}" for a, b, w in edges]
    return "\n".join(out) + "\n"


class Engine:
    """Answers about the tree at root; as_of stands for now."""

    def __init__(self, spark: SparkSession, root: str, as_of: datetime | None = None, store: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        self.store = (store or f"{self.root}/.lodestrata").rstrip("/")

    def close(self) -> None:
        """Deletes what the answers so far have written in the shared folder; their frames can't be read any more."""
        for name, kind in vars(type(self)).items():
            if isinstance(kind, cached_property):
                vars(self).pop(name, None)
        discard(self.spark)

    # relations

    @cached_property
    def tree(self) -> DataFrame:
        return saved(file_source.read_tree(self.spark, self.root), "tree")

    @cached_property
    def files(self) -> DataFrame:
        return saved(file_source.inventory(self.tree), "files")

    @cached_property
    def raw_edges(self) -> DataFrame:
        return saved(imports.import_edges(self.tree), "imports")

    @cached_property
    def functions(self) -> DataFrame:
        return saved(file_source.functions_of(self.tree), "functions")

    @cached_property
    def surface(self) -> DataFrame:
        return saved(file_source.surface_of(self.tree), "surface")

    @cached_property
    def config(self) -> dict:
        text = lambda name: configs.read_text(self.spark, f"{self.root}/{name}")
        manifests = {r.path: r.content for r in self.tree.where(F.col("path").endswith("Cargo.toml")).select("path", "content").collect()}  # one a crate
        mods = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "go.mod").load(self.root).select("path", F.decode("content", "UTF-8").alias("c")).collect()
        at = len(self.root.split("://")[-1]) + 1
        modules = {r.path[r.path.index(self.root.split("://")[-1]) + at :]: r.c for r in mods}
        return {
            "aliases": configs.ts_aliases(text("tsconfig.json")) or configs.ts_aliases(text("jsconfig.json")),
            "crates": configs.rust_crates(manifests), "modules": configs.go_modules(modules),
        }

    @cached_property
    def graph(self) -> dict[str, DataFrame]:
        g = resolve.build_graph(self.files, self.raw_edges, **self.config)
        edges = saved(g["edges"], "edges")
        nodes = saved(graph.entry_depths(g["nodes"], edges), "nodes")
        return {"nodes": nodes, "edges": edges, "unresolved": g["unresolved"]}

    @cached_property
    def cycles(self) -> DataFrame:
        return saved(graph.find_cycles(self.graph["edges"]), "cycles")

    @cached_property
    def metrics(self) -> DataFrame:
        return saved(metrics.file_metrics(self.functions), "metrics")

    @cached_property
    def commits(self) -> DataFrame:
        return saved(git.log(self.spark, self.root), "commits")

    def stats(self, days: int = 90) -> DataFrame:
        return history.file_stats(self.commits, self.as_of, days)

    @cached_property
    def owners(self) -> DataFrame:
        text = next((t for p in configs.OWNER_PLACES if (t := configs.read_text(self.spark, f"{self.root}/{p}"))), None)
        return configs.owner_rules(self.spark, text)

    @cached_property
    def test_map(self) -> DataFrame:
        inline = self.tree.where(paths.has_inline_tests(F.col("language"), F.col("content"))).select("path")
        return saved(testmap.mappings(self.graph["edges"], inline), "tests")

    # answers: structure

    def scan(self) -> DataFrame:
        return metrics.language_summary(self.files)

    def quality(self) -> DataFrame:
        return metrics.quality(self.functions, self.graph["nodes"], self.cycles)

    def issues(self) -> DataFrame:
        return metrics.top_issues(self.functions, self.cycles, self.graph["nodes"])

    def analyze(self) -> dict[str, DataFrame]:
        return {
            "files": self.files, "import_edges": self.raw_edges, "nodes": self.graph["nodes"], "edges": self.graph["edges"], "functions": self.functions,
            "file_metrics": self.metrics, "cycles": self.cycles, "quality": self.quality(), "issues": self.issues(),
        }

    def hotspots(self, days: int = 90, limit: int | None = 40) -> DataFrame:
        hot = history.hotspots(self.stats(days), self.metrics, limit)
        hot = hot.join(history.top_authors(self.commits, self.as_of, days), "path", "left")
        return hot.join(history.owners_of(hot.select("path"), self.owners), "path", "left")

    def test_gaps(self, limit: int = 25) -> DataFrame:
        return testmap.top_gaps(testmap.gaps(self.files, self.test_map, self.metrics), limit)

    def coverage(self) -> DataFrame:
        return testmap.summary(self.files, self.test_map)

    def file_dsm(self, file: str) -> dict[str, DataFrame]:
        return graph.file_dsm(file, self.graph["nodes"], self.graph["edges"], self.raw_edges, self.functions)

    def snippet(self, file: str, line: int, radius: int = 25) -> DataFrame:
        return file_source.snippet_at(self.tree, file, line, radius)

    def markers(self, limit: int = 500) -> DataFrame:
        return file_source.markers(self.tree, limit)

    def rules_check(self) -> DataFrame:
        config = configs.load_toml(configs.read_text(self.spark, f"{self.store}/rules.toml"))
        return rules.evaluate(config, self.graph["edges"], self.functions, self.graph["nodes"], self.surface)

    def architecture(self, depth: int = 2, top: int = 200) -> str:
        """The modules of most files, and the edges among them."""
        nodes, edges = graph.module_graph(self.graph["nodes"], self.graph["edges"], depth)
        shown = nodes.orderBy(F.desc("file_count"), "module").limit(top)
        rows = shown.orderBy("module").collect()
        name = {r.module: r.id for r in rows}
        edges = edges.join(shown.select(F.col("module").alias("source")), "source", "left_semi").join(shown.select(F.col("module").alias("target")), "target", "left_semi")
        return mermaid([(r.id, f"{r.module} ({r.file_count})") for r in rows], [(name[e.source], name[e.target], e.weight) for e in edges.orderBy("source", "target").collect()])

    def file_architecture(self, top: int = 60) -> str:
        nodes, edges = graph.file_graph(self.graph["nodes"], self.graph["edges"], top)
        name = {r.id: f"f{i}" for i, r in enumerate(nodes.orderBy("id").collect())}
        return mermaid([(v, k) for k, v in name.items()], [(name[e.source], name[e.target], None) for e in edges.orderBy("source", "target").collect()])

    def commands(self) -> tuple[DataFrame, DataFrame]:
        """All workspace commands, and the suggested ones."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{package.json,Cargo.toml,config.toml,justfile,Justfile,.justfile,Makefile,makefile,GNUmakefile,pyproject.toml,*.yml,*.yaml}").load(self.root)
        found = configs.commands(raw.where(~F.col("path").contains("/node_modules/")).select("path", F.decode("content", "UTF-8").alias("content")))
        return found, configs.suggested(found)

    # answers: changes

    def diff(self, base: str | None = None, head: str = "HEAD") -> dict[str, DataFrame]:
        changed = saved(git.diff(self.spark, self.root, base, head), "diff")
        hot = history.hotspots(self.stats(), self.metrics)
        gaps = testmap.gaps(self.files, self.test_map, self.metrics)
        return {"files": changed} | history.overlay(changed, hot, gaps, self.surface, self.owners)

    def explain(self, base: str = "HEAD~5", head: str = "HEAD", limit: int = 10) -> DataFrame:
        changed = git.diff(self.spark, self.root, base, head)
        return history.explain(changed, history.hotspots(self.stats(), self.metrics), testmap.gaps(self.files, self.test_map, self.metrics), limit)

    def recent_changes(self, window: str = "7d", prefix: str | None = None, limit: int = 50) -> DataFrame:
        stats = self.stats(scores.window_days(window))
        return history.recent_changes(stats, history.hotspots(self.stats(), self.metrics), self.test_map, prefix, limit)

    # answers: composed

    def brief(self) -> str:
        q = self.quality().select("*", scores.grade(F.col("score")).alias("grade")).first()
        langs = self.scan().orderBy(F.desc("loc"), "language").limit(4).collect()
        shown = lambda v: "n/a" if v is None else f"{v:.0f}"
        out = ["# Brief", "", "## Languages", *[f"- {r.language}: {r.files} files, {r['loc']} lines" for r in langs], ""]
        out += [f"## Quality: {shown(q.score)} ({q.grade})", *[f"- {a}: {shown(q[a])}" for a in metrics.WEIGHTS], ""]
        out += ["## Hotspots", *[f"- {r.path}: {r.churn} commits, complexity {r.complexity}" for r in history.hotspots(self.stats(), self.metrics, 3).orderBy(F.desc("score"), "path").collect()], ""]
        out += ["## Untested", *[f"- {r.source}: complexity {r.total_cyclomatic}" for r in self.test_gaps(3).collect()], ""]
        marks = self.markers(None).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").collect()
        out += ["## Markers", *[f"- {r.kind}: {r.n}" for r in marks], ""]
        out += ["## Entry points", *[f"- {r.id}" for r in self.graph["nodes"].where("is_entry_point").orderBy("id").limit(8).collect()], ""]
        cycle = self.cycles.orderBy("size", "nodes").first()
        if cycle:
            out += ["## Smallest cycle", "- " + " → ".join(cycle.nodes[:6]), ""]
        out += ["## Complex functions", *[f"- {r.file}:{r.start_line} {r.name} (cc {r.cyclomatic})" for r in metrics.top_functions(self.functions, limit=3).collect()]]
        return "\n".join(out) + "\n"

    def pack(self, budget: int = BUDGET, focus: str | None = None) -> dict:
        """Sections until the token budget is full: those that don't fit are passed over, and packing stops near the end."""
        budget = max(MIN_BUDGET, budget)
        sections = [("brief", self.brief())]
        hot = [r.path for r in history.hotspots(self.stats(), self.metrics, 5).collect()]
        gaps = [r.source for r in self.test_gaps(5).collect()]
        recent = [r.path for r in self.recent_changes(limit=5).select("path").collect()]
        groups = {"hot": hot, "untested": gaps, "recent_changes": recent, "architecture": []}
        for kind in [focus] if focus in FOCUS else FOCUS[:3]:
            for p in groups[kind]:
                row = self.tree.where(F.col("path") == p).select("content").first()
                if row:
                    sections.append((f"{kind}: {p}", f"```\n{row.content}\n```\n"))
        if focus in (None, "architecture"):
            sections.append(("architecture", self.architecture()))
        out, left, used = [], budget, set()
        for title, body in sections:
            size = -(-len(body.encode()) * (2 if "```" in body else 1) // (7 if "```" in body else 4))
            if left < RESERVE:
                break
            if size <= left and title.split(": ")[-1] not in used:
                used.add(title.split(": ")[-1])
                out.append(f"## {title}\n{body}")
                left -= size
        return {"text": "\n".join(out), "tokens": budget - left, "budget": budget, "sections": len(out)}

    def function_detail(self, file: str, name: str) -> dict:
        f = self.functions.where((F.col("file") == file) & (F.col("name") == name)).orderBy("start_line").first()
        if not f:
            raise KeyError(f"{file}::{name}")
        tests = self.test_map.where(F.col("source") == file).first()
        churn = self.stats(90).where(F.col("path") == file).first()
        text = self.tree.where(F.col("path") == file).select(F.array_join(F.slice(search.lines_of(F.col("content")), f.start_line, f.end_line - f.start_line + 1), "\n").alias("t")).first()
        out = {"function": f.asDict(), "snippet": text.t, "tests": tests.tests if tests else [], "churn": churn.commits_in_window if churn else 0, "callers": []}
        if self.occurrences is not None:
            s = symbols.symbol_of_function(self.occurrences, self.symbol_info, file, name).first()
            out["callers"] = [r.asDict() for r in symbols.callers(self.calls, s.symbol).collect()] if s else []
        return out

    def describe(self, target: str) -> dict:
        """A file, a directory, or else a hint at symbols."""
        row = self.graph["nodes"].where(F.col("id") == target).first()
        if row:
            m = self.metrics.where(F.col("path") == target).first()
            return {"kind": "file", "node": row.asDict(), "metrics": m.asDict() if m else None, "functions": [r.asDict() for r in metrics.top_functions(self.functions, limit=10, file=target).collect()]}
        inside = self.files.where(F.col("path").startswith(target.rstrip("/") + "/"))
        size = inside.agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).first()
        if size.files:
            top = self.metrics.where(F.col("path").startswith(target.rstrip("/") + "/")).orderBy(F.desc("total_cyclomatic"), "path").limit(5)
            return {"kind": "directory", "files": size.files, "loc": size["loc"], "top": [r.asDict() for r in top.collect()]}
        names = self.functions.where(F.lower("name").contains(target.lower())).select("file", "name", "start_line").orderBy("name", "file").limit(10)
        return {"kind": "symbol", "matches": [r.asDict() for r in names.collect()]}

    def suggest_tests(self, target: str) -> dict:
        language = next((v for k, v in paths.LANGUAGES.items() if target.endswith("." + k)), None)
        has = lambda *names: any(exists(self.spark, f"{self.root}/{n}") for n in names)
        js = "vitest" if has("vitest.config.ts", "vitest.config.js", "vite.config.ts") else "jest" if has("jest.config.ts", "jest.config.js", "jest.config.json") else "vitest" if '"vitest"' in (configs.read_text(self.spark, f"{self.root}/package.json") or "") else "jest"
        framework = {"rust": "cargo_test", "go": "go_test", "python": "pytest", "typescript": js, "javascript": js}.get(language, "unknown")
        folder, _, base = target.rpartition("/")
        stem, _, ext = base.rpartition(".")
        file = {"rust": f"{target}  (add `#[cfg(test)] mod tests {{ ... }}` in-file)", "go": f"{folder}/{stem}_test.go", "python": f"{folder}/test_{stem}.py"}.get(language, f"{folder}/{stem}.test.{ext}" if js and language in ("typescript", "javascript") else f"{folder}/{stem}_test.unknown")
        first = first_functions(self.functions.where(F.col("file") == target)).orderBy("start_line", "name").collect()
        return {"language": language, "framework": framework, "file": file, "tests": [r["name"].lstrip("_").lower() + x for r in first for x in SUFFIXES]}

    def next_action(self, limit: int = 8) -> DataFrame:
        todos = state.list_notes(self.notes, kind="todo", limit=5)
        return next_actions(self.rules_check(), testmap.gaps(self.files, self.test_map, self.metrics), history.hotspots(self.stats(), self.metrics), todos, limit)

    # answers: search

    def index(self) -> Index:
        return Index.open(self.spark, f"{self.store}/index", token=tokens)

    def reindex(self) -> int:
        """Chunks, postings and vectors of files that are new or changed, as one commit; the number of all chunks."""
        index = self.index()
        new, gone = search.changed_files(self.tree.select("path", "language", "content"), index.known)
        new, gone = saved(new, "new"), saved(gone, "gone")
        if index.version and new.isEmpty() and gone.isEmpty():
            return index.size
        functions = self.functions.join(new.select(F.col("path").alias("file")), "file", "left_semi")
        return index.commit(search.numbered(search.chunk_files(new, functions)), new, gone, search.embed).size

    def sentinel(self) -> datetime | None:
        """The newest change of a file of the tree."""
        return self.tree.agg(F.max("modified")).first()[0]

    def index_status(self) -> dict:
        index = self.index()
        return {"newest": self.sentinel(), "chunks": index.size, "languages": [r.lang for r in index.chunks.select("lang").distinct().orderBy("lang").collect()], "state": "ready" if index.version else "empty"}

    def search_code(self, query: str, limit: int = 20, lang: str | None = None, kind: str | None = None) -> DataFrame:
        index = self.index()
        q = self.spark.createDataFrame([(0, "", "", query)], "id long, file string, name string, content string")
        near = search.dense(index.vectors, search.embed(q).first().embedding)
        return search.hydrate(search.fuse(index.bm25(code_tokens(query)), near), index.chunks, limit, lang, kind)

    def similar(self, file: str, limit: int = 10) -> DataFrame:
        index, row = self.index(), self.tree.where(F.col("path") == file).select("content").first()
        words = code_tokens(search.beginning(row.content if row else ""))
        none = self.spark.createDataFrame([], "id long, score double")
        return search.others(search.hydrate(search.fuse(index.bm25(words), none), index.chunks, max(limit + 5, 20)), file, limit)

    def context_list(self) -> DataFrame:
        return configs.artifacts(self.spark, configs.read_text(self.spark, f"{self.store}/artifacts.json"))

    def context_get(self, name: str) -> DataFrame:
        row = self.context_list().where(F.col("name") == name).first()
        return configs.resolve_artifact(self.tree, row.paths if row else [])

    def context_index(self) -> DataFrame | None:
        return search.artifact_chunks(self.context_list(), self.tree)

    def context_search(self, query: str, limit: int = 10) -> DataFrame:
        chunks = search.numbered(self.context_index())
        index = search.postings(chunks)
        return search.hydrate(search.fuse(search.bm25(index, code_tokens(query), chunks.count()), search.bm25(index, [], 1)), chunks, limit)

    def _table(self, name: str, schema: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.store}/{name}", schema)

    # answers: symbols

    @cached_property
    def _index(self):
        path = f"{self.store}/index.scip"
        return scip.read_indexes(self.spark, path) if exists(self.spark, path) else (None, None)

    @cached_property
    def occurrences(self) -> DataFrame | None:
        return saved(self._index[0], "occurrences") if self._index[0] is not None else None

    @property
    def symbol_info(self) -> DataFrame | None:
        return self._index[1]

    @cached_property
    def calls(self) -> DataFrame:
        return saved(symbols.call_edges(symbols.enclosing(self.occurrences)), "calls")

    def search_symbols(self, query: str, limit: int = 50) -> DataFrame:
        return symbols.find_symbols(self.occurrences, self.symbol_info, query, limit)

    def refs(self, symbol: str) -> DataFrame:
        return symbols.refs(self.occurrences, symbol)

    def callers(self, symbol: str) -> DataFrame:
        return symbols.callers(self.calls, symbol)

    def symbol_file(self, path: str) -> DataFrame:
        return symbols.file_summary(self.occurrences, path)

    def who_calls(self, symbol: str, depth: int = 3) -> dict:
        return symbols.impact(self.calls, self.occurrences, symbol, depth)

    def what_does_this_call(self, symbol: str, depth: int = 3) -> dict:
        return symbols.flow(self.calls, symbol, depth)

    def trace(self, symbol: str, direction: str = "both", hops: int = 3) -> dict:
        return symbols.trace(self.calls, symbol, direction, hops)

    def symbol(self, symbol: str) -> dict:
        return symbols.symbol_360(self.occurrences, self.calls, symbol)

    # answers: state

    @property
    def snapshots(self) -> DataFrame:
        return self._table("snapshots", RELATIONS["snapshots"])

    @property
    def pins(self) -> DataFrame:
        return self._table("pins", RELATIONS["pins"])

    @property
    def notes(self) -> DataFrame:
        return self._table("notes", RELATIONS["notes"])

    @property
    def links(self) -> DataFrame:
        return self._table("note_edges", RELATIONS["note_edges"])

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, RELATIONS[name]).coalesce(1).write.mode("append").parquet(f"{self.store}/{name}")

    @staticmethod
    def _new_id() -> int:
        return uuid.uuid4().int >> 66

    def snapshot(self) -> int:
        i = self._new_id()
        one = self.quality().crossJoin(state.hot_functions(self.functions))  # one row each
        one.select(F.lit(i).cast("long").alias("id"), F.lit(self.as_of).alias("ts"), "score", "complexity", "acyclicity", "dead_code", "coupling", "hot_functions").write.mode("append").parquet(f"{self.store}/snapshots")
        return i

    def drift(self, window: str = "7d") -> dict[str, DataFrame]:
        now = state.as_of(self.snapshots, F.lit(self.as_of))
        return state.drift(state.as_of(self.snapshots, F.lit(self.as_of - scores.drift_cutoff(window))), now)

    def pin(self, scope: str, target: str, note: str, ttl: str | None = None) -> int:
        i = self._new_id()
        self._append("pins", [(i, scope, target, note, self.as_of, self.as_of + scores.drift_cutoff(ttl) if ttl else None)])
        return i

    def unpin(self, id_: int) -> None:
        replace_table(saved(self.pins.where(F.col("id") != id_)), f"{self.store}/pins")

    def list_pins(self, scope: str | None = None) -> DataFrame:
        return state.live_pins(self.pins, self.as_of, scope)

    def remember(self, content: str, kind: str = "note", scope: str = "project", session_id: str | None = None, ttl_days: int | None = None, embedding: list[float] | None = None) -> int:
        i = self._new_id()
        self._append("notes", [(i, scope, kind, content, self.as_of, ttl_days, session_id, embedding)])
        return i

    def recall(self, query: str, vector: list[float] | None = None, limit: int = 20) -> tuple[str, DataFrame]:
        return state.recall_best(self.notes, query, vector, limit)

    def decisions(self, limit: int = 50) -> DataFrame:
        return state.list_notes(self.notes, kind="decision", limit=limit)

    def link(self, a: int, b: int, kind: str) -> None:
        replace_table(saved(state.link(self.links, a, b, kind)), f"{self.store}/note_edges")

    def note_links(self, id_: int, direction: str = "both") -> DataFrame:
        return state.note_links(self.links, id_, direction)

    def session_start(self) -> str:
        i = uuid.uuid4().hex
        self._append("sessions", [(i, self.as_of, None, None)])
        return i

    def session_end(self, id_: str, summary: str | None = None) -> DataFrame:
        s = self._table("sessions", RELATIONS["sessions"])
        end = F.col("id") == id_
        replace_table(saved(s.withColumn("ended_at", F.when(end, F.lit(self.as_of)).otherwise(F.col("ended_at"))).withColumn("summary", F.when(end, F.lit(summary)).otherwise(F.col("summary")))), f"{self.store}/sessions")
        return state.session_summary(self.notes, id_)

    # answers: diagnostics

    def _outputs(self) -> dict[str, str]:
        return {t: p for t in tools.READERS if exists(self.spark, p := f"{self.store}/diagnostics/{t}.json")}

    @cached_property
    def all_diagnostics(self) -> DataFrame:
        """Findings of all tools: the stored ones if they are as new as the tree and the tools' outputs, else read again and
        stored with the time of the newest."""
        outputs = self._outputs()
        found = [self.spark.read.format("binaryFile").load(p).select(F.col("modificationTime").alias("m")) for p in outputs.values()]
        newest = reduce(DataFrame.unionByName, [self.tree.select(F.col("modified").alias("m")), *found]).agg(F.max("m")).first()[0]
        path = f"{self.store}/diagnostics.cache"
        stored = read_or_empty(self.spark, path, RELATIONS["diagnostics"] + ", newest timestamp, tools array<string>")
        mark = stored.select("newest", "tools").first()
        if not mark or mark.newest != newest or mark.tools != sorted(outputs):
            rows = tools.read_all(self.spark, outputs)
            replace_table(rows.withColumn("newest", F.lit(newest)).withColumn("tools", F.array(*map(F.lit, sorted(outputs))).cast("array<string>")), path)
        return stored.drop("newest", "tools") if mark and mark.newest == newest and mark.tools == sorted(outputs) else read_or_empty(self.spark, path, RELATIONS["diagnostics"])

    def diagnostics(self, tool: str | None = None, severity: str | None = None, file: str | None = None, limit: int = 200) -> DataFrame:
        return tools.filtered(self.all_diagnostics, tool, severity, file, limit)

    def run_diagnostics(self, only: list[str] | None = None) -> DataFrame:
        """Runs the tools that are installed; root must be a folder of this machine."""
        done = tools.run_tools(self.spark, self.root, self.store, only)
        vars(self).pop("all_diagnostics", None)
        return done

    def diagnostics_status(self) -> DataFrame:
        return tools.tool_status(self.all_diagnostics, self._outputs())

    def components(self) -> DataFrame:
        return tools.components(self.spark, f"{self.store}/components.json")


class Fleet:
    """The same across projects: tables below store, partitioned by app."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.store}/{name}", RELATIONS[name])

    def sync(self, engines: dict[str, Engine]) -> None:
        """Replaces the rows of each app; one job a table for all of them."""
        app = lambda df, a: df.withColumn("app", F.lit(a))
        both = lambda make: reduce(DataFrame.unionByName, [app(make(e), a) for a, e in engines.items()])
        tables = {
            "fleet_surface": both(lambda e: e.surface.select("kind", "name", "method", "file", "line")),
            "fleet_hotspots": both(lambda e: history.hotspots(e.stats(), e.metrics, 100).select("path", "churn", F.col("complexity").cast("long").alias("complexity"), "score")),
            "fleet_test_mapping": both(lambda e: e.test_map.select("source", F.explode("tests").alias("test"))),
            "fleet_file_complexity": both(lambda e: e.metrics.select(F.col("path").alias("file"), "total_cyclomatic").join(e.files.select(F.col("path").alias("file"), F.col("loc").cast("long").alias("loc")), "file")),
            "apps": fleet.app_summary(both(lambda e: e.files)).withColumn("path", reduce(lambda c, x: F.when(F.col("app") == x[0], x[1].root).otherwise(c), engines.items(), F.lit(None).cast("string"))),
        }
        for name, df in tables.items():
            columns = [c.split()[0].strip("`") for c in RELATIONS[name].split(", ")]
            replace_partition(df.select(*columns), f"{self.store}/{name}", "app")

    def apps(self) -> DataFrame:
        return self._read("apps").orderBy("app")

    def info(self, app: str) -> DataFrame:
        return self.apps().where(F.col("app") == app)

    def find(self, pattern: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
        return fleet.find_surface(self._read("fleet_surface"), pattern, kind, limit)

    def hotspots(self, limit: int = 25) -> DataFrame:
        return fleet.top_hotspots(self._read("fleet_hotspots"), limit)

    def test_gaps(self, limit: int = 25) -> DataFrame:
        return fleet.top_test_gaps(self._read("fleet_file_complexity"), self._read("fleet_test_mapping"), limit)

    def diff(self, a: str, b: str) -> dict[str, DataFrame]:
        return fleet.surface_diff(self._read("fleet_surface"), a, b)
