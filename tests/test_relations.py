import os
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata import storage
from lodestrata.functions import paths, scores
from lodestrata.operators import fleet, graph, history, resolve, rules, search, state, symbols, testmap
from lodestrata.schemas import RELATIONS

NOW = datetime(2024, 6, 1)


def flags(spark, test, values):
    df = spark.createDataFrame([(v,) for v in values], "p string")
    return [r[0] for r in df.select(test(F.col("p"))).collect()]


def test_predicates(spark):
    assert flags(spark, paths.is_entry_point, ["vitest.setup.ts", "vite.config.ts", "jest.setup.js", "src/main.rs", "src/lib/helper.ts", "src/util.rs"]) == [True] * 4 + [False] * 2
    yes = ["conftest.py", "a/test_x.py", "a.test.ts", "b.spec.jsx", "x_test.rs", "y_test.go", "tests/a.rs", "src/__tests__/b.ts"]
    assert flags(spark, paths.is_test_file, [*yes, "src/lib.rs", "contest.py", "latest.ts"]) == [True] * 8 + [False] * 3
    assert flags(spark, lambda c: paths.group_key(c, 2), ["a.rs", "x/a.rs", "x/y/a.rs", "x/y/z/a.rs"]) == ["(root)", "x", "x/y", "x/y"]
    assert flags(spark, paths.normalize, ["a/./b/../c.ts", "../x", "a//b"]) == ["a/c.ts", "x", "a/b"]
    assert flags(spark, paths.is_watched, ["src/a.rs", "target/a.rs", "node_modules/x/a.ts", "Cargo.lock", "x/a.PY"]) == [True, False, False, False, True]
    assert flags(spark, paths.is_dead_code_exempt, ["lib.rs", "a/mod.rs", "x/src/bin/t.rs", "tests/a.rs", "a.test.tsx", "src/a.rs"]) == [True] * 5 + [False]


def test_commands_have_purposes(spark):
    rows = [("t", "cargo test"), ("l", "eslint ."), ("f", "prettier -w"), ("b", "tsc -p ."), ("d", "vite"), ("start", "node x"), ("x", "true")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, b string").select(scores.purpose(F.col("n"), F.col("b"))).collect()]
    assert got == ["test", "lint", "format", "build", "other", "dev", "other"]


def test_windows():
    assert [scores.window_days(w) for w in ("7d", "1h", "24h", "48h", "30m")] == [7, 1, 1, 2, 1]
    assert scores.drift_cutoff("30m") == timedelta(minutes=30)
    with pytest.raises(ValueError, match="no window"):
        scores.window_days("soon")


def test_hotspot_order(spark):
    stats = spark.createDataFrame([("a", 8, 80), ("b", 2, 30), ("c", 16, 30)], "path string, commits_in_window long, total_commits long").withColumn("last_edited", F.lit(NOW)).withColumn("last_author", F.lit("x"))
    mets = spark.createDataFrame([("a", 200, 1), ("b", 50, 1), ("c", 40, 1)], "path string, total_cyclomatic long, function_count long")
    got = [(r.path, round(r.score, 1)) for r in history.hotspots(stats, mets).collect()]
    assert got == [("a", 634.0), ("c", 163.5), ("b", 79.2)]


def test_authors_of_the_window(spark):
    rows = [("p", "Andy", 1)] * 3 + [("p", "Rita", 2)] + [("p", "Tom", 400)] * 50
    c = spark.createDataFrame([(str(i), p, a, NOW - timedelta(days=d)) for i, (p, a, d) in enumerate(rows)], "commit string, path string, author string, ts timestamp_ntz")
    top = history.top_authors(c, NOW).first().top_authors
    assert [(t.name, t.commits) for t in top] == [("Andy", 3), ("Rita", 1)]


def test_owners(spark):
    rules_ = [(0, "*", ["@all"]), (1, "/web/", ["@frontend"]), (2, "*.tsx", ["@frontend", "@design"]), (3, "crates/core/", ["@core"])]
    own = spark.createDataFrame(rules_, RELATIONS["owner_rules"])
    files = spark.createDataFrame([("web/src/App.tsx",), ("web/a.ts",), ("crates/core/x.rs",), ("readme.md",)], "path string")
    got = {r.path: r.owners for r in history.owners_of(files, own).collect()}
    assert got == {"web/src/App.tsx": ["@frontend", "@design"], "web/a.ts": ["@frontend"], "crates/core/x.rs": ["@core"], "readme.md": ["@all"]}


def test_test_map(spark):
    files = spark.createDataFrame([("src/lib.rs", "rust", 10), ("src/util.rs", "rust", 10), ("tests/lib_test.rs", "rust", 10)], "path string, language string, loc int")
    edges = spark.createDataFrame([("tests/lib_test.rs", "src/lib.rs", 1)], RELATIONS["graph_edges"])
    mets = spark.createDataFrame([("src/util.rs", 18, 2)], "path string, total_cyclomatic long, function_count long")
    covered = testmap.mappings(edges)
    gap = testmap.top_gaps(testmap.gaps(files, covered, mets)).collect()
    assert [(g.source, g.total_cyclomatic) for g in gap] == [("src/util.rs", 18)]
    s = testmap.summary(files, covered).first()
    assert (s.source_files, s.test_files, s.covered, s.gaps, s.coverage_pct) == (2, 1, 1, 1, 50.0)


def test_rules(spark):
    f = spark.createDataFrame([("src/a.rs", "ok", 1, 2, 1, 0, 5, 5, ""), ("src/x/b.rs", "hot", 1, 2, 1, 0, 20, 30, ""), ("other/c.rs", "far", 1, 2, 1, 0, 50, 5, "")], RELATIONS["functions"])
    cc = rules.complexity_cap(f, [{"glob": "src/**/*.rs", "max_cyclomatic": 10}]).collect()
    assert len(cc) == 1
    assert "cc 20" in cc[0].summary
    cog = rules.complexity_cap(f, [{"glob": "**/*.rs", "max_cognitive": 15}]).collect()
    assert ["cog 30" in v.summary for v in cog] == [True]
    n = spark.createDataFrame([("a.rs", "rust", False, 0), ("b.rs", "rust", False, 0), ("main.rs", "rust", True, 0), ("Cargo.toml", "toml", False, 0)], "id string, language string, is_entry_point boolean, in_degree long")
    assert "2 dead files" in rules.dead_code(n, 1).first().summary
    assert rules.dead_code(n, 2).count() == 0


def raw(spark, rows):
    return spark.createDataFrame([(a, b, k, 1, 0) for a, b, k in rows], "`from` string, `to` string, kind string, line int, k int")


@pytest.mark.parametrize(
    ("files", "edge", "target", "config"),
    [
        (["src/a.ts", "src/b.ts"], ("src/a.ts", "./b"), "src/b.ts", {}),
        (["src/a.ts", "src/lib/index.ts"], ("src/a.ts", "./lib"), "src/lib/index.ts", {}),
        (["crates/foo/src/lib.rs", "crates/foo/src/bar.rs"], ("crates/foo/src/lib.rs", "crate::bar"), "crates/foo/src/bar.rs", {}),
        (["crates/foo/src/a/b.rs", "crates/foo/src/c.rs"], ("crates/foo/src/a/b.rs", "super::c::D"), "crates/foo/src/c.rs", {}),
        (["src/lib.rs", "x/src/lib.rs"], ("src/lib.rs", "my_x::Y"), "x/src/lib.rs", {"crates": {"my_x": "x/src"}}),
        (["src/a.ts"], ("src/a.ts", "lodash"), None, {}),
        (["src/App.tsx", "src/components/widget.tsx"], ("src/App.tsx", "@/components/widget"), "src/components/widget.tsx", {}),
        (["main.go", "api/api.go", "api/helpers.go"], ("main.go", "example.com/proj/api"), "api/api.go", {"modules": {"example.com/proj": ""}}),
        (["main.go", "util/types.go", "util/helpers.go"], ("main.go", "example.com/proj/util"), "util/helpers.go", {"modules": {"example.com/proj": ""}}),
        (["main.go", "pkg/pkg_test.go", "pkg/impl.go"], ("main.go", "example.com/proj/pkg"), "pkg/impl.go", {"modules": {"example.com/proj": ""}}),
        (["main.go", "sub/x/x.go", "x.go"], ("main.go", "example.com/proj/sub/x"), "sub/x/x.go", {"modules": {"example.com/proj": "", "example.com/proj/sub": "sub"}}),
        (["a/b.py", "a/c/__init__.py"], ("a/b.py", "a.c"), "a/c/__init__.py", {}),
        (["a/b.py", "a/d.py"], ("a/b.py", ".d"), "a/d.py", {}),
    ],
)
def test_resolution(spark, files, edge, target, config):
    f = spark.createDataFrame([(p, 10, 100) for p in files], "path string, loc int, bytes long").withColumn("language", paths.language(F.col("path")))
    g = resolve.build_graph(f, raw(spark, [(*edge, "import")]), **config)
    assert [r.to for r in g["edges"].collect()] == ([target] if target else [])
    assert g["unresolved"].count() == (0 if target else 1)


OCC = [
    ("lib.rs", 0, "foo#", True, 1, 3, 1, 6, 1, 0, 10, 0), ("lib.rs", 1, "helper#", False, 5, 4, 5, 10, None, None, None, None), ("lib.rs", 2, "bar#", True, 12, 3, 12, 6, 12, 0, 20, 0),
    ("lib.rs", 3, "helper#", False, 14, 4, 14, 10, None, None, None, None), ("lib.rs", 4, "helper#", False, 14, 20, 14, 26, None, None, None, None),
    ("lib.rs", 5, "foo#", False, 16, 4, 16, 7, None, None, None, None), ("util.rs", 0, "helper#", True, 1, 3, 1, 9, 1, 0, 5, 0),
]


def test_symbols(spark):
    occ = spark.createDataFrame(OCC, RELATIONS["occurrences"])
    calls = symbols.call_edges(symbols.enclosing(occ)).cache()
    assert symbols.refs(occ, "helper#").agg(F.sum("n")).first()[0] == 3
    assert [(r.symbol, r.sites) for r in symbols.callers(calls, "helper#").collect()] == [("bar#", 2), ("foo#", 1)]
    s = symbols.file_summary(occ, "lib.rs").first()
    assert (s.definitions, s.outgoing, s.incoming) == (2, 4, 0)
    i = symbols.impact(calls, occ, "helper#", 3)
    assert {n["symbol"] for n in i["nodes"]} == {"foo#", "bar#"}
    assert i["files"] == ["lib.rs"]
    assert "helper#" in {n["symbol"] for n in symbols.flow(calls, "foo#", 2)["nodes"]}
    assert [d["doc"] for d in symbols.symbol_360(occ, calls, "helper#")["definitions"]] == ["util.rs"]
    assert {(e["caller"], e["callee"]) for e in symbols.trace(calls, "helper#", hops=2)["edges"]} == {("foo#", "helper#"), ("bar#", "helper#"), ("bar#", "foo#")}
    star = spark.createDataFrame([(f"c{i:03d}", "hub", 1) for i in range(201)], "caller string, callee string, sites long")
    w = symbols.walk(star, "hub", True)
    assert (len(w["nodes"]), w["truncated"]) == (200, True)


def test_tightest_definition_wins(spark):
    rows = [("d", 0, "out", True, 0, 0, 0, 1, 0, 0, 100, 0), ("d", 1, "in", True, 10, 0, 10, 1, 10, 0, 20, 0), ("d", 2, "x", False, 15, 0, 15, 1, None, None, None, None), ("d", 3, "y", False, 600, 0, 600, 1, None, None, None, None)]
    occ = spark.createDataFrame(rows, RELATIONS["occurrences"])
    assert [(r.callee, r.caller) for r in symbols.enclosing(occ, bucket=4).collect()] == [("x", "in")]


def chunks(spark, rows):
    return search.numbered(spark.createDataFrame(rows, "file string, lang string, kind string, name string, start_line int, end_line int, content string"))


def test_search(spark):
    files = spark.createDataFrame([("a.toml", "toml", "\n".join(f"k{i} = {i}" for i in range(150))), ("e.md", "markdown", ""), ("c.md", "markdown", "x\r\ny\n")], "path string, language string, content string")
    w = search.window_chunks(files).orderBy("file", "start_line").collect()
    assert [(r.file, r.start_line, r.end_line) for r in w] == [("a.toml", 1, 60), ("a.toml", 51, 110), ("a.toml", 101, 150), ("c.md", 1, 2)]
    c = chunks(spark, [("a.rs", "rust", "function", "parseScipIndex", 1, 2, "fn parseScipIndex() {}"), ("b.rs", "rust", "function", "other", 1, 2, "fn other() {}")])
    hits = search.search(c, search.postings(c), "scip parse").collect()
    assert [h.file for h in hits] == ["a.rs"]
    assert search.similar(c, search.postings(c), "a.rs", "fn parseScipIndex() other").first().file == "b.rs"


def test_tokens():
    from lodestrata.functions.text import code_tokens, stem

    t = code_tokens("parseScipIndex parse_scip_index loadSCIP42")
    assert {"parse", "scip", "index", "42", "parsescipindex"} <= set(t)
    assert "größe" in code_tokens("Größe naïve 日本")
    words = "caresses ponies ties cats hopping hoped relational conditional rationalize triplicate hopeful goodness adjustment running generously flies"
    assert [stem(w) for w in words.split()] == "caress poni tie cat hop hope relat condit ration triplic hope good adjust run generous fli".split()


def test_fusion_and_cosine(spark):
    both = search.fuse(spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, score double"), spark.createDataFrame([(1, 0.9), (3, 0.1)], "id long, score double"))
    assert both.orderBy(F.desc("score")).first().id == 1
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, None)], "chunk_id long, embedding array<float>")
    assert [(r.id, r.score) for r in search.dense(v, [1.0, 0.0, 0.0]).collect()] == [(1, 1.0), (2, 0.0)]


def test_incremental_is_full(spark):
    old = spark.createDataFrame([("a.md", "markdown", "one"), ("b.md", "markdown", "two"), ("c.md", "markdown", "three")], "path string, language string, content string")
    new = spark.createDataFrame([("a.md", "markdown", "one"), ("b.md", "markdown", "2"), ("d.md", "markdown", "four")], "path string, language string, content string")
    none = spark.createDataFrame([], RELATIONS["functions"])
    empty = spark.createDataFrame([], RELATIONS["chunks"])
    known = spark.createDataFrame([], "path string, hash string")
    c, k = search.reindex(empty, old, none, known)
    inc, _ = search.reindex(c, new, none, k)
    fresh, _ = search.reindex(empty, new, none, known)
    key = lambda d: sorted((r.file, r.content) for r in d.collect())
    assert key(inc) == key(fresh)


def test_state(spark):
    notes = spark.createDataFrame(
        [(1, "file", "decision", "use rusqlite for state", NOW, None, "s", [1.0, 0.0]), (2, "project", "decision", "other things", NOW, None, "s", None), (3, "file", "gotcha", "state is odd", NOW, None, "s", [0.0, 1.0])], RELATIONS["notes"]
    )
    assert state.list_notes(notes, kind="decision").count() == 2
    assert state.list_notes(notes, scope="file").count() == 2
    first = state.recall(notes, "rusqlite state").first()
    assert (first.id, first.score) == (1, 1.0)
    assert [r.id for r in state.recall_dense(notes, [1.0, 0.1]).collect()] == [1, 3]
    assert {r.kind: r.n for r in state.session_summary(notes, "s").collect()} == {"decision": 2, "gotcha": 1}
    e = spark.createDataFrame([], RELATIONS["note_edges"])
    once = state.link(e, 1, 2, "supersedes")
    assert state.link(once, 1, 2, "supersedes").count() == 1
    with pytest.raises(ValueError, match="no kind"):
        state.link(e, 1, 2, "hates")
    pins = spark.createDataFrame([(1, "a", "t", "n", NOW, NOW + timedelta(days=1)), (2, "a", "t", "n", NOW, NOW - timedelta(days=1)), (3, "b", "t", "n", NOW, None)], RELATIONS["pins"])
    assert {r.id for r in state.live_pins(pins, NOW).collect()} == {1, 3}


def test_scan_delta(spark):
    t = lambda *r: spark.createDataFrame(list(r), "path string, hash string")
    kinds = lambda d: {r.path: r.change for r in d.collect()}
    assert kinds(state.scan_delta(t(), t(("a", "1")))) == {"a": "added"}
    assert kinds(state.scan_delta(t(("a", "1")), t(("a", "1")))) == {}
    assert kinds(state.scan_delta(t(("a", "1"), ("b", "1")), t(("a", "2")))) == {"a": "changed", "b": "removed"}
    assert kinds(state.scan_delta(t(("a", "1"), ("b", "1")), t(("a", "2")), full_scan=False)) == {"a": "changed"}
    d = state.scan_delta(t(("a", "1"), ("b", "1")), t(("a", "2")))
    assert [(r.path, r.hash) for r in state.commit_delta(t(("a", "1"), ("b", "1")), d).collect()] == [("a", "2")]


def test_as_of_and_drift(spark):
    hot = lambda *r: [dict(zip(("file", "name", "cyclomatic"), x)) for x in r]
    s = spark.createDataFrame([(1, NOW, 80.0, 1.0, 1.0, 1.0, 1.0, hot(("a", "f", 9), ("a", "g", 9))), (2, NOW + timedelta(days=2), 70.0, 1.0, 1.0, 1.0, None, hot(("a", "f", 12), ("b", "h", 8)))], RELATIONS["snapshots"])
    at = lambda t: [r.id for r in state.as_of(s, F.lit(t)).collect()]
    assert (at(NOW - timedelta(1)), at(NOW), at(NOW + timedelta(1)), at(NOW + timedelta(9))) == ([], [1], [1], [2])
    d = state.drift(state.as_of(s, F.lit(NOW)), state.as_of(s, F.lit(NOW + timedelta(9))))
    assert {(r.name, r.change) for r in d["functions"].collect()} == {("f", "worsened"), ("g", "disappeared"), ("h", "new")}
    assert d["scores"].first().score_delta == -10


def test_fleet(spark):
    rows = [("a", "http_route", "/api/users", "GET", "x.rs", 1), ("b", "http_route", "/api/users", "GET", "y.rs", 2), ("a", "http_route", "/api/billing", "GET", "x.rs", 3), ("b", "http_route", "/api/admin", None, "y.rs", 4), ("a", "function", "user_get", None, "x.rs", 5)]
    s = spark.createDataFrame(rows, RELATIONS["fleet_surface"])
    assert fleet.find_surface(s, "USERS", "http_route").count() == 2
    assert fleet.find_surface(s, "user", "function").count() == 1
    d = fleet.surface_diff(s.where("kind = 'http_route'"), "a", "b")
    assert ([r.name for r in d["only_a"].collect()], [r.name for r in d["only_b"].collect()], d["common"].first()[0]) == (["/api/billing"], ["/api/admin"], 1)


def test_live_pins_of_all_users(spark):
    from lodestrata.plans.queries import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").collect()
    live = lambda e: int(re.search("[0-9]+", e.props)[0]) % 3 == 0 or e.ts + timedelta(days=1) > datetime(2024, 1, 15)
    want = sorted((e.event_id, e.event_type) for e in events if live(e))
    assert sorted(map(tuple, QUERIES["p11_live_pins"](spark, "/root/testdata/sf0.01").collect())) == want


def test_file_summaries_of_all_documents(spark):
    from lodestrata.plans.queries import QUERIES

    rows = Source(spark, "/root/testdata/sf0.001").occurrences.select("doc", "symbol", "is_def").collect()
    defined, uses = {}, {}
    for r in rows:
        uses.setdefault(r.symbol, Counter())[r.doc] += 1
        if r.is_def:
            defined.setdefault(r.doc, set()).add(r.symbol)
    incoming = {d: sum(uses[x].total() - uses[x][d] for x in s) for d, s in defined.items()}
    want = {d: (len(defined.get(d, ())), sum(r.doc == d and not r.is_def for r in rows), sum(r.doc == d for r in rows), incoming.get(d, 0)) for d in {r.doc for r in rows}}
    got = QUERIES["a23_file_summaries"](spark, "/root/testdata/sf0.001").collect()
    assert len(want) > 4 and {r.doc: (r.definitions, r.outgoing, r.total, r.incoming) for r in got} == want and len(got) == len(want)


def test_as_of_join_equals_plain_search(spark):
    rng = random.Random(5)
    at = lambda m: NOW + timedelta(minutes=m)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    past = [(key(), at(m), rng.choice([None, m, m])) for m in rng.sample(range(10_000), 300)]
    probes = [(i, key(), at(rng.randrange(-100, 10_100))) for i in range(400)]
    h = spark.createDataFrame(past, "k string, ts timestamp_ntz, v int")
    p = spark.createDataFrame(probes, "id int, k string, ts timestamp_ntz")
    want = {}
    for i, k, t in probes:
        found = [(x, v) for kk, x, v in past if kk == k and x <= t and v is not None]
        want[i] = max(found)[1] if found else None
    for unit in ("hour", "day", "year"):
        assert {r.id: r.v for r in state.as_of_join(p, h, "k", "ts", "v", unit).collect()} == want
    assert {r.v for r in state.as_of_join(p, h.limit(0), "k", "ts", "v").collect()} == {None}


def test_replaced_table_survives_a_lost_driver(spark, tmp_path):
    at = f"{tmp_path}/t"
    storage.replace_table(spark.range(3), at)
    storage.replace_table(spark.read.parquet(at).where("id > 0"), at)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [1, 2]
    os.rename(at, at + storage.BEFORE)  # lost between the two renames
    assert storage.read_or_empty(spark, at, "id long").count() == 2
    assert os.listdir(tmp_path) == ["t"]


def test_lines_and_functions_far_apart(spark):
    f = spark.createDataFrame([("a", "long", 10, 1000), ("a", "inner", 600, 620), ("b", "x", 1, 2)], "file string, name string, start_line int, end_line int")
    lines = spark.createDataFrame([("a", 610, "t"), ("a", 9, "t"), ("a", 1000, "t"), ("b", 300, "t")], "file string, line int, to string")
    got = {(r.file, r.line): r.in_function for r in graph.function_of_lines(lines, f, ["to"]).collect()}
    assert got == {("a", 610): "long", ("a", 9): None, ("a", 1000): "long", ("b", 300): None}


def test_index_holds_lengths(spark):
    c = spark.createDataFrame([(1, "ab", "x y x"), (2, "", "y")], "id long, name string, content string")
    got = {(r.term, r.id, r.field): (r.tf, r.len) for r in search.postings(c).collect()}
    assert got == {("ab", 1, "name"): (1, 1), ("x", 1, "content"): (2, 3), ("y", 1, "content"): (1, 3), ("y", 2, "content"): (1, 1)}


def test_steps_are_discarded(spark, tmp_path):
    before = list(storage.STEPS)
    a = storage.saved(spark.range(3), "x")
    assert a.count() == 3
    (path,) = set(storage.STEPS) - set(before)
    storage.STEPS[:] = [path]
    storage.discard(spark)
    assert not os.path.exists(path)
    storage.STEPS[:] = before


def test_many_owner_rules(spark):
    """5,000 rules: the owners of each of them tried in turn, by a plan that doesn't grow with them."""
    rng = random.Random(4)
    names = ["a", "b", "core", "x.rs", "y.test.js", "z.py", "Makefile", "web"]
    shapes = ["/{}/", "{}/", "/{}/{}", "{}/{}", "*.{}", "/{}/*.rs", "{}/**", "/**/{}", "{}*", "/*.py", "[a-c]/{}", "{}/*", "*.{{js,py}}", "/{}/**/{}", "./{}"]
    rows = [(i, rng.choice(shapes).format(rng.choice(names), rng.choice(names)), [f"@{i}"]) for i in range(5000)]
    rows = [(i, p if rng.random() < 0.01 else f"/only/{i}/" if rng.random() < 0.5 else f"{p}{i}", o) for i, p, o in rows]
    rows[0] = (0, "*", ["@all"])
    paths_ = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(150)} | {"only/77/q.c", "./a/x.rs"})
    files = spark.createDataFrame([(p,) for p in paths_], "path string")
    own = spark.createDataFrame(rows, RELATIONS["owner_rules"])
    found = history.owners_of(files, own)
    patterns = [(re.compile(paths.owner_regex(p)), o) for _, p, o in rows]
    want = {p: next((o for r, o in reversed(patterns) if r.search(re.sub(r"^(?:\./)+", "", p))), []) for p in paths_}
    assert {r.path: r.owners for r in found.collect()} == want
    assert len(set(map(tuple, want.values()))) > 10
    size = lambda r: history.owners_of(files, r)._jdf.queryExecution().optimizedPlan().treeString().count("\n")
    assert size(own) == size(own.limit(3))


def test_many_modules_aliases_and_crates(spark):
    n = 400
    rows = [(f"m{i}/p/f{i}.go", "go", 1) for i in range(n)] + [(f"src{i}/u.ts", "typescript", 1) for i in range(n)] + [(f"c{i}/src/lib.rs", "rust", 1) for i in range(n)] + [("m1/deep/p/g.go", "go", 1), ("src3/index.ts", "typescript", 1)]
    f = spark.createDataFrame(rows, "path string, language string, loc int")
    raw_ = [("m0/p/f0.go", 1, 0, "host/m7/p", "import"), ("m0/p/f0.go", 2, 0, "host/m1/deep/p", "import"), ("m0/p/f0.go", 3, 0, "host/m1x/p", "import"), ("src0/u.ts", 1, 0, "@9/u", "import"),
            ("src0/u.ts", 2, 0, "@3", "import"), ("src0/u.ts", 3, 0, "one", "import"), ("src0/u.ts", 4, 0, "one/more", "import"), ("c0/src/lib.rs", 1, 0, "crate-5::x", "use"), ("c0/src/lib.rs", 2, 0, "std::x", "use")]
    edges = spark.createDataFrame(raw_, "`from` string, line int, k int, `to` string, kind string")
    config = dict(aliases=[(f"@{i}/*", [f"./src{i}/*"]) for i in range(n)] + [("one", ["src1/u.ts"])], modules={f"host/m{i}": f"m{i}" for i in range(n)} | {"host/m1/deep": "m1/deep"}, crates={f"crate_{i}": f"c{i}/src" for i in range(n)})
    got = {(r["from"], r["to"]) for r in resolve.build_graph(f, edges, **config)["edges"].collect()}
    assert got == {("m0/p/f0.go", "m7/p/f7.go"), ("m0/p/f0.go", "m1/deep/p/g.go"), ("src0/u.ts", "src9/u.ts"), ("src0/u.ts", "src3/index.ts"), ("src0/u.ts", "src1/u.ts"), ("c0/src/lib.rs", "c5/src/lib.rs")}


def test_reach_has_no_cap(spark):
    """More callers than a walk shows: all are found, with the documents that define them and the edges among them."""
    calls = spark.createDataFrame([(f"c{i:03}", "hub", 1) for i in range(300)] + [("top", "c299", 2), ("hub", "hub", 1), ("hub", "c000", 1)], "caller string, callee string, sites long")
    roots = spark.createDataFrame([("hub",)], "symbol string")
    found = {r.symbol: r.depth for r in symbols.reach(calls, roots, True, 2).collect()}
    assert found == {"hub": 0, "top": 2} | {f"c{i:03}": 1 for i in range(300)}
    assert len(symbols.walk(calls, "hub", True, 2)["nodes"]) == 200
    occ = spark.createDataFrame([(f"d{i % 250}", f"c{i:03}", True) for i in range(300)] + [("e", "c001", False)], "doc string, symbol string, is_def boolean")
    assert symbols.defining(occ, symbols.reach(calls, roots, True, 1)).count() == 250
    assert symbols.among(calls, symbols.reach(calls, roots, True, 1)).count() == 302


def test_owners_of_many_paths_stay_off_the_driver(spark, tmp_path):
    """Paths look small to Spark, rules don't: it sent the keys of all paths to the driver."""
    spark.range(1000).selectExpr("concat('web/p', id, '.py') AS path").write.parquet(str(tmp_path / "paths"))
    rules = spark.createDataFrame([(0, "*", ["@all"]), (1, "/web/", ["@web"])], "ordinal int, pattern string, owners array<string>")
    found = history.owners_of(spark.read.parquet(str(tmp_path / "paths")), rules)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "BuildRight" in plan and "SortMergeJoin" in plan
    assert {tuple(r.owners) for r in found.collect()} == {("@web",)}


def test_a_similar_file_is_asked_for_by_characters(spark, tmp_path):
    """The query's SQL takes 4096 characters of a text, not bytes."""
    from lodestrata.plans.queries import QUERIES

    rows = [(i, "web", "fr", 9, "needle" if i < 3 else "hay") for i in range(5)] + [(5, "web", "fr", 9, "é " * 1500 + "needle")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["x10_similar_files"](spark, str(tmp_path)).collect()
    assert {r.file for r in found} == {"doc/0.md", "doc/1.md", "doc/2.md"} and len(found) == 3


def test_a_similar_file_is_asked_for_by_its_whole_text(spark, tmp_path):
    """What stands behind the first 4096 characters counts, and so do more terms than a plan names."""
    from lodestrata.plans.queries import QUERIES

    many = " ".join(f"w{i}" for i in range(900))
    rows = [(i, "web", "fr", 9, "needle" if i < 3 else "w899 hay" if i < 5 else "hay") for i in range(9) if i != 5] + [(5, "web", "fr", 9, many + " needle")]
    assert many.index("w899") > 4096
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["x10_similar_files"](spark, str(tmp_path)).collect()
    assert {r.file for r in found if r.score > 1} == {f"doc/{i}.md" for i in range(5)}
