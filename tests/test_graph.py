import random
from collections import defaultdict
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata import storage
from lodestrata.operators import graph, metrics
from lodestrata.schemas import RELATIONS

NODE = "id string, language string, loc int, is_entry_point boolean"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(pairs)], RELATIONS["graph_edges"])


def nodes(spark, ids, entries=(), language="rust", loc=10):
    return spark.createDataFrame([(i, language, loc, i in entries) for i in ids], NODE)


@pytest.mark.parametrize("local", [None, 0])
@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        ("ab bc", []),
        ("ab bc ca", [["a", "b", "c"]]),
        ("ab ba cd dc", [["a", "b"], ["c", "d"]]),
        ("aa", [["a"]]),
    ],
)
def test_cycles(spark, pairs, expected, local):
    got = graph.find_cycles(edges(spark, pairs.split()), local).orderBy("nodes").collect()
    assert [r.nodes for r in got] == expected
    assert [r["size"] for r in got] == [len(x) for x in expected]


@pytest.mark.parametrize("local", [None, 0])
@pytest.mark.parametrize(
    ("pairs", "entries", "depth"),
    [
        ("ab bc cd", "a", {"a": 0, "b": 1, "c": 2, "d": 3}),
        ("ab ac bd cd", "a", {"a": 0, "b": 1, "c": 1, "d": 2}),
        ("ab", "", {"a": 0, "b": 0}),
        ("ex ea ab bx", "ef", {"e": 0, "f": 0, "x": 1, "a": 1, "b": 2}),
        ("ex fa ab bx", "ef", {"e": 0, "f": 0, "x": 3, "a": 1, "b": 2}),  # the farther entry counts
    ],
)
def test_depth(spark, pairs, entries, depth, local):
    n = nodes(spark, list(depth), entries)
    got = graph.entry_depths(n, edges(spark, pairs.split()), local)
    assert {r.id: r.depth_from_entry for r in got.collect()} == depth


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_cycles_are_mutual_reach(spark, pairs):
    reach = defaultdict(set)
    for a, b in pairs:
        reach[a].add(b)
    for _ in range(10):
        for a in list(reach):
            reach[a] |= {c for b in list(reach[a]) for c in reach.get(b, ())}
    groups = {tuple(sorted(b for b in reach[a] if a in reach.get(b, ()))) for a in list(reach) if a in reach[a]}
    expected = sorted(g for g in groups if len(g) > 1)
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "`from` int, `to` int, line int")
    got = sorted(tuple(r.nodes) for r in graph.find_cycles(e).where("size > 1").collect())
    assert got == expected


def test_modules_and_files(spark):
    ids = ["crates/foo/src/a.rs", "crates/foo/src/b.rs", "crates/bar/src/lib.rs", "web/src/app.tsx"]
    n = nodes(spark, ids)
    e = edges(spark, [(ids[0], ids[2]), (ids[1], ids[2]), (ids[3], ids[2])])
    mods, links = graph.module_graph(n, e, 2)
    assert mods.count() == 3
    assert {(r.source, r.target): r.weight for r in links.collect()} == {("crates/foo", "crates/bar"): 2, ("web/src", "crates/bar"): 1}
    kept, among = graph.file_graph(metrics.degrees(nodes(spark, ["a.rs", "b.rs", "c.rs"]), edges(spark, ["ba"])), edges(spark, ["ba"]), 1)
    assert kept.count() == 1
    assert among.count() == 0


def test_dominant_language_takes_the_greatest_of_a_tie(spark):
    df = spark.createDataFrame([("m", "rust"), ("m", "tsx")], "module string, language string")
    assert metrics.dominant(df, ["module"], "language").first().language == "tsx"


def funcs(spark, rows):
    return spark.createDataFrame([("a.rs", f"f{i}", i, i, 1, 0, cc, cog, "") for i, (cc, cog) in enumerate(rows)], RELATIONS["functions"])


def test_complexity_axis(spark):
    axis = lambda *r: metrics.complexity_axis(funcs(spark, r)).first()[0]
    assert axis((1, 1), (5, 5), (8, 8)) == 100
    assert 90 < axis((5, 5), (12, 12), (3, 3)) < 100
    assert axis((2, 60), (2, 2)) < 60
    assert axis() is None


def full(spark, rows):
    return spark.createDataFrame(rows, "id string, language string, loc int, is_entry_point boolean, in_degree long, out_degree long")


def test_other_axes(spark):
    clean = full(spark, [("a.rs", "rust", 1, False, 1, 1), ("b.rs", "rust", 1, False, 1, 1)])
    none = spark.createDataFrame([], "nodes array<string>, size long")
    assert metrics.acyclicity_axis(clean, none).first()[0] == 100
    two = spark.createDataFrame([([], 2)] * 3, "nodes array<string>, size long")
    many = lambda n: spark.range(n).selectExpr("cast(id as string) id", "'rust' language", "1 loc", "false is_entry_point", "1L in_degree", "1L out_degree")
    small, big = (metrics.acyclicity_axis(many(n), two).first()[0] for n in (10, 5000))
    assert big > small + 20
    assert big > 90
    empty = full(spark, [])
    assert metrics.acyclicity_axis(empty, none).first()[0] is None
    assert metrics.dead_code_axis(full(spark, [("a.md", "markdown", 1, False, 0, 0)])).first()[0] is None
    assert metrics.dead_code_axis(full(spark, [(f"tests/{i}.rs", "rust", 1, False, 0, 0) for i in range(10)])).first()[0] == 100
    dead = full(spark, [("dead.rs", "rust", 1, False, 0, 0)] + [(f"f{i}.rs", "rust", 1, False, 1, 0) for i in range(10)])
    assert abs(metrics.dead_code_axis(dead).first()[0] - 54.5) < 2
    god = full(spark, [("g.rs", "rust", 1, False, 1, 50)] + [(f"f{i}.rs", "rust", 1, False, 1, 2) for i in range(10)])
    assert 85 < metrics.coupling_axis(god).first()[0] < 95
    q = metrics.quality(funcs(spark, [(1, 1)]), empty, none).first()
    assert abs(q.score - 100) < 1e-9
    assert q.dead_code is None


def test_page_says_what_is_left_out(spark):
    p = metrics.page(spark.range(5), 2, "id")
    assert (p["total_count"], p["returned"], p["truncated"]) == (5, 2, True)
    assert datetime is not None


def test_queries_pass_cycles_and_violations(spark):
    from lodestrata.plans import engine
    from lodestrata.plans.queries import QUERIES

    run = lambda q: QUERIES[q](spark, "/root/testdata/sf0.01").collect()
    found = sorted(map(tuple, run("q1_cycles")), key=lambda r: (-r[1], r[0].split(",")))[:5]
    assert found and [r.path for r in run("t6_top_issues") if r.section == 2] == [r[0] for r in found]
    broken = sorted((r.rule, r.file or "", r.line or 0, r.summary) for q in ("v1_layer_forbid", "v2_complexity_cap", "v4_dead_code") for r in run(q))[:5]
    assert broken and sorted(r.target for r in run("c9_next_action") if r.category == "rules_violation" and r.score == 0.95) == sorted(b[1] for b in broken)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(engine, "next_actions", lambda v, gaps, hot, todos, n, f=engine.next_actions: f(v, gaps, hot, todos, 99))
        assert {r.category for r in run("c9_next_action")} == {"rules_violation", "test_gap", "hotspot", "pinned_todo"}


def test_depth_of_many_entries(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(220)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(260)}
    entries = set(rng.sample(names, 150))
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    want = dict.fromkeys(names, 0)
    for e in entries:
        at, todo = {e: 0}, [e]
        for x in todo:
            want[x] = max(want[x], at[x])
            for y in after[x] - set(at):
                at[y] = at[x] + 1
                todo.append(y)
    n = spark.createDataFrame([(x, "rust", 1, x in entries) for x in names], "id string, language string, loc int, is_entry_point boolean")
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "`from` string, `to` string, line int")
    for local in (0, None):
        assert {r.id: r.depth_from_entry for r in graph.entry_depths(n, e, local).collect()} == want


def test_rings_and_chains_of_any_length(spark):
    """A ring of 100,000 nodes, one with chords, tails into and out of it: rounds in the logarithm of their lengths."""
    n = 100_000
    ring = spark.range(n).selectExpr("concat('r', id) AS a", f"concat('r', (id + 1) % {n}) AS b")
    other = spark.range(3000).selectExpr("concat('s', id) AS a", "concat('s', (id + 1) % 3000) AS b")
    chords = spark.createDataFrame([("s10", "s500"), ("s900", "s20"), ("s77", "t0"), ("u1999", "s5"), ("x", "y"), ("y", "x"), ("y", "z1"), ("z1", "z2"), ("z2", "y"), ("z2", "w")], "a string, b string")
    tails = spark.range(1999).selectExpr("concat('t', id) AS a", "concat('t', id + 1) AS b").union(spark.range(1999).selectExpr("concat('u', id) AS a", "concat('u', id + 1) AS b"))
    before = len(storage.STEPS)
    got = graph.strong_components(ring.union(other).union(chords).union(tails), 0)
    sizes = {r[0]: r[1] for r in got.groupBy(F.substring("component", 1, 1), "component").count().groupBy("substring(component, 1, 1)").agg(F.sum("count")).collect()}
    assert got.groupBy("component").count().count() == 3
    assert got.count() == got.select("id").distinct().count() == n + 3000 + 4
    assert sizes["r"] == n
    assert len(storage.STEPS) - before < 80


@pytest.mark.parametrize("local", [None, 0])
def test_entry_depths_end_at_so_many_steps(spark, local):
    n = [f"n{i:02}" for i in range(40)]
    e = edges(spark, [*zip(n, n[1:]), ("x", n[35])])
    found = {r.id: r.depth_from_entry for r in graph.entry_depths(nodes(spark, [*n, "x"], (n[0], "x")), e, local, most=30).collect()}
    assert found[n[30]] == 30 and found[n[34]] == 0 and found[n[36]] == 2


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """What a round joins looks small, but each broadcast of each round goes through the driver."""
    plans, old = [], graph.saved

    def saved(df, name="step"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return old(df, name)

    monkeypatch.setattr(graph, "saved", saved)
    n = [f"n{i}" for i in range(8)]
    pairs = spark.createDataFrame([*zip(n, [*n[1:], n[0]]), ("n0", "n4"), ("n5", "n1"), ("n6", "x"), ("n2", "n7")], "a string, b string")
    assert graph.strong_components(pairs, 0).where("component is not null").count() == 8
    assert plans and not any("Broadcast" in p for p in plans)


def test_weak_components_end_in_a_task_each(spark, monkeypatch):
    """Rings in parts of at most `local` edges need no colouring, whatever their number; a larger part has it."""
    import random

    rng, pairs = random.Random(3), []
    for part in range(12):
        n = 30 if part else 90
        pairs += [(part * 1000 + rng.randrange(n), part * 1000 + rng.randrange(n)) for _ in range(2 * n)]
    pairs = sorted({(a, b) for a, b in pairs if a != b})
    want = sorted(tuple(x) for x in graph._strong(pairs))
    got = graph.find_cycles(spark.createDataFrame([(a, b, 1) for a, b in pairs], "`from` long, `to` long, line int"), 100)
    assert sorted(tuple(r.nodes) for r in got.collect()) == want and len(want) >= 12
    names = []
    saved = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name="step", **o: names.append((name, df.columns)) or saved(df, name, **o))
    small = spark.createDataFrame([p for p in pairs if p[0] >= 1000], "a long, b long")
    got = graph.strong_components(small, 100).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("nodes"))
    assert sorted(tuple(r.nodes) for r in got.collect()) == [w for w in want if w[0] >= 1000]
    assert not any("c" in columns for _, columns in names)  # no colours
