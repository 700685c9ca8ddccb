import json
import os
import re
import shutil
import subprocess
import time

import pytest

from lodestrata.operators.segments import Index
from lodestrata.plans.engine import Engine, Fleet
from lodestrata.sources import configs, files, git, imports, parse, scip, tools
from lodestrata.streaming import watch


def by_name(rows):
    return {r[0]: r for r in rows}


def test_functions():
    f = by_name(parse.functions("rust", "fn one() {}\npub fn two(a: u32, b: u32) -> u32 { if a > b { a } else { b } }\nfn three(x: i32) { for i in 0..x { if i > 2 && x > 1 { } } }\n"))
    assert list(f) == ["one", "two", "three"]
    assert f["two"][4] == 2
    assert f["two"][5] >= 2
    assert f["three"][5] >= 3
    nested = by_name(parse.functions("rust", "fn outer() {\n  fn inner(x: i32) { if x > 0 { if x > 1 { } } for _ in 0..1 {} while x > 3 {} }\n  if true { }\n}\n"))
    assert nested["outer"][5] == 2
    assert nested["inner"][5] >= 5
    flat = parse.functions("rust", "fn m(x: u8) -> u8 { match x { 0 => 1, 1 => 2, 2 => 3, 3 => 4, _ => 5 } }")[0]
    assert flat[5] >= 5
    assert flat[6] <= 2
    ts = by_name(parse.functions("typescript", "class A {\n  greet(name: string): string {\n    if (name) { return name; }\n    return 'x';\n  }\n}\nfunction add(a: number, b: number) { return a + b; }\n"))
    assert ts["greet"][4] == 1
    assert ts["greet"][5] >= 2
    assert "add" in ts
    js = by_name(parse.functions("javascript", "function decl(a){ return a }\nconst arrow = (x) => { if (x) { return 1 } };\nclass B { method(a, b) { return a ? b : 1; } }\n"))
    assert set(js) == {"decl", "method"}
    py = parse.functions("python", "class A:\n    def m(self, a, b):\n        if a and b:\n            return 1\n        elif b:\n            return 2\n")[0]
    assert py[4] == 2
    assert py[5] >= 3
    go = parse.functions("go", "package x\n\nfunc (r *R) Do(a, b int, c string) error {\n\tif a > b && c != \"\" {\n\t\treturn nil\n\t}\n\treturn nil\n}\n")[0]
    assert (go[0], go[4], go[5]) == ("Do", 2, 3)
    assert [r[0] for r in parse.functions("typescript", "export function Greet(p: P) { return <div>{p.n ? 'a' : 'b'}</div>; }")] == ["Greet"]
    assert parse.functions("python", "def broken(:") == []
    assert parse.functions("rust", "") == []


def test_surface():
    r = {(k, n) for k, n, *_ in parse.surface("rust", "pub fn a(x: u8) -> u8 { 1 }\npub struct S;\nenum P {}\npub const K: u8 = 1;\npub use foo::bar;\nfn hidden() {}\nimpl S { pub fn m(&self) {} }\n")}
    assert r == {("function", "a"), ("type", "S"), ("constant", "K"), ("re_export", "bar")}
    t = [(k, n) for k, n, *_ in parse.surface("typescript", "export function f() {}\nexport class C {}\nexport const k = 1;\nexport { a } from './a';\nfunction no() {}\n")]
    assert t[:3] == [("function", "f"), ("type", "C"), ("constant", "k")]
    assert t[3][0] == "re_export"
    assert [(n, m) for _, n, _, _, m in parse.surface("rust", 'R::new().route("/a", get(h)).route("/b", post(h))')] == [("/a", "GET"), ("/b", "POST")]
    assert [m for *_, m in parse.surface("javascript", "app.get('/a', h);\napp.post('/a', h);\napp.delete('/a', h);")] == ["GET", "POST", "DELETE"]


def edges_of(spark, language, text):
    ext = {"typescript": "ts", "python": "py", "rust": "rs", "go": "go"}[language]
    df = spark.createDataFrame([(f"x.{ext}", language, text)], "path string, language string, content string")
    return sorted((r.line, r.to) for r in imports.import_edges(df).collect())


def test_imports(spark):
    assert edges_of(spark, "typescript", "// hello\nimport x from 'lodash';\nimport { y } from \"./y\";") == [(2, "lodash"), (3, "./y")]
    assert edges_of(spark, "typescript", "const A = lazy(() => import('../components/Foo'));") == [(1, "../components/Foo")]
    assert edges_of(spark, "typescript", "await import(name)") == []
    assert [t for _, t in edges_of(spark, "typescript", "export { Foo } from './Foo';\nexport type { B } from './Bar';\nexport * from './star';")] == ["./Foo", "./Bar", "./star"]
    assert [t for _, t in edges_of(spark, "python", "from os.path import join\nimport sys")] == ["os.path", "sys"]
    assert [i for i, _ in edges_of(spark, "rust", "use std::io;\nuse crate::a::{B, C};")] == [1, 2]
    assert edges_of(spark, "rust", "\npub mod foo;\n  mod bar;") == [(2, "self::foo"), (3, "self::bar")]
    assert len(edges_of(spark, "go", 'package x\nimport "fmt"\nimport m "math"\n')) == 2
    assert len(edges_of(spark, "go", 'import (\n\t"fmt"\n\tm "math"\n\t_ "os"\n)\nvar s = "no"\n')) == 3
    assert len(edges_of(spark, "go", 'import (\n\t// c\n\n\t"fmt"\n\t"os"\n)\n')) == 2


def test_lines_markers_snippets(spark):
    df = spark.createDataFrame([("a.rs", "rust", "// TODO: one\r\nlet x = 1; // fixme two\n\nlast"), ("b.rs", "rust", "")], "path string, language string, content string")
    assert [(m.line, m.kind, m.text) for m in files.markers(df).collect()] == [(1, "TODO", "one"), (2, "FIXME", "two")]
    s = files.snippet_at(df, "a.rs", 2, 1).first()
    assert (s.start, s.end) == (1, 3)
    with pytest.raises(ValueError, match="outside"):
        files.snippet_at(df, "../x", 1)
    assert [r[0] for r in df.select(files.loc(df.language, df.content)).collect()] == [2, 0]


def test_configs(spark):
    assert configs.ts_aliases('{ // c\n "compilerOptions": { "paths": { "@/*": ["./src/*"], "x": ["node_modules/x"] } } }') == [("@/*", ["./src/*"])]
    assert configs.rust_crates({"Cargo.toml": '[package]\nname = "my-x"', "a/Cargo.toml": "[workspace]"}) == {"my_x": "src"}
    assert configs.go_modules({"sub/go.mod": "module example.com/p\n"}) == {"example.com/p": "sub"}
    assert [r.pattern for r in configs.owner_rules(spark, "# c\n* @all\n!x @no\norphan\n/web/ @a @b\n").orderBy("ordinal").collect()] == ["*", "/web/"]
    texts = spark.createDataFrame([("package.json", json.dumps({"scripts": {"test": "vitest", "dev": "vite dev"}})), ("Makefile", "build: x\n\tcc\n"), ("justfile", "lint:\n  x\n")], "path string, content string")
    found = configs.commands(texts)
    assert {r.slot: r.command for r in configs.suggested(found).collect()} == {"test": "npm run test", "run": "npm run dev", "build": "make build", "lint": "just lint"}


def _field(n, value):
    def varint(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def test_scip(spark, tmp_path):
    occ = _field(1, bytes([1, 3, 6])) + _field(2, b"foo#") + _field(3, 1) + _field(7, bytes([1, 0, 10, 0]))
    ref = _field(1, bytes([5, 4, 10])) + _field(2, b"local 1")
    index = _field(2, _field(1, b"lib.rs") + _field(2, occ) + _field(2, ref) + _field(3, _field(1, b"foo#") + _field(6, b"foo"))) + _field(3, _field(1, b"ext#"))
    (tmp_path / "a.scip").write_bytes(index)
    o, s = scip.read_indexes(spark, f"file://{tmp_path}/a.scip")
    rows = o.orderBy("occ").collect()
    assert (rows[0].symbol, rows[0].is_def, rows[0].end_char, rows[0].enc_end_line) == ("foo#", True, 6, 10)
    assert rows[1].symbol == "lib.rs#local 1"
    assert {(r.symbol, r.display_name, r.external) for r in s.collect()} == {("foo#", "foo", False), ("ext#", "", True)}


def test_tools(spark, tmp_path):
    (tmp_path / "ruff.json").write_text(json.dumps([{"code": "F401", "message": "unused", "filename": "a.py", "location": {"row": 1, "column": 2}, "end_location": {"row": 1, "column": 5}}]))
    (tmp_path / "eslint.json").write_text(json.dumps([{"filePath": "a.ts", "messages": [{"ruleId": "no-x", "severity": 2, "message": "m", "line": 3}]}]))
    d = tools.read_all(spark, {"ruff": f"{tmp_path}/ruff.json", "eslint": f"{tmp_path}/eslint.json", "semgrep": f"{tmp_path}/none.json"})
    assert {(r.tool, r.rule, r.severity, r.line) for r in d.collect()} == {("ruff", "F401", "warning", 1), ("eslint", "no-x", "error", 3)}
    (tmp_path / "c.json").write_text(json.dumps({"x.tsx": [{"displayName": "X", "description": "d", "props": {"b": {"required": True, "tsType": {"name": "string"}}, "a": {"required": False}, "c": {"required": True}}}]}))
    c = tools.components(spark, f"{tmp_path}/c.json").first()
    assert [(p.name, p.required) for p in c.props] == [("b", True), ("c", True), ("a", False)]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, text in {
        "src/main.rs": "mod util;\nmod dead2;\nfn main() { if true { } }\n", "src/util.rs": "// TODO: more\npub fn help(a: u8) -> u8 { if a > 1 { 1 } else { 2 } }\n#[cfg(test)]\nmod t {}\n", "src/dead.rs": "pub fn gone() {}\n",
        "src/dead2.rs": "use crate::util;\n", "web/app.ts": "import { x } from './x';\n", "web/x.ts": "export const x = 1;\napp.get('/u', h);\n", "CODEOWNERS": "* @all\n", "Cargo.toml": '[package]\nname = "p"\n',
    }.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(text)
    g = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    g("init", "-q")
    g("add", ".")
    g("commit", "-qm", "one")
    (root / "src/util.rs").write_text("pub fn help(a: u8) -> u8 { if a > 1 { 1 } else { 2 } }\nfn b() {}\n#[cfg(test)]\nmod t {}\n")
    (root / "src/dead.rs").unlink()
    g("add", "-A")
    g("commit", "-qm", "two")
    return root


def test_git(spark, tree):
    assert sorted(r.path for r in git.log(spark, str(tree)).collect()).count("src/util.rs") == 2
    d = {r.path: (r.status, r.additions, r.deletions) for r in git.diff(spark, str(tree)).collect()}
    assert d == {"src/util.rs": ("modified", 1, 1), "src/dead.rs": ("deleted", 0, 1)}
    assert git.diff(spark, str(tree), head="HEAD~1").where("status = 'added'").count() == 8


def test_engine(spark, tree, tmp_path):
    e = Engine(spark, str(tree), store=str(tmp_path / "store"))
    assert {(r["from"], r.to) for r in e.graph["edges"].collect()} == {("src/main.rs", "src/util.rs"), ("src/main.rs", "src/dead2.rs"), ("src/dead2.rs", "src/util.rs"), ("web/app.ts", "web/x.ts")}
    assert e.quality().first().score > 0
    hot = {r.path: r for r in e.hotspots().collect()}
    assert hot["src/util.rs"].churn == 2
    assert hot["src/util.rs"].owners == ["@all"]
    assert "src/util.rs" in {r.source for r in e.test_map.collect()}
    assert "# Brief" in e.brief()
    p = e.pack(600)
    assert p["tokens"] <= p["budget"]
    assert e.architecture().startswith("graph LR")
    assert e.describe("src/util.rs")["kind"] == "file"
    assert e.describe("src")["kind"] == "directory"
    assert e.function_detail("src/util.rs", "help")["churn"] == 2
    assert e.suggest_tests("src/util.rs")["tests"][0] == "help_happy_path"
    assert e.reindex() > 0
    assert e.search_code("help").first().file == "src/util.rs"
    assert e.index_status()["state"] == "ready"
    assert e.next_action().count() > 0
    assert e.explain("HEAD~1").count() == 2
    e.snapshot()
    n = e.remember("use util", "decision")
    e.link(n, n + 1, "relates_to")
    assert e.note_links(n).count() == 1
    assert e.recall("util")[1].first().id == n
    i = e.pin("file", "src/util.rs", "look", "1d")
    assert e.list_pins().count() == 1
    e.unpin(i)
    assert e.list_pins().count() == 0
    assert e.session_end(e.session_start()).count() == 0
    f = Fleet(spark, str(tmp_path / "fleet"))
    f.sync({"one": e, "two": e})
    f.sync({"one": e})
    assert [r.app for r in f.apps().collect()] == ["one", "two"]
    assert f.find("/u", "http_route").count() == 2
    assert f.diff("one", "two")["only_a"].count() == 0
    assert f.test_gaps().count() > 0


def test_stream_of_changes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("p", "a.rs", "1", 1), ("p", "b.rs", "1", 1), ("p", "a.rs", "1", 2), ("p", "a.rs", "2", 3), ("p", "b.rs", None, 4)], "project string, path string, hash string, t long").selectExpr("project", "path", "hash", "timestamp_seconds(t) ts").write.parquet(str(src / "1"))
    rows = spark.readStream.schema(watch.EVENTS).parquet(str(src / "*"))
    q = watch.changes(watch.relevant(rows)).writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    assert watch.status(q)["active"]
    q.stop()
    got = sorted((r.path, r.change) for r in spark.table("changes").collect())
    assert got == [("a.rs", "added"), ("a.rs", "changed"), ("b.rs", "added"), ("b.rs", "removed")]
    batch = spark.read.schema(watch.EVENTS).parquet(str(src / "*"))
    assert sorted((r.path, r.change) for r in watch.changes(batch).collect()) == got


def test_reindexing_batches(spark, tmp_path):
    texts = {"a.md": "one", "b.md": "two"}
    read = lambda ps: ps.join(spark.createDataFrame(list(texts.items()), "path string, content string"), "path")
    run = watch.reindex_batch(str(tmp_path / "idx"), read, files.functions_of)
    batch = lambda *r: spark.createDataFrame(list(r), "path string, change string")
    run(batch(("a.md", "added"), ("b.md", "added")), 0)
    texts["a.md"] = "changed"
    for _ in range(2):  # a batch may run again
        run(batch(("a.md", "changed"), ("b.md", "removed")), 1)
    index = Index.open(spark, str(tmp_path / "idx"))
    assert index.version == 2
    assert [(r.file, r.content) for r in index.chunks.collect()] == [("a.md", "changed")]
    assert [r.path for r in index.known.collect()] == ["a.md"]
    seen = []
    watch.languages_batch(seen.append)(batch(("a.rs", "added"), ("b.py", "added")), 0)
    assert seen == [["python", "rust"]]


def test_observed_tree(spark, tmp_path):
    """Added, changed and removed files over triggers, after a restart between them, and with a driver lost in between."""
    root, store = tmp_path / "tree", str(tmp_path / "store")
    (root / "src").mkdir(parents=True)

    def write(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    def triggered():
        watch.observe(spark, str(root), "p", store)
        q = watch.changes(watch.observed(spark, store)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.path.rsplit("/tree/")[-1], r.change) for r in rows)

    write("src/a.rs", "one", 1000)
    write("b c.md", "two", 2000)
    first = [("b c.md", "added"), ("src/a.rs", "added")]
    assert triggered() == first
    write("src/a.rs", "other", 1000)  # no newer, but of another length
    write("d.py", "x", 3000)
    (root / "b c.md").unlink()
    second = [("b c.md", "removed"), ("d.py", "added"), ("src/a.rs", "changed")]
    assert triggered() == sorted(first + second)
    write("d.py", "x", 4000)  # touched, not changed
    assert triggered() == sorted(first + second)
    assert watch.observe(spark, str(root), "p", store) == 4  # nothing differs
    (root / "d.py").unlink()
    shutil.move(f"{store}/events/4", f"{store}/lost")
    assert watch.observe(spark, str(root), "p", store) == 4  # the listing that still waited for its events
    assert triggered() == sorted([*first, *second, ("d.py", "removed")])


def test_ticks_observe(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.rs").write_text("fn a() {}")
    q = watch.watch_tree(spark, str(tmp_path / "tree"), "p", str(tmp_path / "store"), "0 seconds")
    for _ in range(300):
        if (tmp_path / "store/events/2").exists():
            break
        time.sleep(0.2)
    q.stop()
    events = [r for n in ("1", "2") for r in spark.read.schema(watch.EVENTS).parquet(str(tmp_path / "store/events" / n)).collect()]
    assert [r.path.rsplit("/")[-1] for r in events] == ["a.rs"]


def test_exports_inside_braces_are_none():
    text = "namespace n {\n  export const a = 1;\n  { export function b() {} }\n}\nexport const c = { d: { e: 1 } };\nexport class F { g() {} }\n" + "{ x(); }\n" * 2000 + "export function h() {}\n"
    assert [(i[0], i[1]) for i in parse.surface("typescript", text)] == [("constant", "c"), ("type", "F"), ("function", "h")]


def test_tools_are_run_or_passed_over(spark, tmp_path, monkeypatch):
    (tmp_path / "bin").mkdir()
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("import os\n")
    report = json.dumps([{"code": "F401", "message": "unused", "filename": "a.py", "url": "u", "location": {"row": 1, "column": 8}, "end_location": {"row": 1, "column": 10}}])
    for name, text in (("ruff", f"#!/bin/sh\n[ $1 = --version ] && echo ruff 1 && exit\necho '{report}'\nexit 1\n"), ("semgrep", "#!/bin/sh\n[ $1 = --version ] && echo 2 && exit\necho broken >&2\nexit 2\n")):
        (tmp_path / "bin" / name).write_text(text)
        (tmp_path / "bin" / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}/bin:/bin:/usr/bin")
    monkeypatch.setattr(tools, "COMMANDS", {k: v for k, v in tools.COMMANDS.items() if k in ("ruff", "semgrep", "clippy")})
    e = Engine(spark, str(tmp_path / "tree"), store=str(tmp_path / "store"))
    got = {r.tool: r for r in e.run_diagnostics().collect()}
    assert (got["ruff"].available, got["ruff"].ran, got["ruff"].version, got["ruff"].findings) == (True, True, "ruff 1", 1)
    assert (got["semgrep"].available, got["semgrep"].ran, got["semgrep"].error) == (True, False, "broken")
    assert (got["clippy"].available, got["clippy"].ran) == (False, False)
    assert [(r.tool, r.rule, r.file, r.line) for r in e.diagnostics().collect()] == [("ruff", "F401", "a.py", 1)]
    assert [(r.tool, r.rule) for r in Engine(spark, str(tmp_path / "tree"), store=str(tmp_path / "store")).diagnostics().collect()] == [("ruff", "F401")]  # from the store
    later = json.loads(report)[0] | {"code": "E1"}
    (tmp_path / "store" / "diagnostics" / ".ruff.json.crc").unlink(missing_ok=True)
    (tmp_path / "store" / "diagnostics" / "ruff.json").write_text(json.dumps([later]))
    os.utime(tmp_path / "store" / "diagnostics" / "ruff.json", (2_000_000_000, 2_000_000_000))
    assert [r.rule for r in Engine(spark, str(tmp_path / "tree"), store=str(tmp_path / "store")).diagnostics().collect()] == ["E1"]  # newer than the store


TEMPLATES = """export function f(a, b) {
  const s = `a ${b ? `x{${a}` : ''} c`;
}
function g(x) {
  return `x ${x ? 1 : 2} ${x && 3} \\` \\${ }`;
}
function j(p) {
  return <p>Don't {p.a && <b>it's</b>} stop</p>;
}
function k(v) {
  return v ? /[/'"}]/.test(v) || v / 2 / 3 : "a" === v && v ?? `}`;
}
class A {
  m(a, b = `${1}`) { if (a) { return <Foo a={b => b && a} {...a}/> } else if (b) { return <></> } return a?.x ? a?.5:b : 1 }
}
"""


def test_templates_and_tags():
    for lang, path in (("javascript", "a.js"), ("typescript", "a.tsx"), ("typescript", "")):
        rows = {r[0]: r[1:7] for r in parse.functions(lang, TEMPLATES, path)}
        # start, end, lines, parameters, cyclomatic, cognitive
        assert rows == {"f": (1, 3, 3, 2, 2, 1), "g": (4, 6, 3, 1, 3, 2), "j": (7, 9, 3, 1, 2, 1), "k": (10, 12, 3, 1, 5, 4), "m": (14, 14, 1, 2, 5, 5)}


def test_what_only_looks_like_tags_and_branches():
    types = """function k<T, U>(v: any) {
  type X = T extends U ? 1 : 2;
  let y: T extends (a: string) => infer R ? R : never;
  const f = <A,>(a: A) => a, g = <B extends {}>(b: B) => b, h: <C>(c: C) => void = () => {};
  v ||= 1; v &&= 2; v ??= 3;
  return v!/2 > 1 / 3 ? v < 3 : v;
}
function l(x) { let i = 0; i++ / 2; if (x) /[}]/.test(x); return x.return / 2 / 1; }
"""
    rows = {r[0]: r[1:7] for r in parse.functions("typescript", types, "a.tsx")}
    assert rows == {"k": (1, 7, 7, 1, 2, 1), "l": (8, 8, 1, 1, 2, 1)}
    old = "function c(x) { const y = <T>x; return y && <string>(x) }\nfunction d() {}\n"
    assert [(r[0], r[5]) for r in parse.functions("typescript", old, "a.ts")] == [("c", 2), ("d", 1)]
    # a tag without an end was none: what follows is read as code
    assert [r[0] for r in parse.functions("javascript", "const a = <T;\nfunction d() {}\n")] == ["d"]


def test_operands_in_quotes():
    assert parse.functions("rust", 'fn f(s: &str) -> bool { s == "x" && t || s == "y" }')[0][5:7] == (3, 2)
    assert parse.functions("go", 'func f(s string) bool {\n return s == "x" && t\n}\n')[0][5:7] == (2, 1)


@pytest.mark.parametrize("more", ["  if (a && b) { c(); } else if (x) d();\n", "  else if (a && b) { c(); }\n", "  `${a ? b : <p>{a && b}</p>}`;\n"])
def test_long_functions_take_time_in_proportion(more):
    taken = []
    for n in (2000, 16000):
        source = "function f(a) {\n  if (a) {}\n" + more * n + "}\n"
        began = time.perf_counter()
        (row,) = parse.functions("javascript", source)
        taken.append(time.perf_counter() - began)
        assert row[2] == n + 3
        assert row[5] == 2 + n * len(re.findall(r"\?|&&|if", more))
    assert taken[1] < 24 * taken[0]


BROKEN = """import x

def good(a, b):
    if a:
        return b
    return \"\"\"
def no(): pass
\"\"\"

class C:
    def m(self, x):
        return x and 1

    def bad(self, y):
        if y:
            print y
        for z in y:
            z ==== 3
        return 1

    def after(self): return 2 if self else 3

def headless(a, b:
    return a

async def last(
    p,
    q=1,
):
    while p:
        p -= 1

    # end
x = = 3
def tail(): pass
"""


def test_python_with_errors():
    rows = [r[:7] for r in parse.functions("python", BROKEN)]
    assert rows == [("good", 3, 8, 6, 2, 2, 1), ("m", 11, 12, 2, 1, 2, 1), ("bad", 14, 19, 6, 1, 3, 2), ("after", 21, 21, 1, 0, 2, 1), ("last", 26, 31, 6, 2, 2, 1), ("tail", 35, 35, 1, 0, 1, 0)]
    whole = BROKEN[: BROKEN.index("    def bad")] + "    def z(self):\n        pass\n"
    assert parse.functions("python", whole)[:2] == parse.functions("python", whole + "\nx = = 1\n")[:2]  # hashes too
    assert [r[0] for r in parse.functions("python", "x = = 1\n" + "def f():\n  y = = 1\n  def g(): pass\n" * 50)] == ["f", "g"] * 50


RULES = {
    ".gitignore": "# comment\n*.log\n/build/\nnode_modules/\n!keep.log\ndocs/*.md\n**/gen/**\n\\#odd.py\ntemp \nfoo?.ts\n[ab].go\nsrc/deep/**/x.rs\n/only.py\ndir/\n",
    "src/.gitignore": "*.py\n!main.py\n/local/\n!*.log\n",
    "src/deep/.gitignore": "main.py\n",
}
PATHS = [
    "a.py", "only.py", "src/only.py", "x.log.rs", "build/a.rs", "src/build/a.rs", "lib/node_modules/m/i.js", "docs/a.md", "docs/b/c.md", "x/gen/y.rs", "gen/z.rs", "gen.rs", "#odd.py", "temp/a.rs", "foo1.ts",
    "foo12.ts", "a.go", "c.go", "src/a.go", "src/deep/x.rs", "src/deep/p/q/x.rs", "src/x.py", "src/main.py", "src/deep/main.py", "src/local/a.rs", "local/a.rs", "dir.rs", "x/dir/y.rs", "src/t/u/main.py", "keep.log.md",
]


def test_ignore_files(spark, tmp_path):
    for p in PATHS:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x\n")
    for p, text in RULES.items():
        (tmp_path / p).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, check=True).stdout.decode()
    run("init", "-q")
    (tmp_path / ".git/info/exclude").write_text("c.go\n")
    want = {p for p in run("ls-files", "-o", "--exclude-standard", "-z").split("\0") if p and not p.rsplit("/")[-1].startswith(".")}
    assert {r.path for r in files.read_tree(spark, str(tmp_path)).select("path").collect()} == want
    assert 10 < len(want) < len(PATHS)
    assert {r.path for r in files.read_tree(spark, str(tmp_path), respect_ignores=False).select("path").collect()} == set(PATHS)
    (tmp_path / "src/.ignore").write_text("!x.py\nmain.py\n")  # stronger than the others
    assert {r.path for r in files.read_tree(spark, str(tmp_path)).select("path").collect()} == want - {"src/main.py", "src/t/u/main.py"} | {"src/x.py"}
