"""The canonical relations over the driver's tables: adapters in SQL that Spark and other engines read alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.storage import saved

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def path(k: str) -> str:
    """A file path for a part: tests and entry points among them, languages by key."""
    return (
        f"concat(CASE WHEN {k} % 13 = 0 THEN 'tests/' WHEN {k} % 13 = 1 THEN 'web/src/' ELSE 'part/' END, CAST({k} % 10 AS STRING), '/', "
        f"CASE {k} % 7 WHEN 0 THEN concat('p', CAST({k} AS STRING), '.rs') WHEN 1 THEN concat('p', CAST({k} AS STRING), '.ts') "
        f"WHEN 2 THEN concat('p', CAST({k} AS STRING), CASE WHEN {k} % 3 = 0 THEN '.test.js' ELSE '.js' END) "
        f"WHEN 3 THEN concat(CASE WHEN {k} % 5 = 0 THEN 'test_p' ELSE 'p' END, CAST({k} AS STRING), '.py') "
        f"WHEN 4 THEN concat('p', CAST({k} AS STRING), CASE WHEN {k} % 3 = 0 THEN '.config.go' ELSE '.go' END) "
        f"WHEN 5 THEN concat('p', CAST({k} AS STRING), '.json') ELSE concat('p', CAST({k} AS STRING), '.md') END)"
    )


def lang(k: str) -> str:
    return f"CASE {k} % 7 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'python' WHEN 4 THEN 'go' WHEN 5 THEN 'json' ELSE 'markdown' END"


def folder(k: str) -> str:
    return f"concat(CASE WHEN {k} % 13 = 0 THEN 'tests/' WHEN {k} % 13 = 1 THEN 'web/src/' ELSE 'part/' END, CAST({k} % 10 AS STRING), '/')"


def stem(k: str) -> str:
    """A file's name as scripts import it: without the ending of a script."""
    return f"CASE WHEN {k} % 7 IN (1, 2) THEN regexp_replace(regexp_replace({path(k)}, '^.*/', ''), '[.][^.]*$', '') ELSE regexp_replace({path(k)}, '^.*/', '') END"


#: Each relation's SQL over the tables and the relations before it.
RELATIONS = {
    "commits": f"SELECT DISTINCT CAST(l_orderkey AS STRING) AS commit, {path('l_partkey')} AS path, concat('supp', CAST(l_suppkey % 10 AS STRING)) AS author, l_shipdate AS ts FROM lineitem",
    "functions": (
        f"SELECT {path('l_partkey')} AS file, concat('f', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS name, CAST(l_linenumber * 10 AS INT) AS start_line, "
        "CAST(l_linenumber * 20 AS INT) AS end_line, CAST(l_linenumber * 10 AS INT) AS loc, CAST(l_linenumber % 5 AS INT) AS params, CAST(l_quantity AS INT) AS cyclomatic, "
        "CAST(round(l_discount * 100) AS INT) * 5 AS cognitive FROM lineitem"
    ),
    "files": f"SELECT {path('p_partkey')} AS path, {lang('p_partkey')} AS language, p_size AS loc, CAST(p_partkey % 997 AS BIGINT) AS bytes FROM part",
    # Parts of one size that an order holds one after the other.
    "pairs": (
        "SELECT a.l_partkey AS f, b.l_partkey AS t, min(a.l_linenumber) AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber "
        "JOIN part x ON x.p_partkey = a.l_partkey JOIN part y ON y.p_partkey = b.l_partkey WHERE x.p_size = y.p_size AND a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey"
    ),
    "edges": f"SELECT {path('f')} AS \"from\", {path('t')} AS \"to\", line FROM pairs",
    "nodes": (
        f"SELECT {path('p_partkey')} AS id, {lang('p_partkey')} AS language, p_size AS loc, p_partkey % 29 = 5 AS is_entry_point, "
        "coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM part "
        "LEFT JOIN (SELECT t, count(*) AS n FROM pairs GROUP BY t) i ON i.t = p_partkey LEFT JOIN (SELECT f, count(*) AS n FROM pairs GROUP BY f) o ON o.f = p_partkey"
    ),
    # Import statements of the files of a tree: what each names, its line, and whether it means that file.
    "imports": (
        f"SELECT f, t, {path('f')} AS path, CASE WHEN f % 7 IN (1, 2) THEN CASE WHEN t % 13 = 1 AND (f + t) % 2 = 0 THEN concat('~/', CAST(t % 10 AS STRING), '/', {stem('t')}) "
        f"ELSE concat(CASE WHEN f % 13 = 1 THEN '../../../' ELSE '../../' END, {folder('t')}, {stem('t')}) END "
        f"WHEN f % 7 = 3 THEN replace(regexp_replace({path('t')}, '[.][^./]*$', ''), '/', '.') WHEN f % 7 = 0 THEN concat('crate::', CAST(t % 10 AS STRING), '::p', CAST(t AS STRING)) "
        f"ELSE concat('mod/', regexp_replace({path('t')}, '[.][^./]*$', '')) END AS spec, CAST(1 + row_number() OVER (PARTITION BY f ORDER BY t) AS INT) AS line, "
        "CASE WHEN f % 7 IN (1, 2) THEN true WHEN f % 7 = 3 THEN t % 7 = 3 WHEN f % 7 = 0 THEN f % 13 = 1 AND t % 13 = 1 AND t % 7 = 0 ELSE t % 7 = 4 END AS hit FROM pairs WHERE f % 7 < 5"
    ),
    # The files of that tree: a comment, the imports, a mark, and a function with so many branches. Python files with
    # imports have errors, since folders are numbers; their functions are found all the same.
    "units": (
        f"SELECT p_partkey AS k, {path('p_partkey')} AS path, {lang('p_partkey')} AS language, CAST(p_partkey % 4 AS INT) AS branches, CAST(coalesce(n, 0) AS INT) AS n, p_partkey % 7 < 5 AS code, p_partkey % 7 < 5 AS parses, "
        "p_partkey % 7 < 5 AND p_partkey % 5 = 0 AS mark, p_partkey % 7 = 0 AND p_partkey % 3 = 0 AS test, "
        "CAST(2 + coalesce(n, 0) + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 AND p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS first, "
        "CAST(2 + (p_partkey % 4) * CASE WHEN p_partkey % 7 = 3 THEN 2 ELSE 3 END AS INT) AS size FROM part LEFT JOIN (SELECT f, count(*) AS n FROM imports GROUP BY f) i ON i.f = p_partkey"
    ),
    "chunk_files": "SELECT concat('doc/', CAST(doc_id AS STRING), '.md') AS path, lang AS language, text AS content FROM documents",
    "days": "SELECT datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, * FROM orders",
    "occurrences": (
        "SELECT CAST(o_custkey AS STRING) AS doc, 0 AS occ, concat('order ', CAST(o_orderkey AS STRING)) AS symbol, true AS is_def, day AS start_line, 0 AS start_char, day AS end_line, 1 AS end_char, "
        "day AS enc_start_line, 0 AS enc_start_char, day + 120 AS enc_end_line, 0 AS enc_end_char FROM days "
        "UNION ALL SELECT CAST(o_custkey AS STRING), CAST(l_linenumber AS INT), CASE WHEN l_partkey % 2 = 0 THEN concat('order ', CAST(1 + (l_orderkey * 7 + l_linenumber) % 15000 AS STRING)) "
        "ELSE concat('part ', CAST(l_partkey % 50 AS STRING)) END, false, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), CAST(l_linenumber * 2 AS INT), "
        "datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), CAST(l_linenumber * 2 + 1 AS INT), NULL, NULL, NULL, NULL FROM lineitem JOIN days ON l_orderkey = o_orderkey"
    ),
    "notes": "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 2 = 0 THEN 'file' ELSE 'project' END AS scope, role AS kind, text AS content, conv_id AS session_id FROM conversations",
    "surface": (
        "SELECT DISTINCT concat('app', CAST(s_nationkey AS STRING)) AS app, p_type AS kind, p_name AS name, p_brand AS method, concat(p_type, '.rs') AS file, p_size AS line "
        "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"
    ),
    "daily": "SELECT date_trunc('day', ts) AS day, user_id % 20 AS user_key, count(*) AS n, sum(value) AS total, max(value) AS top FROM events GROUP BY date_trunc('day', ts), user_id % 20",
}
NEEDS = {"edges": ("pairs",), "nodes": ("pairs",), "imports": ("pairs",), "units": ("pairs", "imports"), "occurrences": ("days",)}
#: Relations that are written once for a query, since several others read them.
WRITTEN = ("pairs", "imports")


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in (*NEEDS.get(n, ()), n):
            if m not in out:
                out.append(m)
    return out


def sql(query: str, *names: str) -> str:
    """query after the definitions of the relations that it reads."""
    recursive, body = ("RECURSIVE ", query.removeprefix("RECURSIVE ")) if query.startswith("RECURSIVE ") else ("", query)
    defined = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in _order(names))
    return f"WITH {recursive}{defined}{',' if body.startswith('+') else ''} {body.removeprefix('+')}" if names else query


class Source:
    """The driver's tables of one folder and the relations over them, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in RELATIONS:
            raise AttributeError(name)
        if name == "pairs":
            self.pairs = saved(self._pairs(), name)
            return self.pairs
        text = RELATIONS[name].replace('"', "`").replace("datediff('day', DATE '1970-01-01', ", "unix_date(")
        frames = {t: getattr(self, t) for t in (*TABLES, *RELATIONS) if t != name and _reads(text, t)}
        for t in frames:
            text = _placeholder(text, t)
        out = self.spark.sql(text, **frames)
        if name in WRITTEN:
            out = saved(out, name)
        setattr(self, name, out)
        return out

    def _pairs(self) -> DataFrame:
        """As in RELATIONS, but sizes are joined to items first: then only items of one order and size meet."""
        size = self.part.select(F.col("p_partkey").alias("l_partkey"), "p_size").hint("shuffle_hash")  # a row for each file: its columns look small for long
        items = self.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").join(size, "l_partkey")
        two = items.alias("a").join(items.alias("b"), F.expr("a.l_orderkey = b.l_orderkey AND a.p_size = b.p_size AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey"))
        return two.groupBy(F.col("a.l_partkey").alias("f"), F.col("b.l_partkey").alias("t")).agg(F.min("a.l_linenumber").alias("line"))

    @cached_property
    def code(self) -> DataFrame:
        """(path, language, content) of a source tree over imports and units."""
        by = lambda *options: F.element_at(F.array(*options), (F.col("k") % 7 + 1).cast("int"))
        lit = F.lit
        text = (
            F.when((F.col("f") % 7).isin(1, 2), F.when(F.col("t") % 3 == 0, F.format_string("import x from '%s';", "spec")).when(F.col("t") % 3 == 1, F.format_string("const x = require('%s');", "spec")).otherwise(F.format_string("export * from '%s';", "spec")))
            .when(F.col("f") % 7 == 3, F.when(F.col("t") % 2 == 0, F.format_string("from %s import x", "spec")).otherwise(F.format_string("import %s", "spec")))
            .when(F.col("f") % 7 == 0, F.format_string("use %s;", "spec")).otherwise(F.format_string('import "%s"', "spec"))
        )
        each = self.imports.groupBy(F.col("f").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))), lambda x: x["text"]).alias("imports"))
        name, none = F.concat(lit("f"), F.col("k").cast("string")), F.array().cast("array<string>")
        head = by(
            F.concat(F.when(F.col("k") % 2 == 0, "pub ").otherwise(""), lit("fn "), name, lit("(a: i32, b: i32) {")), F.concat(lit("export function "), name, lit("(a: number, b: number) {")),
            F.concat(lit("function "), name, lit("(a, b) {")), F.concat(lit("def "), name, lit("(a, b):")), F.concat(lit("func "), name, lit("(a int, b int) {")), lit(""), lit(""),
        )
        lines = lambda *x: F.array(*map(lit, x))
        # One branch each in three lines: plain, in templates inside of one another, after a type, and among tags.
        plain, template = lines("    if (a > 0) {", "        b();", "    }"), lines("    b(`a ${b ? `x{${a}` : ''} c", "        {{ ${a}; if (a) // }", "    `);")
        kind = lines("    type X<T> = T extends string ? `${T}` : never;", "    const re = /[/'\"{]/;", "    if (re.test(a) ) b();")
        tags = lines("    b(<p title=\"{\">Don't {a", "        && <b>it's {'{'}{/* { */}</b>} stop {'if'}", "    </p>);")
        script = lambda *other: F.element_at(F.array(plain, template, *other), (F.col("k") % 3 + 1).cast("int"))
        one = by(lines("    if a > 0 {", "        b();", "    }"), script(kind), script(tags), lines("    if a > 0:", "        b()"), lines("    if a > 0 {", "        b()", "    }"), none, none)
        sign = F.when(F.col("k") % 7 == 3, "# ").otherwise("// ")
        body = F.concat(
            F.array(F.concat(sign, lit("file "), F.col("k").cast("string"))), F.coalesce("imports", none), F.when(F.col("mark"), F.array(F.concat(sign, lit("TODO: check "), name))).otherwise(none),
            F.when(F.col("test"), lines("#[test]")).otherwise(none), F.array(head), F.flatten(F.array_repeat(one, F.col("branches"))), F.array(F.when(F.col("k") % 7 == 3, "    return a").otherwise("}")),
        )
        content = F.when(F.col("code"), F.concat(F.array_join(body, "\n"), lit("\n"))).when(F.col("k") % 7 == 5, F.format_string('{"k": %d}\n', "k")).otherwise(F.format_string("text of %d\n", "k"))
        return saved(self.units.join(each, "k", "left").select("path", "language", content.alias("content")), "code")


def _reads(text: str, name: str) -> bool:
    import re

    return bool(re.search(rf"\b(?:FROM|JOIN) {name}\b", text))


def _placeholder(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
