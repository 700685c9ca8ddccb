"""Outputs of external analysis tools (JSON) as the relations diagnostics and components."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scores import severity

SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,`end`:struct<line:int,col:int>,extra:struct<message:string,severity:string,metadata:struct<category:string,source:string>>>>"
RUFF = "code string, message string, filename string, url string, location struct<row:int,column:int>, end_location struct<row:int,column:int>"
ESLINT = "filePath string, messages array<struct<ruleId:string,severity:int,message:string,line:int,column:int,endLine:int,endColumn:int>>"
CLIPPY = "reason string, message struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,line_end:int,column_start:int,column_end:int,is_primary:boolean>>>"
DEPCRUISE = "summary struct<violations:array<struct<`from`:string,`to`:string,rule:struct<name:string,severity:string>>>>"
TOKEI = "map<string, struct<code:int,comments:int,blanks:int,reports:array<struct<name:string,stats:struct<code:int>>>>>"
FIELDS = ("tool", "rule", "severity", "message", "file", "line", "column", "end_line", "end_column", "url", "category")


def _row(tool: str, raw: Column, **cols) -> list[Column]:
    types = {"line": "int", "column": "int", "end_line": "int", "end_column": "int"}
    cols |= {"tool": F.lit(tool), "severity": severity(F.lit(tool), raw.cast("string"))}
    return [cols.get(f, F.lit(None)).cast(types.get(f, "string")).alias(f) for f in FIELDS]


def semgrep(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(SEMGREP).json(path, multiLine=True).select(F.explode("results").alias("r"))
    c = F.col
    return r.select(*_row("semgrep", c("r.extra.severity"), rule=c("r.check_id"), message=c("r.extra.message"), file=c("r.path"), line=c("r.start.line"), column=c("r.start.col"), end_line=c("r.end.line"), end_column=c("r.end.col"), url=c("r.extra.metadata.source"), category=c("r.extra.metadata.category")))


def ruff(spark: SparkSession, path: str) -> DataFrame:
    c = F.col
    return spark.read.schema(RUFF).json(path, multiLine=True).select(*_row("ruff", F.lit("warning"), rule=c("code"), message=c("message"), file=c("filename"), line=c("location.row"), column=c("location.column"), end_line=c("end_location.row"), end_column=c("end_location.column"), url=c("url")))


def eslint(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(ESLINT).json(path, multiLine=True).select("filePath", F.explode("messages").alias("m"))
    c = F.col
    return r.select(*_row("eslint", c("m.severity"), rule=c("m.ruleId"), message=c("m.message"), file=c("filePath"), line=c("m.line"), column=c("m.column"), end_line=c("m.endLine"), end_column=c("m.endColumn")))


def clippy(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(CLIPPY).json(path).where("reason = 'compiler-message'")
    r = r.select("message", F.try_element_at(F.filter("message.spans", lambda s: s["is_primary"]), F.lit(1)).alias("s")).where("s IS NOT NULL")
    c = F.col
    return r.select(*_row("clippy", c("message.level"), rule=c("message.code.code"), message=c("message.message"), file=c("s.file_name"), line=c("s.line_start"), column=c("s.column_start"), end_line=c("s.line_end"), end_column=c("s.column_end")))


def dependency_cruiser(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(DEPCRUISE).json(path, multiLine=True).select(F.explode("summary.violations").alias("v"))
    c = F.col
    return r.select(*_row("dependency-cruiser", c("v.rule.severity"), rule=c("v.rule.name"), message=F.format_string("%s → %s", c("v.from"), c("v.to")), file=c("v.from"), category=F.lit("dependency")))


def cargo_modules(spark: SparkSession, path: str) -> DataFrame:
    """Orphaned modules, one a line of text."""
    m = F.regexp_extract("value", r"orphaned module `?([\w:]+)`?.*?at\s+(\S+)", 1)
    f = F.regexp_extract("value", r"orphaned module `?([\w:]+)`?.*?at\s+(\S+)", 2)
    return spark.read.text(path).where(m != "").select(*_row("cargo-modules", F.lit("warning"), rule=F.lit("orphan"), message=F.concat(F.lit("orphaned module "), m), file=f))


def tokei(spark: SparkSession, path: str) -> DataFrame:
    """(path, loc) of tokei's report."""
    r = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TOKEI)).alias("language", "l"))
    return r.select(F.explode("l.reports").alias("r")).select(F.regexp_replace("r.name", r"^\./", "").alias("path"), F.col("r.stats.code").alias("loc"))


READERS = {"semgrep": semgrep, "ruff": ruff, "eslint": eslint, "clippy": clippy, "dependency-cruiser": dependency_cruiser, "cargo-modules": cargo_modules}


# How each tool is called in a tree.
COMMANDS = {
    "semgrep": "semgrep scan --config auto --json --no-git-ignore --quiet --metrics=off --timeout 60 .",
    "ruff": "ruff check --output-format=json --no-cache .",
    "eslint": "npx --no-install eslint --format json .",
    "clippy": "cargo clippy --workspace --message-format=json --quiet --all-targets --no-deps",
    "dependency-cruiser": "npx --no-install depcruise --output-type json src",
    "cargo-modules": "cargo modules orphans",
}


def _called(command: str, root: str, timeout: int) -> tuple[bytes, str | None]:
    """(output, error): tools that find something end with an error code, so only a lack of output is an error."""
    try:
        done = subprocess.run(command.split(), cwd=root, capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.SubprocessError) as e:
        return b"", f"{type(e).__name__}: {e}"[:300]
    return done.stdout, None if done.stdout.strip() or not done.returncode else done.stderr.decode(errors="replace").strip()[:300] or f"exit code {done.returncode}"


def run_tools(spark: SparkSession, root: str, store: str, only: list[str] | None = None, timeout: int = 600) -> DataFrame:
    """Runs the tools that are installed on this machine over a local tree and keeps their reports below store, where
    read_all() finds them; a tool that isn't installed is passed over. Returns the relation tool_status."""
    from lodestrata.schemas import RELATIONS

    rows, kept = [], {}
    for tool, command in COMMANDS.items():
        if only and tool not in only:
            continue
        if not shutil.which(command.split()[0]):
            rows.append((tool, False, False, None, 0, None))
            continue
        version = _called(f"{command.split()[0]} --version", root, 20)[0].decode(errors="replace").strip().split("\n")[0] or None
        output, error = _called(command, root, timeout)
        if error is None:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/diagnostics/{tool}.json")
            out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
            out.write(bytearray(output))
            out.close()
            kept[tool] = f"{store}/diagnostics/{tool}.json"
        rows.append((tool, True, error is None, version, 0, error))
    found = {r.tool: r.n for r in read_all(spark, kept).groupBy("tool").agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame([(*r[:4], found.get(r[0], 0), r[5]) for r in rows], RELATIONS["tool_status"])


def read_all(spark: SparkSession, outputs: dict[str, str]) -> DataFrame:
    """All diagnostics of the outputs that there are, by tool."""
    from lodestrata.schemas import RELATIONS
    from lodestrata.storage import exists

    out = spark.createDataFrame([], RELATIONS["diagnostics"])
    for tool, path in outputs.items():
        if exists(spark, path):
            out = out.unionByName(READERS[tool](spark, path))
    return out


def tool_status(diagnostics: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """A row for each known tool: whether it ran, and its findings."""
    known = diagnostics.sparkSession.createDataFrame([(t, t in outputs) for t in READERS], "tool string, ran boolean")
    return known.join(diagnostics.groupBy("tool").agg(F.count("*").alias("findings")), "tool", "left").fillna(0, ["findings"])


def filtered(diagnostics: DataFrame, tool: str | None = None, severity_: str | None = None, file: str | None = None, limit: int = 200) -> DataFrame:
    for c, v in (("tool", tool), ("severity", severity_), ("file", file)):
        diagnostics = diagnostics.where(F.col(c) == v) if v else diagnostics
    return diagnostics.orderBy("file", "line", "tool", "rule").limit(limit)


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupingSets([["tool"], ["severity"]], "tool", "severity").agg(F.count("*").alias("n"))


def components(spark: SparkSession, path: str) -> DataFrame:
    """React components of a react-docgen report: {file: [{displayName, description, props: {name: {...}}}]}."""
    prop = "struct<required:boolean,description:string,type:struct<name:string>,tsType:struct<name:string>>"
    shape = f"map<string, array<struct<displayName:string,description:string,props:map<string,{prop}>>>>"
    r = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("file", "cs")).select("file", F.explode("cs").alias("c"))
    props = F.transform(
        F.coalesce(F.map_entries("c.props"), F.array().cast(f"array<struct<key:string,value:{prop}>>")),
        lambda e: F.struct((~F.coalesce(e["value"]["required"], F.lit(False))).alias("optional"), e["key"].alias("name"), F.coalesce(e["value"]["type"]["name"], e["value"]["tsType"]["name"]).alias("type"), e["value"]["description"].alias("description")),
    )  # required ones first, then by name
    return r.select("file", F.col("c.displayName").alias("name"), F.col("c.description").alias("description"), F.transform(F.sort_array(props), lambda p: F.struct((~p["optional"]).alias("required"), p["name"].alias("name"), p["type"].alias("type"), p["description"].alias("description"))).alias("props"))
