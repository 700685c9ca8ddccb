"""Small configuration files, read on the driver, and what bulk ones hold, read by Spark."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.paths import glob_regex
from lodestrata.functions.scores import purpose
from lodestrata.schemas import RELATIONS

OWNER_PLACES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
# What every crate can run.
CARGO = (("build", "cargo build"), ("test", "cargo test"), ("check", "cargo check"), ("fmt", "cargo fmt"), ("clippy", "cargo clippy"), ("run", "cargo run"))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file from any store that Spark reads; None if it isn't there."""
    from lodestrata.storage import exists

    if not exists(spark, path):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row.value if row else ""


def load_toml(text: str | None) -> dict:
    return tomllib.loads(text) if text else {}


def strip_comments(text: str) -> str:
    """JSON with comments as JSON: strings stay."""
    return re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0][0] == '"' else "", text, flags=re.S)


def ts_aliases(text: str | None) -> list[tuple[str, list[str]]] | None:
    """compilerOptions.paths of a tsconfig or jsconfig; None where there are none."""
    try:
        paths = json.loads(strip_comments(text or "")).get("compilerOptions", {}).get("paths", {})
    except (ValueError, AttributeError):
        return None
    out = [(k, [x for x in v if isinstance(x, str) and "node_modules" not in x]) for k, v in paths.items() if isinstance(v, list)]
    return [(k, v) for k, v in out if v] or None


def rust_crates(manifests: dict[str, str]) -> dict[str, str]:
    """Crate names (with _) to source folders, of Cargo.toml texts by path."""
    out = {}
    for path, text in manifests.items():
        try:
            name = tomllib.loads(text).get("package", {}).get("name")
        except tomllib.TOMLDecodeError:
            continue
        if isinstance(name, str):
            folder = str(PurePosixPath(path).parent)
            out[name.replace("-", "_")] = "src" if folder == "." else f"{folder}/src"
    return out


def go_modules(manifests: dict[str, str]) -> dict[str, str]:
    """Module paths to folders, of go.mod texts by path."""
    out = {}
    for path, text in manifests.items():
        if m := re.search(r"^\s*module\s+(\S+)", text, re.M):
            folder = str(PurePosixPath(path).parent)
            out[m[1].strip('"')] = "" if folder == "." else folder
    return out


def owner_rules(spark: SparkSession, text: str | None) -> DataFrame:
    """Rules of a CODEOWNERS text; comments, negations and rules without owners are passed over."""
    rows = []
    for line in (text or "").splitlines():
        parts = line.split("#", 1)[0].split()
        if len(parts) > 1 and not parts[0].startswith("!"):
            rows.append((len(rows), parts[0], parts[1:]))
    return spark.createDataFrame(rows, RELATIONS["owner_rules"])


def artifacts(spark: SparkSession, text: str | None) -> DataFrame:
    """A registry of artifacts: an object with a list in it, or the list."""
    data = json.loads(text) if text else []
    data = data.get("artifacts", []) if isinstance(data, dict) else data
    rows = [(a["name"], a.get("description"), list(a.get("paths", [])), a.get("when")) for a in data]
    return spark.createDataFrame(rows, RELATIONS["artifacts"])


def resolve_artifact(files: DataFrame, paths: list[str]) -> DataFrame:
    return files.where(F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in paths) or "^$")).select("path", "content")


def commands(texts: DataFrame) -> DataFrame:
    """named_commands of package.json, Cargo.toml, justfile, Makefile, pyproject.toml and workflow texts (path, content)."""
    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(n, c, s) for p, t in zip(f["path"], f["content"]) for n, c, s in _commands(p, t or "")]
            if rows:
                yield pd.DataFrame(rows, columns=["name", "command", "source"])

    found = texts.select("path", "content").mapInPandas(run, "name string, command string, source string")
    return found.withColumn("purpose", purpose(F.col("name"), F.col("command")))


def _commands(path: str, text: str):
    name = PurePosixPath(path).name
    try:
        if name == "package.json":
            for k, v in (json.loads(text).get("scripts") or {}).items():
                yield k, f"npm run {k}", "package.json"
        elif name == "Cargo.toml":
            for k, v in CARGO:
                yield k, v, "cargo"
        elif name == "config.toml" and ".cargo/" in path:
            for k, v in tomllib.loads(text).get("alias", {}).items():
                yield k, f"cargo {k}", "cargo"
        elif name.lower() in ("justfile", ".justfile"):
            for m in re.finditer(r"^@?([A-Za-z_][\w-]*)(?:\s+[^:=\n]*)?:(?!=)", text, re.M):
                yield m[1], f"just {m[1]}", "just"
        elif name in ("Makefile", "makefile", "GNUmakefile"):
            for m in re.finditer(r"^([A-Za-z0-9][\w./-]*)\s*:(?![=:])", text, re.M):
                yield m[1], f"make {m[1]}", "make"
        elif name == "pyproject.toml":
            data = tomllib.loads(text)
            tool = data.get("tool", {})
            for table, call in ((data.get("project", {}).get("scripts", {}), "{}"), (tool.get("poetry", {}).get("scripts", {}), "poetry run {}"), (tool.get("poe", {}).get("tasks", {}), "poe {}")):
                for k in table:
                    yield k, call.format(k), "python"
        elif ".github/workflows/" in path:
            m = re.search(r"^name:\s*(.+)$", text, re.M)
            yield (m[1].strip().strip("'\"") if m else PurePosixPath(path).stem), path, "github"
    except (ValueError, tomllib.TOMLDecodeError, AttributeError):
        return


SOURCE_ORDER = ("package.json", "just", "make", "cargo", "python")


def suggested(found: DataFrame) -> DataFrame:
    """The first command for each purpose, by source and name; run stands in for dev."""
    order = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source"))
    rows = found.where(F.col("source").isin(*SOURCE_ORDER)).groupBy("purpose").agg(F.min_by("command", F.struct(order, "name")).alias("command"))
    slot = F.when(F.col("purpose").isin("dev", "run"), "run").otherwise(F.col("purpose"))
    return (
        rows.where(F.col("purpose").isin("dev", "run", "build", "test", "lint", "format")).groupBy(slot.alias("slot"))
        .agg(F.min_by("command", F.when(F.col("purpose") == "dev", 0).otherwise(1)).alias("command"))
    )
