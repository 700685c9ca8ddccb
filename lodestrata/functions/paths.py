"""Predicates and keys on file paths, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "rs": "rust", "py": "python", "go": "go", "java": "java", "rb": "ruby", "json": "json", "toml": "toml", "md": "markdown", "html": "html", "css": "css",
}
PARSED = ("typescript", "javascript", "rust", "python", "go")
# Names of entry points.
ENTRY_NAMES = (
    "main.rs lib.rs build.rs mod.rs index.ts index.tsx index.js index.jsx index.mts index.mjs index.cts index.cjs main.ts main.tsx main.js "
    "main.jsx app.ts app.tsx app.js app.jsx _app.tsx _app.jsx server.ts server.js __init__.py __main__.py manage.py app.py main.py setup.py conftest.py"
).split()
ENTRY_SUFFIXES = (".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.tsx", ".spec.js", "_test.rs", "_test.py")
# Marks of test files.
TEST_SUFFIXES = (".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "_test.rs", "_test.py", "_test.go")
TEST_DIRS = ("tests", "__tests__", "spec")
# Directories that a watcher passes over.
SKIPPED_DIRS = (".git", "node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__", ".next", ".cache")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """Language of a path by its extension; null where it isn't known."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(known, F.regexp_extract(basename(path), r"\.([A-Za-z0-9]+)$", 1))


def has_parser(lang: Column) -> Column:
    return lang.isin(*PARSED)


def group_key(path: Column, depth: int) -> Column:
    """Module of a path: at most depth (1 at least) leading directories, (root) for top-level files."""
    s = F.split(path, "/")
    n = F.greatest(F.lit(1), F.least(F.lit(depth), F.size(s) - 1))
    return F.when(F.size(s) == 1, "(root)").otherwise(F.array_join(F.slice(s, F.lit(1), n), "/"))


def _alternatives(names) -> str:
    return "|".join(map(re.escape, names))


def is_entry_point(path: Column) -> Column:
    """One pattern, so that the path's own expression is evaluated once."""
    ends = "|".join(re.escape(x) for x in ENTRY_SUFFIXES)
    return F.lower(path).rlike(rf"(?:^|/)(?:{_alternatives(ENTRY_NAMES)})$|\.(?:config|setup)\.[^/]*$|(?:{ends})$|(?:^|/)test_[^/]*$")


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(rf"(?:^|/)(?:{_alternatives(TEST_DIRS)})/|(?:^|/)conftest\.py$|(?:^|/)test_[^/]*\.py$|(?:{_alternatives(TEST_SUFFIXES)})$")


# Files that nothing imports but that aren't dead, by whole paths, ends, parts and first folders.
EXEMPT_PATHS = ("lib.rs", "main.rs")
EXEMPT_ENDS = (
    "/lib.rs", "/main.rs", "/mod.rs", "/__init__.py", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js",
    ".spec.jsx", "_test.go",
)
EXEMPT_PARTS = ("/src/bin/", "/tests/", "/benches/", "/examples/")
EXEMPT_FOLDERS = ("tests/", "benches/", "examples/")


def is_dead_code_exempt(path: Column) -> Column:
    exempt = f"^(?:{_alternatives(EXEMPT_PATHS)})$|(?:{_alternatives(EXEMPT_ENDS)})$|{_alternatives(EXEMPT_PARTS)}|^(?:{_alternatives(EXEMPT_FOLDERS)})"
    return F.translate(path, "\\", "/").rlike(exempt)


def has_inline_tests(lang: Column, content: Column) -> Column:
    return (
        F.when(lang == "rust", content.contains("#[cfg(test)]") | content.contains("#[test]")).when(lang == "go", content.contains("*testing.T)")).otherwise(False)
    )


def is_watched(path: Column) -> Column:
    """Paths whose change matters: of a known language, outside directories that are passed over."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRS))) & language(F.lower(path)).isNotNull()


def normalize_delta_path(path: Column, prefix: str | None = None) -> Column:
    """A path relative to a subdirectory, with / between parts; null outside it."""
    p = F.translate(path, "\\", "/")
    if not prefix:
        return p
    prefix = prefix.rstrip("/") + "/"
    return F.when(p.startswith(prefix), F.substring(p, F.lit(len(prefix) + 1), F.length(p)))


def normalize(path: Column) -> Column:
    """Resolves . and .. in a relative path."""
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
    step = lambda out, x: F.when((x == "") | (x == "."), out).when(x == "..", up(out)).otherwise(F.concat(out, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("CAST(array() AS array<string>)"), step), "/")


def parent(path: Column) -> Column:
    """Directory of a path, empty for top-level files."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def prefixes(path: Column) -> Column:
    """A path and all folders that it lies in."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def glob_regex(glob: str, separator: bool = False) -> str:
    """A regular expression for a glob (? * ** [..] {a,b}); with separator * and ? stop at /."""
    one = "[^/]" if separator else "."
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def owner_regex(pattern: str) -> str:
    """A CODEOWNERS pattern: a leading / anchors, a trailing / means all below, others match at any depth."""
    anchored, p = pattern.startswith("/"), pattern.removeprefix("/")
    p += "**" if p.endswith("/") else ""
    return glob_regex(p if anchored else "**/" + p, separator=True)


#: What a pattern may be looked up by: the folder that it begins in, a whole part of a path, the ending of a file; and for
#: patterns that have none of these, the same for all.
ANY = "*"


def owner_key(pattern: str) -> str:
    """A key that owner_keys() gives for every path that the pattern can match."""
    anchored, parts = pattern.startswith("/"), pattern.removeprefix("/").rstrip("/").split("/")
    if set(pattern) & set("{}\\"):  # a slash may stand inside of braces
        return ANY
    plain = [not set(x) & set("*?[]") for x in parts]
    if anchored and plain[0]:
        n = plain.index(False) if False in plain else len(plain)
        return "/" + "/".join(parts[:n])
    if True in plain:
        return "=" + max((x for x, p in zip(parts, plain) if p), key=len)
    ending = re.search(r"(?<=\.)[^.*?\[\]]+$", parts[-1])
    return "." + ending[0] if ending and not pattern.endswith("/") else ANY


def owner_keys(path: Column) -> Column:
    """The keys of a path: all folders that it lies in and itself, its parts, its ending, and the one for all."""
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.array_distinct(F.concat(heads, F.transform(parts, lambda x: F.concat(F.lit("="), x)), F.array(F.concat(F.lit("."), F.regexp_extract(path, r"([^./]*)$", 1)), F.lit(ANY))))
