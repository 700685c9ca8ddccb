"""Scalar expressions: ramps, grades, estimates, classifiers."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Purposes of commands, first match wins, by substrings.
PURPOSES = (
    ("test", ("test", "spec", "pytest", "vitest", "jest", "cargo test")),
    ("lint", ("lint", "clippy", "eslint", "ruff", "flake8", "shellcheck")),
    ("format", ("fmt", "format", "prettier", "rustfmt", "black")),
    ("build", ("build", "compile", "bundle", "tsc", "vite build")),
    ("dev", ("dev", "watch", "start", "serve")),
    ("release", ("release", "publish", "ship", "deploy", "tag")),
    ("ci", ("ci", "workflow")),
    ("run", ("run", "cli")),
)
# Severities of tools.
SEVERITIES = {
    "semgrep": {"ERROR": "error", "WARNING": "warning", "INFO": "info"},
    "dependency-cruiser": {"error": "error", "warn": "warning", "info": "info", "ignore": "hint"},
    "clippy": {"error": "error", "warning": "warning", "note": "info", "help": "hint"},
    "eslint": {"2": "error", "1": "warning", "0": "info"},
    "ruff": {"error": "error", "warning": "warning"},
}


def ramp(value: Column, ok: float, bad: float) -> Column:
    """1 up to ok, 0 from bad on, a line between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (value.cast("double") - ok) / (bad - ok)))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def purpose(name: Column, body: Column) -> Column:
    s = F.lower(F.concat_ws(" ", name, body))
    out = F
    for kind, needles in PURPOSES:
        out = out.when(s.rlike("|".join(map(re.escape, needles))), kind)
    return out.otherwise("other")


def severity(tool: Column, raw: Column) -> Column:
    out = F.lit("warning")
    for name, kinds in SEVERITIES.items():
        for k, v in kinds.items():
            out = F.when((tool == name) & (raw == k), v).otherwise(out)
    return out


def snippet(content: Column, lines: int = 12) -> Column:
    """The first lines, and a mark where there are more."""
    parts = F.split(content, "\n")
    return F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.when(F.size(parts) > lines, "\n…").otherwise(""))


def tokens_of_prose(s: Column) -> Column:
    return F.ceil(F.octet_length(s) / 4)


def tokens_of_code(s: Column) -> Column:
    return F.ceil(F.octet_length(s) * 2 / 7)


def hotspot_score(churn: Column, complexity: Column) -> Column:
    return F.log2(churn + F.lit(1.0)) * F.greatest(complexity.cast("double"), F.lit(1.0))


def content_hash(content: Column, digits: int = 32) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, digits)


def drift_cutoff(window: str) -> timedelta:
    """7d, 48h or 30m."""
    m = re.fullmatch(r"\s*(\d+)\s*([dhm])\s*", window)
    if not m:
        raise ValueError(f"no window: {window!r}")
    return timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])})


def window_days(window: str) -> int:
    """The same in whole days, 1 at least: hours round up, minutes down."""
    t = drift_cutoff(window)
    if window.strip()[-1] == "m":
        return max(1, t.days)
    return max(1, -(-t // timedelta(days=1)))
