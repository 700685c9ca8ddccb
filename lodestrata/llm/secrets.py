"""Secret scans with multipart credential linking.

Base spans are matches of three patterns. Weak candidates (an identifier, a bare secret, an endpoint) mean little alone:
they are reported only where complementary parts stand in one scope. The link is an interval join: identifiers, secrets
and endpoints of a text, widened to their scopes and sorted, are swept once; a weak part is reported if the scope of a
part of the other kind reaches it, an endpoint if both kinds do.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ship, table
from lodestrata.llm.words import lean, slices

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Fixed patterns of the base kinds, each with the group that is measured and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs are maximal: the same as [0-9a-f]+ of 16 or more
)
#: Weak parts: account names beside a key word, bare tokens of mixed characters, addresses of services.
IDENTIFIER = re.compile(r"""(?:client|access_?key|account|tenant|user)[_-]?(?:id|name)?["']?[ ]*[:=][ ]*["']?([A-Za-z0-9@._-]{3,})""", re.A | re.I)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", re.A | re.I)
#: Characters on both sides that belong to a part's scope.
SCOPE = 200


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        if kind == 1 and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch none of those that are taken; both sorted."""
    out, j = [], 0
    for a, b in spans:
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        if j == len(taken) or taken[j][0] >= b:
            out.append((a, b))
    return out


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _near(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[bool]:
    """Interval join as a sweep over two sorted lists: whether one of the others is in each span's scope."""
    out, j = [], 0
    others = _disjoint(others)
    for a, b in spans:
        while j < len(others) and others[j][1] < a - SCOPE:
            j += 1
        out.append(j < len(others) and others[j][0] <= b + SCOPE)
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) and sorted."""
    base = base_spans(text)
    taken = _disjoint([(a, b) for a, _, b in base])
    secrets = _free([m.span() for m in SECRET.finditer(text)], taken) if len(text) >= 32 else []
    if not base and not secrets:
        return base, base
    names = _free([m.span(1) for m in IDENTIFIER.finditer(text)], taken)
    ends = _free([m.span() for m in ENDPOINT.finditer(text)], taken)
    all_names = sorted([(a, b) for a, k, b in base if k == 1] + names)
    all_secrets = sorted([(a, b) for a, k, b in base if k != 1] + secrets)
    # A bare secret inside an address belongs to it, and a name to a secret that holds it.
    found = list(base)
    found += [(a, 3, b) for (a, b), ok in zip(names, _near(names, all_secrets)) if ok]
    found += [(a, 4, b) for (a, b), ok in zip(secrets, _near(secrets, all_names)) if ok]
    found += [(a, 5, b) for (a, b), x, y in zip(ends, _near(ends, all_names), _near(ends, all_secrets)) if x and y]
    return base, sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs (doc_id long, text string).

    spans: kind:start:end in code points, by start and then by kind as listed, commas between. A null text is empty and
    has no spans. Rows that repeat are returned each; a row's doc_id may be null. Other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            found = [all_spans(t or "") for t in b.column("text").to_pylist()]
            counts = {f"n_{k}": pa.array([sum(s[1] == i for s in base) for base, _ in found], pa.int64()) for i, k in enumerate(KINDS[:3])}
            yield pa.record_batch({"doc_id": b.column("doc_id")} | counts | {
                "base_sha256": pa.array([sha256(_joined(base).encode()).hexdigest() for base, _ in found]),
                "spans": pa.array([_joined(s) for _, s in found], pa.string()),
            })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows and columns of docs with the mark in place of all spans (but endpoints) of text; null stays null."""
    ship(docs.sparkSession)

    def redacted(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, b in _disjoint([(a, b) for a, k, b in all_spans(text)[1] if k != 5]):
            out += [text[at:a], mark]
            at = b
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        for b in slices(batches):
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array([redacted(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
