"""SCIP indexes: protobuf messages decoded field by field, no generated code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.schemas import RELATIONS

# Field numbers of the public message definitions.
INDEX_DOCUMENT, INDEX_EXTERNAL = 2, 3
DOC_PATH, DOC_OCCURRENCE, DOC_SYMBOL = 1, 2, 3
OCC_RANGE, OCC_SYMBOL, OCC_ROLES, OCC_ENCLOSING = 1, 2, 3, 7
SYM_SYMBOL, SYM_KIND, SYM_DISPLAY = 1, 5, 6
DEFINITION = 1


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = b[at : at + n], at + n
        yield key >> 3, value


def _ints(parts: list) -> list[int]:
    out = []
    for p in parts:
        if isinstance(p, int):
            out.append(p)
            continue
        at = 0
        while at < len(p):
            v, at = _varint(p, at)
            out.append(v)
    return [v - (1 << 64) if v >> 63 else v for v in out]


def span(parts: list) -> tuple:
    """Three numbers are within a line, four are over lines, others none."""
    v = _ints(parts)
    if len(v) == 3:
        return v[0], v[1], v[0], v[2]
    return tuple(v) if len(v) == 4 else (None,) * 4


def _symbol(b: bytes) -> tuple[str, str, int]:
    name, shown, kind = "", "", 0
    for f, v in fields(b):
        if f == SYM_SYMBOL:
            name = v.decode()
        elif f == SYM_DISPLAY:
            shown = v.decode()
        elif f == SYM_KIND:
            kind = v
    return name, shown, kind


def documents(index: bytes) -> Iterator[tuple]:
    for f, v in fields(index):
        if f == INDEX_DOCUMENT:
            path, occ, sym = "", [], []
            for g, w in fields(v):
                if g == DOC_PATH:
                    path = w.decode()
                elif g == DOC_OCCURRENCE:
                    occ.append(w)
                elif g == DOC_SYMBOL:
                    sym.append(_symbol(w))
            yield path, occ, sym
        elif f == INDEX_EXTERNAL:
            yield None, [], [_symbol(v)]


def occurrences_of(index: bytes) -> Iterator[tuple]:
    for path, occ, _ in documents(index):
        for i, b in enumerate(occ):
            where, around, symbol, roles = [], [], "", 0
            for f, v in fields(b):
                if f == OCC_RANGE:
                    where.append(v)
                elif f == OCC_ENCLOSING:
                    around.append(v)
                elif f == OCC_SYMBOL:
                    symbol = v.decode()
                elif f == OCC_ROLES:
                    roles = v
            at = span(where)
            if at[0] is not None:
                symbol = f"{path}#{symbol}" if symbol.startswith("local ") else symbol  # local names are a document's own
                yield (path, i, symbol, bool(roles & DEFINITION), *at, *span(around))


def read_indexes(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(occurrences, symbols) of one or more indexes: several are simply read together."""
    raw = spark.read.format("binaryFile").load(paths).select("content")

    def table(names, rows):
        def run(frames):
            for f in frames:
                for content in f["content"]:
                    if found := list(rows(bytes(content))):
                        yield pd.DataFrame(found, columns=names).astype({n: "Int32" for n in names if n.endswith(("_line", "_char")) or n in ("occ", "kind")})
        return run

    occ_names = [c.split()[0] for c in RELATIONS["occurrences"].split(", ")]
    occ = raw.mapInPandas(table(occ_names, occurrences_of), RELATIONS["occurrences"])
    rows = lambda b: ((n, d, k, p is None) for p, _, sym in documents(b) for n, d, k in sym)
    return occ, raw.mapInPandas(table(["symbol", "display_name", "kind", "external"], rows), RELATIONS["symbols"])


def rebuild_languages(delta: DataFrame) -> list[str]:
    """Languages of changed paths, for which an index has to be made anew."""
    from lodestrata.functions.paths import language

    return [r[0] for r in delta.select(language(F.col("path")).alias("l")).where("l IS NOT NULL").distinct().orderBy("l").collect()]
