"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition of the distinct vectors keeps its count, exact sums, and all singular values and vectors of its centred
rows. Summaries are merged in groups of MERGE, round by round: scaled singular vectors are stacked with one row for each
difference of means, and decomposed again. Nothing is cut off, so the last summary has the principal axes of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import release, save, ship, table

#: Components that are returned, summaries merged at a time, rows decomposed at a time (or twice the dimensions, if more).
COMPONENTS, MERGE, ROWS = 4, 8, 4096
SCALE = 256.0
SUMMARY = "part long, n long, high binary, low binary, axes binary"


class Summary:
    """Count, exact sums (Python integers) and singular values times vectors (a row each) of centred rows."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray):
        self.n, self.sums, self.axes = n, sums, axes

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        sums = [(int(h) << 32) + int(lo) for h, lo in zip(high, low)]
        return Summary(len(x), sums, reduced(x - np.array([s / len(x) for s in sums])))

    @staticmethod
    def merged(parts: list[Summary]) -> Summary:
        """All in one: their axes, and for each further part a row for the distance between its mean and that of those before."""
        n, sums, rows = parts[0].n, parts[0].sums, [parts[0].axes]
        for p in parts[1:]:
            # the difference of means, from integers: (sums / n) - (p.sums / p.n)
            gap = np.array([(a * p.n - b * n) / (n * p.n) for a, b in zip(sums, p.sums)])
            rows += [p.axes, sqrt(n / (n + p.n) * p.n) * gap[None, :]]
            n, sums = n + p.n, [a + b for a, b in zip(sums, p.sums)]
        return Summary(n, sums, reduced(np.vstack(rows))) if len(parts) > 1 else parts[0]

    def row(self, part: int) -> dict:
        high, low = np.array([s >> 32 for s in self.sums], np.int64), np.array([s & 0xFFFFFFFF for s in self.sums], np.int64)
        return {"part": part, "n": self.n, "high": high.tobytes(), "low": low.tobytes(), "axes": self.axes.tobytes()}

    @staticmethod
    def read(r) -> Summary:
        sums = [(int(h) << 32) + int(lo) for h, lo in zip(np.frombuffer(r.high, np.int64), np.frombuffer(r.low, np.int64))]
        return Summary(int(r.n), sums, np.frombuffer(r.axes).reshape(-1, len(sums)))

    def principal(self, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Up to k unit axes (rows) with variance, their variances, and the variance of all. Each axis has its largest entry
        positive. What rounding alone can make is no variance."""
        _, s, v = np.linalg.svd(self.axes, full_matrices=False)
        some = s > s.max(initial=0) * max(self.axes.shape) * np.finfo(float).eps
        v, s = v[some], s[some]
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None] if len(v) else v
        return v[:k], (s * s / self.n)[:k], float((s * s).sum() / self.n)


def reduced(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors: as many rows as the lesser dimension, with the same product."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the usable rows, their lengths, their entries one after the other) of a column of lists.

    Rows that are null, or hold an entry that is null, not finite, or beyond 64 bits as an integer, aren't usable.
    """
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    values = lists.flatten()  # what null rows may hide is left out
    x = np.floor(SCALE * np.asarray(values.fill_null(np.nan), dtype=np.float64))
    good = np.abs(x) < 2.0**62
    start = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~good)])
    fine = (bad[start[1:]] == bad[start[:-1]]) & np.asarray(lists.is_valid())
    return np.flatnonzero(fine), lengths[fine], x[np.repeat(fine, lengths)].astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, x): the entries as bytes of 64-bit integers."""
    for b in batches:
        _, lengths, x = integers(b.column(0))
        offsets = np.concatenate([[0], np.cumsum(8 * lengths)]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int64)), data], ["dims", "x"])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def _summaries(dims: int):
    """One summary of a partition, merged from summaries of at most ROWS rows (or twice the dimensions) each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got, waiting, have = [], [], 0
        for b in batches:
            waiting.append(_matrix(b.column(0), dims))
            have += len(waiting[-1])
            if have >= max(ROWS, 2 * dims):
                got, waiting, have = [Summary.merged([*got, Summary.of(np.vstack(waiting))])], [], 0
        if have:
            got = [Summary.merged([*got, Summary.of(np.vstack(waiting))])]
        if got:
            row = got[0].row(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("n", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("axes", pa.binary())]))
    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    parts = [Summary.read(r) for r in rows.sort_values("part").itertuples()]
    return pd.DataFrame([Summary.merged(parts).row(int(rows.part.min()) // MERGE)])


def summary(fit: DataFrame, dims: int) -> Summary:
    """The summary of all rows of fit (x binary, of one length): merged in a tree, so a task holds MERGE summaries at most."""
    level = save(fit.select("x").mapInArrow(_summaries(dims), SUMMARY), "summaries")
    parts = level.agg(F.max("part")).first()[0]
    while parts:
        above = save(level.groupBy(F.expr(f"part div {MERGE}")).applyInPandas(_merge, SUMMARY), "summaries")
        release(level)
        level, parts = above, parts // MERGE
    out = Summary.read(level.first())
    release(level)
    return out


class Model:
    """Projects integer vectors on the components of a summary."""

    def __init__(self, fit: Summary, components: int):
        self.n, self.sums = fit.n, fit.sums
        axes, variances, self.trace = fit.principal(components)
        self.explained = [float(e / self.trace) for e in variances]
        self.weights = (axes / np.sqrt(variances)[:, None]).T if len(axes) else np.zeros((len(fit.sums), 0))

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: Python integers where 64 bits might not do for the sum of their squares."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest * largest * x.shape[1] < 2**63 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets / self.n).astype(np.float64) @ self.weights


def _projected(model: Model, dims: int):
    """(vec_id, deviation, whitened) of the rows of one length; a deviation beyond 64 bits is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, lengths, x = integers(b.column(1))
            mine = lengths == dims
            ids, x = b.column(0).take(pa.array(places[mine])), x[np.repeat(mine, lengths)].reshape(-1, dims)
            y = model.offsets(x)
            squares = [int(d) if d < 2**63 else None for d in (y * y).sum(1)]
            white = model.whitened(y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(squares, pa.int64()), lists], ["vec_id", "deviation", "whitened"])
    return run


def _fit_projected(model: Model, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.whitened(model.offsets(_matrix(b.column(0), dims)))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i], pa.float64()) for i in range(w.shape[1])], [f"w{i}" for i in range(w.shape[1])])
    return run


def identity_error(fit: DataFrame, model: Model, dims: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = model.weights.shape[1]
    white = fit.select("x").mapInArrow(_fit_projected(model, dims), ", ".join(f"w{i} double" for i in range(k)))
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector of vectors (vec_id,
    embedding) and component.

    Vectors are usable if they aren't null and hold no entry that is null, not finite or beyond 62 bits when scaled. Rows that
    repeat are returned each; the fit takes each distinct vector once. Vectors of different lengths are whitened apart, one
    length after the other, so the driver holds their lengths and one model. Components without variance aren't returned:
    none at all where all vectors of a length are equal, or have no entries. An empty table gives no rows. A deviation
    beyond 64 bits is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = save(rows.select("embedding").mapInArrow(_vectors, "dims long, x binary").distinct(), "fit")
    out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for dims in sorted(r[0] for r in fit.select("dims").distinct().collect()):
        mine = fit.where(F.col("dims") == dims)
        model = Model(summary(mine, dims), components) if dims else None
        if not model or not model.explained:
            continue
        error = identity_error(mine, model, dims)
        white = rows.mapInArrow(_projected(model, dims), "vec_id long, deviation long, whitened array<double>")
        white = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        explained = F.array(*[F.lit(e) for e in model.explained])
        out = out.unionByName(
            white.select(
                "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
            )
        )
    release(fit)
    return out


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
