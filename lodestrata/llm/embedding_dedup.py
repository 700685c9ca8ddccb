"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on random directions; each projection is shifted at random and quantised, and a few of
them make a bucket of one table. Vectors of a cosine near 1 share a bucket of at least one of enough tables. Equal
vectors are one class from the start. Buckets of more than one class are compared in blocks of bounded size; a pair is
counted in the first table that brings it together only, so a block returns counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from hashlib import blake2b
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import components, release, save, ship, table
from lodestrata.llm.words import lean, mix, slices

#: Width of a quantum, recall at the threshold that the number of tables is made for, and far pairs of a vector in a table.
WIDTH, RECALL, FAR = 2.0, 0.95, 0.1
#: Classes of a block.
BLOCK = 256
SEED = 20_240_501


def same_quantum(distance: float) -> float:
    """Probability that a projection puts two vectors of this distance in one quantum."""
    c = WIDTH / distance
    return erf(c / sqrt(2)) - 2 / (sqrt(2 * pi) * c) * (1 - exp(-c * c / 2))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors: so many projections that unlike vectors (at right angles) rarely
    meet, and so many tables that pairs at the threshold meet with probability RECALL."""
    m = max(4, ceil(log(max(n, 2) / FAR) / -log(same_quantum(sqrt(2)))))
    return m, ceil(log(1 - RECALL) / log(1 - same_quantum(sqrt(2 - 2 * threshold)) ** m))


class Hasher:
    def __init__(self, projections: int, tables: int):
        self.m, self.tables, self.made = projections, tables, {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Bucket names (32 bits) of the rows of x in all tables; x is normalised."""
        if x.shape[1] not in self.made:
            rng = np.random.default_rng([SEED, x.shape[1]])
            self.made[x.shape[1]] = rng.normal(size=(x.shape[1], self.m * self.tables)), rng.uniform(0, WIDTH, self.m * self.tables)
        a, b = self.made[x.shape[1]]
        q = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.m)
        h = np.full((len(x), self.tables), np.uint64(x.shape[1]))
        for i in range(self.m):
            h = mix(h * np.uint64(31) + q[:, :, i])
        return (h >> np.uint64(32)).astype(np.uint32)


def _class_rows(batches):
    """(vec_id, key, vector as float64 bytes); key null where the vector links with nothing."""
    for b in batches:
        lists = b.column("embedding")
        off = lists.offsets.to_numpy()
        flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # nulls are nan, -0 is 0
        bad, full = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
        good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[off[1:]] == bad[off[:-1]]) & (full[off[1:]] > full[off[:-1]])
        vectors = [flat[x:y].tobytes() if g else None for x, y, g in zip(off[:-1].tolist(), off[1:].tolist(), good.tolist())]
        keys = [blake2b(v, digest_size=16).digest() if v else None for v in vectors]
        yield pa.record_batch({"vec_id": b.column("vec_id"), "key": pa.array(keys, pa.binary()), "vector": pa.array(vectors, pa.binary())})


def _matrix(raw: pa.Array, kind) -> np.ndarray:
    """A binary column whose values are of one length, as rows."""
    off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(raw: pa.Array):
    size = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def links(x: np.ndarray, names: np.ndarray, at: int, mine: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs that link and met in table `at` first. mine: the block of each row; with two blocks
    only pairs across them."""
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if mine.any() and not mine.all():
        near &= mine[:, None] != mine[None, :]
    i, j = np.nonzero(near)
    earlier = np.zeros(len(i), bool)
    for t in range(0, at, 16):
        earlier |= (names[i, t : min(at, t + 16)] == names[j, t : min(at, t + 16)]).any(1)
    near[i[earlier], j[earlier]] = False
    return near


def _groups(rows: pa.Table, threshold: float):
    """Compares the groups of rows, which are sorted by (key, i, j): (counts, edges) as arrays of (id, n) and (id, id)."""
    counts, edges = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for part in _by_length(rows.column("vector")):
        own = rows.take(pa.array(part))
        key, i, j, mine, ids, copies = (own.column(c).to_numpy() for c in ("key", "i", "j", "own", "id", "copies"))
        x, names = _unit(_matrix(own.column("vector"), np.float64)), _matrix(own.column("names"), np.uint32)
        table = key >> 32
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        size = np.diff(np.append(start, len(key)))
        a = start[size == 2]  # most groups, all at once
        a = a[(i[a] == j[a]) | (mine[a] != mine[a + 1])]
        a = a[np.einsum("ij,ij->i", x[a], x[a + 1]) >= threshold]
        a = a[~((names[a] == names[a + 1]) & (np.arange(names.shape[1]) < table[a, None])).any(1)]
        counts += [np.stack([ids[a], copies[a + 1]]), np.stack([ids[a + 1], copies[a]])]
        edges.append(np.stack([ids[a], ids[a + 1]]))
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            g = slice(s, s + n)
            near = links(x[g], names[g], int(table[s]), mine[g] == i[s] if i[s] != j[s] else np.zeros(n, bool), threshold)
            count = near @ copies[g]
            some = np.flatnonzero(count)
            counts.append(np.stack([ids[g][some], count[some]]))
            label = np.arange(n)
            for k in some.tolist():
                for other in np.unique(label[near[k]]).tolist():
                    if other != label[k]:
                        edges.append(np.array([[ids[s + k]], [ids[s + int(np.flatnonzero(near[k] & (label == other))[0])]]]))
                        label[label == other] = label[k]
    return np.concatenate(counts, axis=1), np.concatenate(edges, axis=1)


def _compare(threshold: float):
    """Rows come sorted by (key, i, j): compares each such group, of two blocks at most."""
    def found(rows: pa.Table):
        counts, edges = _groups(rows.combine_chunks().to_batches()[0], threshold)
        none = pa.nulls
        return pa.record_batch({
            "a": pa.array(np.concatenate([counts[0], edges[0]])), "b": pa.concat_arrays([none(counts.shape[1], pa.int64()), pa.array(edges[1])]),
            "n": pa.concat_arrays([pa.array(counts[1]), none(edges.shape[1], pa.int64())]),
        })

    def run(batches):
        held = None
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                t = pa.Table.from_batches([b.slice(k, 4096)])
                held = t if held is None else pa.concat_tables([held, t])
                key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
                last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
                whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                if whole:
                    yield found(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield found(held)
    return run


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id long, embedding array of numbers).

    Two rows link if their cosine in double precision reaches the threshold; equal vectors always do. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of different lengths.
    n_links: other rows that link directly. component_id: the smallest vec_id reachable by links, itself included; kept:
    whether that is its own. Rows that repeat are rows of their own. A row without a vec_id links with nothing and has
    no component. Other columns are ignored. Pairs at the threshold are found with probability RECALL, nearer ones more
    often.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = save(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(lean(_class_rows), "vec_id long, key binary, vector binary").withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key"))),
        "vectors",
    )
    classes = save(
        rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes"
    )
    m, tables = shape(classes.count(), threshold)
    hasher = Hasher(m, tables)

    def named(batches):
        for b in batches:
            raw = b.column("vector")
            names = np.zeros((len(raw), tables), np.uint32)
            for part in _by_length(raw):
                for k in range(0, len(part), 500):
                    some = part[k : k + 500]
                    names[some] = hasher(_unit(_matrix(raw.take(pa.array(some)), np.float64)))
            yield pa.record_batch({"id": b.column("id"), "names": pa.array([n.tobytes() for n in names], pa.binary())})

    def buckets(batches):
        for b in slices(batches, 1 << 20):
            names = _matrix(b.column("names"), np.uint32)
            keys = names.astype(np.int64) + (np.arange(tables, dtype=np.int64) << 32)
            yield pa.record_batch({"id": pa.array(np.repeat(b.column("id").to_numpy(), tables)), "key": pa.array(keys.ravel())})

    signed = save(classes.select("id", "vector").mapInArrow(lean(named), "id long, names binary"), "names")
    index = signed.mapInArrow(lean(buckets), "id long, key long")  # key: the table, then the bucket
    full = index.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = (
        index.join(full, "key").withColumn("s", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id"), "s"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
        .select("id", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    found = save(
        dealt.join(classes.select("id", "copies", "vector").join(signed, "id"), "id")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(lean(_compare(threshold)), "a long, b long, n long"),
        "found",
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    label = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "id")
    known = save(
        classes.select("key", "id", "copies").join(counts, "id", "left").join(label, "id", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")),
        "known",
    )
    release(classes, signed, found)
    return rows.drop("vector").join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))
