"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (projections and attention inside a document). Whole sequences
are cut from long documents first. The rests are taken in descending order, each to the sequence of the lowest cost
that has room for it; there are just as many sequences as the tokens fill, so where none has room the piece is cut. Every task packs the documents of its own input partition, window by window, and nothing is shuffled: the
work grows with the input alone, and neither a long document nor a hot source meets others in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ship, table
from lodestrata.llm.tokens import encoder, with_end
from lodestrata.llm.words import lean, slices

LENGTH = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Tokens of rests that a task packs at once.
WINDOW = 4_000_000
#: What a tree holds of rooms that no sequence has.
NONE = (float("inf"), -1, -1)
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def fill(lengths: list[int], rooms: list[int]) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) in the order of assignment; cuts as needed, leaves what no room is for.

    Sequences of equal room are a heap by cost, and a tree over rooms holds the least of each range of rooms.
    """
    top = max(rooms, default=0)
    size = 1 << top.bit_length()
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(size)]
    tree = [NONE] * (2 * size)

    def renew(r: int) -> None:
        at = size + r
        tree[at] = (*heaps[r][0], r) if heaps[r] else NONE
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    for b, r in enumerate(rooms):
        if r:
            heaps[r].append((0.0, b))
    for r in range(1, top + 1):
        if heaps[r]:
            renew(r)
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, left = 0, lengths[i]
        while left:
            while top and not heaps[top]:
                top -= 1
            if not top:
                return out
            r = top  # where none has room for all of it the roomiest takes a part
            if left <= top:
                best, x, y = NONE, size + left, 2 * size
                while x < y:
                    if x & 1:
                        best = min(best, tree[x])
                        x += 1
                    x >>= 1
                    y >>= 1
                r = best[2]
            c, b = heapq.heappop(heaps[r])
            renew(r)
            n = min(left, r)
            out.append((i, at, n, b))
            at, left = at + n, left - n
            if r > n:
                heapq.heappush(heaps[r - n], (c + cost(n), b))
                renew(r - n)
    return out


class _Packer:
    """Pieces of one input partition."""

    def __init__(self, base: int, with_ids: bool):
        self.base, self.with_ids, self.next, self.rests, self.held = base, with_ids, 0, [], 0
        self.rows: list[tuple] = []

    def piece(self, doc, start, ids, tokens, sequence, offset) -> None:
        row = (doc, start, len(ids), crc32(ids.astype("<u4").tobytes()), tokens, self.base + sequence, offset)
        self.rows.append((*row, ids.tolist()) if self.with_ids else row)

    def add(self, doc, ids) -> None:
        whole = len(ids) // LENGTH * LENGTH
        for at in range(0, whole, LENGTH):
            self.piece(doc, at, ids[at : at + LENGTH], len(ids), self.next, 0)
            self.next += 1
        if whole < len(ids):
            self.rests.append((doc, whole, ids[whole:].copy(), len(ids)))
            self.held += len(ids) - whole

    def pack(self, last: bool) -> None:
        """All rests but less than a sequence, which waits for the next window; the last goes to sequences of powers of two."""
        rooms = [LENGTH] * (self.held // LENGTH)
        if last:
            rooms += [1 << b for b in range(LENGTH.bit_length() - 2, -1, -1) if self.held % LENGTH >> b & 1]
        used, filled = [0] * len(self.rests), [0] * len(rooms)
        for i, at, n, b in fill([len(r[2]) for r in self.rests], rooms):
            doc, start, ids, tokens = self.rests[i]
            self.piece(doc, start + at, ids[at : at + n], tokens, self.next + b, filled[b])
            used[i], filled[b] = at + n, filled[b] + n
        self.next += len(rooms)
        self.rests = [(d, s + u, ids[u:], t) for (d, s, ids, t), u in zip(self.rests, used) if u < len(ids)]
        self.held = sum(len(r[2]) for r in self.rests)

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        if rows:
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            data = {n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))}
            if self.with_ids:
                data["ids"] = pa.array([r[-1] for r in rows], pa.list_(pa.int32()))
            yield pa.record_batch(data)


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs (doc_id long, text string): COLUMNS, and with_ids the piece's ids.

    Ids are those of the tokenizer at path, then id 0. A null or empty text is the end id alone. Each id lies in just
    one piece. All sequences have LENGTH tokens but the last of an input partition, whose tokens go to sequences of
    powers of two, so nothing is padded. Rows that repeat are packed each; a row without a doc_id is packed like any
    other. Other columns are ignored. sequence_id is the input partition times 2^40 and a count, so it stays the same
    when a task is run again.
    """
    ship(docs.sparkSession)

    def run(batches):
        packer = _Packer(TaskContext.get().partitionId() << 40, with_ids)
        for b in slices(batches, 2 << 20):
            ids, off = with_end(*encoder(path).ids(b.column("text")))
            for doc, a, e in zip(b.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                packer.add(doc, ids[a:e])
            if packer.held > WINDOW:
                packer.pack(last=False)
            yield from packer.flush()
        packer.pack(last=True)
        yield from packer.flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run, path), COLUMNS + (", ids array<int>" if with_ids else ""))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
