"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of WINDOW words (a shorter item is one window). A document that holds a window holds
all of its shingles, so for full containment the necessary prefix of a window is one shingle: its rarest. Shingles are
ordered by their number of uses in all documents (first pass). The second pass joins document shingles with the prefix
shingles, bounds the window by the shingle's position in it and by the document's length, and verifies the words.

Items are taken in blocks of at most BLOCK bytes of text (one item may have more), each a broadcast of its own, and the
driver makes one at a time. A benchmark of one block stays loaded in the workers. Of more blocks a worker loads one at a
time against GROUP bytes of documents, so a worker's memory is bounded by a block and a group whatever the benchmark's
size, and no document is collected or shuffled.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ship, table
from lodestrata.llm.words import ALNUM, column_bytes, lean, shingle_hashes, slices, word_hashes

WINDOW = 10
#: Words of a shingle; windows of fewer have one shingle of all their words.
SHINGLE = 3
#: Bytes of item texts in a block, and of documents that are held against one block after another.
BLOCK, GROUP = 2_000_000, 64_000_000
#: log2 of the bits of the table that most document shingles fail at once.
SIEVE = 20


class Block:
    """Windows of some items, and the shingles that can stand for them."""

    def __init__(self, ids: list, texts: list[str]):
        h, count = word_hashes(*column_bytes(pa.array(texts, pa.string())), ALNUM)
        self.words, self.ids = h, ids
        first, item, length = [], [], []
        for i, (a, b) in enumerate(zip(count[:-1].tolist(), count[1:].tolist())):
            n = min(WINDOW, b - a)
            for at in range(a, b - n + 1) if n else ():
                first.append(at)
                item.append(i)
                length.append(n)
        self.first, self.item, self.length = (np.array(x, np.int64) for x in (first, item, length))
        # Each shingle of each window: its size, hash, window and place in the window.
        parts = []
        for n in range(1, SHINGLE + 1):
            w = np.flatnonzero(self.length == n) if n < SHINGLE else np.flatnonzero(self.length >= SHINGLE)
            if len(w):
                s, places = shingle_hashes(h, n), np.maximum(self.length[w] - n + 1, 0)
                window = np.repeat(w, places)
                place = np.arange(len(window)) - np.repeat(np.cumsum(places) - places, places)
                parts.append((np.full(len(window), n), s[self.first[window] + place], window, place))
        self.size, self.hash, self.window, self.place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))

    def keys(self) -> None:
        """Prepares look-ups of the shingles that are left."""
        order = np.lexsort((self.hash, self.size))
        self.size, self.hash, self.window, self.place = (x[order] for x in (self.size, self.hash, self.window, self.place))
        self.index = {}
        for n in range(1, SHINGLE + 1):
            a, b = np.searchsorted(self.size, [n, n + 1])
            if b > a:
                key, start = np.unique(self.hash[a:b], return_index=True)
                sieve = np.zeros(1 << SIEVE, bool)
                sieve[key >> np.uint64(64 - SIEVE)] = True
                self.index[n] = (key, np.append(start, b - a) + a, sieve)

    def find(self, h: np.ndarray):
        """For each size: (places in h of shingles that are keys, number of the key)."""
        for n, (key, start, sieve) in self.index.items():
            s = shingle_hashes(h, n)
            at = np.flatnonzero(sieve[s >> np.uint64(64 - SIEVE)])
            k = np.minimum(np.searchsorted(key, s[at]), len(key) - 1)
            same = key[k] == s[at]
            yield n, start, at[same], k[same]

    def uses(self, h: np.ndarray) -> np.ndarray:
        """How often each row's shingle occurs in h (a slice of documents; the few across two texts count too)."""
        out = np.zeros(len(self.hash), np.int64)
        for _, start, _, k in self.find(h):
            c = np.bincount(k, minlength=len(start) - 1)
            out[start[0] : start[-1]] += np.repeat(c, np.diff(start))
        return out

    def prefixes(self, uses: np.ndarray) -> None:
        """Keeps the rarest shingle of each window."""
        order = np.lexsort((self.place, self.hash, uses, self.window))
        w = self.window[order]
        order = order[np.concatenate([[True], w[1:] != w[:-1]])] if len(w) else order
        self.size, self.hash, self.window, self.place = (x[order] for x in (self.size, self.hash, self.window, self.place))
        self.keys()

    def windows(self, h: np.ndarray, count: np.ndarray):
        """(first word in h, length, item) of all occurrences of windows inside documents, which end at count in h."""
        found = [np.zeros((3, 0), np.int64)]
        for _, start, at, k in self.find(h):
            n = start[k + 1] - start[k]
            at = np.repeat(at, n)
            row = np.repeat(start[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            w = self.window[row]
            begin, length = at - self.place[row], self.length[w]
            doc = np.searchsorted(count, at, "right") - 1
            use = (begin >= count[doc]) & (begin + length <= count[doc + 1])  # bounds of position and length
            begin, length, w = begin[use], length[use], w[use]
            same = np.ones(len(w), bool)
            for i in range(WINDOW):  # verification, word by word
                live = np.flatnonzero(same & (length > i))
                same[live] = h[begin[live] + i] == self.words[self.first[w[live]] + i]
            found.append(np.stack([begin[same], length[same], self.item[w[same]]]))
        return np.concatenate(found, axis=1)


def _groups(batches, blocks: list):
    """Lists of (batch, word hashes, counts): one slice each for one block, GROUP bytes of slices for more."""
    group, held = [], 0
    for b in slices(batches):
        group.append((b, *word_hashes(*column_bytes(b.column("text")), ALNUM)))
        held += b.nbytes
        if len(blocks) <= 1 or held > GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def _each(blocks: list):
    """The blocks, one loaded at a time if there are more than one."""
    for shared, _ in blocks:
        yield shared.value
        if len(blocks) > 1 and hasattr(shared, "_value"):
            del shared._value


def decontaminate(docs: DataFrame, items: DataFrame, clean: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs (doc_id long, text string).

    Words are runs of letters, digits and characters beyond ASCII, A to Z as a to z. A word is hit if an occurrence of a
    window of an item covers it. items_sha256: of the item_ids with occurring windows, as sorted strings with commas. A
    null or empty text has no words. Items without words and items without an id don't count; rows of one item_id are
    one item. Rows of docs that repeat are returned each. Without items nothing is hit. Other columns are ignored. With
    clean the rows of docs that aren't contaminated are returned instead, with all their columns.
    Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs if clean else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK)
    blocks = []
    for i in range(parts):  # the driver holds one block at a time
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == i).collect()
        b = Block([r.id for r in rows], [r.text for r in rows])
        b.keys()
        blocks.append((spark.sparkContext.broadcast(b), len(b.hash)))

    def count_uses(batches):
        def rows(i, total):
            at = np.flatnonzero(total)
            return pa.record_batch({"block": pa.array(np.full(len(at), i, np.int32)), "row": pa.array(at), "uses": pa.array(total[at])})

        one = np.zeros(blocks[0][1], np.int64) if len(blocks) == 1 else None  # summed over the whole task
        for group in _groups(batches, blocks):
            for i, block in enumerate(_each(blocks)):
                total = sum(block.uses(h) for _, h, _ in group)
                if one is None:
                    yield rows(i, total)
                else:
                    one += total
        if one is not None:
            yield rows(0, one)

    used = texts.select("text").mapInArrow(lean(count_uses), "block int, row long, uses long").groupBy("block", "row").agg(F.sum("uses").alias("uses"))
    if blocks:
        used = used.persist() if len(blocks) > 1 else used
        for i, (old, n) in enumerate(list(blocks)):
            uses = np.zeros(n, np.int64)
            for r in used.where(F.col("block") == i).select("row", "uses").toLocalIterator():  # as many rows as the block has at most
                uses[r.row] = r.uses
            b = old.value
            b.prefixes(uses)
            blocks[i] = (spark.sparkContext.broadcast(b), len(b.hash))
        used.unpersist()

    def hits(batches):
        for group in _groups(batches, blocks):
            edges = [np.zeros(len(h) + 1, np.int64) for _, h, _ in group]
            found: list[list[set]] = [[set() for _ in range(b.num_rows)] for b, _, _ in group]
            for block in _each(blocks):
                for (_, h, count), edge, ids in zip(group, edges, found):
                    begin, length, item = block.windows(h, count)
                    edge += np.bincount(begin, minlength=len(edge)) - np.bincount(begin + length, minlength=len(edge))
                    doc = np.searchsorted(count, begin, "right") - 1
                    for d, i in set(zip(doc.tolist(), item.tolist())):
                        ids[d].add(block.ids[i])
            for (b, _, count), edge, ids in zip(group, edges, found):
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                n_hit = hit[count[1:]] - hit[count[:-1]]
                if clean:
                    yield b.filter(pa.array(n_hit == 0))
                    continue
                yield pa.record_batch({
                    "doc_id": b.column("doc_id"), "n_words": pa.array(np.diff(count)), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in ids], pa.int64()),
                    "items_sha256": pa.array([sha256(",".join(sorted(x)).encode()).hexdigest() for x in ids]), "contaminated": pa.array(n_hit > 0),
                })

    return texts.mapInArrow(lean(hits), docs.schema if clean else "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
