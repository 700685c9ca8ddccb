"""Token ids in files, compressed by a grammar of pairs (Re-Pair) for each block of a shard.

Documents are dealt out by range of doc_id and sorted, so shards follow one another. A task encodes its texts and writes
blocks of whole documents: the most frequent pairs of symbols are replaced by nonterminals again and again, never across
the end of a document, until no pair has USES uses. A block holds its rules, the expansion length of each, the documents' places in the symbols and
their token counts; any document is decoded by itself, and any token of it is found by expansion lengths.

A block is a row of a Parquet table in the shared folder: Spark's committer makes writes whole when tasks run again, on
any store that Spark can write to.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.llm.common import save, ship, table
from lodestrata.llm.tokens import encoder, with_end
from lodestrata.llm.words import ODD, lean, slices

#: Ids of a block (one document may have more), pairs replaced in a round, and least uses of a pair: pairs with 9 to 23 uses
#: would make files about 4 % smaller, but take more time than there is for it.
BLOCK, PAIRS, USES = 1_000_000, 4000, 24
#: First nonterminal where none is given; files take the size of the tokenizer's vocabulary.
FIRST = 51_000
#: Counters of pairs, and the one of pairs that a document's end parts.
COUNTERS = 1 << 18
FORMAT = (
    "shard int, block int, n_ids long, n_docs int, doc_ids binary, doc_tokens binary, doc_places binary, "
    "first int, rules binary, expansions binary, symbols binary"
)


def _counter(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((((left.astype(np.uint64) << np.uint64(32)) + right) * ODD) >> np.uint64(46)).astype(np.int32)


def _frequent(at: np.ndarray, slot: np.ndarray, pair: np.ndarray, slots: int, uses: int):
    """(positions, number of the pair of each, pairs, uses of each) of all pairs with so many uses among positions whose
    counters (so many, numbered from 0) are full. Pairs that share a counter are told apart: one is counted, then the rest
    of the counter, until what is left is too little."""
    out, known = [], 0
    value, number = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
    while len(at):
        value[slot] = pair  # the last of a counter is counted
        same = value[slot] == pair
        n = np.bincount(slot[same], minlength=slots)
        enough = n >= uses
        those = np.flatnonzero(enough)
        number[those] = np.arange(known, known + len(those))
        good = same & enough[slot]
        out.append((at[good], number[slot[good]], value[those], n[those]))
        known += len(those)
        other = np.flatnonzero(~same)
        enough = np.bincount(slot[other], minlength=slots) >= uses
        other = other[enough[slot[other]]]
        at, slot, pair = at[other], slot[other], pair[other]
    return [np.concatenate(x) for x in zip(*out)] if known else None


def _marked(n: int, *places: np.ndarray) -> np.ndarray:
    """The places, each once and in order."""
    mark = np.zeros(n, bool)
    for p in places:
        mark[p] = True
    return np.flatnonzero(mark)


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int | None = None, uses: int = USES, first: int = FIRST):
    """(symbols, places of the documents, rules) of ids whose documents end at ends (exclusive, ascending).

    Each round replaces the PAIRS most frequent pairs of neighbours inside documents that have so many uses; of pairs that
    overlap the more frequent wins, in a run of one symbol every other. Counters follow what changes. Rounds go on until no
    pair has so many uses (or so many rounds were made).
    """
    symbols, rules, known = ids.astype(np.uint32), [], {}
    end = np.zeros(len(ids), bool)
    end[ends - 1] = True
    slot = np.append(_counter(symbols[:-1], symbols[1:]), np.int32(COUNTERS)) if len(symbols) else np.zeros(0, np.int32)
    slot[end] = COUNTERS
    total, number = np.bincount(slot, minlength=COUNTERS + 1), np.full(COUNTERS + 1, -1, np.int32)
    while rounds is None or rounds > 0:
        rounds = rounds and rounds - 1
        full = np.flatnonzero(total[:COUNTERS] >= uses)
        number[full] = np.arange(len(full))
        here = number[slot]
        at = np.flatnonzero(here >= 0)
        found = _frequent(at, here[at], (symbols[at].astype(np.uint64) << np.uint64(32)) + symbols[at + 1], len(full), uses)
        number[full] = -1
        if found is None:
            break
        at, of, value, n = found
        rank = np.empty(len(value), np.int64)
        rank[np.lexsort((value, -n))] = np.arange(len(value))
        use = rank[of] < PAIRS
        at, here = at[use], rank[of[use]]
        by_place = np.full(len(symbols), -1, np.int32)
        by_place[at] = here
        at = np.flatnonzero(by_place >= 0)
        here = by_place[at]
        value = value[np.argsort(rank)][:PAIRS]
        # Neighbours overlap: of unlike ones the lower rank wins, of a run of like ones each second is used.
        near = np.diff(at) == 1
        like = np.append(False, near & (here[1:] == here[:-1]))
        start = np.maximum.accumulate(np.where(like, 0, np.arange(len(at))))
        wins = (np.arange(len(at)) - start) % 2 == 0
        wins[1:] &= ~near | (here[1:] <= here[:-1])
        wins[:-1] &= ~near | (here[:-1] <= here[1:])
        at, here = at[wins], here[wins]
        symbol = np.empty(len(value), np.uint32)
        for k in _marked(len(value), here).tolist():
            v = int(value[k])
            if v not in known:
                known[v] = first + len(rules)
                rules.append((v >> 32, v & 0xFFFFFFFF))
            symbol[k] = known[v]
        # The pair itself and those that it had with its neighbours are gone, new ones come.
        old = _marked(len(symbols), at, at + 1, np.maximum(at - 1, 0))
        np.subtract.at(total, slot[old], 1)
        end[at] = end[at + 1]
        symbols[at] = symbol[here]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep, dtype=np.int32) - 1
        fresh = _marked(int(moved[-1]) + 1, moved[old])
        symbols, end, slot = symbols[keep], end[keep], slot[keep]
        slot[fresh] = np.where(end[fresh], COUNTERS, _counter(symbols[fresh], symbols[np.minimum(fresh + 1, len(symbols) - 1)]))
        np.add.at(total, slot[fresh], 1)
    return symbols.astype("<u2" if first + len(rules) < 1 << 16 else "<u4"), np.flatnonzero(end) + 1, np.array(rules, "<u4").reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, first: int = FIRST) -> np.ndarray:
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def decode(symbols: np.ndarray, rules: np.ndarray, first: int = FIRST) -> np.ndarray:
    """Ids of any range of symbols: pass a document's for random access."""
    if not len(rules):
        return symbols.astype(np.uint32)
    part: list[np.ndarray] = []
    for a, b in rules.tolist():
        part.append(np.concatenate([part[x - first] if x >= first else np.array([x], np.uint32) for x in (a, b)]))
    pool = np.concatenate([np.zeros(0, np.uint32), *part])
    size = np.array([len(x) for x in part], np.int64)
    rule = np.flatnonzero(symbols >= first)
    of = symbols[rule].astype(np.int64) - first
    length = np.ones(len(symbols), np.int64)
    length[rule] = size[of]
    before = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint32)
    plain = symbols < first
    out[before[plain]] = symbols[plain]
    n, at = size[of], (np.cumsum(size) - size)[of]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(before[rule], n) + inner] = pool[np.repeat(at, n) + inner]
    return out


def token_at(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, i: int, first: int = FIRST) -> int:
    """The i-th id of a range of symbols, found by expansion lengths without decoding the rest."""
    wide = np.where(symbols >= first, lengths[np.maximum(symbols.astype(np.int64) - first, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(wide)
    k = int(np.searchsorted(ends, i, "right"))
    i -= int(ends[k] - wide[k])
    s = int(symbols[k])
    while s >= first:
        a, b = rules[s - first].tolist()
        n = int(lengths[a - first]) if a >= first else 1
        s, i = (a, i) if i < n else (b, i - n)
    return s


def _write(path: str):
    def block(shard, number, docs, ids, sizes):
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        first = len(encoder(path).bytes)
        symbols, places, rules = compress(flat, np.cumsum(size), first=first)
        return pa.record_batch({
            "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()),
            "n_docs": pa.array([len(size)], pa.int32()), "doc_ids": pa.array([np.array(docs, "<i8").tobytes()]), "doc_tokens": pa.array([size.astype("<i8").tobytes()]),
            "doc_places": pa.array([places.astype("<i8").tobytes()]), "first": pa.array([first], pa.int32()), "rules": pa.array([rules.tobytes()]),
            "expansions": pa.array([expansion_lengths(rules, first).astype("<i8").tobytes()]), "symbols": pa.array([symbols.tobytes()]),
        })

    def run(batches):
        shard, number, docs, ids, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        for b in slices(batches, 1 << 20):
            i, off = with_end(*encoder(path).ids(b.column("text")))
            ids.append(i)
            sizes.append(np.diff(off))
            docs += [-(1 << 63) if d is None else d for d in b.column("doc_id").to_pylist()]
            held += len(i)
            if held >= BLOCK:
                yield block(shard, number, docs, ids, sizes)
                number, docs, ids, sizes, held = number + 1, [], [], [], 0
        if docs:
            yield block(shard, number, docs, ids, sizes)
    return run


def _read(batches):
    for b in batches:
        for r in b.to_pylist():
            rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 2)
            symbols = np.frombuffer(r["symbols"], "<u2" if r["first"] + len(rules) < 1 << 16 else "<u4")
            size, ids = np.frombuffer(r["doc_tokens"], "<i8"), decode(symbols, rules, r["first"]).astype("<u4")
            at = np.cumsum(size) - size
            doc = np.frombuffer(r["doc_ids"], "<i8")
            raw = memoryview(ids.tobytes())
            yield pa.record_batch({
                "doc_id": pa.array(doc, mask=doc == -(1 << 63)), "start": pa.array(at + r["before"]), "n_tokens": pa.array(size.astype(np.int64)),
                "ids_crc32": pa.array([crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())], pa.int64()),
            })


def write_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Writes docs (doc_id long, text string) in ascending doc_id order and returns the table of blocks (FORMAT).

    A null text is empty: its end id alone. Rows without a doc_id come first; rows of one doc_id stand side by side in
    the order of their texts. Other columns are ignored. An empty table gives no blocks.
    """
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return save(rows.mapInArrow(lean(_write(path), path), FORMAT), "tokens")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the blocks, decoded by the grammar."""
    # One row a shard, then a window over a shard's blocks: no window over all blocks.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", "n_ids").join(F.broadcast(base), "shard")  # one row a shard
    starts = starts.select("shard", "block", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("before"))
    rows = blocks.join(starts, ["shard", "block"]).select("before", "doc_ids", "doc_tokens", "first", "rules", "symbols")
    return rows.mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
