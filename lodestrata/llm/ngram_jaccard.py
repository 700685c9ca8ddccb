"""N-gram Jaccard join by vertical partitioning.

The hash value orders all n-grams of all documents; equal cuts of that order give fragments. Two sets of like size whose
similarity reaches the threshold differ in so few n-grams that at least two of enough fragments hold the same n-grams,
so fragments that are alike (never single frequent n-grams) bring candidates together. Each candidate family is then
compared fragment by fragment: partial overlaps are counted separately and summed per pair, and the sum decides.

Stages: (A) each text to (size, hash of its set): equal sets are one node from here on. (B) Where fragments
are short, only sets that share enough of their n-grams with any other set go on: n-grams are dealt out by ranges of the
order, uses are counted in each range separately and summed per set. Then fragment keys, dealt out by key; nodes of one key are tied to the first of them (a star, not pairs). Each task first ties the nodes that it sees
itself, so a key that a third of all rows share reaches the shuffle once a task. (C) Families of several blocks, which
chance ties make the larger the more texts there are, are split first: of each set the parities of its n-grams by hash are
compared, two bits for an n-gram; they differ in no more places than the sets do, so pairs that differ in too many can't be
similar. (D) families, cut in blocks of bounded size; a task compares two blocks and returns a spanning forest of the links that it found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import components, release, save, ship, table, tidy
from lodestrata.llm.words import BLANKS, lean, mix, slices, text_shingles

#: Sizes of one scheme of cuts differ by this ratio at most.
RATIO = 1.3
#: Documents and n-grams of a block at most (one document may have more).
BLOCK_DOCS, BLOCK_NGRAMS = 2048, 1_000_000
#: The same for blocks whose parities are compared.
SKETCH_DOCS, SKETCH_NGRAMS = 4096, 16_000_000
#: Vertical fragments that a family's n-grams are cut into when overlaps are counted.
FRAGMENTS = 4
#: N-grams that a fragment holds at least on average where candidates need no other proof than one fragment.
LONG = 8
#: N-grams that a task holds before it deals them out; uses are counted by so many bits of their hashes.
CHUNK, BITS = 1_000_000, 48
#: log2 of the bits of the filter that picks the texts of candidates.
FILTER_BITS = 22
BOUNDS = [1]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(max(BOUNDS[-1] + 1, int(BOUNDS[-1] * RATIO)))


def schemes(n: int, p: int, q: int) -> range:
    """Of a set of n: its own, and those of the larger sets that it can be similar to."""
    return range(bisect_left(BOUNDS, n), bisect_left(BOUNDS, n * q // p) + 1)


def cuts(scheme: int, p: int, q: int) -> int:
    """Fragments of a scheme: two more than the n-grams that similar sets can differ in; 0 where only equal sets are similar."""
    differ = 2 * BOUNDS[scheme] * (q - p) // (q + p)
    return differ + 2 if differ else 0


@cache
def _pivots(k: int) -> np.ndarray:
    return np.array([(j << 64) // k for j in range(1, k)], dtype=np.uint64)


def set_hash(a: np.ndarray) -> np.uint64:
    return mix(np.array([np.sum(mix(a ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64) + np.uint64(len(a))], dtype=np.uint64))[0]


def fragment_keys(a: np.ndarray, p: int, q: int) -> Iterator[tuple[int, np.ndarray]]:
    """(scheme, keys): a key for each fragment that isn't empty, and one for each two that are."""
    for g in schemes(len(a), p, q):
        k = cuts(g, p, q)
        if not k:
            continue
        at = np.concatenate([[0], np.searchsorted(a, _pivots(k)), [len(a)]])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(a ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
        part = sums[at[1:]] - sums[at[:-1]]
        full = at[1:] > at[:-1]
        name = (np.arange(k, dtype=np.uint64) << np.uint64(16)) + np.uint64(g)
        keys = mix(mix(part[full]) ^ mix(name[full]))
        empty = np.flatnonzero(~full).tolist()
        if len(empty) > 1:
            pairs = np.array(list(combinations(empty, 2)), dtype=np.uint64)
            keys = np.concatenate([keys, mix(mix((pairs[:, 0] << np.uint64(32)) + pairs[:, 1]) + np.uint64(g))])
        yield g, keys


def _set_rows(words: int):
    def run(batches):
        for b in slices(batches):
            found = list(text_shingles(b.column("text"), BLANKS, words))
            yield pa.record_batch({
                "doc_id": b.column("doc_id"),
                "n": pa.array([len(a) for a in found], pa.int64()),
                "node": pa.array(np.array([set_hash(a) if len(a) else 0 for a in found], np.uint64).view(np.int64)),
            })
    return run


#: Keys that a task holds before it ties those that are alike.
HELD = 1_000_000


def _key_rows(words: int, p: int, q: int, bits: np.ndarray | None):
    """(key, node, first, scheme): first is null for a row that has to meet others, else the tie is found already."""
    def flush(keys, nodes, marks):
        key, node, mark = np.concatenate(keys), np.concatenate(nodes), np.concatenate(marks)
        order = np.lexsort((node, key))
        key, node, mark = key[order], node[order], mark[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        use = new | (node != first) & np.concatenate([[True], (node[1:] != node[:-1])])
        return pa.record_batch({
            "key": pa.array(key[use].view(np.int64)), "node": pa.array(node[use].view(np.int64)),
            "first": pa.array(first[use].view(np.int64), mask=new[use]), "scheme": pa.array(mark[use]),
        })

    def run(batches):
        keys, nodes, marks, held, seen = [], [], [], 0, set()
        for b in slices(_passing(batches, bits)):
            for a in text_shingles(b.column("text"), BLANKS, words):
                if not len(a) or (node := set_hash(a)) in seen:
                    continue
                seen.add(node)
                for g, k in fragment_keys(a, p, q):
                    keys.append(k)
                    nodes.append(np.full(len(k), node))
                    marks.append(np.full(len(k), g, np.int32))
                    held += len(k)
            if held > HELD:
                yield flush(keys, nodes, marks)
                keys, nodes, marks, held, seen = [], [], [], 0, set()
        if held:
            yield flush(keys, nodes, marks)
    return run


def _ties(batches):
    """Rows come sorted by key: ties that a task had found pass, the rest is tied to the first node of its key.

    Only the last key is remembered, so a key may have any number of nodes.
    """
    last_key = last_first = None
    for b in batches:
        found = b.column("first").is_valid()
        old, b = b.filter(found), b.filter(pc.invert(found))
        if old.num_rows:
            yield old.select(["node", "first", "scheme"])
        if not b.num_rows:
            continue
        key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
        new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, node[np.maximum(at, 0)], 0 if last_first is None else last_first)
        last_key, last_first = key[-1], first[-1]
        use = node != first
        yield pa.record_batch({"node": pa.array(node[use]), "first": pa.array(first[use]), "scheme": b.column("scheme").filter(pa.array(use))})


PIECES = "part int, chunk long, docs int, tokens binary, owners binary, nodes binary, sizes binary"


def _range_rows(words: int, parts: int):
    """A chunk's distinct n-grams by ranges of the order, with the set that each is of (the first of BITS bits count).

    An n-gram that two sets of the chunk have is sent once, with owner 65535; the chunk counts it for its sets itself.
    """
    def flush(chunk, sets, nodes):
        flat = np.concatenate(sets) >> np.uint64(64 - BITS)
        owner = np.repeat(np.arange(len(sets)), [len(a) for a in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        many = ~np.concatenate([new[1:], [True]])[np.flatnonzero(new)]
        first = np.flatnonzero(new)
        shared = np.repeat(many, np.diff(np.append(first, len(flat))))
        own = np.bincount(owner[shared], minlength=len(sets)).astype(np.int32)
        flat, owner = flat[first], np.where(many, 65535, owner[first]).astype(np.uint16)
        cut = np.searchsorted(flat, np.array([(i << BITS) // parts for i in range(parts + 1)], dtype=np.uint64))
        sizes = np.array([len(a) for a in sets], np.int64)
        out = [(-1, own.tobytes(), b"", np.array(nodes, np.uint64).tobytes(), sizes.tobytes())]
        for i in range(parts):
            t = flat[cut[i] : cut[i + 1]]
            if len(t):
                step = np.diff(t, prepend=t[:1])
                step = step.astype(np.uint32) if step.max() < 1 << 32 else step
                out.append((i, t[:1].tobytes() + step.tobytes(), owner[cut[i] : cut[i + 1]].tobytes(), b"", b""))
        part, tokens, owners, names, ns = zip(*out)
        return pa.record_batch({
            "part": pa.array(part, pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int64()), "docs": pa.array([len(sets)] * len(out), pa.int32()),
            "tokens": pa.array(tokens, pa.binary()), "owners": pa.array(owners, pa.binary()), "nodes": pa.array(names, pa.binary()), "sizes": pa.array(ns, pa.binary()),
        })

    def run(batches):
        chunk, sets, nodes, held, seen = TaskContext.get().partitionId() << 24, [], [], 0, set()
        for b in slices(batches):
            for a in text_shingles(b.column("text"), BLANKS, words):
                if not len(a) or (node := set_hash(a)) in seen:
                    continue
                seen.add(node)
                sets.append(a)
                nodes.append(node)
                held += len(a)
                if held > CHUNK or len(sets) >= 60_000:
                    yield flush(chunk, sets, nodes)
                    chunk, sets, nodes, held, seen = chunk + 1, [], [], 0, set()
        if sets:
            yield flush(chunk, sets, nodes)
    return run


def _count_shared(batches):
    """For each chunk the number of its sets' n-grams of one range that another chunk has too. Rows come sorted by part;
    a range holds a fixed share of the hashes, and of each n-gram one row for each chunk at most."""
    def count(pieces):
        flat, cuts = [], [0]
        for _, _, tokens, owners in pieces:
            n = len(owners) // 2
            first = np.frombuffer(tokens[:8], np.uint64)
            flat.append(np.cumsum(np.frombuffer(tokens[8:], np.uint32 if len(tokens) == 8 + 4 * n else np.uint64), dtype=np.uint64) + first)
            cuts.append(cuts[-1] + n)
        flat = np.concatenate(flat)
        order = np.argsort(flat, kind="stable")
        same = np.concatenate([[False], flat[order][1:] == flat[order][:-1]])
        shared = np.zeros(len(flat), bool)
        shared[order] = same | np.concatenate([same[1:], [False]])
        for (chunk, docs, _, owners), a, b in zip(pieces, cuts[:-1], cuts[1:]):
            who = np.frombuffer(owners, np.uint16)
            yield chunk, docs, np.bincount(who[shared[a:b] & (who != 65535)], minlength=docs).astype(np.uint16 if b - a < 65536 else np.int32).tobytes(), b"", b""

    def out(rows):
        chunk, docs, counts, names, ns = zip(*rows)
        return pa.record_batch({"chunk": pa.array(chunk, pa.int64()), "docs": pa.array(docs, pa.int32()), "counts": pa.array(counts, pa.binary()), "nodes": pa.array(names, pa.binary()), "sizes": pa.array(ns, pa.binary())})

    part, pieces = None, []
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["part"] < 0:
                rows.append((r["chunk"], r["docs"], r["tokens"], r["nodes"], r["sizes"]))
                continue
            if r["part"] != part and pieces:
                rows += count(pieces)
                pieces = []
            part = r["part"]
            pieces.append((r["chunk"], r["docs"], r["tokens"], r["owners"]))
        if rows:
            yield out(rows)
    if pieces:
        yield out(list(count(pieces)))


def _sharers(p: int, q: int):
    """Nodes of sets that share at least p / q of their n-grams. Rows come sorted by chunk."""
    def pick(total, nodes, sizes):
        use = q * total >= p * np.frombuffer(sizes, np.int64)
        return pa.record_batch({"node": pa.array(np.frombuffer(nodes, np.uint64)[use].view(np.int64))})

    def run(batches):
        chunk, total, nodes, sizes = None, None, b"", b""
        for b in batches:
            for r in b.to_pylist():
                if r["chunk"] != chunk:
                    if chunk is not None:
                        yield pick(total, nodes, sizes)
                    chunk, total = r["chunk"], np.zeros(r["docs"], np.int64)
                n = len(r["counts"])
                total += np.frombuffer(r["counts"], np.uint16 if n == 2 * r["docs"] else np.int32)
                if r["nodes"]:
                    nodes, sizes = r["nodes"], r["sizes"]
        if chunk is not None:
            yield pick(total, nodes, sizes)
    return run


def _passing(batches, bits: np.ndarray | None):
    """The rows whose doc_id passes a filter; all without one."""
    for b in batches:
        if bits is None:
            yield b
            continue
        ids = b.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
        slot = mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
        yield b.filter(pa.array((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1))


def _token_rows(words: int, bits: np.ndarray):
    """(node, tokens) of texts, each once a task."""
    def run(batches):
        seen = set()
        for b in slices(_passing(batches, bits)):
            found = {}
            for a in text_shingles(b.column("text"), BLANKS, words):
                if len(a) and (node := int(set_hash(a).view(np.int64))) not in seen:
                    seen.add(node)
                    found[node] = a.tobytes()
            yield pa.record_batch({"node": pa.array(list(found), pa.int64()), "tokens": pa.array(list(found.values()), pa.binary())})
    return run


def sketch(a: np.ndarray, scheme: int) -> np.ndarray:
    """Parities of the n-grams by hash, at least two bits for each n-gram of a set of the scheme, as words."""
    bits = 64
    while bits < 2 * BOUNDS[scheme]:
        bits *= 2
    slot = mix(a ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)
    odd = (np.bincount(slot.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _sketch_rows(words: int, p: int, q: int, bits: np.ndarray):
    """(node, scheme, sketch) of texts, each once a task."""
    def run(batches):
        seen = set()
        for b in slices(_passing(batches, bits)):
            found = []
            for a in text_shingles(b.column("text"), BLANKS, words):
                if len(a) and (node := int(set_hash(a).view(np.int64))) not in seen:
                    seen.add(node)
                    found += [(node, g, sketch(a, g).tobytes()) for g in schemes(len(a), p, q)]
            node, scheme, data = zip(*found) if found else ((), (), ())
            yield pa.record_batch({"node": pa.array(node, pa.int64()), "scheme": pa.array(scheme, pa.int32()), "sketch": pa.array(data, pa.binary())})
    return run


def near_links(sketches: np.ndarray, size: np.ndarray, p: int, q: int) -> list[tuple[int, int]]:
    """Links (pairs of positions) that span the components of all pairs whose parities allow that they are similar."""
    m = len(size)
    group, links = np.arange(m), []
    for i in range(m - 1):
        rest = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not len(rest):
            continue
        differ = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        both = size[rest] + size[i]
        near = rest[(p + q) * (both - differ) >= 2 * p * both]
        for g in np.unique(group[near]).tolist():
            links.append((i, int(near[group[near] == g][0])))
        group[np.isin(group, group[near])] = group[i]
    return links


def _sketch_links(p: int, q: int):
    """Rows come sorted by (family, i, j): pairs of such a group's sets that may be similar, as far as they span all."""
    def links(at, rows):
        if len(rows) < 2:
            return []
        found = near_links(np.stack([np.frombuffer(s, np.uint64) for _, _, s in rows]), np.array([n for _, n, _ in rows], np.int64), p, q)
        return [(at[0], rows[i][0], rows[j][0]) for i, j in found]

    def batch(found):
        return pa.record_batch({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate(("family", "a", "b"))})

    def run(batches):
        at, rows = None, []
        for b in batches:
            out = []
            for key, row in zip(zip(*(b.column(c).to_pylist() for c in ("family", "i", "j"))), zip(*(b.column(c).to_pylist() for c in ("node", "n", "sketch")))):
                if key != at:
                    out += links(at, rows)
                    at, rows = key, []
                rows.append(row)
            yield batch(out)
        yield batch(links(at, rows))
    return run


def _slots(column: str):
    """The filter's words and bits, as numpy's."""
    def run(batches):
        for b in batches:
            slot = mix(b.column(column).to_numpy().astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
            word, at = np.unique(slot >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (slot & np.uint64(63)))
            yield pa.record_batch({"word": pa.array(word.view(np.int64)), "value": pa.array(value.view(np.int64))})
    return run


def spanning_links(sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links (pairs of positions) that span the components of all pairs with q * intersection >= p * union.

    Overlaps are counted for one set against all others at once, in each vertical fragment separately, and summed. Pairs
    that are connected already needn't be counted: first the largest component grows from its own members, then each
    set outside it is held against all.
    """
    m = len(sets)
    if m < 2:
        return []
    size = np.array([len(a) for a in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    by_token = np.repeat(np.arange(m, dtype=np.int32), size)[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    start = np.append(np.flatnonzero(new), len(flat))
    token = np.empty(len(flat), np.int32)
    token[order] = np.cumsum(new, dtype=np.int32) - 1
    del flat, order, new
    begin = np.concatenate([[0], np.cumsum(size)])
    shared = np.diff(start) > 1
    step = -(-len(shared) // FRAGMENTS)

    def overlaps(i: int) -> np.ndarray:
        mine = token[begin[i] : begin[i + 1]]
        mine = mine[shared[mine]]
        total = np.zeros(m, np.int64)
        for cut in np.split(mine, np.searchsorted(mine, np.arange(1, FRAGMENTS) * step)):
            if len(cut):
                a, n = start[cut], start[cut + 1] - start[cut]
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                total += np.bincount(by_token[at], minlength=m)
        return total

    group, links, done = np.arange(m), [], np.zeros(m, bool)

    def hold(i: int) -> int:
        done[i] = True
        both = overlaps(i)
        near = np.flatnonzero(q * both >= p * (size + size[i] - both))
        joined = 0
        for g in np.unique(group[near]).tolist():
            if g != group[i]:
                j = int(near[group[near] == g][0])
                links.append((i, j))
                group[group == g] = group[i]
                joined += 1
        return joined

    hold(0)
    idle = 0
    while idle < 32:
        names, counts = np.unique(group, return_counts=True)
        inside = np.flatnonzero((group == names[np.argmax(counts)]) & ~done)
        if counts.max() == m:
            return links
        if not len(inside):
            break
        idle = 0 if hold(int(inside[len(inside) // 2])) else idle + 1
    for i in range(m):
        names, counts = np.unique(group, return_counts=True)
        if counts.max() == m:
            break
        if not done[i] and group[i] != names[np.argmax(counts)]:
            hold(i)
    names, counts = np.unique(group, return_counts=True)
    most = names[np.argmax(counts)]
    for i in np.flatnonzero(~done & (group != most)).tolist():  # the largest component may have changed
        hold(i)
    return links


def _block_links(p: int, q: int):
    """Rows come sorted by (family, i, j): compares all sets of each such group, at most two blocks."""
    def links(rows):
        found = spanning_links([np.frombuffer(t, np.uint64) for _, t in rows], p, q)
        return [(rows[i][0], rows[j][0]) for i, j in found]

    def run(batches):
        at, rows = None, []
        for b in batches:
            out = []
            for key, node, tokens in zip(zip(*(b.column(c).to_pylist() for c in ("family", "i", "j"))), b.column("node").to_pylist(), b.column("tokens").to_pylist()):
                if key != at:
                    out += links(rows)
                    at, rows = key, []
                rows.append((node, tokens))
            yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
        out = links(rows)
        yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
    return run


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id long, text string).

    Two texts link when 100 * intersection >= percent * union of their sets of `words` consecutive words (words part at
    blanks, A to Z count as a to z; of fewer words, all of them make one shingle). A text without words or a null text
    has an empty set and links with nothing. component_id is the smallest doc_id that links reach, itself included; a
    row without a doc_id links with nothing and has none. Rows that repeat are returned as often as they come. Other
    columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    ship(spark)
    p, q = percent, 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = save(texts.mapInArrow(lean(_set_rows(words)), "doc_id long, n long, node long"), "sets")
    reps = rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    bits = None
    if q + p < 2 * LONG * (q - p):
        bits = _filter(reps.join(_near_sets(texts, words, p, q).distinct(), "node", "left_semi"))
    ties = _tied(texts, words, p, q, bits)
    tidy(spark)
    # A family lives in one scheme: nodes are named by both.
    family = components(ties.select(F.xxhash64("node", "scheme").alias("u"), F.xxhash64("first", "scheme").alias("v")), "u", "v")
    named = ties.select("node", "scheme").unionByName(ties.select(F.col("first").alias("node"), "scheme")).distinct()
    member = save(
        named.withColumn("u", F.xxhash64("node", "scheme")).join(family.withColumnRenamed("node", "u"), "u")
        .select("node", "scheme", F.col("component").alias("family")).join(reps, "node"),
        "members",
    )
    split = _split(texts, member, words, p, q)
    dealt = _dealt(split, BLOCK_DOCS, BLOCK_NGRAMS).select("node", "family", "i", "j")
    tokens = texts.mapInArrow(lean(_token_rows(words, _filter(split))), "node long, tokens binary")
    links = save(
        dealt.join(tokens, "node").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node").mapInArrow(lean(_block_links(p, q)), "a long, b long"),
        "links",
    )
    tidy(spark)
    found = components(links, "a", "b").withColumnRenamed("component", "c")
    least = reps.join(found, "node", "left").groupBy(F.coalesce("c", "node").alias("c")).agg(F.min("doc_id").alias("component_id"))
    label = reps.select("node").join(found, "node", "left").select("node", F.coalesce("c", "node").alias("c")).join(least, "c").select("node", "component_id")
    release(ties, member, split, links)
    return (
        rows.withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")))
        .join(label, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The row of the smallest doc_id of each component, with all columns of docs; one row for each doc_id that stays.

    Rows without a doc_id all stay.
    """
    groups = save(ngram_jaccard_join(docs, words, percent), "groups")
    # Written without a shuffle: Spark knows its size, and deals no texts out if it is small.
    gone = save(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "gone")
    tidy(docs.sparkSession)
    stay = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    twice = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return stay
    own = stay["doc_id"].cast("long") == twice["_twice"]
    return stay.join(twice, own, "left_anti").unionByName(stay.join(twice, own, "left_semi").dropDuplicates(["doc_id"]))


def _blocks(member: DataFrame, docs: int, ngrams: int) -> DataFrame:
    """(family, s): the blocks that each family of several sets is cut into."""
    size = member.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("ngrams"))
    return size.where("docs > 1").select("family", F.greatest(F.ceil(F.col("docs") / docs), F.ceil(F.col("ngrams") / ngrams)).alias("s"))


def _dealt(member: DataFrame, docs: int, ngrams: int) -> DataFrame:
    """member with i and j: a row for each two blocks of its family that it is compared in."""
    return (
        member.join(_blocks(member, docs, ngrams), "family")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(7), "node"), "s"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
        .select(*member.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )


def _split(texts: DataFrame, member: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """member (node, scheme, family, doc_id, n) with families of several blocks split into the sets that parities tie: a
    set's n-grams are sent once for each block of its family, so a family has to stay small."""
    large = save(member.join(_blocks(member, BLOCK_DOCS, BLOCK_NGRAMS).where("s > 1"), "family", "left_semi"), "large")
    if large.isEmpty():
        return member
    sketches = texts.mapInArrow(lean(_sketch_rows(words, p, q, _filter(large))), "node long, scheme int, sketch binary")
    dealt = _dealt(large.select("node", "scheme", "family", "n"), SKETCH_DOCS, SKETCH_NGRAMS).join(sketches, ["node", "scheme"])
    dealt = dealt.select("family", "i", "j", "node", "n", "sketch").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    near = save(dealt.mapInArrow(lean(_sketch_links(p, q)), "family long, a long, b long"), "parities")
    tidy(texts.sparkSession)
    found = components(near.select(F.xxhash64("family", "a").alias("u"), F.xxhash64("family", "b").alias("v")), "u", "v")
    parts = large.withColumn("u", F.xxhash64("family", "node")).join(found.withColumnRenamed("node", "u"), "u").select("node", "scheme", F.col("component").alias("family"), "doc_id", "n")
    rest = member.join(large.select("family").distinct(), "family", "left_anti").select("node", "scheme", "family", "doc_id", "n")
    split = save(rest.unionByName(parts), "split")
    release(large, near)
    return split


def _near_sets(texts: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(node): sets that share p / q of their n-grams at least with others, whichever these are."""
    spark = texts.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(lean(_range_rows(words, parts)), PIECES).repartition(parts, "part", F.when(F.col("part") < 0, F.col("chunk"))).sortWithinPartitions("part")
    counts = dealt.mapInArrow(lean(_count_shared), "chunk long, docs int, counts binary, nodes binary, sizes binary")
    near = save(counts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(_sharers(p, q)), "node long"), "near")
    del dealt, counts
    tidy(spark)
    return near


def _tied(texts: DataFrame, words: int, p: int, q: int, bits: np.ndarray | None) -> DataFrame:
    """(node, first, scheme): nodes that share a fragment key with a first one."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = texts.mapInArrow(lean(_key_rows(words, p, q, bits)), "key long, node long, first long, scheme int").repartition(n, "key").sortWithinPartitions("key", "node")
    return save(keys.mapInArrow(lean(_ties), "node long, first long, scheme int").distinct(), "ties")


def _filter(docs: DataFrame) -> np.ndarray:
    """Bits that the doc_ids of docs set; as many rows as words of the filter come to the driver at most."""
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for word, value in docs.select("doc_id").distinct().mapInArrow(lean(_slots("doc_id")), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).collect():
        bits[word] = np.uint64(value & (1 << 64) - 1)
    return bits


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)
