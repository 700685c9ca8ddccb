"""Tokens, packing, Re-Pair and shards: exact round trips."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import packing, repair, sharding, tokens


@pytest.fixture(scope="module")
def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def check(path, library, texts):
    ids, off = tokens.Encoder(path).ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == library(texts)


def test_ids_are_the_librarys(path, library):
    check(path, library, ["", " ", "a", "it's we're 'll ''s", "x'", "  a \n\n b\t", "don't'S 5's", "日本 한국", "😀 smile's", "<|endoftext|> hi", "\x1c\x85 a", "a b", "ß" * 300_000])
    settled = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and tokens._classes()[c] != tokens.UNSETTLED]
    check(path, library, ["".join(f"a{c}1 {c} " for c in settled[i : i + 400]) for i in range(0, len(settled), 400)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abst 'sdrelvm\n\t 019.,!éÉ日😀  ", max_size=20), max_size=30))
def test_ids_of_any_texts(path, library, texts):
    check(path, library, texts)


def encoded(library, rows):
    return {d: [*i, 0] for (d, _), i in zip(rows, library([t or "" for _, t in rows]))}


ROWS = [(1, "a short one"), (2, None), (3, ""), (4, "many words here " * 3000), (5, "x y z " * 200), (9, "é" * 3000), (7, "tail")]


def test_packing_round_trip(docs, path, library):
    want = encoded(library, ROWS)
    rows = packing.pack(docs(*ROWS).coalesce(2), path, with_ids=True).collect()
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert (r.length, r.doc_tokens) == (len(r.ids), len(want[r.doc_id]))
        parts[r.doc_id].append((r.start, r.ids))
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, ids in want.items():
        assert [x for _, part in sorted(parts[d]) for x in part] == ids
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == packing.LENGTH or at & (at - 1) == 0  # nothing to pad
    assert packing.pack(docs(), path).count() == 0


def test_packing_of_odd_rows(odd, path):
    r = packing.pack(odd, path).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {x.doc_id for x in r} == {None, 1, 2, 3, 4, 5, 6, 7, 8}


def test_room_is_found_among_all_sequences():
    assert packing.fill([400], [100] * 10 + [500]) == [(0, 0, 400, 10)]
    rng = random.Random(1)
    for _ in range(50):
        rooms = [rng.randrange(1, 200) for _ in range(40)]
        lengths, costs, left = [rng.randrange(1, 150) for _ in range(80)], [0.0] * 40, list(rooms)
        for i, at, n, b in packing.fill(lengths, rooms):
            fits = [x for x in range(40) if left[x] >= lengths[i] - at]
            assert b == (min(fits, key=lambda x: (costs[x], x)) if fits else min(range(40), key=lambda x: (-left[x], costs[x], x)))
            costs[b], left[b] = costs[b] + packing.cost(n), left[b] - n


@given(st.lists(st.integers(1, 1023), max_size=60))
def test_filling_is_exact(lengths):
    total = sum(lengths)
    rooms = [1024] * (total // 1024)
    out = packing.fill(lengths, rooms)
    used, room = defaultdict(int), defaultdict(int)
    for i, at, n, b in out:
        assert at == used[i]
        used[i] += n
        room[b] += n
    assert all(room[b] == 1024 for b in range(len(rooms)))
    assert sum(used.values()) == len(rooms) * 1024


def test_costs_are_balanced():
    out = packing.fill([512] * 8 + [64] * 64, [1024] * 8)
    first = [b for i, _, _, b in out if i < 8]
    assert sorted(first) == list(range(8))  # a long one each


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=30))
def test_grammar_round_trip(parts):
    parts = [[*x, 0] for x in parts]
    flat, ends = np.array([i for x in parts for i in x], np.int32), np.cumsum([len(x) for x in parts])
    symbols, places, rules = repair.compress(flat, ends, rounds=6, uses=2)
    lengths = repair.expansion_lengths(rules)
    assert repair.decode(symbols, rules).tolist() == flat.tolist()
    for k, x in enumerate(parts):  # each document, and each token of it, by itself
        own = symbols[places[k - 1] if k else 0 : places[k]]
        assert repair.decode(own, rules).tolist() == x
        assert [repair.token_at(own, rules, lengths, i) for i in range(len(x))] == x


def test_grammar_gets_smaller():
    flat = np.array([1, 2, 3, 4, 0] * 1000, np.int32)
    symbols, _, rules = repair.compress(flat, np.arange(5, 5001, 5), rounds=6, uses=2)
    assert len(symbols) + 2 * len(rules) < len(flat) / 3


def test_token_files(docs, path, library, odd):
    want = encoded(library, ROWS)
    got = {r.doc_id: r for r in repair.read_tokens(repair.write_tokens(docs(*ROWS), path)).collect()}
    at = 0
    for d in sorted(want):
        assert (got[d].start, got[d].n_tokens) == (at, len(want[d]))
        assert got[d].ids_crc32 == crc32(np.array(want[d], "<u4").tobytes())
        at += len(want[d])
    assert repair.read_tokens(repair.write_tokens(docs(), path)).count() == 0
    rows = repair.read_tokens(repair.write_tokens(odd, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_shards(docs, odd):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(4000)] + [(5000 + i, "the same text") for i in range(3000)] + [(9000, None)]
    got = sharding.shard(docs(*rows), 16).collect()
    texts = dict(rows)
    size, slots, group = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        group[raw].add(r.shard)
    mean = sum(size.values()) / 16
    assert max(abs(s - mean) for s in size.values()) < 0.02 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for raw, s in group.items() if raw not in (b"the same text", b"")) == 0
    assert sharding.shard(odd).count() == 11
    assert sharding.shard(docs()).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_ids_of_patterned_words(path, library):
    words = [w for n in (1024, 2048, 4096, 8192) for w in (thue_morse(n), thue_morse(n, "ba"))]
    check(path, library, words + [" ".join(words)])


def test_entries_that_differ_are_not_used(path, library, monkeypatch):
    monkeypatch.setattr(tokens, "mix", lambda x: x * np.uint64(0) + np.uint64(6))  # all hashes are alike
    tokens._values.cache_clear()
    check(path, library, ["one two three", "four five six one", "two two, three 33", ""])
    monkeypatch.undo()
    tokens._values.cache_clear()


def plain_shards(rows, shards, whole):
    """(doc_id, size, shard, slot) by a plain pass over all rows in order."""
    raw = [((t or "").encode(), d) for d, t in rows]
    key = lambda r: (np.int64(np.uint64(xxhash.xxh64(r[0], seed=42).intdigest())), r[1] is not None, r[1] or 0)
    raw.sort(key=key)
    sizes = [len(t) + 1 for t, _ in raw]
    before, total = np.concatenate([[0], np.cumsum(sizes)]).tolist(), sum(sizes)
    cuts = [total * k // shards for k in range(1, shards)]
    for i, c in enumerate(cuts):
        at = next(j for j in range(len(raw)) if before[j] <= c < before[j + 1])
        own = [j for j in range(len(raw)) if raw[j][0] == raw[at][0]]
        a, b = before[own[0]], before[own[-1] + 1]
        if a < c < b and b - a <= whole * total / shards:
            cuts[i] = a if c - a <= b - c else b
    out, slots = [], defaultdict(int)
    for j, (_, d) in enumerate(raw):
        k = sum(2 * before[j] + sizes[j] >= 2 * c for c in cuts)
        out.append((d, sizes[j], k, slots[k]))
        slots[k] += 1
    return out


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_equal_a_plain_pass(docs, shards):
    rng = random.Random(shards)
    rows = [(i, rng.choice(["x", "é" * 9, "", None]) if i % 3 == 0 else "w" * rng.randrange(300) + str(i % 200)) for i in range(600)]
    got = [(r.doc_id, r["size"], r.shard, r.slot) for r in sharding.shard(docs(*rows), shards, 0.05).collect()]
    assert sorted(got) == sorted(plain_shards(rows, shards, 0.05))
