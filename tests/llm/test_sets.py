"""N-gram Jaccard join and decontamination against plain versions."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import decontamination, ngram_jaccard, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_equals_all_pairs(docs, n, percent):
    rng = random.Random(n)
    texts = []
    for size in (6, 12, 40, 150, 400):
        base = [f"b{size}_{rng.randrange(300)}" for _ in range(size)]
        texts += family(rng, base, 40, max(2, size // 12))
    shared = " ".join(f"p{i}" for i in range(60))  # a passage that many documents share
    texts += [shared + " " + " ".join(f"u{k}_{i}" for i in range(rng.randrange(5, 200))) for k in range(40)]
    texts += [texts[0].upper(), texts[0], "", None, "a", "A", "a b"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(docs(*rows), n, percent).collect()}
    assert got == brute(rows, n, percent)
    assert len({c for _, c in got.values()}) < len(rows) - 60  # there is something to find


def test_join_of_odd_rows(odd, docs):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(odd, 3, 90).collect())
    assert len(got) == 11
    assert [g for g in got if g[0] in "136"] == [("1", 4, 1), ("3", 0, 3), ("6", 4, 1)]
    assert [g for g in got if g[0] == "None"] == [("None", 0, None), ("None", 3, None)]
    assert ngram_jaccard.ngram_jaccard_join(docs(), 3, 90).count() == 0
    kept = ngram_jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None", "None"]


def test_links_span_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(70, 100), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(120)]
    found = ngram_jaccard.spanning_links(sets, 80, 100)
    group = list(range(len(sets)))
    for i, j in found:
        a = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * a >= 80 * (len(sets[i]) + len(sets[j]) - a)
        group = [group[i] if g == group[j] else g for g in group]
    for i in range(len(sets)):
        for j in range(i):
            a = len(np.intersect1d(sets[i], sets[j]))
            if 100 * a >= 80 * (len(sets[i]) + len(sets[j]) - a):
                assert group[i] == group[j]


def test_fragments_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    for size in (10, 11, 30, 200, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            b = a
            while True:  # change as much as the threshold allows
                c = np.unique(np.concatenate([np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 63, 1).astype(np.uint64)]))
                both = len(np.intersect1d(a, c))
                if 100 * both < 90 * (len(a) + len(c) - both):
                    break
                b = c
            if len(np.intersect1d(a, b)) == len(a) == len(b):
                continue
            key = lambda s: {(g, k) for g, ks in ngram_jaccard.fragment_keys(s, 90, 100) for k in ks.tolist()}
            assert key(a) & key(b)


def test_hashes_of_words_match_python():
    texts = ["The cat\tSAT", "", None, "x" * 3_000_000 + " y", "É é a-b\x0bq", "end"]
    h, count = words.word_hashes(*words.column_bytes(pa.array(texts)), words.BLANKS)
    flat = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))]
    assert count.tolist()[-1] == len(flat) == len(h)
    by = defaultdict(set)
    for w, x in zip(flat, h.tolist()):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values())
    assert len({x for v in by.values() for x in v}) == len(by)


def windows(items):
    out = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            out[tuple(w[k : k + n])].add(i)
    return out


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_decontamination_equals_plain_search(spark, docs, monkeypatch):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40, 10])] + [(9, None), (10, "--"), (None, "alpha beta"), (3, "Écho deux")]
    rows = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(60))] if i % 4 else [f"n{k}" for k in range(30)]
        put = rng.choice([t for _, t in items if t])
        rows.append((i, ", ".join(body[: len(body) // 2]) + " " + (put.upper() if i % 2 else "") + " " + " ".join(body[len(body) // 2 :])))
    rows += [(100, None), (101, ""), (102, "écho\nDEUX"), (103, items[7][1])]
    win = windows(items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontamination.BLOCK, 60):  # one block, and several
        monkeypatch.setattr(decontamination, "BLOCK", size)
        got = {r.doc_id: r for r in decontamination.decontaminate(docs(*rows), bench).collect()}
        for d, t in rows:
            w, hit, ids = tokens(t), set(), set()
            for n in {len(k) for k in win}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in win:
                        hit.update(range(k, k + n))
                        ids |= win[tuple(w[k : k + n])]
            r = got[d]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
            assert r.items_sha256 == sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert Counter(r.contaminated for r in got.values())[True] > 10


def test_decontamination_of_odd_rows(spark, odd, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(odd, none).where("contaminated").count() == 0
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    assert decontamination.decontaminate(odd, bench).where("contaminated").count() == 2
    clean = decontamination.decontaminate(odd, bench, clean=True)
    assert clean.columns == odd.columns
    assert clean.count() == 9
    assert decontamination.decontaminate(docs(), bench).count() == 0


def test_patterned_words_have_hashes_of_their_own():
    words_ = ["".join(c[i.bit_count() % 2] for i in range(n)) for n in (1024, 2048, 4096, 8192) for c in ("ab", "ba")]
    h, _ = words.word_hashes(*words.column_bytes(pa.array(words_, pa.string())), words.BLANKS)
    assert len(set(h.tolist())) == len(words_)


def test_families_of_several_blocks(docs, monkeypatch):
    rng = random.Random(11)
    rows = []
    for size, copies in ((40, 60), (90, 30)):
        base = [f"c{size}_{i}" for i in range(size)]
        rows += family(rng, base, copies, max(2, size // 8))
    rows = list(enumerate(rows))
    for blocks in (8, 30):
        monkeypatch.setattr(ngram_jaccard, "BLOCK_DOCS", blocks)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(docs(*rows), 3, 80).collect()}
        assert got == brute(rows, 3, 80)
    assert 1 < len({c for _, c in got.values()}) < len(rows)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_families_of_several_blocks_are_split_without_losing_a_link(docs, monkeypatch, n, percent):
    """Texts that share a passage tie by chance; a set is sent once for each block of its family, so these have to stay small."""
    rng = random.Random(n)
    shared = " ".join(f"p{i}" for i in range(60))
    texts = [shared + " " + " ".join(f"u{k}_{i}" for i in range(rng.randrange(5, 30))) for k in range(60)]
    for size in (40, 150):
        texts += family(rng, [f"b{size}_{rng.randrange(300)}" for _ in range(size)], 30, max(2, size // 12))
    rows = list(enumerate(texts))
    for name, value in (("BLOCK_DOCS", 4), ("SKETCH_DOCS", 25)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    sent = {}
    old = ngram_jaccard._dealt

    def dealt(member, most, ngrams):
        sent[most] = old(member, 4, ngrams).count()
        return old(member, most, ngrams)

    monkeypatch.setattr(ngram_jaccard, "_dealt", dealt)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(docs(*rows), n, percent).collect()}
    assert got == brute(rows, n, percent)
    assert sent[4] < sent[25]  # all rows of families against those of large ones as they were before


def test_parities_let_similar_sets_pass_and_part_others():
    rng = np.random.default_rng(1)
    for size in (3, 50, 700, 4000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (0, size // 30, size // 12, size // 2)] + [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))]
        g = max(ngram_jaccard.schemes(size, 80, 100))
        found = ngram_jaccard.near_links(np.stack([ngram_jaccard.sketch(a, g) for a in sets]), np.array([len(a) for a in sets]), 80, 100)
        assert {frozenset(x) for x in found} >= {frozenset((0, 1)), frozenset((0, 2))}
        if size >= 50:
            assert not {i for x in found for i in x} & {3, 4}
