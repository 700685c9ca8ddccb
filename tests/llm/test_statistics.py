"""Whitening, manifests and quality rules against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import groupby
from zlib import crc32

import numpy as np
import pytest

from lodestrata.llm import merkle, quality, whitening

VECTORS = "vec_id long, embedding array<float>, n long, x binary, dims long, deviation double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, 1, 0.0) for i, v in rows], VECTORS)


def plain_whitening(rows, k=4):
    """Components and whitened values by an eigendecomposition of the covariance."""
    x = {i: np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    trace = np.trace(centred.T @ centred / n)
    return {i: (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(y, sums)), (y - sums / n) @ v / np.sqrt(e), e / trace) for i, y in x.items()}


@pytest.mark.parametrize(("dims", "rows", "parts"), [(6, 300, 20), (40, 60, 3), (3, 2000, 1)])
def test_whitening_is_that_of_an_eigendecomposition(spark, dims, rows, parts):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(rows, dims)) * np.linspace(3, 0.3, dims) + 5
    data = [(i, [float(c) for c in v]) for i, v in enumerate(np.vstack([base, np.repeat(base[:1], rows // 2, 0)]).astype(np.float32))]
    want = plain_whitening(data)
    got = defaultdict(dict)
    for r in whitening.whiten(vectors(spark, data).repartition(parts)).collect():
        got[r.vec_id][r.component] = r
        assert r.identity_error < 1e-9
    assert set(got) == set(want)
    sign = {c: math.copysign(1, got[1][c].whitened * want[1][2][c - 1]) for c in got[1]}
    for i, (n, deviation, white, explained) in want.items():
        assert sorted(got[i]) == list(range(1, min(4, dims) + 1))
        for c, r in got[i].items():
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened * sign[c] == pytest.approx(white[c - 1], abs=1e-8)
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)


def test_summaries_merge_in_any_grouping():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 900, (700, 12))
    whole = whitening.Summary.of(x)
    for cuts in ([1], [350], [3, 5, 200, 690], list(range(50, 700, 50))):
        parts = [whitening.Summary.of(p) for p in np.split(x, cuts)]
        nested = whitening.Summary.merged([whitening.Summary.merged(parts[:2]), *parts[2:]])
        assert (nested.n, nested.sums) == (whole.n, whole.sums)
        assert np.allclose(nested.axes.T @ nested.axes, whole.axes.T @ whole.axes, rtol=1e-10)
    again = whitening.Summary.read(type("R", (), whole.row(0)))
    assert again.sums == whole.sums
    assert np.array_equal(again.axes, whole.axes)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [3.0, 1.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [0.0, 0.5]), (9, [1e38, 0.0]), (10, [1.0, 2.0, 3.0]), (11, [4.0, 2.0, 3.5]), (12, [-0.0, 0.5])]
    rows = whitening.whiten(vectors(spark, odd)).collect()
    two, three = [r for r in rows if r.n == 3], [r for r in rows if r.n == 2]
    assert sorted((r.vec_id or 0) for r in two if r.component == 1) == [0, 1, 7, 7, 8, 12]
    assert sorted((r.vec_id, r.component) for r in three) == [(10, 1), (11, 1)]  # two vectors have variance along one line
    assert len(rows) == len(two) + len(three)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [2.0]), (2, [2.0])])).count() == 0  # no variance


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduce_(nodes):
    """(root, siblings of each node as (left, right) from the bottom)."""
    proofs, members, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, joined = [], []
        for k in range(0, len(level), 2):
            pair = level[k : k + 2]
            for side in range(len(pair)):
                for i in members[k + side]:
                    proofs[i].append((pair[0] if side else "", pair[1] if not side and len(pair) > 1 else ""))
            above.append(sha(*pair))
            joined.append([i for m in members[k : k + 2] for i in m])
        level, members = above, joined
    return level[0], proofs


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(field(r[0]), field(r[3]), field(r[2]), field(None if r[4] is None else r[4] + more), field(r[1]))
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    trees = []
    for _, group in groupby(sorted(rows, key=lambda r: (*key(r), r[0] is not None, r[0] or 0, leaf(r))), key=key):
        group = list(group)
        trees.append((group, *reduce_([leaf(r) for r in group])))
    root, tops = reduce_([t[1] for t in trees])
    out = []
    for (group, subroot, proofs), top in zip(trees, tops):
        for r, proof in zip(group, proofs):
            proof = proof + top
            node = leaf(r, 1) if r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for a, b in proof:
                node = sha(a, node, b)
            out.append((r[0], leaf(r), subroot, root, sha(*[x for s in proof for x in s]), node, node == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "0 as i", "'x' as node", "1 as tree", "'p' as proof")
    proof = "sha2(array_join(transform(proof, s -> concat(s.left, s.right)), ''), 256)"
    got = merkle.manifest(df).selectExpr("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()
    return sorted([tuple(r) for r in got], key=str)


@pytest.mark.parametrize("size", [1, 2, 16, 17, 33, 700])
def test_manifest_is_that_of_a_plain_tree(spark, size):
    rng = random.Random(size)
    rows = [(rng.randrange(2 * size), "é" * rng.randrange(9), rng.choice(["en", "de", "é", "a", None]) if size < 700 else rng.choice(["en", *map(str, range(40))]), "s", rng.choice([None, 3, 9])) for _ in range(size)]
    got = manifest_rows(spark, rows)
    assert got == plain_manifest(rows)
    assert size < 700 or {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "b", "en", None, 2**63 - 1), (-7, "x" * 200_000, "", "s", -1)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)
    assert manifest_rows(spark, []) == []
    same = [(5, "copy", "en", "s", 4)] * 300
    assert manifest_rows(spark, same) == plain_manifest(same)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts(docs, odd):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b ", "c\n", " ", "é ", "#", " ", "😀 ", "\x0b", "a b c d e f "]) for _ in range(rng.randrange(120)))) for i in range(400)]
    for df in (docs(*rows), odd):
        texts = Counter((r.doc_id, plain_counts(r.text)) for r in df.collect())
        got = quality.judge(df).collect()
        assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == texts
    assert quality.judge(docs()).count() == 0


def test_odd_histograms_fail_and_the_language_passes(spark):
    rng = random.Random(3)
    common = {"en": "the of and to in is that it".split(), "de": "der die und den von zu das mit".split()}

    def prose(lang, n):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.45 else "".join(rng.choices("aeioustrnl", k=rng.randrange(4, 10))) for _ in range(n)) + "."

    rows = [(i, prose(lang := rng.choice(["en", "de"]), rng.randrange(30, 400)), lang, "s", 0) for i in range(300)]
    junk = [(1000 + i, t, "en", "s", 0) for i, t in enumerate([prose("en", 200).upper(), " | ".join("".join(rng.choices("aeioustrnl", k=8)) for _ in range(150)), prose("en", 200).replace(" ", "&&& "), prose("de", 200), " ".join(map(str, range(200)))])]
    short = [(2000, "zz yy xx ww vv uu tt ss rr qq pp", "en", "s", 0), (2001, prose("en", 80).upper(), None, "s", 0), (2002, prose("en", 80).upper(), "rare", "s", 0)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows + junk + short, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[r[0]].kept for r in rows)
    assert not any(got[r[0]].kept for r in junk)
    assert all(got[r[0]].kept and got[r[0]].char_distance is None for r in short)  # nothing to compare with, or too short


def test_distance_is_jensen_shannons(spark):
    df = spark.createDataFrame([([3, 0, 1], [0.25, 0.25, 0.5])], "a array<long>, b array<double>")
    p, q = np.array([0.75, 0, 0.25]), np.array([0.25, 0.25, 0.5])
    kl = lambda x, m: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    want = math.sqrt((kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2)
    assert df.select(quality.distance(df.a, df.b)).first()[0] == pytest.approx(want)
