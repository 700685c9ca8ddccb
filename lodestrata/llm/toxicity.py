"""Toxicity scores of texts restored from obfuscation by a noisy-channel decoder.

A word that may be disguised (leet digits and signs, letters set apart, repeated letters) becomes a lattice of what each
character may stand for; Viterbi decoding finds the likeliest reading under a language model of characters that was
counted over all documents. The text with these readings is scored by a decision list over words and word
beginnings that tell the labels apart.

Passes: (1) counts of four characters in a row over all documents; (2) words of labelled documents, counted by label, one
document of each group of near copies (or a group's words would pass for cues); (3) the chosen features of all documents, written narrow; the model is fitted on the labelled ones and applied.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import save, ship, table
from lodestrata.llm.words import BLANKS, BYTES, LOWER, column_bytes, lean, mix, resident, slices, text_shingles, word_hashes

#: Labelled rows that the model is fitted on at most (those of the smallest hashes).
SAMPLE = 20_000
#: Share of chosen features that may be there by chance, and least toxic documents that have a feature.
CHANCE, SUPPORT = 0.2, 3
#: Bytes of word beginnings that are features beside whole words; a feature that a text has twice is one more.
BEGINNINGS = (4, 5, 6)
TWICE = np.uint64(0x2545F4914F6CDD1D)
#: Standard errors below its precision at which a feature is ranked, and documents that its precision counts as.
DOUBT, DRAW = 1.5, 4.0
THRESHOLD = 0.3
#: What characters may stand for, as fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Log probabilities of the channel: a sign for a letter, a sign for itself, a letter written twice, a gap inside a word
#: and one between words.
DISGUISE, ITSELF, REPEAT, GAP, BREAK = -1.0, -6.0, -0.7, -0.7, -1.5
#: Symbols of the model: 0 between words, 1 to 26 letters, 27 anything else.
N = 28
SYMBOL = np.full(256, 27, np.uint8)
SYMBOL[list(b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>/-_")] = 0
SYMBOL[97:123] = np.arange(1, 27)
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in LEET if ord(c) < 128]] = True
GAPS = np.zeros(256, bool)
GAPS[list(b".-_*~")] = True
LATIN = np.zeros(256, bool)
LATIN[97:123] = True


#: Two characters in a row that aren't marks, and a mark.
APART, MARK = re.compile(r"[^.\-_*~]{2}"), re.compile(r"[.\-_*~]")


def count_symbols(column: pa.Array) -> np.ndarray:
    """Counts of four symbols in a row (blank edges between texts)."""
    buf, off = column_bytes(column)
    s = np.insert(SYMBOL[LOWER[buf]], off, 0).astype(np.int32)
    if len(s) < 4:
        return np.zeros(N**4, np.int64)
    return np.bincount(((s[:-3] * N + s[1:-2]) * N + s[2:-1]) * N + s[3:], minlength=N**4)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after three: counts smoothed by those after fewer."""
    c = counts.reshape((N,) * 4).astype(np.float64)
    p = (c.sum((0, 1, 2)) + 1) / (c.sum() + N)
    for known in (c.sum((0, 1)), c.sum(0), c):
        p = (known + 8 * p) / (known.sum(-1, keepdims=True) + 8)
    return np.log(p).astype(np.float32).ravel()


class Decoder:
    """Viterbi decoding of lattices under a model; remembers readings of so many words that aren't longer than LONGEST."""

    REMEMBERED, LONGEST = 50_000, 64

    def __init__(self, model: np.ndarray):
        self.p = array("d", model.astype(np.float64).tobytes())
        self.known: dict[str, str] = {}

    def __call__(self, word: str) -> str:
        if len(word) > self.LONGEST:
            return self.decode(word)
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.decode(word)
        return found

    @staticmethod
    def lattice(word: str) -> Iterator[list[tuple[str, int, float]]]:
        """For each character its readings: (text, symbol or -1 for none, log probability)."""
        spaced = " " in word or APART.search(word) is None and MARK.search(word) is not None
        before = ""
        for c in word:
            if "a" <= c <= "z":
                yield [(c, ord(c) - 96, 0.0)] + ([("", -1, REPEAT)] if c == before else [])
            elif c in LEET:
                yield [(x, ord(x) - 96, DISGUISE) for x in LEET[c]] + [(c, 27, ITSELF)] + ([("", -1, REPEAT)] if c == before else [])
            elif c in " .-_*~":
                yield [(" ", 0, BREAK if spaced else 0.0)] + ([("", -1, GAP)] if spaced else [])
            else:
                yield [(c, 27 if c.isalpha() else 0, 0.0)]
            before = c

    def decode(self, word: str) -> str:
        # Each state's best score and its reading, as a chain from the last text to the first.
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in self.lattice(word):
            new: dict[int, tuple[float, tuple | None]] = {}
            for ctx, (score, read) in states.items():
                for t, s, cost in options:
                    if s < 0:
                        to, value = ctx, score + cost
                    else:
                        to, value = ctx % (N * N) * N + s, score + cost + self.p[ctx * N + s]
                    if to not in new or value > new[to][0]:
                        new[to] = (value, (read, t) if t else read)
            states = new
        ends = {ctx: score + self.p[ctx * N] for ctx, (score, _) in states.items()}
        read, out = states[max(ends, key=ends.get)][1], []
        while read:
            read, t = read
            out.append(t)
        return "".join(reversed(out))


def decoder_of(name: str, model) -> Decoder:
    """The decoder of a broadcast model, made once in each process."""
    return resident(name, lambda: Decoder(model.value))


def disguised(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, str]]:
    """(text, span) of all spans that may be disguised words, in lower case."""
    if not len(buf):
        return []
    low = LOWER[buf]
    _, _, start, end = word_hashes(buf, off, BLANKS, spans=True)
    if not len(start):
        return []
    doc = np.searchsorted(off, start, "right") - 1
    sums = [np.concatenate([[0], np.cumsum(t[low], dtype=np.int32)]) for t in (LATIN, SIGNS, GAPS)]
    letters, signs, gaps = (s[end] - s[start] for s in sums)
    # A mark of exclamation at the end of a word is just that.
    tail = end.copy()
    for _ in range(3):
        tail = np.where((tail - start > 1) & (low[tail - 1] == ord("!")), tail - 1, tail)
    signs = signs - (end - tail)
    three = np.zeros(len(low) + 1, np.int32)
    three[3:] = np.cumsum((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & LATIN[low[2:]]) if len(low) > 2 else 0
    thrice = (end - start >= 3) & (three[end] - three[np.minimum(start + 2, len(low))] > 0)
    apart = (gaps >= 2) & (letters + signs <= gaps + 1) & (letters >= 2)
    flag = (letters >= 1) & (signs >= 1) | thrice | apart
    out = [(d, low[s:e].tobytes().decode(errors="replace")) for d, s, e in zip(doc[flag].tolist(), start[flag].tolist(), tail[flag].tolist())]
    # Single characters in a row.
    one = (tail - start == 1) & (LATIN[low[start]] | SIGNS[low[start]])
    first = one & ~np.concatenate([[False], one[:-1] & (doc[1:] == doc[:-1])])
    runs = np.flatnonzero(first)
    after = np.flatnonzero(one & ~np.concatenate([one[1:] & (doc[1:] == doc[:-1]), [False]])) + 1
    for a, b in zip(runs.tolist(), after.tolist()):
        if b - a >= 3:
            out.append((int(doc[a]), " ".join(map(chr, low[start[a:b]].tolist()))))
    return out


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words of texts and of their beginnings."""
    h, count, start, end = word_hashes(buf, off, LETTERS, spans=True)
    doc = np.repeat(np.arange(len(count) - 1), np.diff(count))
    low, hs, ds = LOWER[buf], [h], [doc]
    for n in BEGINNINGS:
        w = np.flatnonzero(end - start >= n)
        at, value = start[w], np.zeros(len(w), np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + BYTES[low[at + i]]
        hs.append(mix(value + np.uint64(n)))
        ds.append(doc[w])
    return np.concatenate(hs), np.concatenate(ds)


def restored(column: pa.Array, decode: Decoder) -> pa.Array:
    """For each text the readings of its disguised spans."""
    found: list[list[str]] = [[] for _ in range(len(column))]
    for d, span in disguised(*column_bytes(column)):
        found[d].append(decode(span))
    return pa.array([" ".join(x) for x in found], pa.string())


def text_features(column: pa.Array, decode: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts and of their restored spans."""
    a, b = features(*column_bytes(column)), features(*column_bytes(restored(column, decode)))
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def group_keys(column: pa.Array) -> list[list[int]]:
    """For each text the least hash of its shingles among the even and among the odd ones; near copies share one mostly."""
    return [[int(half[0]) for half in (a[a % 2 == 0], a[a % 2 == 1]) if len(half)] for a in text_shingles(column, BLANKS, 5)]


def one_of_each_group(texts: DataFrame, sample: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, toxic) of one document for each group of near copies in the sample, with the label that most of them have."""
    def run(batches):
        for b in slices(batches):
            keys = [[k - (1 << 63) for k in x] for x in group_keys(b.column("text"))]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "keys": pa.array(keys, pa.list_(pa.int64()))})

    rows = texts.join(F.broadcast(sample), "doc_id").mapInArrow(lean(run), "doc_id long, toxic int, keys array<long>").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # SAMPLE rows at most
    first: dict[int, int] = {}
    votes: dict[int, Counter] = {}
    for doc, toxic, keys in rows:
        to = next((first[k] for k in keys if k in first), doc)
        for k in keys:
            first.setdefault(k, to)
        votes.setdefault(to, Counter())[toxic] += 1
    return [(doc, int(v[1] >= v[0])) for doc, v in votes.items()]


def beyond_chance(evidence: list[float], tried: int) -> int:
    """How many features to choose, the first having most evidence, so that CHANCE of them at most are there by chance.

    exp(-evidence) bounds the probability that so many of a feature's documents are toxic by chance; the step-up rule of
    Benjamini and Hochberg weighs it against the number of features tried, so few labels do where the cues are clear.
    """
    return max((k for k, e in enumerate(evidence, 1) if tried * np.exp(-e) <= CHANCE * k), default=0)


def fit(found: list[list[int]], toxic: np.ndarray, n: int) -> tuple[list[int], list[float]]:
    """A decision list over n features: (place of each feature, score of each place; the last place is for none).

    Features are ranked by the lower bound of their precision; a text is judged by the best that it has. A place's score is
    the toxic rate of the texts that it judges, drawn to the feature's own precision where these are few.
    """
    has = np.zeros((2, n))
    for f, y in zip(found, toxic.tolist()):
        has[y, f] += 1
    total = has.sum(0)
    rate = (has[1] + 0.5) / (total + 1)
    low = rate - DOUBT * np.sqrt(rate * (1 - rate) / (total + 1))
    order = np.argsort(-low, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    judged = np.zeros((2, n + 1))
    for f, y in zip(found, toxic.tolist()):
        judged[y, place[f].min() if f else n] += 1
    prior = np.append(rate[order], toxic.mean() / 10 if len(toxic) else 0.0)
    return place.tolist(), ((judged[1] + DRAW * prior) / (judged.sum(0) + DRAW)).tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id long, text string).

    labels (doc_id, toxic 0 or 1; any other number is 1) is read for rows that aren't held out; of several rows of one doc_id one that says 1
    wins, rows without a label or an id don't count. A null or empty text has no words and is scored too. Without
    labels of both kinds, or without features that tell them apart, all scores are the rate of toxic labels (0 without
    labels), held under the threshold. Rows that repeat are returned each; a row without a doc_id isn't held out. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    sample = spark.createDataFrame(one_of_each_group(texts, spark.createDataFrame(sample.collect(), "doc_id long, toxic int")), "doc_id long, toxic int")  # SAMPLE rows at most

    def count(batches):
        total = np.zeros(N**4, np.int64)
        for b in slices(batches, 1 << 20):
            total += count_symbols(b.column("text"))
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    counts = np.zeros(N**4, np.int64)  # as many rows as the model has cells at most
    for cell, n in texts.select("text").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    model = spark.sparkContext.broadcast(language_model(counts))

    name = uuid4().hex

    def words(batches):
        for b in slices(batches, 1 << 20):
            h, doc = text_features(b.column("text"), decoder_of(name, model))
            y = b.column("toxic").to_numpy()
            seen, n = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1, return_counts=True)
            again = seen[:, n > 1]
            again[0] ^= TWICE
            seen = np.concatenate([seen, again], axis=1)
            value, at = np.unique(seen[0], return_inverse=True)
            toxic = y[seen[1].astype(np.int64)]
            yield pa.record_batch({
                "feature": pa.array(value.view(np.int64)), "toxic": pa.array(np.bincount(at, toxic, len(value)).astype(np.int64)),
                "clean": pa.array(np.bincount(at, 1 - toxic, len(value)).astype(np.int64)),
            })

    known = texts.join(F.broadcast(sample), "doc_id")
    n1, n0 = (int(x or 0) for x in known.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    rate = n1 / max(1, n1 + n0)
    chosen = np.zeros(0, np.uint64)
    if n1 and n0:
        tried = save(
            known.mapInArrow(lean(words, name), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") + F.col("clean") >= SUPPORT),
            "tried",
        )
        of = F.col("toxic") + F.col("clean")
        odds = [F.when(c > 0, c * F.log(c / of / r)).otherwise(0.0) for c, r in ((F.col("toxic"), rate), (F.col("clean"), 1 - rate))]
        best = (
            tried.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") > of * rate)).withColumn("evidence", odds[0] + odds[1])
            .orderBy(F.desc("evidence"), "feature").collect()
        )
        best = best[: beyond_chance([r.evidence for r in best], tried.count())]
        chosen = np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))

    def hits(batches):
        for b in slices(batches, 1 << 20):
            found: list[list[int]] = [[] for _ in range(b.num_rows)]
            if len(chosen):
                h, doc = text_features(b.column("text"), decoder_of(name, model))
                for times, sought in ((1, h), (2, h ^ TWICE)):
                    k = np.minimum(np.searchsorted(chosen, sought), len(chosen) - 1)
                    use = chosen[k] == sought
                    for (d, f), n in sorted(Counter(zip(doc[use].tolist(), k[use].tolist())).items()):
                        if n >= times:
                            found[d].append(f)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "found": pa.array(found, pa.list_(pa.int32()))})

    rows = save(texts.mapInArrow(lean(hits, name), "doc_id long, found array<int>"), "features")
    score = F.lit(min(rate, 0.99 * THRESHOLD))  # nothing learned, nothing predicted
    if len(chosen):
        fitted = rows.join(F.broadcast(sample), "doc_id").select("found", "toxic").collect()  # SAMPLE documents at most
        place, scores = fit([r.found for r in fitted], np.array([r.toxic for r in fitted], int), len(chosen))
        of, rated = F.array(*[F.lit(p) for p in place]), F.array(*[F.lit(float(x)) for x in scores])
        best = F.element_at(rated, F.coalesce(F.array_min(F.transform("found", lambda i: F.element_at(of, i + 1))), F.lit(len(chosen))).cast("int") + 1)
        # Further features move a score inside its side of the threshold, so texts with more of them rank higher.
        rest = F.aggregate("found", F.lit(1.0), lambda left, i: left * (1 - F.element_at(rated, F.element_at(of, i + 1) + 1) / 2))
        score = best + F.when(best >= THRESHOLD, (1 - best) / 2).otherwise((THRESHOLD - best) / 2) * (1 - rest)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.cast("double").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all columns; rows without a doc_id stay."""
    # Written without a shuffle: Spark knows its size, and deals no texts out if it is small.
    bad = save(score_toxicity(docs, labels).where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("_bad")), "toxic")
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
