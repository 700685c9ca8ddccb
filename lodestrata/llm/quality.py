"""Quality rules over documents: plain counts, and how far a document's histograms are from those of its language.

Two histograms of each document, one of character classes and one of the common words of its language, are compared with
the language's reference by Jensen-Shannon distance. References are learned from all documents: the common words by
count, the references as the mean share of each class over the documents of the language. Short documents scatter, so
the limits fall with the length, and below a least length nothing is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.llm.common import save, table

#: Words of a window, common words of a language and the bytes that they have at most, words that a document needs and
#: documents that a language needs to be compared.
WINDOW, COMMON, SHORT, LEAST_WORDS, LEAST_DOCS = 5, 16, 6, 30, 50
#: A distance may be A + B / sqrt(words): (A, B) for character classes and for common words.
CHARS_LIMIT, WORDS_LIMIT = (0.2, 1.0), (0.18, 2.0)
#: Character classes; what is in none of them is the last class.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{N}", r"[\x20\x09-\x0D]", r"[.,;:?'\x22()-]")
BLANKS, SYMBOLS = 3, "#*$%&|<>"  # BLANKS: the place of blanks in CLASSES


def let(value: Column, f) -> Column:
    """f of a value that is computed once, though f may use it inside of lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more. Only if two windows have one hash, they are sorted
    by it, and equal neighbours are compared word by word."""
    def same(w: Column, x: Column, y: Column) -> Column:
        alike = x["h"] == y["h"]
        for k in range(width):
            alike = alike & (F.get(w, x["i"] + k) == F.get(w, y["i"] + k))
        return F.coalesce(alike, F.lit(False))

    def found(w: Column, hashes: Column) -> Column:
        sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: same(w, x, F.get(s, j - 1)) | same(w, x, F.get(s, j + 1)))
        places = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
        covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)
        any_twice = let(F.sort_array(hashes), lambda s: F.size(F.filter(s, lambda h, i: h == F.get(s, i + 1))) > 0)
        return F.when(any_twice, let(let(sorted_, places), covered)).otherwise(0)

    def windows(h: Column, have: int = 1) -> Column:
        """Hashes of `width` words, from those of `have`: each is joined with the one that begins where it ends, or with one
        that overlaps it."""
        if have == width:
            return h
        by = min(have, width - have)
        n = F.size(h) - by
        return let(F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y)), lambda g: windows(g, have + by))

    return F.when(F.size(words) >= width, let(words, lambda w: let(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: windows(h)), lambda h: found(w, h)))).otherwise(0).cast("long")


def class_counts(text: Column) -> Column:
    """Characters of each of CLASSES and of none, and SYMBOLS among these. Each class is taken out of what the ones before left."""
    def step(left: Column, rest: tuple[str, ...], got: list[Column]) -> Column:
        if not rest:
            return F.array(*got, F.length(left).cast("long"), (F.length(left) - F.length(F.translate(left, SYMBOLS, ""))).cast("long"))
        return let(F.regexp_replace(left, f"{rest[0]}+", ""), lambda t: step(t, rest[1:], [*got, (F.length(left) - F.length(t)).cast("long")]))
    return step(text, CLASSES, [])


def common_words(docs: DataFrame, k: int = COMMON) -> DataFrame:
    """(lang, common): the k most frequent words of each language, of SHORT bytes at most and without commas, in one string
    with a comma between them; ties by the word. docs: (lang, text)."""
    words = docs.where("lang IS NOT NULL").select("lang", F.explode(F.filter(words_of(F.col("text")), lambda x: F.octet_length(x) <= SHORT)).alias("word"))
    counts = words.groupBy("lang", "word").count().where("instr(word, ',') = 0")
    best = counts.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("place") <= k)
    return best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w")).select("lang", F.array_join("w.word", ",").alias("common"))


def measures(docs: DataFrame, common: DataFrame, k: int = COMMON) -> DataFrame:
    """The counts of each document, its character classes and the uses of its language's common words (the last: all other
    words). docs: (doc_id, lang, text)."""
    ws, text = F.col("_ws"), F.col("text")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    places = F.filter(F.transform(F.filter(ws, lambda x: F.octet_length(x) <= SHORT), lambda x: F.call_function("find_in_set", x, F.col("common"))), lambda p: p > 0)
    uses = lambda p: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("long"))
    counted = docs.join(common, "lang", "left").withColumn("_ws", words_of(text)).withColumn("_classes", class_counts(text))
    return counted.select(
        "doc_id",
        "lang",
        F.size(ws).cast("long").alias("n_words"),
        (F.length(text) - F.get("_classes", F.lit(BLANKS))).alias("word_chars"),
        F.get("_classes", F.lit(len(CLASSES) + 1)).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        F.slice("_classes", 1, len(CLASSES) + 1).alias("chars"),
        F.when(F.col("common").isNotNull(), let(places, lambda p: F.concat(uses(p), F.array((F.size(ws) - F.size(p)).cast("long"))))).alias("words"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """(lang, chars_ref, words_ref): mean shares over the documents of LEAST_WORDS and more, for languages with LEAST_DOCS of them."""
    long_ = measured.where((F.col("n_words") >= LEAST_WORDS) & F.col("words").isNotNull())
    mean = lambda c, n: F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(n)])
    shares = long_.select("lang", _shares(F.col("chars")).alias("c"), _shares(F.col("words")).alias("w"))
    found = shares.groupBy("lang").agg(F.count("*").alias("n"), mean("c", len(CLASSES) + 1).alias("chars_ref"), mean("w", COMMON + 1).alias("words_ref"))
    return found.where(F.col("n") >= LEAST_DOCS).drop("n")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram of counts and a reference of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(_shares(counts), reference, lambda p, r: part(p, (p + r) / 2) + part(r, (p + r) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, char_distance,
    word_distance) of each row of docs (doc_id, lang, text).

    A null text is an empty one and fails the base rules. Rows that repeat are judged each. Rows without a language, of a
    language with fewer than LEAST_DOCS long documents, or with fewer than LEAST_WORDS words have null distances and fail
    by the base rules only. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Small written tables: Spark broadcasts them if their size allows, and deals the rows out by language if not.
    common = save(common_words(rows), "common")
    measured = save(measures(rows, common), "measured")
    judged = measured.join(save(references(measured), "references"), "lang", "left")
    long_ = F.col("n_words") >= LEAST_WORDS
    over = lambda d, limit: F.coalesce(d > limit[0] + limit[1] / F.sqrt(F.col("n_words").cast("double")), F.lit(False))
    return (
        judged.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("char_distance", F.when(long_ & F.col("chars_ref").isNotNull(), distance(F.col("chars"), F.col("chars_ref"))))
        .withColumn("word_distance", F.when(long_ & F.col("words_ref").isNotNull(), distance(F.col("words"), F.col("words_ref"))))
        .withColumn("kept", ~(F.col("base_failed") | over(F.col("char_distance"), CHARS_LIMIT) | over(F.col("word_distance"), WORDS_LIMIT)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "char_distance", "word_distance")
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("lang", "char_distance", "word_distance")
