"""Chunks, BM25 postings, dense vectors and rank fusion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.scores import content_hash, snippet
from lodestrata.functions.text import code_tokens, tokens
from lodestrata.storage import remove, saved, upsert

LINES, STEP = 60, 50
K1, B, NAME_BOOST, RRF, CANDIDATES = 1.2, 0.75, 2.0, 60, 50


def lines_of(content: Column) -> Column:
    """Lines without the empty one after a last line feed."""
    parts = F.split(content, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def window_chunks(files: DataFrame) -> DataFrame:
    """files (path, language, content) in windows of 60 lines that overlap by 10, named L<first>-<last>."""
    rows = files.select("path", "language", lines_of(F.col("content")).alias("ls")).withColumn("n", F.size("ls")).where("n > 0")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(STEP)), lambda s: (s == 0) | (s + (LINES - STEP) < F.col("n")))
    w = rows.select("path", "language", "ls", "n", F.explode(starts).alias("s")).withColumn("e", F.least(F.col("s") + LINES, F.col("n")))
    return w.select(
        F.col("path").alias("file"), F.col("language").alias("lang"), F.lit("window").alias("kind"), F.format_string("L%d-%d", F.col("s") + 1, F.col("e")).alias("name"),
        (F.col("s") + 1).alias("start_line"), F.col("e").alias("end_line"), F.array_join(F.slice("ls", F.col("s") + 1, F.col("e") - F.col("s")), "\n").alias("content"),
    )


def function_chunks(files: DataFrame, functions: DataFrame) -> DataFrame:
    rows = files.select(F.col("path").alias("file"), F.col("language").alias("lang"), lines_of(F.col("content")).alias("ls"))
    return functions.select("file", "name", "start_line", "end_line").join(rows, "file").select(
        "file", "lang", F.lit("function").alias("kind"), "name", "start_line", "end_line",
        F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content"),
    )


def chunk_files(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions of files that have any, windows of the others."""
    rest = files.join(functions.select(F.col("file").alias("path")).distinct(), "path", "left_anti")
    return function_chunks(files, functions).unionByName(window_chunks(rest))


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with an id that depends on their place alone."""
    return chunks.withColumn("id", F.xxhash64("file", "kind", "name", "start_line"))


def postings(chunks: DataFrame, token=tokens) -> DataFrame:
    """(term, id, field, tf, len) of names and contents; len: the field's number of terms. Sorted by term in each
    partition, so a stored index is read for the terms of a query alone."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), token(F.col(f)).alias("terms")) for f in ("name", "content")])
    each = chunks.select("id", F.explode(fields).alias("x")).select("id", "x.field", "x.terms")
    flat = each.select("id", "field", F.size("terms").cast("long").alias("len"), F.explode("terms").alias("term"))
    return flat.groupBy("term", "id", "field", "len").agg(F.count("*").alias("tf")).select("term", "id", "field", "tf", "len").sortWithinPartitions("term")


def bm25(index: DataFrame, terms: list[str], n_chunks: int, k: int = CANDIDATES, boosts: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of the k best chunks: any term counts, names count twice; ties by id."""
    boosts = boosts or {"name": NAME_BOOST, "content": 1.0}
    mean = index.groupBy("field").agg((F.sum("tf") / F.lit(float(max(1, n_chunks)))).alias("avg"))
    hits = index.where(F.col("term").isin(sorted(set(terms))))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.lit(0.0)
    for f, b in boosts.items():
        boost = F.when(F.col("field") == f, b).otherwise(boost)
    idf = F.ln(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(mean), "field")  # df: a row for each query term, mean: for each field
    return scored.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def cosine(embedding: Column, query: list[float]) -> Column:
    """Null for vectors that are null, zero, or of another length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(embedding, q, lambda a, b: a.cast("double") * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(embedding, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add))
    size = float(sum(x * x for x in query) ** 0.5)
    return F.when((F.size(embedding) == len(query)) & (norm > 0) & F.lit(size > 0), dot / (norm * F.lit(size)))


def dense(vectors: DataFrame, query: list[float], k: int = CANDIDATES, id_: str = "chunk_id") -> DataFrame:
    """(id, score) of the k nearest vectors."""
    return vectors.select(F.col(id_).alias("id"), cosine(F.col("embedding"), query).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame, name: str) -> DataFrame:
    """Places from 0 of hits that a limit bounds."""
    return hits.select("id", (F.row_number().over(W.orderBy(F.desc("score"), "id")) - 1).alias(name))


def fuse(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: (id, score, bm25_rank, dense_rank)."""
    both = ranked(lexical, "bm25_rank").join(ranked(semantic, "dense_rank"), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return both.select("id", (part("bm25_rank") + part("dense_rank")).alias("score"), "bm25_rank", "dense_rank")


def hydrate(fused: DataFrame, chunks: DataFrame, limit: int = 20, lang: str | None = None, kind: str | None = None) -> DataFrame:
    """Hits with their chunks; language and kind are filtered after fusion, so there may be fewer than limit."""
    out = chunks.join(F.broadcast(fused), "id")  # twice CANDIDATES rows
    out = out.where(F.col("lang") == lang) if lang else out
    out = out.where(F.col("kind") == kind) if kind else out
    return out.select("id", "file", "lang", "kind", "name", "start_line", "end_line", "score", "bm25_rank", "dense_rank", snippet(F.col("content")).alias("snippet")).orderBy(F.desc("score"), "id").limit(limit)


def hashed_embedding(text: Column, dim: int = 384) -> Column:
    """A stand-in where no model is installed: signed hashes of code tokens and their trigrams, normalised."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        from zlib import crc32

        def one(t: str):
            v = np.zeros(dim)
            for w in code_tokens(t or ""):
                for g in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                    h = crc32(g.encode())
                    v[h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype("float32")

        return s.map(one)

    return run(text)


def embed(chunks: DataFrame, provider=hashed_embedding) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), provider(F.concat("file", F.lit("::"), "name", F.lit("\n"), "content")).alias("embedding"))


def search(chunks: DataFrame, index: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, limit: int = 20, lang: str | None = None, kind: str | None = None, stemmed: bool = False) -> DataFrame:
    lexical = bm25(index, code_tokens(query, stemmed), chunks.count())
    semantic = dense(vectors, query_vector) if vectors is not None and query_vector else lexical.limit(0)
    return hydrate(fuse(lexical, semantic), chunks, limit, lang, kind)


def beginning(content: str) -> str:
    """What a file is compared by: its first 4096 bytes."""
    return content.encode()[:4096].decode(errors="ignore")


def others(hits: DataFrame, file: str, limit: int) -> DataFrame:
    return hits.where(F.col("file") != file).orderBy(F.desc("score"), "id").limit(limit)


def similar(chunks: DataFrame, index: DataFrame, file: str, content: str, limit: int = 10) -> DataFrame:
    """Files like one: its beginning is the query, hits in itself are dropped."""
    return others(search(chunks, index, beginning(content), limit=max(limit + 5, 20)), file, limit)


def changed_files(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose content isn't the one known by (path, hash), paths that are gone)."""
    now = files.withColumn("hash", content_hash(F.col("content")))
    new = saved(now.select("path", "hash").join(known.select("path", "hash"), ["path", "hash"], "left_anti"), "new")  # texts stay where they are
    return now.join(new, ["path", "hash"], "left_semi"), known.select("path").join(now.select("path"), "path", "left_anti")


def reindex(chunks: DataFrame, files: DataFrame, functions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, known) after chunking only what changed and dropping what is gone."""
    new, gone = changed_files(files, known)
    fresh = numbered(chunk_files(new, functions.join(new.select(F.col("path").alias("file")), "file", "left_semi")))
    kept = remove(chunks, gone.select(F.col("path").alias("file")).unionByName(new.select(F.col("path").alias("file"))), ["file"])
    return kept.unionByName(fresh.select(*chunks.columns)), upsert(remove(known, gone, ["path"]), new.select("path", "hash"), ["path"])


def artifact_chunks(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """One chunk for each file of an artifact's globs, keyed by (file, kind) beside its code chunks."""
    from lodestrata.functions.paths import glob_regex

    out = None
    for a in artifacts.collect():  # a registry is a small file
        hit = files.where(F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in a["paths"]) or "^$"))
        rows = hit.select(
            F.col("path").alias("file"), F.col("language").alias("lang"), F.lit("artifact").alias("kind"), F.lit(a["name"]).alias("name"), F.lit(1).alias("start_line"),
            F.size(lines_of(F.col("content"))).alias("end_line"), F.concat(F.lit(f"# {a['name']}\n{a['description'] or ''}\n\n"), "content").alias("content"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out
