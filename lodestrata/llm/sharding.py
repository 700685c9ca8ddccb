"""Contiguous shards of near equal bytes, from global prefix sums of sizes.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together and yet a text that a third of all rows
share spreads over many tasks. Totals of each range partition give global prefix sums; cuts at equal targets give the
shards. A cut that falls inside a small group of equal texts moves to the nearer edge of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ranged, save, table

SHARDS = 16
#: Groups of at most this share of a shard aren't cut.
WHOLE = 0.01


def shard(docs: DataFrame, shards: int = SHARDS, whole: float = WHOLE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs (doc_id long, text string).

    size: UTF-8 bytes of the text and 1; a null text has no bytes. slot numbers a shard's rows from 0 in the order of
    the shards. Rows that repeat are placed each, in any order among themselves; a row without a doc_id comes before
    others of its text. An empty table gives no rows. Other columns are ignored.
    """
    binary = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(binary) + 1).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.xxhash64(binary).alias("group"),
    )
    placed, totals = ranged(rows, [F.col("group"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.col("size"))
    placed = save(placed, "placed")
    total = totals.agg(F.sum("_sum")).first()[0] or 0
    cuts = [total * k // shards for k in range(1, shards)]  # no more numbers than shards from here on
    over = F.array(*[F.lit(c).cast("long") for c in cuts])
    hit = placed.select("group", "before", "size").where(F.exists(over, lambda c: (c > F.col("before")) & (c < F.col("before") + F.col("size"))) | F.array_contains(over, F.col("before")))
    groups = [r[0] for r in hit.select("group").distinct().collect()]
    if groups:
        edges = placed.where(F.col("group").isin(groups)).groupBy("group").agg(F.min("before").alias("a"), F.max(F.col("before") + F.col("size")).alias("b")).collect()
        for a, b in ((r.a, r.b) for r in edges):
            if b - a <= whole * total / shards:
                cuts = [(a if c - a <= b - c else b) if a < c < b else c for c in cuts]
    # A row over a cut goes to the side that holds its middle.
    number = sum((F.when(2 * F.col("before") + F.col("size") >= F.lit(2 * c).cast("long"), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", number.cast("int"))
    first = {r.shard: r.n for r in placed.groupBy("shard").agg(F.min("rank").alias("n")).collect()}
    base = F.element_at(F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - base).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
