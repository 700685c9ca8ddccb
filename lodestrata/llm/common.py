"""What the operators of this subpackage share: the shared folder, shipping of code, connected components and prefix sums."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only in local mode, where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = getattr(work_dir, "own", None) or tempfile.mkdtemp(prefix="lodestrata-")
        work_dir.own = root
    return root.rstrip("/")


#: Rows that a task hands to Python at once while a step is written: whole texts, so fewer than Spark's default.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns a frame that reads it: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(ROWS, int(before)) if int(before) > 0 else ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are written and no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def release(*frames: DataFrame) -> None:
    """Deletes what save() wrote, once nothing lazy refers to it."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="lodestrata-code-"), "lodestrata.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(target)
    sc._lodestrata_shipped = True


#: Edges of a task that writes a round.
EDGES = 50_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node that is reachable.

    Large-star and small-star steps in turn; each round is written to the shared folder, in as many files as its edges
    need (EDGES each at least). Nodes of no edge (or only of a loop) aren't returned. Degrees may be as skewed as they like: minima
    combine before the shuffle and the joins can be split.
    """
    e = save(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    most = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    state = lambda x: x.agg(F.count("*"), F.sum(h)).first()
    mark = state(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        new = save(new.coalesce(min(most, 1 + mark[0] // EDGES)), "edges")  # a round has no more edges than the one before
        now = state(new)
        release(e)
        e = new
        if now == mark:
            break
        mark = now
    root = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(root)


def ranged(df: DataFrame, order: list[Column], weight: Column) -> tuple[DataFrame, DataFrame]:
    """Global prefix sums without a global window.

    df, dealt out by range of the order and written; then totals for each partition (as many rows as partitions), their
    prefix sums, and a running sum inside each partition. Returns the rows with `before` (weight of all rows before) and
    `rank` (rows before), and the totals. The order must be total but for rows that are alike.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, names)], weight.cast("long").alias("_w"))
    rows = save(keyed.repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = rows.groupBy("_part").agg(F.sum("_w").alias("_sum"), F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
    )
    inside = W.partitionBy("_part").orderBy(*names)
    out = (
        rows.withColumn("_r", F.row_number().over(inside))
        .withColumn("_c", F.sum("_w").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(F.broadcast(base), "_part")  # one row for each partition
        .select(*df.columns, (F.col("_sum0") + F.col("_c") - F.col("_w")).alias("before"), (F.col("_n0") + F.col("_r") - 1).alias("rank"))
    )
    return out, totals
