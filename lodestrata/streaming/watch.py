"""Changes of a source tree as a stream: relevance, debouncing, change detection by content hash, incremental indexing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.functions.paths import is_watched, language
from lodestrata.functions.scores import content_hash
from lodestrata.operators import search
from lodestrata.operators.segments import Index
from lodestrata.storage import forget, saved

EVENTS = "project string, path string, hash string, ts timestamp"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, length) of the files below root: what a store tells without reading them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.col("modificationTime").alias("modified"), "length")


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, modified, gone): files of one listing that the other hasn't, or has with another time or length."""
    now = new.select("path", F.col("modified").alias("m"), F.col("length").alias("n"))
    both = old.join(now, "path", "full_outer")
    same = (F.col("modified") == F.col("m")) & (F.col("length") == F.col("n"))
    return both.where(~F.coalesce(same, F.lit(False))).select("path", F.col("m").alias("modified"), F.col("m").isNull().alias("gone"))


def observe(spark: SparkSession, root: str, project: str, store: str) -> int:
    """Lists the files below root once, and writes EVENTS of what differs from the listing before: new and changed files
    with the hash of their content, files that are gone with none. Returns the number of listings so far.

    Below store, listings/<n> is the n-th listing and events/<n> its difference to the one before. A listing counts once it
    is whole, and its events follow from it, so a driver that is lost in between writes them when it comes back. Contents
    are read only of files as new as the oldest changed one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda folder: [int(f.getPath().getName()) for f in fs.listStatus(path(f"{store}/{folder}")) if f.getPath().getName().isdigit()] if fs.exists(path(f"{store}/{folder}")) else []

    def put(df: DataFrame, name: str) -> None:
        aside = f"{store}/.{uuid.uuid4().hex}"
        df.write.parquet(aside)
        fs.mkdirs(path(f"{store}/{name}").getParent())
        fs.rename(path(aside), path(f"{store}/{name}"))

    n = max(there("listings"), default=0)
    if n == max(there("events"), default=0):  # else the last listing still waits for its events
        n += 1
        put(listing(spark, root).coalesce(64), f"listings/{n}")
    known = "path string, modified timestamp, length long"
    old = spark.read.schema(known).parquet(f"{store}/listings/{n - 1}") if n > 1 else spark.createDataFrame([], known)
    found = saved(listing_changes(old, spark.read.schema(known).parquet(f"{store}/listings/{n}")), "found")
    since = found.agg(F.min("modified")).first()[0]
    gone = found.where("gone").select("path", F.lit(None).cast("string").alias("hash"), F.current_timestamp().alias("ts"))
    events = gone
    if since is not None:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("modificationTime") >= F.lit(since))
        read = raw.select("path", content_hash(F.col("content"), 16).alias("hash"), F.col("modificationTime").alias("ts"))
        events = events.unionByName(read.join(found.where("NOT gone").select("path"), "path", "left_semi"))
    put(events.select(F.lit(project).alias("project"), "path", "hash", "ts"), f"events/{n}")
    return n


def observed(spark: SparkSession, store: str) -> DataFrame:
    """The stream of what observe() has written and will write."""
    spark._jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/events"))
    return spark.readStream.schema(EVENTS).parquet(f"{store}/events/*")


def watch_tree(spark: SparkSession, root: str, project: str, store: str, every: str = "30 seconds"):
    """A query that observes root at each trigger. Whatever a trigger finds goes to observed()."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: observe(spark, root, project, store)).trigger(processingTime=every).option("checkpointLocation", f"{store}/.ticks").start()


def relevant(events: DataFrame) -> DataFrame:
    return events.where(is_watched(F.col("path")))


def debounce(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of changes of a project, closed by a quiet gap. The watermark is needed to close them at all."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy("project", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("events"), F.collect_set("path").alias("paths")).select(
        "project", F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "events", F.array_sort("paths").alias("paths")
    )


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of a path is its last hash; null stands for a path that is gone."""
    old = state.get[0] if state.exists else None
    out = []
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    for h, ts in zip(rows["hash"], rows["ts"]):
        h = None if pd.isna(h) else h
        if h != old:
            out.append((*key, "added" if old is None else "removed" if h is None else "changed", h, ts))
            old = h
    state.update((old,))
    yield pd.DataFrame(out, columns=["project", "path", "change", "hash", "ts"])


def changes(events: DataFrame) -> DataFrame:
    """(project, path, change, hash, ts) of EVENTS: what differs from the last hash of the path. A batch has no state
    before it: there the last hash is that of the row before."""
    if not events.isStreaming:
        old = F.lag("hash").over(W.partitionBy("project", "path").orderBy("ts"))
        change = F.when(F.col("old").isNull() & F.col("hash").isNotNull(), "added").when(F.col("hash").isNull() & F.col("old").isNotNull(), "removed").when(F.col("hash") != F.col("old"), "changed")
        return events.withColumn("old", old).withColumn("change", change).where("change IS NOT NULL").select("project", "path", "change", "hash", "ts")
    return events.groupBy("project", "path").applyInPandasWithState(
        _changes, "project string, path string, change string, hash string, ts timestamp", "hash string", "append", GroupStateTimeout.NoTimeout
    )


def reindex_batch(root: str, read: Callable[[DataFrame], DataFrame], functions_of: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the index below root up to date: each batch is one commit. read gives (path,
    content) of those of the paths that are there. A batch that runs again changes nothing."""
    def run(batch: DataFrame, number: int) -> None:
        index = Index.open(batch.sparkSession, root)
        if index.batch is not None and number <= index.batch:
            return
        paths = batch.where("change <> 'removed'").select("path").distinct()
        there = saved(read(paths), "read", compression="zstd")  # chunks and hashes are of one reading
        files = there.withColumn("language", language(F.col("path")))
        chunks = search.numbered(search.chunk_files(files, functions_of(files)))
        index.commit(chunks, files.select("path", content_hash(F.col("content"), 16).alias("hash")), batch.select("path").distinct(), embed, number)
        forget(there)

    return run


def languages_batch(seen: Callable[[list[str]], None]) -> Callable[[DataFrame, int], None]:
    """Calls seen with the languages of each batch's changes."""
    def run(batch: DataFrame, _: int) -> None:
        found = [r[0] for r in batch.select(language(F.col("path")).alias("l")).where("l IS NOT NULL").distinct().orderBy("l").collect()]
        if found:
            seen(found)
    return run


def status(query) -> dict:
    """State of a running index stream."""
    p = query.lastProgress
    return {"active": query.isActive, "message": query.status["message"], "rows": p["numInputRows"] if p else 0, "batch": p["batchId"] if p else None}
