"""Tables in the shared folder: cut lineage, upserts by key, and appends."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What is added to the name of a table that is being replaced.
BEFORE = ".before"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only in local mode, where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lodestrata-")
        shared_dir.own = root
    return root.rstrip("/")


#: Steps that this driver has written and not deleted yet.
STEPS: list[str] = []


def saved(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """df written (options: the writer's) and read again: what follows doesn't depend on executors that may be lost. discard() deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    STEPS.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what saved() wrote for these frames, once nothing lazy reads it, and lets Spark delete shuffles that no frame
    refers to any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._step)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        STEPS.remove(df._step)
    if frames:
        gc.collect()
        frames[0].sparkSession._jvm.System.gc()


def discard(spark: SparkSession) -> None:
    """Deletes the steps that were written so far, once no frame that is still wanted reads them."""
    h = spark._jvm.org.apache.hadoop.fs.Path
    while STEPS:
        path = h(STEPS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or table is there. A table whose replacement broke off between its two renames is put back first."""
    h = spark._jvm.org.apache.hadoop.fs.Path
    fs = h(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(h(path)) or fs.exists(h(f"{path}{BEFORE}")) and fs.rename(h(f"{path}{BEFORE}"), h(path))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new version of a table that df may read to a side folder, puts the old one aside and the new one in its
    place. At each moment one whole version is there: exists() finds the old one if a driver is lost in between."""
    spark = df.sparkSession
    new = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    h = spark._jvm.org.apache.hadoop.fs.Path
    fs = h(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = h(f"{path}{BEFORE}")
    if exists(spark, path):
        fs.delete(old, True)
        fs.rename(h(path), old)
    fs.rename(h(new), h(path))
    fs.delete(old, True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new: delete by key and insert."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def last_of_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last in order: insert or replace."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
