"""Session factory: UTC, adaptive execution, shuffle partitions by cores unless told otherwise."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lodestrata", **conf: str) -> SparkSession:
    """The active session, or a local one. Keyword names have _ for the dots of Spark's settings."""
    cores = os.cpu_count() or 1
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.shuffle.partitions": str(max(8, cores)),
    }
    settings |= {k.replace("_", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if SparkSession.getActiveSession() is None and "spark.master" not in settings:
        builder = builder.master(f"local[{cores}]")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
