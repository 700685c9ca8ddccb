"""Snapshots and drift, pins, notes and their links, sessions, and deltas of scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.search import cosine

EDGE_KINDS = ("relates_to", "supersedes", "caused_by", "blocks", "references")


def hot_functions(functions: DataFrame, least: int = 8, limit: int = 50) -> DataFrame:
    """One row: the functions that a snapshot keeps."""
    top = functions.where(F.col("cyclomatic") >= least).orderBy(F.desc("cyclomatic"), "file", "name").limit(limit)
    return top.agg(F.collect_list(F.struct("file", "name", "cyclomatic")).alias("hot_functions"))


def as_of(snapshots: DataFrame, ts: Column) -> DataFrame:
    """The last snapshot at or before a time; no row if there is none."""
    rest = [c for c in snapshots.columns if c != "ts"]
    best = snapshots.where(F.col("ts") <= ts).agg(F.max_by(F.struct(*rest, "ts"), F.struct("ts", "id")).alias("s"))
    return best.where("s IS NOT NULL").select("s.*").select(*snapshots.columns)


def as_of_join(probes: DataFrame, history: DataFrame, key: str, ts: str, value: str, unit: str = "day") -> DataFrame:
    """probes with the last value that isn't null of history (key, ts, value) at or before each. A key's time is cut into
    units (as date_trunc names them): rows are sorted by key and unit, so no task has a key's whole history, and a unit
    begins with the last value of those before it, from one row for each key and unit."""
    from pyspark.sql.window import Window as W

    rest = [c for c in probes.columns if c not in (key, ts)]
    kind = history.schema[value].dataType
    past = history.where(F.col(value).isNotNull()).select(key, ts, F.lit(0).alias("_p"), F.col(value).alias("_v"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest])
    both = probes.select(key, ts, F.lit(1).alias("_p"), F.lit(None).cast(kind).alias("_v"), *rest).unionByName(past).withColumn("_u", F.date_trunc(unit, ts))
    unit_end = both.groupBy(key, "_u").agg(F.max_by("_v", F.when(F.col("_p") == 0, F.col(ts))).alias("_e"))
    before = unit_end.select(F.col(key).alias("_k"), F.col("_u").alias("_b"), F.last("_e", ignorenulls=True).over(W.partitionBy(key).orderBy("_u").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    inside = F.last("_v", ignorenulls=True).over(W.partitionBy(key, "_u").orderBy(ts, "_p").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = both.withColumn("_v", inside).where("_p = 1")
    out = placed.join(before, placed[key].eqNullSafe(F.col("_k")) & placed["_u"].eqNullSafe(F.col("_b")), "left")
    return out.select(key, ts, *rest, F.coalesce("_v", "_c").alias(value))


def drift(baseline: DataFrame, latest: DataFrame) -> dict[str, DataFrame]:
    """Score changes, and hot functions that are new, gone or worse. Each side is one snapshot."""
    axes = ("score", "complexity", "acyclicity", "dead_code", "coupling")
    b = baseline.select(*[F.col(a).alias(f"_{a}") for a in axes])
    scores = latest.select(*axes).crossJoin(b).select(*[(F.col(a) - F.col(f"_{a}")).alias(f"{a}_delta") for a in axes])  # one row each
    flat = lambda s, n: s.select(F.explode("hot_functions").alias("h")).select("h.file", "h.name", F.col("h.cyclomatic").alias(n)).groupBy("file", "name").agg(F.max(n).alias(n))
    return {"scores": scores, "functions": hot_drift(flat(baseline, "before"), flat(latest, "after"))}


def hot_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """before (file, name, before) against after (file, name, after): (file, name, before, after, change)."""
    both = before.join(after, ["file", "name"], "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "disappeared").when(F.col("after") > F.col("before"), "worsened")
    return both.withColumn("change", change).where("change IS NOT NULL")


def live_pins(pins: DataFrame, now: datetime | Column, scope: str | None = None) -> DataFrame:
    now = now if isinstance(now, Column) else F.lit(now)
    out = pins.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    out = out.where(F.col("scope") == scope) if scope else out
    return out.orderBy(F.desc("created_at"), "id")


def list_notes(notes: DataFrame, scope: str | None = None, kind: str | None = None, since: datetime | None = None, limit: int = 50) -> DataFrame:
    for c, v in (("scope", scope), ("kind", kind)):
        notes = notes.where(F.col(c) == v) if v is not None else notes
    notes = notes.where(F.col("created_at") >= F.lit(since)) if since else notes
    return notes.orderBy(F.desc("created_at"), "id").limit(limit)


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def recall(notes: DataFrame, query: str, scope: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Notes by the share of the query's words that they have; the newest where the query has none."""
    for c, v in (("scope", scope), ("kind", kind)):
        notes = notes.where(F.col(c) == v) if v is not None else notes
    q = words(F.lit(query))
    score = F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.col("content")))) / F.size(q))
    scored = notes.withColumn("score", score).where("score IS NULL OR score > 0")
    return scored.orderBy(F.desc_nulls_last("score"), F.desc("created_at"), "id").limit(limit)


def recall_dense(notes: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    return notes.withColumn("score", cosine(F.col("embedding"), query)).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(limit)


def recall_best(notes: DataFrame, query: str, vector: list[float] | None = None, limit: int = 20) -> tuple[str, DataFrame]:
    """(mode, notes): by vectors if there is one and it finds anything, else by words."""
    if vector:
        found = recall_dense(notes, vector, limit)
        if not found.isEmpty():
            return "dense", found
    return "lexical", recall(notes, query, limit=limit)


def link(edges: DataFrame, from_id: int, to_id: int, kind: str) -> DataFrame:
    """edges with one more; a link that is there stays one."""
    if kind not in EDGE_KINDS:
        raise ValueError(f"no kind of link: {kind!r}; known: {', '.join(EDGE_KINDS)}")
    return edges.unionByName(edges.sparkSession.createDataFrame([(from_id, to_id, kind)], edges.schema)).dropDuplicates(["from_id", "to_id", "kind"])


def note_links(edges: DataFrame, id_: int, direction: str = "both") -> DataFrame:
    out = edges.where(F.col("from_id") == id_).select(F.lit("out").alias("direction"), F.col("to_id").alias("other"), "kind")
    into = edges.where(F.col("to_id") == id_).select(F.lit("in").alias("direction"), F.col("from_id").alias("other"), "kind")
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def session_summary(notes: DataFrame, session_id: str | None = None) -> DataFrame:
    notes = notes if session_id is None else notes.where(F.col("session_id") == session_id)
    return notes.groupBy("kind").agg(F.count("*").alias("n"))


def scan_delta(known: DataFrame, now: DataFrame, full_scan: bool = True) -> DataFrame:
    """(path, change) of now (path, hash) against known: added, changed or removed. Without full_scan, paths that now
    doesn't have are left alone; a null hash in now stands for a path that was deleted."""
    both = known.select("path", F.col("hash").alias("old"), F.lit(True).alias("was")).join(now.select("path", F.col("hash").alias("new"), F.lit(True).alias("seen")), "path", "full_outer")
    change = (
        F.when(F.col("seen").isNull(), F.when(F.lit(full_scan), "removed")).when(F.col("new").isNull(), F.when(F.col("was"), "removed"))
        .when(F.col("was").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return both.withColumn("change", change).where("change IS NOT NULL").select("path", "change", F.col("new").alias("hash"))


def commit_delta(known: DataFrame, delta: DataFrame) -> DataFrame:
    kept = known.select("path", "hash").join(delta.select("path"), "path", "left_anti")
    return kept.unionByName(delta.where("change <> 'removed'").select("path", "hash"))
