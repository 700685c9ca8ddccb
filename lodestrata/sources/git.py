"""Git history as Spark data sources (format git_log and git_diff): the git command is the reader."""

from __future__ import annotations

import subprocess
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
STATUSES = {"A": "added", "M": "modified", "D": "deleted", "T": "modified"}


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=600).stdout.decode(errors="replace")


class _LogReader(DataSourceReader):
    """Each partition reads a stretch of the commits."""

    def __init__(self, options):
        self.root, self.size, self.rev = options["path"], int(options.get("commits_per_partition", 5000)), options.get("rev", "HEAD")

    def partitions(self):
        try:
            n = int(_git(self.root, "rev-list", "--count", self.rev))
        except subprocess.CalledProcessError:
            n = 0
        return [InputPartition(i) for i in range(0, n, self.size)] or [InputPartition(-1)]

    def read(self, partition):
        if partition.value < 0:
            return
        out = _git(
            self.root, "log", self.rev, "--date-order", f"--skip={partition.value}", f"-n{self.size}", "--diff-merges=first-parent", "--no-renames", "--name-only", "-z", "--format=%x01%H%x02%an%x02%ct"
        )
        for block in out.split("\x01")[1:]:
            head, _, names = block.partition("\0")
            head, nl, first = head.partition("\n")
            commit, author, at = head.split("\x02")
            ts = datetime.fromtimestamp(int(at), tz=timezone.utc).replace(tzinfo=None)
            for p in [first, *names.split("\0")] if nl else names.split("\0"):
                if p := p.strip("\n"):
                    yield commit, p, author, ts


class GitLog(DataSource):
    """(commit, path, author, ts): a row for each path of each commit against its first parent."""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return "commit string, path string, author string, ts timestamp_ntz"

    def reader(self, schema):
        return _LogReader(self.options)


class _DiffReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.base, self.head = options["path"], options.get("base"), options.get("head", "HEAD")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        base = self.base
        if not base:
            try:
                base = _git(self.root, "rev-parse", f"{self.head}^").strip()
            except subprocess.CalledProcessError:
                base = EMPTY_TREE
        status = _git(self.root, "diff", "--no-renames", "--name-status", "-z", base, self.head).split("\0")
        kinds = dict(zip(status[1::2], status[0::2]))
        for row in _git(self.root, "diff", "--no-renames", "--numstat", "-z", base, self.head).split("\0"):
            if row:
                plus, minus, path = row.split("\t", 2)
                yield path, None, STATUSES.get(kinds.get(path, "M")[0], "modified"), 0 if plus == "-" else int(plus), 0 if minus == "-" else int(minus)


class GitDiff(DataSource):
    """(path, old_path, status, additions, deletions) of head against base (its first parent unless given). Renames
    are a deletion and an addition."""

    @classmethod
    def name(cls):
        return "git_diff"

    def schema(self):
        return "path string, old_path string, status string, additions long, deletions long"

    def reader(self, schema):
        return _DiffReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitDiff)


def log(spark: SparkSession, root: str):
    register(spark)
    return spark.read.format("git_log").load(root)


def diff(spark: SparkSession, root: str, base: str | None = None, head: str = "HEAD"):
    register(spark)
    r = spark.read.format("git_diff").option("head", head)
    return (r.option("base", base) if base else r).load(root)
