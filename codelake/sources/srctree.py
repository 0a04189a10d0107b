"""Source trees as DataFrames: a batch scan of all files, and a stream of their changes."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from codelake.functions import paths

SCHEMA = "file_path string, size_bytes bigint, modified double, content binary"
CHANGES = "seq bigint, file_path string, op string, ts timestamp"


def walk(root: str) -> Iterator[str]:
    """Paths of the regular files below a folder, hidden folders included, links to folders not followed, in order."""
    for folder, folders, files in os.walk(root):
        folders.sort()
        yield from (os.path.relpath(os.path.join(folder, f), root) for f in sorted(files) if os.path.isfile(os.path.join(folder, f)))


class Batch(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class TreeReader(DataSourceReader):
    """Lists the tree once and deals its files out; contents are read in the tasks."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.most = int(options.get("maxFileBytes", 1 << 30))
        self.parts = int(options.get("numPartitions", 16))

    def partitions(self) -> list[Batch]:
        names = list(walk(self.root))
        return [Batch(names[n :: self.parts]) for n in range(min(self.parts, len(names)))] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for name in partition.names:
            try:
                state = os.stat(full := os.path.join(self.root, name))
                content = None
                if state.st_size <= self.most:
                    with open(full, "rb") as file:
                        content = file.read()
            except OSError:  # gone or unreadable since it was listed
                continue
            yield name, state.st_size, state.st_mtime, content


class ChangeReader(SimpleDataSourceStreamReader):
    """Changes of a tree between listings: created, modified and deleted files, by size and time of change."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def listing(self) -> dict[str, str]:
        found = {}
        for name in walk(self.root):
            try:
                state = os.stat(os.path.join(self.root, name))
            except OSError:
                continue
            found[name] = f"{state.st_mtime_ns}:{state.st_size}"
        return found

    def initialOffset(self) -> dict:
        return {"seq": 0, "files": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import datetime

        old, new, seq, now = start["files"], self.listing(), start["seq"], datetime.datetime.now()
        rows = []
        for name in sorted(old.keys() | new.keys()):
            op = "deleted" if name not in new else "created" if name not in old else "modified" if old[name] != new[name] else None
            if op:
                seq += 1
                rows.append((seq, name, op, now))
        return iter(rows), {"seq": seq, "files": new}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        import datetime

        seq, now = start["seq"], datetime.datetime.now()
        for name in sorted(start["files"].keys() | end["files"].keys()):
            before, after = start["files"].get(name), end["files"].get(name)
            if before != after:
                seq += 1
                yield seq, name, "deleted" if after is None else "created" if before is None else "modified", now


class SourceTree(DataSource):
    """``spark.read.format("srctree").load(folder)`` and, for changes, ``spark.readStream.format("srctree")``."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return CHANGES if self.options.get("changes") == "true" else SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def read_tree(spark: SparkSession, root: str, repo_name: str, patterns: tuple[str, ...] = (), max_bytes: int = 500_000) -> DataFrame:
    """Indexable files of a tree in the shape of the files table; .gitignore at its top is honoured, texts that are not UTF-8 are null."""
    spark.dataSource.register(SourceTree)
    ignore = os.path.join(root, ".gitignore")
    lines = open(ignore, encoding="utf-8", errors="ignore").read().splitlines() if os.path.isfile(ignore) else []
    files = spark.read.format("srctree").option("maxFileBytes", max_bytes).load(root)
    path = F.col("file_path")
    text = F.when(F.is_valid_utf8("content"), F.col("content").cast("string"))
    return files.where(paths.indexable(path, F.col("size_bytes"), patterns, lines, max_bytes)).select(
        F.lit(repo_name).alias("repo_name"), "file_path", paths.language(path).alias("language"), "size_bytes", F.sha2("content", 256).alias("content_hash"), text.alias("content")
    )
