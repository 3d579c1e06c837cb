"""A data source that walks a folder's metadata: ``spark.read.format("treeline_scan").option("path", ...)``.

One partition for each entry of the top level, so subtrees are walked side by side; links are never followed and no
content is read. An unreadable folder gives a row with an error instead of ending the scan.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.store import ship

SCHEMA = (
    "relative_path string, parent_path string, name string, extension string, entry_type string, logical_bytes long, modified_ns long, accessed_ns long, "
    "attributes long, depth int, observation_status string, error string"
)


class _Subtree(InputPartition):
    def __init__(self, relative: str) -> None:
        self.relative = relative


def suffix(name: str) -> str:
    """As :func:`treeline.functions.paths.suffix`."""
    stem, dot, end = name.rpartition(".")
    return f".{end}" if dot and stem and end else ""


def observe(root: str, relative: str) -> tuple:
    """One entry's row; its type is that of the entry itself, not of what a link points to."""
    parent, _, name = relative.rpartition("/")
    depth = relative.count("/") + 1
    try:
        s = os.lstat(os.path.join(root, relative))
    except OSError as e:
        return relative, parent or None, name, suffix(name), "OTHER", 0, None, None, 0, depth, "ERROR", type(e).__name__
    kind = "OTHER"
    if stat.S_ISLNK(s.st_mode):
        kind = "SYMLINK_DIRECTORY" if os.path.isdir(os.path.join(root, relative)) else "SYMLINK"
    elif stat.S_ISDIR(s.st_mode):
        kind = "DIRECTORY"
    elif stat.S_ISREG(s.st_mode):
        kind = "FILE"
    size = s.st_size if kind == "FILE" else 0
    return relative, parent or None, name, suffix(name) if kind != "DIRECTORY" else "", kind, size, s.st_mtime_ns, s.st_atime_ns, 0, depth, "OBSERVED", None


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [_Subtree(n) for n in sorted(os.listdir(self.root))] or [_Subtree("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.relative] if partition.relative else []
        while todo:
            relative = todo.pop()
            row = observe(self.root, relative)
            if row[4] == "DIRECTORY":
                try:
                    todo += [f"{relative}/{n}" for n in sorted(os.listdir(os.path.join(self.root, relative)), reverse=True)]
                except OSError as e:
                    row = (*row[:-2], "ERROR", type(e).__name__)
            yield row


class ScanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeline_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = self.options.get("path")
        if not path or not os.path.isdir(path):
            raise ValueError("the option path must name a folder")
        return _Reader(os.path.realpath(path))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every entry below ``path``."""
    ship(spark)
    spark.dataSource.register(ScanSource)
    return spark.read.format("treeline_scan").option("path", path).load()


def split(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(directories, files, errors) of a scan; links and other entries are with the files."""
    return entries.where("entry_type = 'DIRECTORY'"), entries.where("entry_type <> 'DIRECTORY'"), entries.where("error IS NOT NULL").selectExpr("relative_path", "'enumerate' AS operation", "error AS error_type")


def scale_corpus(spark: SparkSession, entries: int, shards: int) -> DataFrame:
    """The inventory of a synthetic corpus of empty files in equal shards, at any size."""
    if not 1 <= shards <= min(10_000, entries):
        raise ValueError("shards must be from 1 to 10000 and not more than entries")
    per = -(-entries // shards)
    path = f"format_string('shard-%04d/item-%012d.dat', id div {per}, id)"
    return spark.range(entries).selectExpr(f"{path} AS relative_path", "0L AS logical_bytes")
