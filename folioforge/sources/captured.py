"""Captured payloads: the offline form of a connector, as files that Spark reads itself.

A capture folder holds one JSON payload a line under ``source_id=<id>/day=<yyyy-mm-dd>/``, on any file system
that Spark knows.  Filters on source and day choose folders, large files are read in splits, and the same
folder is a stream whose offsets a checkpoint keeps.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import RAW_ITEM

_QUERY = RAW_ITEM.split("query ", 1)[1]
_LINES = "value string, source_id string, day date"


def _items(lines: DataFrame, seq: Column) -> DataFrame:
    """Raw items with their day."""
    no_query = F.expr(f"cast(null as {_QUERY})")
    return lines.where(F.trim("value") != "").select("source_id", seq.alias("seq"), F.trim("value").alias("payload"), no_query.alias("query"), "day")


def read_captured(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """Raw items (source_id, seq, payload, query) and their day.  ``only``: a condition on source_id and day that
    chooses folders before any is read (numbers for seq stand between a later filter and the folders).  seq orders
    the items of a file as they stand in it; it is the line's place in its split and the split's in the read, so it
    has gaps but no ties."""
    lines = spark.read.schema(_LINES).option("basePath", path).text(path)
    return _items(lines if only is None else lines.where(only), F.monotonically_increasing_id())


def stream_captured(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The same items as files come in: (source_id, payload, query, day) without an order."""
    lines = spark.readStream.schema(_LINES).option("basePath", path).option("maxFilesPerTrigger", files_per_trigger).text(path)
    return _items(lines, F.lit(None).cast("bigint")).drop("seq")


def write_captured(items: DataFrame, path: str, day: Column) -> None:
    """Adds raw items to a capture folder, a file a task, source and day."""
    rows = items.select(F.col("payload").alias("value"), "source_id", day.cast("date").alias("day"))
    rows.write.mode("append").partitionBy("source_id", "day").text(path)


class CapturedPartition(InputPartition):
    def __init__(self, source_id: str, path: str, first: int):
        super().__init__((source_id, path))
        self.source_id, self.path, self.first = source_id, path, first


class CapturedReader(DataSourceReader):
    def __init__(self, path: str, only: str | None):
        self.path, self.only = path, only

    def partitions(self) -> list[CapturedPartition]:
        out = []
        for source in sorted(os.listdir(self.path)):
            folder = os.path.join(self.path, source)
            if os.path.isdir(folder) and self.only in (None, source):
                out += [CapturedPartition(source, os.path.join(folder, n), i << 32) for i, n in enumerate(sorted(os.listdir(folder)))]
        return out

    def read(self, partition: CapturedPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                if line.strip():
                    yield partition.source_id, partition.first + i, line.strip(), None


class CapturedSource(DataSource):
    """The format ``captured`` for folders named by source_id alone, on a mount that all machines share."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return RAW_ITEM

    def reader(self, schema) -> CapturedReader:
        return CapturedReader(self.options["path"], self.options.get("source"))
