"""Streaming forms of the incremental run (extensions: the batch operators remain the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "3 days") -> DataFrame:
    """Rows with keys not seen within the look-back: state is dropped behind the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", slide: str | None = None, late: str = "3 days") -> DataFrame:
    """Counts by tumbling (or sliding) windows of event time."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    timed = stream.withWatermark(time, late) if stream.isStreaming else stream
    return timed.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """Sessions of a key: rows no further apart than the gap."""
    timed = stream.withWatermark(time, late) if stream.isStreaming else stream
    return timed.groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there, then stops: a scheduled run whose offsets the checkpoint keeps."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
