"""Archiving a growing folder: each micro-batch of new files becomes batches of the archive.

An addition, not something that a bounded archive has. A micro-batch that is run again after a failure
overwrites its own folder, so that every file is archived once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.archive import pack_files, unpack

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def archive_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, max_files: int = 256) -> StreamingQuery:
    """Archives files as they appear; each micro-batch goes to path/part=<number>."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files).load(folder)

    def keep(batch: DataFrame, number: int) -> None:
        named = batch.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
        order = named.select("name").withColumn("file_ordinal", F.row_number().over(Window.orderBy("name")) - 1)
        if not batch.isEmpty():
            pack_files(named.join(order, "name"), f"{path}/part={number}", max_files)

    return files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unpack_parts(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    out = None
    for n in parts:
        one = unpack(spark, f"{path}/part={n}")
        out = one if out is None else out.union(one)
    return out


def windowed_profile(events: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, low, high and mean of `value` by event type and window, for batch or streaming events."""
    bounded = events.withWatermark(time, late) if events.isStreaming else events
    out = bounded.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "low", "high", "mean")
