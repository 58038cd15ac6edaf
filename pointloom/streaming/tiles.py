"""Streams of points: tiles processed as files arrive, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tile_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """Point files of a folder as a stream, so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def process_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a step to each batch and write it, once: a batch goes to a folder of its number, which a retry overwrites."""

    def write(df: DataFrame, number: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_windows(points: DataFrame, width: str = "30 days", late: str = "7 days") -> DataFrame:
    """Points and files per window of ingestion, rows later than the watermark left out of closed windows.

    On a batch frame the watermark has no effect and every row counts.
    """
    df = points.withWatermark("ingested_at", late) if points.isStreaming else points
    return df.where("ingested_at IS NOT NULL").groupBy(F.window("ingested_at", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("file_id").alias("files")).select(F.col("w.start").alias("start"), "n", "files")


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions of a key: runs of rows no more than ``gap`` apart, on a stream or a table."""
    w = F.session_window(time, gap)
    return df.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
