"""Incremental ingestion and windows with Structured Streaming; every stream gives the batch result once it has run dry."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one only where it is unset."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='plantlens-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """A stream of the files under path with a watermark; timestamps without a zone are taken in the session's zone."""
    schema = spark.read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # a pattern may stand for one file as well as for a folder
    return spark.readStream.schema(schema).parquet(either).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions by user: a new one begins after `gap` without an event."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("started"), "n_events", "total")


def windows(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Counts and totals by window and type; with slide, windows overlap."""
    grouped = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def run_dry(result: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and reads back its last state."""
    spark = result.sparkSession
    out, schema = work_folder(spark, name), result.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:08d}")

    # complete output: the last batch holds the whole result
    stream = result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    stream.awaitTermination()
    last = (stream.lastProgress or {}).get("batchId", 0)
    return spark.read.schema(schema).parquet(f"{out}/{last:08d}")


def run_sessions(spark: SparkSession, path: str, gap: str) -> DataFrame:
    return run_dry(sessions(event_stream(spark, path), gap), "sessions")


def run_windows(spark: SparkSession, path: str, width: str) -> DataFrame:
    return run_dry(windows(event_stream(spark, path), width), "windows")


def ingest_files(spark: SparkSession, folder: str, out: str, decode: Callable[[DataFrame], DataFrame]) -> int:
    """Decodes the new files of a folder and appends the rows to out; returns the rows that out then has.

    Files that were taken in before are not read again, by the stream's own log beside out.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    query = files.writeStream.foreachBatch(lambda batch, _: decode(batch).write.mode("append").parquet(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).count()
