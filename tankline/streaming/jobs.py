"""T: file drops and event streams with the same results as the batch functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a stream gives for the input that is there now, as a table."""
    folder = shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_counts(stream: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts that only rise, for the input that is there now: each micro-batch gives on those that changed, the largest of a key holds."""
    folder = shared_folder(stream.sparkSession)
    query = (
        stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
    return found.groupBy(*keys).agg(F.max(count).alias(count))


def ingest_files(spark: SparkSession, folder: str, step: Callable[[DataFrame], None], state: str, pattern: str = "*.csv"):
    """Whole files as they arrive, each micro-batch handed to the batch ingest (whose hashes and keys make repeats
    harmless); late files need no watermark, as rows are keyed by their own day."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return rows.writeStream.foreachBatch(lambda batch, _: step(batch)).option("checkpointLocation", state).trigger(availableNow=True).start()


def daily_calls(events: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Calls of each key and UTC day; state of a day lives until the watermark has passed it."""
    day = F.window(at, "1 day")
    return events.withWatermark(at, late).groupBy(day, *keys).agg(F.count("*").alias("calls")).select(F.to_date("window.start").alias("day"), *keys, "calls")


def first_within(events: DataFrame, keys: list[str], at: str, ttl: str = "30 days") -> DataFrame:
    """T5: a key's first event, without waiting for order; its state lives until the watermark passes the time to live, then the key is new again."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)
