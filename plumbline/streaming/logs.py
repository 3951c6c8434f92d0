"""Incremental jobs: the correction log, job states, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.corpus import pending_corrections
from plumbline.sources.records import CORRECTION_DDL


def correction_stream(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """The log as a stream, each correction once within the delay."""
    rows = spark.readStream.schema(CORRECTION_DDL).json(path)
    return rows.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["correction_id"])


def pending_sink(stream: DataFrame, promotions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is pending at the time of each batch. A batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        pending_corrections(batch, promotions).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame) -> DataFrame:
    """The latest status of each job (update mode in a stream)."""
    return events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def windowed_counts(events: DataFrame, size: str, *keys: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events for each window and key; late ones beyond the delay are left out in a stream."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
