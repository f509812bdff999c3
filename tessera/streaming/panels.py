"""The user-day panel from a stream of events: the same aggregation, by event time, with late rows dropped after a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def user_days(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """``entity_id, day, n_events, target_source, avg_value``: a row per user and day, final once the watermark has passed the day."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("_day"), F.col("user_id").cast("string").alias("entity_id"))
        .agg(
            F.count(F.lit(1)).alias("n_events"), (F.count_if(F.col("event_type") == "error") * 100.0 / F.count(F.lit(1))).alias("target_source"), F.avg("value").alias("avg_value"),
        )
        .select("entity_id", F.col("_day.start").cast("date").alias("day"), "n_events", "target_source", "avg_value")
    )


def append_available(days: DataFrame, path: str, checkpoint: str) -> None:
    """Append the days that are final to a Parquet table, with all input that is there now; a later call goes on from the checkpoint."""
    days.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
