"""Activity over event time; the same plan runs on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder, so many in a batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path)


def windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values by window and kind; rows later than the watermark are dropped from streams only. Null times are in no window."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
