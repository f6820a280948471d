"""Event-time analytics over log streams; the same functions take tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    w = timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    w = timed(events, late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    w = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("user_id", F.col("w.start").alias("start"), "n", "total")


def stream_tumbling(spark: SparkSession, source: str, checkpoint: str, sink: str, size: str = "1 day", late: str = "1 hour") -> None:
    """Windows that the watermark closes are appended to ``sink``; later rows for them are dropped."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = tumbling(events, size, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()
