"""Event-time windows over a stream of events, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over Parquet files of events."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hopping(events: DataFrame, length: str = "6 hours", hop: str = "2 hours", late: str = "1 day") -> DataFrame:
    """event_type, start, n, mean, peak per hopping window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", length, hop).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "mean", "peak")


def sessions(events: DataFrame, gap: str = "3 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, finish, n per session."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
