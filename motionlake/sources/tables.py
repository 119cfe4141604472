"""Parquet tables, and the views that trajectory and vector queries read (FIXTURES.md section 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import split_of


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discover(spark: SparkSession, pattern: str, limit: int | None = None) -> list[str]:
    """Paths that a glob matches in any file system Spark reads, in lexicographic order, the first `limit` of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])[:limit]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario_id, track_id, is_ego, t, valid, x, y, vx, vy: one row per track and frame."""
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    scenario, track = F.expr("user_id div 5"), F.col("user_id") % 5
    part = F.col("value") % F.lit(10.0)
    return events.select(
        scenario.alias("scenario_id"), track.alias("track_id"), (scenario % 5 == track).alias("is_ego"), t.alias("t"), (F.col("event_type") != "error").alias("valid"),
        part.alias("part"), "event_id",
    ).select(
        "scenario_id", "track_id", "is_ego", "t", "valid",
        (F.lit(12.0) * F.col("track_id") + F.lit(0.9) * F.col("t") + F.lit(0.6) * F.col("part")).alias("x"),
        (F.lit(0.2) * ((F.col("event_id") % 11) - 5)).alias("y"),
        (F.lit(6.0) + F.lit(0.5) * F.col("part")).alias("vx"),
        (F.lit(0.1) * ((F.col("event_id") % 7) - 3)).alias("vy"),
    )


def vectors(spark: SparkSession, sf_dir: str, policy: Column | None = None) -> DataFrame:
    """row_index, embedding, label, policy_id, source_index, split."""
    table = load(spark, sf_dir, "embeddings")
    return table.select(
        F.col("vec_id").alias("row_index"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("bigint").alias("label"),
        (F.col("label") % 3 if policy is None else policy).cast("bigint").alias("policy_id"), F.expr("vec_id div 3").alias("source_index"), split_of(F.col("vec_id")).alias("split"),
    )


def nested_to_tracks(records: DataFrame) -> DataFrame:
    """Scenario records (scenario_id, sdc_track_index, tracks[].states[]) as track rows; invalid records go."""
    good = records.where(valid_record(F.col("tracks"), F.col("sdc_track_index")))
    track = good.select("scenario_id", "sdc_track_index", F.posexplode("tracks").alias("track_id", "track"))
    state = track.select("scenario_id", F.col("track_id").cast("bigint").alias("track_id"), (F.col("track_id") == F.col("sdc_track_index")).alias("is_ego"), F.posexplode("track.states").alias("t", "s"))
    return state.select("scenario_id", "track_id", "is_ego", F.col("t").cast("bigint").alias("t"), F.col("s.valid").alias("valid"), F.col("s.center_x").alias("x"), F.col("s.center_y").alias("y"), F.col("s.velocity_x").alias("vx"), F.col("s.velocity_y").alias("vy"))


def valid_record(tracks_column: Column, ego_index: Column) -> Column:
    return F.coalesce((F.size(tracks_column) > 0) & ego_index.between(0, F.size(tracks_column) - 1), F.lit(False))
