"""Lead selection and frame alignment.

Scenarios are independent, so everything is keyed by scenario_id: one shuffle on (scenario_id, t) for the
join, and its aggregate on (scenario_id, track) combines before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import norm2


def speed_filter(tracks: DataFrame, least: float = 5.5) -> DataFrame:
    """scenario_id, n_frames, min_speed, mean_speed, kept: over all valid ego frames; none means not kept."""
    ego = tracks.where("is_ego")
    speed = F.when(F.col("valid"), norm2(F.col("vx"), F.col("vy")))
    out = ego.groupBy("scenario_id").agg(F.count(speed).alias("n_frames"), F.min(speed).alias("min_speed"), F.avg(speed).alias("mean_speed"))
    return out.withColumn("kept", F.coalesce(F.col("min_speed") >= least, F.lit(False)))


def ego_motion(tracks: DataFrame) -> DataFrame:
    """Ego frames with mx, my: the displacement to the next frame where that is valid, else the velocity."""
    w = Window.partitionBy("scenario_id", "track_id").orderBy("t")
    moved = lambda c, v: F.when(F.coalesce(F.lead("valid").over(w), F.lit(False)), F.lead(c).over(w) - F.col(c)).otherwise(F.col(v))
    return tracks.where("is_ego").withColumns({"mx": moved("x", "vx"), "my": moved("y", "vy")})


def lead_tracks(tracks: DataFrame, reach: float = 100.0, most: float = 999.0) -> DataFrame:
    """scenario_id, front_id, mean_dist, n_frames: the track ahead with the least mean distance, lower ids first."""
    ego = ego_motion(tracks).where("valid").select("scenario_id", "t", F.col("track_id").alias("ego_id"), F.col("x").alias("ex"), F.col("y").alias("ey"), "mx", "my")
    other = tracks.where("valid and not is_ego").select("scenario_id", "t", "track_id", "x", "y")
    rx, ry = F.col("x") - F.col("ex"), F.col("y") - F.col("ey")
    ahead = other.join(ego, ["scenario_id", "t"]).withColumn("d", norm2(rx, ry)).where((rx * F.col("mx") + ry * F.col("my") > 0) & (F.col("d") < reach))
    per = ahead.groupBy("scenario_id", "track_id").agg(F.avg("d").alias("mean_dist"), F.count("*").alias("n_frames")).where(F.col("mean_dist") < most)
    best = per.groupBy("scenario_id").agg(F.min(F.struct("mean_dist", "track_id", "n_frames")).alias("b"))
    return best.select("scenario_id", F.col("b.track_id").alias("front_id"), F.col("b.mean_dist").alias("mean_dist"), F.col("b.n_frames").alias("n_frames"))


def aligned_frames(tracks: DataFrame, leads: DataFrame) -> DataFrame:
    """scenario_id, front_id, k, x, y, vx, vy, fx, fy, fvx, fvy: frames in which both are valid, numbered from 0."""
    front = tracks.where("valid").join(leads.select("scenario_id", F.col("front_id").alias("track_id")), ["scenario_id", "track_id"])
    front = front.select("scenario_id", "t", F.col("track_id").alias("front_id"), *(F.col(c).alias(f"f{c}") for c in ("x", "y", "vx", "vy")))
    both = tracks.where("is_ego and valid").select("scenario_id", "t", "x", "y", "vx", "vy").join(front, ["scenario_id", "t"])
    k = F.row_number().over(Window.partitionBy("scenario_id").orderBy("t")).cast("bigint") - 1
    return both.select("scenario_id", "front_id", k.alias("k"), "x", "y", "vx", "vy", "fx", "fy", "fvx", "fvy")


def filter_counts(tracks: DataFrame, leads: DataFrame, aligned: DataFrame, window_len: int) -> DataFrame:
    """One row: scenarios, those dropped by speed, without a lead, too short, and kept."""
    speed = speed_filter(tracks).select("scenario_id", "kept")
    rows = tracks.select("scenario_id").distinct().join(speed, "scenario_id", "left")
    rows = rows.join(leads.select("scenario_id", "front_id"), "scenario_id", "left").join(aligned.groupBy("scenario_id").agg(F.count("*").alias("n")), "scenario_id", "left")
    slow = ~F.coalesce("kept", F.lit(False))
    alone = ~slow & F.col("front_id").isNull()
    short = ~slow & ~alone & (F.coalesce("n", F.lit(0)) < window_len)
    return rows.agg(F.count("*").alias("n_scenarios"), F.count_if(slow).alias("n_slow"), F.count_if(alone).alias("n_no_lead"), F.count_if(short).alias("n_short"), F.count_if(~slow & ~alone & ~short).alias("n_kept"))
