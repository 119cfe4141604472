"""Closed-loop policy roll-outs: a fold over each window's frames, inside the JVM.

Each policy is a row of parameters (a small table, joined by broadcast). The fold's state is the ego's position,
velocity, last acceleration and smoothed heading; its output array grows by one state per frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import wrap_angle
from ..sources.metadata import dense_numbers

#: thw_target, a_max, a_min, jerk_limit, yaw_rate_clip, heading_smooth_alpha, kp_thw, kd_vrel of each policy.
PARAMETERS = ("thw_target", "a_max", "a_min", "jerk_limit", "yaw_rate_clip", "heading_smooth_alpha", "kp_thw", "kd_vrel")
POLICIES = {
    "conservative": (2.5, 1.5, -3.0, 0.5, 0.05, 0.0, 0.6, 0.4),
    "aggressive": (1.0, 3.5, -5.0, 2.0, 0.20, 0.0, 1.5, 0.8),
    "lateral_stable": (1.4, 1.5, -2.8, 0.35, 0.02, 0.45, 1.0, 0.6),
}


def policy_table(spark: SparkSession, names=tuple(POLICIES), overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """policy_id, policy_name and the parameters; an unknown name or parameter is an error."""
    if unknown := {*names, *(overrides or {})} - {*POLICIES}:
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    rows = []
    for n, name in enumerate(names):
        own = dict(zip(PARAMETERS, POLICIES[name], strict=True))
        changed = (overrides or {}).get(name, {})
        if odd := {*changed} - {*PARAMETERS}:
            raise ValueError(f"unknown parameters: {sorted(odd)}")
        rows.append((n, name, *(float((own | changed)[p]) for p in PARAMETERS)))
    return spark.createDataFrame(rows, "policy_id int, policy_name string, " + ", ".join(f"{p} double" for p in PARAMETERS))


def packed(windows: DataFrame) -> DataFrame:
    """wid, source_index and frames in order, each with the source heading of the frame after it. One group is one window."""
    frame = F.struct("i", "x", "y", "vx", "vy", "fx", "fy", "fvx", "fvy")
    rows = windows.groupBy("wid", "scenario_id", "start", "front_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    nxt = F.transform("frames", lambda f, n: F.struct(*(f[c].alias(c) for c in ("x", "y", "vx", "vy", "fx", "fy", "fvx", "fvy")), F.atan2(F.coalesce(F.get("frames", n + 1)["vy"], f["vy"]), F.coalesce(F.get("frames", n + 1)["vx"], f["vx"])).alias("turn")))
    return rows.withColumn("frames", nxt)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _advance(s: Column, f: Column, dt: float) -> Column:
    p = {c: F.col(c) for c in PARAMETERS}
    speed = F.hypot(s["vx"], s["vy"])
    gap = F.greatest(F.hypot(f["fx"] - s["x"], f["fy"] - s["y"]), F.lit(0.5))
    first = F.struct(speed.alias("v"), gap.alias("gap"))

    def control(k: Column) -> Column:
        error = k["gap"] / F.greatest(k["v"], F.lit(1e-3)) - p["thw_target"]
        wanted = p["kp_thw"] * error - p["kd_vrel"] * (k["v"] - F.hypot(f["fvx"], f["fvy"]))
        change = F.greatest(-p["jerk_limit"], F.least(p["jerk_limit"], wanted - s["a"]))
        a = F.greatest(p["a_min"], F.least(p["a_max"], s["a"] + change))
        aim = F.when(p["heading_smooth_alpha"] > 0, s["aim"] + (1 - p["heading_smooth_alpha"]) * wrap_angle(f["turn"] - s["aim"])).otherwise(f["turn"])
        own = F.when(k["v"] > 1e-3, F.atan2(s["vy"], s["vx"])).otherwise(F.atan2(f["vy"], f["vx"]))
        return F.struct(k["v"].alias("v"), a.alias("a"), aim.alias("aim"), own.alias("own"))

    def turned(k: Column) -> Column:
        turn = F.greatest(-p["yaw_rate_clip"], F.least(p["yaw_rate_clip"], wrap_angle(k["aim"] - k["own"])))
        return F.struct(F.greatest(k["v"] + k["a"] * dt, F.lit(0.0)).alias("v"), k["a"].alias("a"), k["aim"].alias("aim"), (k["own"] + turn).alias("h"))

    def moved(k: Column) -> Column:
        vx, vy = k["v"] * F.cos(k["h"]), k["v"] * F.sin(k["h"])
        return F.struct((s["x"] + vx * dt).alias("x"), (s["y"] + vy * dt).alias("y"), vx.alias("vx"), vy.alias("vy"), k["a"].alias("a"), k["aim"].alias("aim"))

    return _let(first, lambda k: _let(control(k), lambda m: _let(turned(m), moved)))


def simulate(windows: DataFrame, policies: DataFrame, dt: float = 0.1) -> DataFrame:
    """wid, policy_id, policy_name, i, x, y, vx, vy of every window under every policy; frame 0 is the source's."""
    both = packed(windows).crossJoin(F.broadcast(policies))
    f0 = F.get("frames", F.lit(0))
    start = F.struct(f0["x"].alias("x"), f0["y"].alias("y"), f0["vx"].alias("vx"), f0["vy"].alias("vy"), F.lit(0.0).alias("a"), F.atan2(f0["vy"], f0["vx"]).alias("aim"))
    steps = F.slice("frames", 1, F.greatest(F.size("frames") - 1, F.lit(0)))
    states = F.aggregate(steps, F.array(start), lambda out, f: F.concat(out, F.array(_advance(F.element_at(out, -1), f, dt))))
    rows = both.select("wid", "scenario_id", "start", "front_id", "policy_id", "policy_name", F.posexplode(states).alias("i", "s"))
    return rows.select("wid", "scenario_id", "start", "front_id", "policy_id", "policy_name", F.col("i").cast("bigint").alias("i"), "s.x", "s.y", "s.vx", "s.vy")


def rollout_meta(window_rows: DataFrame, policies: DataFrame) -> DataFrame:
    """The fixed metadata of each roll-out row: policy-major row_index over windows numbered by wid."""
    numbered = dense_numbers(window_rows, "wid", "source_index")
    n = numbered.agg(F.count("*").alias("n_sources"))
    both = numbered.crossJoin(F.broadcast(policies.select("policy_id", "policy_name"))).crossJoin(F.broadcast(n))
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("scenario_id", "start", "window_len", "front_id")))
    return both.select((F.col("policy_id") * F.col("n_sources") + F.col("source_index")).alias("row_index"), "source_index", key.alias("source_key"), "policy_id", "policy_name", "scenario_id", "start", "window_len", "front_id", "split")


def kinematics_report(rollouts: DataFrame) -> DataFrame:
    """policy_name, yaw_p95, heading_change_mean: 95th percentile of turns, and mean total turn per window."""
    w = Window.partitionBy("wid", "policy_id").orderBy("i")
    h = F.atan2("vy", "vx")
    turn = F.abs(wrap_angle(h - F.lag(h).over(w)))
    rows = rollouts.withColumn("turn", turn).where("turn is not null")
    total = rows.groupBy("policy_name", "wid").agg(F.sum("turn").alias("t")).groupBy("policy_name").agg(F.avg("t").alias("heading_change_mean"))
    return rows.groupBy("policy_name").agg(F.percentile("turn", F.lit(0.95)).alias("yaw_p95")).join(total, "policy_name")
