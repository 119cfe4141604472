"""Hopping row windows and per-frame signals.

Windows are kept long, one row per window and frame: keys are (scenario_id, start), which `wid` packs into a number where
scenario ids are numbers, and into a struct of both otherwise (see `window_key`), so later window functions and aggregates by wid
share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import TWO_PI, heading, norm2, split_of, thw_floor, thw_soft, wrap_angle


def in_order():
    """A window's frames in order."""
    return Window.partitionBy("wid").orderBy("i")


#: Starts below PACKED give scenario_id * PACKED + start; the ids of later ones lie below LATE, where none of these do.
PACKED, LATE = 1_000_000, -(1 << 62)


def window_id(scenario_id: Column, start: Column) -> Column:
    """One number per (scenario_id, start), different for all windows; an error where a number has no room."""
    early = F.when(scenario_id >= -(-LATE // PACKED), scenario_id * PACKED + start)
    fits = (scenario_id >= -(1 << 29)) & (scenario_id < 1 << 29) & (start < 1 << 32)
    late = F.lit(LATE) - 1 - (scenario_id.cast("bigint") + (1 << 29)) * (1 << 32) - start
    error = F.raise_error(F.concat(F.lit("no window id for scenario "), scenario_id.cast("string"), F.lit(", start "), start.cast("string"))).cast("bigint")
    return F.coalesce(F.when(start < PACKED, early).when(fits, late), F.when(scenario_id.isNotNull(), error))


#: Types of scenario ids that window_id packs.
NUMBERS = ("tinyint", "smallint", "int", "bigint")


def window_key(rows: DataFrame) -> Column:
    """The key of the window (scenario_id, start) of each row: window_id for numbers; for names, as record files have them,
    a struct of both, which groups, joins and sorts as numbers do. Null where the scenario is null."""
    scenario, start = F.col("scenario_id"), F.col("start")
    if dict(rows.dtypes)["scenario_id"] in NUMBERS:
        return window_id(scenario, start)
    return F.when(scenario.isNotNull(), F.struct(scenario.alias("scenario_id"), start.alias("start")))


def scenario_of(wid: Column, packed: bool = True) -> Column:
    """The scenario of a window's key; packed: it is a number."""
    if not packed:
        return wid.getField("scenario_id")
    late = F.call_function("div", -(wid - LATE) - 1, F.lit(1 << 32)) - (1 << 29)
    return F.when(wid < LATE, late).otherwise(F.call_function("div", wid, F.lit(PACKED)))


def sliding(aligned: DataFrame, length: int = 80, stride: int = 20) -> DataFrame:
    """wid, scenario_id, start, i and the frames of each full window. A frame goes to the windows that hold it,
    found from its own number: no join."""
    last = F.count("*").over(Window.partitionBy("scenario_id")) - length
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - (length - 1)) / stride)).cast("bigint")
    final = F.floor(F.least(F.col("k"), F.col("last")) / stride).cast("bigint")
    rows = aligned.withColumn("last", last).where("last >= 0").withColumns({"a": first, "b": final}).where("a <= b")
    rows = rows.withColumn("start", F.explode(F.transform(F.sequence("a", "b"), lambda s: s * stride)))
    return rows.select(window_key(rows).alias("wid"), "scenario_id", "start", (F.col("k") - F.col("start")).alias("i"), "front_id", "x", "y", "vx", "vy", "fx", "fy", "fvx", "fvy")


def window_rows(windows: DataFrame) -> DataFrame:
    """One row per window with its metadata; the split hashes the scenario's name."""
    rows = windows.groupBy("wid", "scenario_id", "start", "front_id").agg(F.count("*").alias("window_len"))
    return rows.withColumn("split", split_of(F.concat(F.lit("scenario_"), F.col("scenario_id").cast("string"))))


def step(c: Column) -> Column:
    """Backward difference, 0 at the first row."""
    return F.coalesce(c - F.lag(c).over(in_order()), F.lit(0.0))


def gradient(c: Column, dt: float) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(c).over(in_order()), F.lead(c).over(in_order())
    return F.when(before.isNull(), (after - c) / dt).when(after.isNull(), (c - before) / dt).otherwise((after - before) / (2 * dt))


def unwrap(rows: DataFrame, column: str, out: str) -> DataFrame:
    """`out`: the angle with jumps of more than half a turn taken out, by a running sum of corrections."""
    d = F.col(column) - F.lag(column).over(in_order())
    half = TWO_PI / 2
    bent = wrap_angle(F.col("_d"))
    bent = F.when((bent == -half) & (F.col("_d") > 0), half).otherwise(bent)
    fix = F.when(F.abs("_d") < half, 0.0).otherwise(bent - F.col("_d"))
    rows = rows.withColumn("_d", d).withColumn("_fix", F.coalesce(fix, F.lit(0.0)))
    return rows.withColumn(out, F.col(column) + F.sum("_fix").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_d", "_fix")


def kinematics(windows: DataFrame) -> DataFrame:
    """Per frame: v, fv, v_rel, d, a, fa, jerk, yaw (wrapped), thw and the strict car-following mask. Steps are per frame."""
    rows = windows.withColumns({"v": norm2(F.col("vx"), F.col("vy")), "fv": norm2(F.col("fvx"), F.col("fvy")), "d": norm2(F.col("fx") - F.col("x"), F.col("fy") - F.col("y"))})
    rows = rows.withColumns({"a": step(F.col("v")), "fa": step(F.col("fv")), "dx": step(F.col("x")), "dy": step(F.col("y")), "v_rel": F.col("v") - F.col("fv")})
    rows = rows.withColumn("heading", heading(F.col("dx"), F.col("dy"), F.col("vx"), F.col("vy")))
    back = F.col("heading") - F.lag("heading").over(in_order())
    rows = rows.withColumns({"jerk": step(F.col("a")), "yaw": F.coalesce(wrap_angle(back), F.lit(0.0)), "thw": thw_soft(F.col("d"), F.col("v"))})
    return rows.withColumn("following", (F.col("v") > 5.5) & (F.col("d") >= 8) & (F.col("d") <= 60) & (F.abs("v_rel") < 6))


def relative_kinematics(windows: DataFrame, dt: float = 0.1) -> DataFrame:
    """The 12 relative columns per frame."""
    rows = windows.withColumns({"ego_v": norm2(F.col("vx"), F.col("vy")), "front_v": norm2(F.col("fvx"), F.col("fvy")), "dx": F.col("fx") - F.col("x"), "dy": F.col("fy") - F.col("y"), "ego_heading": F.atan2("vy", "vx")})
    rows = rows.withColumns({"v_rel": F.col("ego_v") - F.col("front_v"), "dist": norm2(F.col("dx"), F.col("dy"))})
    turn = wrap_angle(F.col("ego_heading") - F.lag("ego_heading").over(in_order()))
    rate = lambda c: step(F.col(c)) / dt
    return rows.select("wid", "i", "ego_v", "front_v", "v_rel", "dx", "dy", "dist", rate("dist").alias("closing_rate"), rate("ego_v").alias("ego_a"), rate("front_v").alias("front_a"), "ego_heading", (F.coalesce(turn, F.lit(0.0)) / dt).alias("ego_yaw_rate"), thw_floor(F.col("dist"), F.col("ego_v"), 1e-6).alias("thw"))


def replay_signals(windows: DataFrame, dt: float = 0.1) -> DataFrame:
    """wid, i, speed, accel, jerk, yaw_step and curvature_step (wrapped backward differences), heading (unwrapped), yaw and
    curvature (gradients), gap, thw."""
    rows = windows.withColumns({"speed": norm2(F.col("vx"), F.col("vy")), "raw": F.atan2("vy", "vx"), "gap": norm2(F.col("fx") - F.col("x"), F.col("fy") - F.col("y"))})
    rows = unwrap(rows, "raw", "heading")
    back = F.coalesce(wrap_angle(F.col("raw") - F.lag("raw").over(in_order())), F.lit(0.0)) / dt
    rows = rows.withColumns({"accel": gradient(F.col("speed"), dt), "yaw": gradient(F.col("heading"), dt), "yaw_step": back})
    floor = F.greatest("speed", F.lit(1e-8))
    rows = rows.withColumns({"jerk": gradient(F.col("accel"), dt), "curvature": F.col("yaw") / floor, "curvature_step": F.col("yaw_step") / floor, "thw": F.col("gap") / floor})
    return rows.select("wid", "i", "speed", "accel", "jerk", "heading", "yaw", "yaw_step", "curvature", "curvature_step", "gap", "thw")


def signal_summary(signals: DataFrame) -> DataFrame:
    """The 18 statistics of each window's replay signals."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return signals.groupBy("wid").agg(
        F.avg("speed").alias("mean_speed"), F.stddev_pop("speed").alias("std_speed"), F.avg("accel").alias("mean_accel"), F.stddev_pop("accel").alias("std_accel"), rms("accel").alias("rms_accel"),
        F.avg("jerk").alias("mean_jerk"), rms("jerk").alias("rms_jerk"), F.max(F.abs("jerk")).alias("max_abs_jerk"),
        F.avg("yaw").alias("mean_yaw"), F.stddev_pop("yaw").alias("std_yaw"), rms("yaw").alias("rms_yaw"),
        F.avg("curvature").alias("mean_curvature"), F.stddev_pop("curvature").alias("std_curvature"), rms("curvature").alias("rms_curvature"),
        F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"), F.avg("thw").alias("mean_thw"), F.min("thw").alias("min_thw"),
    )


def aligned_to_start(windows: DataFrame) -> DataFrame:
    """wid, i, ax, ay: positions moved to the window's first frame and turned by its heading."""
    first = lambda c: F.first(c).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = windows.withColumns({"x0": first("x"), "y0": first("y"), "h0": F.atan2(first("vy"), first("vx"))})
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    return rows.select("wid", "i", (px * F.cos("h0") + py * F.sin("h0")).alias("ax"), (py * F.cos("h0") - px * F.sin("h0")).alias("ay"))
