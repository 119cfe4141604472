"""Window features: the 20 style columns, the 20 legacy columns, the condition vector and standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket_of, finite_or_zero, sanitized_gap, thw_soft
from ..functions.selection import quantiles
from .windows import in_order, step

CORE = ("acc_abs_p95", "acc_abs_p99", "acc_rms", "jerk_abs_p95", "jerk_abs_p99", "jerk_rms", "yaw_rate_rms", "yaw_rate_abs_p95", "heading_change_total")
MOTION = (*CORE, "speed_control_oscillation", "cf_valid_frac")
FOLLOWING = ("thw_p50", "thw_p20", "thw_iqr", "v_rel_p50", "closing_gain_kv", "gap_gain_kd", "desired_gap_d0", "acc_sync_lag", "acc_sync_corr")
STYLE = (*MOTION, *FOLLOWING)


def core_features(rows: DataFrame) -> DataFrame:
    """wid with features 0 to 8 and 10 of kinematics rows: one aggregate."""
    p = lambda c, q: F.percentile(F.abs(c), F.lit(q))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return rows.groupBy("wid").agg(
        p("a", 0.95).alias("acc_abs_p95"), p("a", 0.99).alias("acc_abs_p99"), rms("a").alias("acc_rms"),
        p("jerk", 0.95).alias("jerk_abs_p95"), p("jerk", 0.99).alias("jerk_abs_p99"), rms("jerk").alias("jerk_rms"),
        rms("yaw").alias("yaw_rate_rms"), p("yaw", 0.95).alias("yaw_rate_abs_p95"), F.sum(F.abs("yaw")).alias("heading_change_total"),
        F.avg(F.when(F.col("following"), 1.0).otherwise(0.0)).alias("cf_valid_frac"),
    )


def oscillation(rows: DataFrame, least: float = 1e-3) -> DataFrame:
    """wid, speed_control_oscillation: the share of sign changes among speed steps of over `least`; 0 with fewer than two."""
    moved = rows.where("i > 0").where(F.abs("a") > least)
    flip = F.signum("a") * F.lag(F.signum("a")).over(in_order()) < 0
    share = moved.withColumn("flip", flip).groupBy("wid").agg(F.avg(F.col("flip").cast("double")).alias("s"))
    return rows.select("wid").distinct().join(share, "wid", "left").select("wid", F.coalesce("s", F.lit(0.0)).alias("speed_control_oscillation"))


def following_features(rows: DataFrame, least_points: int = 20) -> DataFrame:
    """wid, n_following, features 11 to 14 over following frames; NULL with fewer than `least_points`."""
    when = lambda c: F.when(F.col("following"), F.col(c))
    out = rows.groupBy("wid").agg(F.count_if("following").alias("n_following"), F.percentile(when("thw"), F.array(*map(F.lit, (0.5, 0.2, 0.75, 0.25)))).alias("t"), F.percentile(when("v_rel"), F.lit(0.5)).alias("v"))
    enough = F.col("n_following") >= least_points
    t = lambda i: F.get("t", F.lit(i))
    return out.select("wid", "n_following", F.when(enough, t(0)).alias("thw_p50"), F.when(enough, t(1)).alias("thw_p20"), F.when(enough, t(2) - t(3)).alias("thw_iqr"), F.when(enough, F.col("v")).alias("v_rel_p50"))


def ridge_gains(rows: DataFrame, least_points: int = 20, penalty: float = 1e-3, least_kd: float = 1e-3) -> DataFrame:
    """wid, closing_gain_kv, gap_gain_kd, desired_gap_raw, kd_small, desired_gap_d0.

    a = kv * v_rel + kd * d + b by ridge on nine sums, solved by cofactors. The condition guard (1e12) uses the
    eigenvalues of the symmetric 3 x 3 matrix in trigonometric form.
    """
    f = rows.where("following")
    s = f.groupBy("wid").agg(
        F.count("*").alias("n"), F.sum(F.col("v_rel") * F.col("v_rel")).alias("vv"), F.sum(F.col("v_rel") * F.col("d")).alias("vd"), F.sum("v_rel").alias("sv"), F.sum(F.col("d") * F.col("d")).alias("dd"),
        F.sum("d").alias("sd"), F.sum(F.col("v_rel") * F.col("a")).alias("va"), F.sum(F.col("d") * F.col("a")).alias("da"), F.sum("a").alias("sa"),
    )
    s = s.where(F.col("n") >= max(3, least_points)).withColumns({"p": F.col("vv") + penalty, "q": F.col("dd") + penalty, "r": F.col("n") + penalty})
    s = s.withColumns({"c1": F.expr("q * r - sd * sd"), "c2": F.expr("vd * r - sd * sv"), "c3": F.expr("vd * sd - q * sv")})
    s = s.withColumn("det", F.expr("p * c1 - vd * c2 + sv * c3"))
    mean = F.expr("(p + q + r) / 3")
    s = s.withColumn("m", mean).withColumn("spread", F.expr("sqrt(((p - m) * (p - m) + (q - m) * (q - m) + (r - m) * (r - m) + 2 * (vd * vd + sv * sv + sd * sd)) / 6)"))
    shape = F.expr("((p - m) * ((q - m) * (r - m) - sd * sd) - vd * (vd * (r - m) - sd * sv) + sv * (vd * sd - (q - m) * sv)) / (2 * spread * spread * spread)")
    s = s.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(shape, F.lit(1.0))))) / 3)
    high, low = F.expr("m + 2 * spread * cos(phi)"), F.expr("m + 2 * spread * cos(phi + 2 * pi() / 3)")
    # rounding can leave the least eigenvalue below the penalty that bounds it
    good = high / F.greatest(low, F.lit(penalty)) <= 1e12
    kv, kd = F.expr("(va * c1 - vd * (da * r - sd * sa) + sv * (da * sd - q * sa)) / det"), F.expr("(p * (da * r - sd * sa) - va * c2 + sv * (vd * sa - da * sv)) / det")
    b = F.expr("(p * (q * sa - da * sd) - vd * (vd * sa - da * sv) + va * c3) / det")
    s = s.where(good).withColumns({"kv": kv, "kd": kd, "b": b})
    small = F.abs("kd") < least_kd
    s = s.withColumn("raw", F.when(~small, -F.col("b") / F.when(F.col("kd") != 0, F.col("kd"))))
    found = s.select("wid", F.col("kv").alias("closing_gain_kv"), F.col("kd").alias("gap_gain_kd"), F.col("raw").alias("desired_gap_raw"), small.alias("kd_small"), sanitized_gap(F.col("raw")).alias("desired_gap_d0"))
    return rows.select("wid").distinct().join(found, "wid", "left")


def _moments(x: Column, y: Column) -> Column:
    """n, s1, s2, c of two arrays of one length: population deviations and covariance, in two passes over the pairs."""
    n = F.size(x).cast("double")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    spread = lambda v, w, m: total(F.zip_with(v, w, lambda a, b: (a - m[0]) * (b - m[1])))
    means = F.array(F.struct((total(x) / n).alias("x"), (total(y) / n).alias("y")))
    made = F.transform(means, lambda m: F.struct(F.size(x).alias("n"), F.sqrt(spread(x, x, (m["x"], m["x"])) / n).alias("s1"), F.sqrt(spread(y, y, (m["y"], m["y"])) / n).alias("s2"), (spread(x, y, (m["x"], m["y"])) / n).alias("c")))
    return F.get(made, F.lit(0))


def sync_lag(rows: DataFrame, least_points: int = 20, most: int = 10, least: float = 1e-8) -> DataFrame:
    """wid, acc_sync_lag, acc_sync_corr: the lag with the highest correlation of the two accelerations over following
    frames, which are numbered afresh; the smallest of equal lags. The accelerations of a window are two arrays in one row, of which each lag
    compares two slices: frames are neither copied nor joined."""
    f = rows.where("following").groupBy("wid").agg(F.count("*").alias("n"), F.var_pop("a").alias("va"), F.var_pop("fa").alias("vf"), F.array_sort(F.collect_list(F.struct("i", "a", "fa"))).alias("at"))
    usable = f.where((F.col("n") >= max(3, least_points)) & (F.col("va") >= least) & (F.col("vf") >= least))
    packed = usable.select("wid", F.col("at.a").alias("a"), F.col("at.fa").alias("fa"))

    def tried(lag: Column) -> Column:
        n = F.greatest(F.size("a") - F.abs(lag), F.lit(0))
        return F.struct(lag.alias("lag"), _moments(F.slice("a", F.greatest(lag, F.lit(0)) + 1, n), F.slice("fa", F.greatest(-lag, F.lit(0)) + 1, n)).alias("m"))

    lags = F.transform(F.sequence(F.lit(-most), F.lit(most)), tried)
    good = F.filter(lags, lambda x: (x["m"]["n"] >= 3) & (x["m"]["s1"] >= least) & (x["m"]["s2"] >= least))
    scored = F.transform(good, lambda x: F.transform(F.array(x["m"]["c"] / (x["m"]["s1"] * x["m"]["s2"])), lambda r: F.struct(F.round(r, 12).alias("key"), (-x["lag"]).alias("back"), r.alias("r")))[0])
    best = packed.select("wid", F.array_max(scored).alias("b")).where("b is not null")
    best = best.select("wid", (-F.col("b.back")).cast("double").alias("acc_sync_lag"), F.col("b.r").alias("acc_sync_corr"))
    return rows.select("wid").distinct().join(best, "wid", "left")


def style_features(rows: DataFrame, least_points: int = 20) -> DataFrame:
    """wid and the 20 style columns."""
    out = core_features(rows).join(oscillation(rows), "wid").join(following_features(rows, least_points), "wid").join(ridge_gains(rows, least_points), "wid").join(sync_lag(rows, least_points), "wid")
    return out.select("wid", *STYLE)


def legacy_features(windows: DataFrame) -> DataFrame:
    """wid and the 20 legacy columns; headings are not wrapped here."""
    rows = windows.withColumns({"v": F.sqrt(F.expr("vx * vx + vy * vy")), "fv": F.sqrt(F.expr("fvx * fvx + fvy * fvy")), "d": F.sqrt(F.expr("(fx - x) * (fx - x) + (fy - y) * (fy - y)"))})
    rows = rows.withColumns({"rel": F.col("v") - F.col("fv"), "a": step(F.col("v")), "fa": step(F.col("fv")), "turn": F.atan2(step(F.col("y")), step(F.col("x"))), "thw": thw_soft(F.col("d"), F.col("v")), "norm": F.col("v") / (F.col("fv") + 1e-3)})
    rows = rows.withColumns({"jerk": step(F.col("a")), "rel_acc": F.col("a") - F.col("fa"), "yaw": step(F.col("turn")), "front_at": F.min(F.when(F.col("fa") < -0.5, F.col("i"))).over(Window.partitionBy("wid"))})
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    braked = F.min(F.when((F.col("a") < -0.5) & (F.col("i") >= F.col("front_at")) & (F.col("i") < F.col("front_at") + 10), F.col("i") - F.col("front_at")))
    return rows.groupBy("wid").agg(
        F.avg("rel").alias("rel_speed_mean"), F.stddev_pop("rel").alias("rel_speed_std"), share(F.col("rel") > 0).alias("rel_speed_pos_frac"),
        F.avg("thw").alias("thw_mean"), F.stddev_pop("thw").alias("thw_std"), F.min("thw").alias("thw_min"),
        F.avg("jerk").alias("jerk_mean"), F.stddev_pop("jerk").alias("jerk_std"), F.percentile("jerk", F.lit(0.95)).alias("jerk_p95"),
        F.avg("rel_acc").alias("rel_acc_mean"), F.stddev_pop("rel_acc").alias("rel_acc_std"), F.coalesce(braked, F.lit(0)).cast("double").alias("reaction_time"),
        F.stddev_pop("yaw").alias("yaw_std"), F.count_if(F.abs("yaw") > 0.1).alias("lane_change_count"), share(F.abs("yaw") > 0.1).alias("lane_change_frac"),
        F.avg("norm").alias("speed_norm_mean"), F.stddev_pop("norm").alias("speed_norm_std"), F.stddev_pop("v").alias("speed_std"), F.stddev_pop("a").alias("acc_std"), F.avg("v").alias("speed_mean"),
    )


def conditions(rows: DataFrame) -> DataFrame:
    """wid, speed_mean, dist_mean, vrel_mean, cf_valid_frac, bucket of kinematics rows."""
    out = rows.groupBy("wid").agg(F.avg("v").alias("speed_mean"), F.avg("d").alias("dist_mean"), F.avg("v_rel").alias("vrel_mean"), F.avg(F.when(F.col("following"), 1.0).otherwise(0.0)).alias("cf_valid_frac"))
    return out.withColumn("bucket", bucket_of(F.col("cf_valid_frac")))


def standardized(features: DataFrame, columns=STYLE, fit_on: DataFrame | None = None) -> DataFrame:
    """Columns as (x - mean) / (population deviation + 1e-6), with missing and infinite values as 0 first.

    fit_on: rows that the statistics come from, else all. The statistics are one row, broadcast.
    """
    clean = lambda c: finite_or_zero(F.col(c))
    stats = (features if fit_on is None else fit_on).agg(*(F.avg(clean(c)).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(clean(c)).alias(f"_s_{c}") for c in columns))
    both = features.crossJoin(F.broadcast(stats))
    return both.withColumns({c: (clean(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6) for c in columns}).select(*features.columns)


def missing_counts(features: DataFrame, columns=STYLE) -> DataFrame:
    """feature, n_missing, n."""
    rows = features.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("p.*")
    return rows.groupBy("feature").agg(F.count_if(F.col("x").isNull() | F.isnan("x")).alias("n_missing"), F.count("*").alias("n"))


def dataset_report(speeds: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: statistics of all speeds (speed), and of windows (split, cf_valid_frac, desired_gap_raw, desired_gap_d0, kd_small): numbers per
    split, of gains too small, and of gaps, with extremes and percentiles of gaps before and after cleaning."""
    first = speeds.agg(F.avg("speed").alias("speed_mean"), F.stddev_pop("speed").alias("speed_std"), F.min("speed").alias("speed_min"), F.max("speed").alias("speed_max"))
    splits = [F.count_if(F.col("split") == s).alias(f"{s}_count") for s in ("train", "val", "test")]
    gaps, ranks = [], {f"cf_p{p}": (F.col("cf_valid_frac"), p / 100) for p in (10, 50, 90)}
    for c, name in (("desired_gap_raw", "d0_raw"), ("desired_gap_d0", "d0_sanitized")):
        gaps += [F.count(c).alias(f"{name}_valid_count"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
        ranks |= {f"{name}_p{p}": (F.col(c), p / 100) for p in (1, 50, 99)}
    cf = [F.avg("cf_valid_frac").alias("cf_mean"), F.stddev_pop("cf_valid_frac").alias("cf_std")]
    second = rows.agg(F.count("*").alias("total_windows"), *splits, *gaps, F.count_if("kd_small").alias("kd_small_count"), F.count_if(F.col("desired_gap_d0").isNull()).alias("d0_nan_count"), *cf)
    return first.crossJoin(F.broadcast(second)).crossJoin(F.broadcast(quantiles(rows, ranks)))  # a row each
