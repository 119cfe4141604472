"""Queries over the driver's tables, each with its SQL equivalent where SQL expresses it.

Trajectory queries read `tracks` derived from events, windows of 20 frames every 5, and car-following minima of 18
frames. Vector queries read `embeddings` with policy = label mod 3 and source = id div 3; pair queries work inside
scopes of 64 consecutive ids, the size of a mini-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, selection
from ..operators import evaluate, features, lead, learn, pairs, retrieve, rollouts, windows
from ..session import stored
from ..sources import metadata, tables
from . import sql
from .registry import ORACLES, QUERIES, query

LENGTH, STRIDE, LEAST = 20, 5, 18


def _tracks(spark, d):
    return tables.tracks(spark, d)


def _aligned(spark, d):
    t = _tracks(spark, d)
    return lead.aligned_frames(t, lead.lead_tracks(t))


def _windows(spark, d):
    return windows.sliding(_aligned(spark, d), LENGTH, STRIDE)


def _kin(spark, d):
    return windows.kinematics(_windows(spark, d))


def _vectors(spark, d):
    return tables.vectors(spark, d).withColumn("scope", F.expr("row_index div 64"))


def _complete(spark, d):
    return tables.vectors(spark, d, F.col("vec_id") % 3)


def _policies(spark):
    return spark.range(3).withColumnRenamed("id", "policy_id")


# tracks and windows


@query("tracks", f"WITH {sql.TRACKS} SELECT * FROM tracks", "x y vx vy")
def tracks(spark, d):
    return _tracks(spark, d)


@query("lead_vehicle", f"WITH {sql.LEADS} SELECT * FROM leads", "mean_dist")
def lead_vehicle(spark, d):
    return lead.lead_tracks(_tracks(spark, d))


@query("scenario_speed_filter", f"WITH {sql.TRACKS} SELECT scenario_id, count(*) FILTER (valid) AS n_frames, min(sqrt(vx * vx + vy * vy)) FILTER (valid) AS min_speed, avg(sqrt(vx * vx + vy * vy)) FILTER (valid) AS mean_speed, coalesce(min_speed >= 6.0, false) AS kept FROM tracks WHERE is_ego GROUP BY scenario_id", "min_speed mean_speed")
def scenario_speed_filter(spark, d):
    return lead.speed_filter(_tracks(spark, d), 6.0)


@query("filter_counts", f"""WITH {sql.ALIGNED}, s AS (SELECT scenario_id, coalesce(min(sqrt(vx * vx + vy * vy)) FILTER (valid AND is_ego) >= 5.5, false) AS kept FROM tracks GROUP BY 1),
    c AS (SELECT s.*, l.front_id, (SELECT count(*) FROM aligned a WHERE a.scenario_id = s.scenario_id) AS n FROM s LEFT JOIN leads l USING (scenario_id))
    SELECT count(*) AS n_scenarios, count(*) FILTER (NOT kept) AS n_slow, count(*) FILTER (kept AND front_id IS NULL) AS n_no_lead, count(*) FILTER (kept AND front_id IS NOT NULL AND n < 40) AS n_short, count(*) FILTER (kept AND front_id IS NOT NULL AND n >= 40) AS n_kept FROM c""")
def filter_counts(spark, d):
    t = _tracks(spark, d)
    leads = lead.lead_tracks(t)
    return lead.filter_counts(t, leads, lead.aligned_frames(t, leads), 40)


@query("aligned_frames", f"WITH {sql.ALIGNED} SELECT * FROM aligned", "x y vx vy fx fy fvx fvy")
def aligned_frames(spark, d):
    return _aligned(spark, d)


@query("sliding_windows", f"WITH {sql.WINDOWS} SELECT wid, scenario_id, start, front_id, count(*) AS window_len, {sql.SPLIT(chr(39) + 'scenario_' + chr(39) + ' || scenario_id')} AS split FROM win GROUP BY ALL")
def sliding_windows(spark, d):
    return windows.window_rows(_windows(spark, d))


@query("window_frames", f"WITH {sql.WINDOWS} SELECT wid, scenario_id, start, i, front_id, x, y, vx, vy, fx, fy, fvx, fvy FROM win", "x y vx vy fx fy fvx fvy")
def window_frames(spark, d):
    return _windows(spark, d)


# features


@query("window_core_features", f"WITH {sql.CORE} SELECT * FROM core", " ".join((*features.CORE, "cf_valid_frac")))
def window_core_features(spark, d):
    return features.core_features(_kin(spark, d))


@query("speed_oscillation", f"""WITH {sql.KINEMATICS}, m AS (SELECT wid, sign(a) * lag(sign(a)) OVER (PARTITION BY wid ORDER BY i) < 0 AS flip FROM kin WHERE i > 0 AND abs(a) > 1e-3)
    SELECT wid, coalesce((SELECT avg(flip::INT::DOUBLE) FROM m WHERE m.wid = w.wid), 0) AS speed_control_oscillation FROM (SELECT DISTINCT wid FROM kin) w""", "speed_control_oscillation")
def speed_oscillation(spark, d):
    return features.oscillation(_kin(spark, d))


@query("cf_features", f"""WITH {sql.KINEMATICS}, f AS (SELECT wid, count(*) FILTER (following) AS n_following, quantile_cont(thw, 0.5) FILTER (following) AS a, quantile_cont(thw, 0.2) FILTER (following) AS b,
    quantile_cont(thw, 0.75) FILTER (following) - quantile_cont(thw, 0.25) FILTER (following) AS c, quantile_cont(v_rel, 0.5) FILTER (following) AS e FROM kin GROUP BY wid)
    SELECT wid, n_following, CASE WHEN n_following >= 18 THEN a END AS thw_p50, CASE WHEN n_following >= 18 THEN b END AS thw_p20, CASE WHEN n_following >= 18 THEN c END AS thw_iqr, CASE WHEN n_following >= 18 THEN e END AS v_rel_p50 FROM f""", "thw_p50 thw_p20 thw_iqr v_rel_p50")
def cf_features(spark, d):
    return features.following_features(_kin(spark, d), LEAST)


@query("cf_gains_ridge", f"""WITH {sql.KINEMATICS}, s AS (SELECT wid, count(*) AS n, sum(v_rel * v_rel) + 1e-3 AS p, sum(v_rel * d) AS vd, sum(v_rel) AS sv, sum(d * d) + 1e-3 AS q, sum(d) AS sd, count(*) + 1e-3::DOUBLE AS r, sum(v_rel * a) AS va, sum(d * a) AS da, sum(a) AS sa FROM kin WHERE following GROUP BY wid HAVING count(*) >= 18),
    b AS (SELECT *, p * (q * r - sd * sd) - vd * (vd * r - sd * sv) + sv * (vd * sd - q * sv) AS det FROM s),
    g AS (SELECT wid, (va * (q * r - sd * sd) - vd * (da * r - sd * sa) + sv * (da * sd - q * sa)) / det AS kv, (p * (da * r - sd * sa) - va * (vd * r - sd * sv) + sv * (vd * sa - da * sv)) / det AS kd,
        (p * (q * sa - da * sd) - vd * (vd * sa - da * sv) + va * (vd * sd - q * sv)) / det AS c FROM b)
    SELECT w.wid, kv AS closing_gain_kv, kd AS gap_gain_kd, abs(kd) < 1e-3 AS kd_small FROM (SELECT DISTINCT wid FROM kin) w LEFT JOIN g USING (wid)""", "closing_gain_kv gap_gain_kd")
def cf_gains_ridge(spark, d):
    return features.ridge_gains(_kin(spark, d), LEAST).select("wid", "closing_gain_kv", "gap_gain_kd", "kd_small")


@query("acc_sync_lag", f"""WITH {sql.KINEMATICS}, f AS (SELECT wid, a, fa, row_number() OVER (PARTITION BY wid ORDER BY i) - 1 AS p FROM kin WHERE following),
    u AS (SELECT wid FROM f GROUP BY wid HAVING count(*) >= 18 AND var_pop(a) >= 1e-8 AND var_pop(fa) >= 1e-8),
    l AS (SELECT f.wid, f.a, f.p, lag FROM f JOIN u USING (wid) CROSS JOIN (SELECT unnest(range(-10, 11)) AS lag)),
    c AS (SELECT l.wid, l.lag, covar_pop(l.a, g.fa) / (stddev_pop(l.a) * stddev_pop(g.fa)) AS r FROM l JOIN f g ON g.wid = l.wid AND g.p = l.p - l.lag GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(l.a) >= 1e-8 AND stddev_pop(g.fa) >= 1e-8),
    b AS (SELECT wid, lag, r FROM c QUALIFY row_number() OVER (PARTITION BY wid ORDER BY round(r, 12) DESC, lag) = 1)
    SELECT w.wid, b.lag::DOUBLE AS acc_sync_lag, b.r AS acc_sync_corr FROM (SELECT DISTINCT wid FROM kin) w LEFT JOIN b USING (wid)""", "acc_sync_lag acc_sync_corr")
def acc_sync_lag(spark, d):
    return features.sync_lag(_kin(spark, d), LEAST)


@query("style_features")
def style_features(spark, d):
    return features.style_features(_kin(spark, d), LEAST)


@query("rel_kinematics", f"""WITH {sql.WINDOWS}, k AS (SELECT wid, i, sqrt(vx * vx + vy * vy) AS ego_v, sqrt(fvx * fvx + fvy * fvy) AS front_v, fx - x AS dx, fy - y AS dy, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) AS dist, atan2(vy, vx) AS ego_heading FROM win)
    SELECT wid, i, ego_v, front_v, ego_v - front_v AS v_rel, dx, dy, dist, coalesce(dist - lag(dist) OVER w, 0) / 0.1 AS closing_rate, coalesce(ego_v - lag(ego_v) OVER w, 0) / 0.1 AS ego_a, coalesce(front_v - lag(front_v) OVER w, 0) / 0.1 AS front_a,
    ego_heading, coalesce({sql.WRAP('ego_heading - lag(ego_heading) OVER w')}, 0) / 0.1 AS ego_yaw_rate, dist / greatest(ego_v, 1e-6) AS thw FROM k WINDOW w AS (PARTITION BY wid ORDER BY i)""", "ego_v front_v v_rel dx dy dist closing_rate ego_a front_a ego_heading ego_yaw_rate thw")
def rel_kinematics(spark, d):
    return windows.relative_kinematics(_windows(spark, d))


_GRAD = lambda c: f"CASE WHEN lag({c}) OVER w IS NULL THEN (lead({c}) OVER w - {c}) / 0.1 WHEN lead({c}) OVER w IS NULL THEN ({c} - lag({c}) OVER w) / 0.1 ELSE (lead({c}) OVER w - lag({c}) OVER w) / 0.2 END"
_SIGNALS = f"""{sql.WINDOWS}, g1 AS (SELECT wid, i, sqrt(vx * vx + vy * vy) AS speed, atan2(vy, vx) AS raw, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) AS gap FROM win),
    g2 AS (SELECT *, raw - lag(raw) OVER (PARTITION BY wid ORDER BY i) AS dr FROM g1),
    g3 AS (SELECT *, raw + sum(coalesce(CASE WHEN abs(dr) < {sql.PI} THEN 0 ELSE {sql.WRAP('dr')} - dr END, 0)) OVER (PARTITION BY wid ORDER BY i) AS heading FROM g2),
    g4 AS (SELECT *, {_GRAD('speed')} AS accel, {_GRAD('heading')} AS yaw, coalesce({sql.WRAP('dr')}, 0) / 0.1 AS yaw_step FROM g3 WINDOW w AS (PARTITION BY wid ORDER BY i)),
    signals AS (SELECT wid, i, speed, accel, {_GRAD('accel')} AS jerk, heading, yaw, yaw_step, yaw / greatest(speed, 1e-8) AS curvature, yaw_step / greatest(speed, 1e-8) AS curvature_step, gap, gap / greatest(speed, 1e-8) AS thw FROM g4 WINDOW w AS (PARTITION BY wid ORDER BY i))"""


@query("replay_signals", f"WITH {_SIGNALS} SELECT * FROM signals", "speed accel jerk heading yaw yaw_step curvature curvature_step gap thw")
def replay_signals(spark, d):
    return windows.replay_signals(_windows(spark, d))


_STATS = "mean_speed std_speed mean_accel std_accel rms_accel mean_jerk rms_jerk max_abs_jerk mean_yaw std_yaw rms_yaw mean_curvature std_curvature rms_curvature mean_gap min_gap mean_thw min_thw"


@query("signal_summary", f"""WITH {_SIGNALS} SELECT wid, avg(speed) AS mean_speed, stddev_pop(speed) AS std_speed, avg(accel) AS mean_accel, stddev_pop(accel) AS std_accel, sqrt(avg(accel * accel)) AS rms_accel, avg(jerk) AS mean_jerk, sqrt(avg(jerk * jerk)) AS rms_jerk, max(abs(jerk)) AS max_abs_jerk,
    avg(yaw) AS mean_yaw, stddev_pop(yaw) AS std_yaw, sqrt(avg(yaw * yaw)) AS rms_yaw, avg(curvature) AS mean_curvature, stddev_pop(curvature) AS std_curvature, sqrt(avg(curvature * curvature)) AS rms_curvature, avg(gap) AS mean_gap, min(gap) AS min_gap, avg(thw) AS mean_thw, min(thw) AS min_thw FROM signals GROUP BY wid""", _STATS)
def signal_summary(spark, d):
    return windows.signal_summary(windows.replay_signals(_windows(spark, d)))


@query("minmax_fingerprint", f"""WITH {_SIGNALS}, s AS (SELECT wid // 1000000 AS scenario_id, wid, avg(speed) AS mean_speed, sqrt(avg(jerk * jerk)) AS rms_jerk, min(thw) AS min_thw FROM signals GROUP BY wid)
    SELECT scenario_id, wid, {', '.join(f'CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-8 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END AS {c}' for c in ('mean_speed', 'rms_jerk', 'min_thw'))} FROM s WINDOW w AS (PARTITION BY scenario_id)""", "mean_speed rms_jerk min_thw")
def minmax_fingerprint(spark, d):
    s = windows.signal_summary(windows.replay_signals(_windows(spark, d))).select(windows.scenario_of(F.col("wid")).alias("scenario_id"), "wid", "mean_speed", "rms_jerk", "min_thw")
    return evaluate.minmax(s, ["mean_speed", "rms_jerk", "min_thw"], "scenario_id")


@query("aligned_to_start", f"""WITH {sql.WINDOWS}, z AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, atan2(first_value(vy) OVER w, first_value(vx) OVER w) AS h FROM win WINDOW w AS (PARTITION BY wid ORDER BY i))
    SELECT wid, i, (x - x0) * cos(h) + (y - y0) * sin(h) AS ax, (y - y0) * cos(h) - (x - x0) * sin(h) AS ay FROM z""", "ax ay")
def aligned_to_start(spark, d):
    return windows.aligned_to_start(_windows(spark, d))


@query("legacy_features", f"""WITH {sql.WINDOWS}, a1 AS (SELECT *, sqrt(vx * vx + vy * vy) AS v, sqrt(fvx * fvx + fvy * fvy) AS fv, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) AS d FROM win),
    a2 AS (SELECT *, v - fv AS rel, coalesce(v - lag(v) OVER w, 0) AS a, coalesce(fv - lag(fv) OVER w, 0) AS fa, atan2(coalesce(y - lag(y) OVER w, 0), coalesce(x - lag(x) OVER w, 0)) AS turn, d / (v + 1e-3::DOUBLE) AS thw, v / (fv + 1e-3::DOUBLE) AS nrm FROM a1 WINDOW w AS (PARTITION BY wid ORDER BY i)),
    a3 AS (SELECT *, coalesce(a - lag(a) OVER w, 0) AS jerk, a - fa AS rel_acc, coalesce(turn - lag(turn) OVER w, 0) AS yaw, min(CASE WHEN fa < -0.5 THEN i END) OVER (PARTITION BY wid) AS fat FROM a2 WINDOW w AS (PARTITION BY wid ORDER BY i))
    SELECT wid, avg(rel) AS rel_speed_mean, stddev_pop(rel) AS rel_speed_std, avg((rel > 0)::INT::DOUBLE) AS rel_speed_pos_frac, avg(thw) AS thw_mean, stddev_pop(thw) AS thw_std, min(thw) AS thw_min, avg(jerk) AS jerk_mean, stddev_pop(jerk) AS jerk_std, quantile_cont(jerk, 0.95) AS jerk_p95,
    avg(rel_acc) AS rel_acc_mean, stddev_pop(rel_acc) AS rel_acc_std, coalesce(min(CASE WHEN a < -0.5 AND i >= fat AND i < fat + 10 THEN i - fat END), 0)::DOUBLE AS reaction_time, stddev_pop(yaw) AS yaw_std, count(*) FILTER (abs(yaw) > 0.1) AS lane_change_count, avg((abs(yaw) > 0.1)::INT::DOUBLE) AS lane_change_frac,
    avg(nrm) AS speed_norm_mean, stddev_pop(nrm) AS speed_norm_std, stddev_pop(v) AS speed_std, stddev_pop(a) AS acc_std, avg(v) AS speed_mean FROM a3 GROUP BY wid""", "rel_speed_mean rel_speed_std rel_speed_pos_frac thw_mean thw_std thw_min jerk_mean jerk_std jerk_p95 rel_acc_mean rel_acc_std reaction_time yaw_std lane_change_frac speed_norm_mean speed_norm_std speed_std acc_std speed_mean")
def legacy_features(spark, d):
    return features.legacy_features(_windows(spark, d))


@query("condition_vector", f"WITH {sql.CONDITIONS} SELECT * FROM cond", "speed_mean dist_mean vrel_mean cf_valid_frac")
def condition_vector(spark, d):
    return features.conditions(_kin(spark, d))


@query("cond_bucket_counts", f"WITH {sql.CONDITIONS} SELECT bucket, count(*) AS n FROM cond GROUP BY bucket")
def cond_bucket_counts(spark, d):
    return features.conditions(_kin(spark, d)).groupBy("bucket").agg(F.count("*").alias("n"))


_CORE = (*features.CORE, "cf_valid_frac")


@query("zscore_features", f"WITH {sql.CORE} SELECT wid, {', '.join(f'({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-6) AS {c}' for c in _CORE)} FROM core", " ".join(_CORE), digits=5)
def zscore_features(spark, d):
    return features.standardized(features.core_features(_kin(spark, d)), _CORE)


@query("nan_counts", f"""WITH {sql.KINEMATICS}, f AS (SELECT wid, count(*) FILTER (following) AS n FROM kin GROUP BY wid)
    SELECT unnest(['n_following', 'thw_p50', 'thw_p20', 'thw_iqr', 'v_rel_p50']) AS feature, unnest([0, m, m, m, m]) AS n_missing, n FROM (SELECT count(*) FILTER (n < 18) AS m, count(*) AS n FROM f)""")
def nan_counts(spark, d):
    return features.missing_counts(features.following_features(_kin(spark, d), LEAST), ("n_following", "thw_p50", "thw_p20", "thw_iqr", "v_rel_p50"))


@query("dataset_summary", f"""WITH {sql.KINEMATICS}, f AS (SELECT wid, {sql.SPLIT(chr(39) + 'scenario_' + chr(39) + ' || scenario_id')} AS split, avg(following::INT::DOUBLE) AS cf FROM kin GROUP BY wid, scenario_id)
    SELECT split, count(*) AS n_windows, avg(cf) AS cf_mean, quantile_cont(cf, 0.1) AS cf_p10, quantile_cont(cf, 0.5) AS cf_p50, quantile_cont(cf, 0.9) AS cf_p90 FROM f GROUP BY split""", "cf_mean cf_p10 cf_p50 cf_p90")
def dataset_summary(spark, d):
    rows = _kin(spark, d).groupBy("wid", "scenario_id").agg(F.avg(F.when(F.col("following"), 1.0).otherwise(0.0)).alias("cf"))
    rows = rows.withColumn("split", scalar.split_of(F.concat(F.lit("scenario_"), F.col("scenario_id").cast("string"))))
    p = lambda q: F.percentile("cf", F.lit(q))
    return rows.groupBy("split").agg(F.count("*").alias("n_windows"), F.avg("cf").alias("cf_mean"), p(0.1).alias("cf_p10"), p(0.5).alias("cf_p50"), p(0.9).alias("cf_p90"))


@query("md5_split", f"SELECT {sql.SPLIT('o_orderkey::VARCHAR')} AS split, count(*) AS n FROM orders GROUP BY 1")
def md5_split(spark, d):
    return tables.load(spark, d, "orders").groupBy(scalar.split_of(F.col("o_orderkey")).alias("split")).agg(F.count("*").alias("n"))


# neighbours and evaluation


@query("knn_cosine", f"WITH {sql.KNN(5, sql.COS('a.v', 'b.v'))} SELECT i, j, d, rank FROM near", "d")
def knn_cosine(spark, d):
    return _long(pairs.knn(_vectors(spark, d), 5))


@query("knn_l2", f"WITH {sql.KNN(5, 'list_distance(a.v, b.v)')} SELECT i, j, d, rank FROM near", "d")
def knn_l2(spark, d):
    return _long(pairs.knn(_vectors(spark, d), 5, "l2"))


@query("farthest_k", f"WITH {sql.KNN(5, 'list_distance(a.v, b.v)', 'DESC')} SELECT i, j, d, rank FROM near", "d")
def farthest_k(spark, d):
    return _long(pairs.knn(_vectors(spark, d), 5, "l2", farthest=True))


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


_RECALL = f"""{sql.KNN(10, sql.COS('a.v', 'b.v'))}, h AS (SELECT near.i, count(*) FILTER (x.label = y.label) AS same FROM near JOIN vectors x ON x.row_index = i JOIN vectors y ON y.row_index = j GROUP BY i),
    rec AS (SELECT v.row_index, v.label, CASE WHEN n_pos = 0 THEN 1 ELSE coalesce(h.same, 0) / least(10, n_pos)::DOUBLE END AS recall FROM (SELECT *, count(*) OVER (PARTITION BY label) - 1 AS n_pos FROM vectors) v LEFT JOIN h ON h.i = v.row_index)"""


@query("recall_at_k", f"WITH {_RECALL} SELECT row_index, label, recall FROM rec", "recall")
def recall_at_k(spark, d):
    return evaluate.recall_at_k(_vectors(spark, d), "label", 10)


@query("recall_by_label", f"WITH {_RECALL} SELECT label, count(*) AS n, avg(recall) AS recall FROM rec GROUP BY GROUPING SETS ((label), ())", "recall")
def recall_by_label(spark, d):
    return evaluate.recall_at_k(_vectors(spark, d), "label", 10).rollup("label").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"))


@query("label_centroids", f"WITH {sql.CENTROIDS} SELECT label, n, unnest(c) AS m, generate_subscripts(c, 1) - 1 AS pos FROM cents", "m")
def label_centroids(spark, d):
    return evaluate.centroids(_vectors(spark, d).where("split = 'train'"), "policy_id").select("label", "n", F.posexplode("centroid").alias("pos", "m")).withColumn("pos", F.col("pos").cast("bigint"))


def _predictions(spark, d):
    v = _vectors(spark, d)
    return evaluate.nearest_centroid(v.where("split = 'train'"), v.where("split <> 'train'"), "policy_id")


@query("nearest_centroid", f"WITH {sql.CENTROIDS} SELECT * FROM preds", "distance")
def nearest_centroid(spark, d):
    return _predictions(spark, d)


@query("centroid_accuracy", f"WITH {sql.CENTROIDS} SELECT label, count(*) AS n, avg((label = predicted)::INT::DOUBLE) AS accuracy FROM preds GROUP BY GROUPING SETS ((label), ())", "accuracy")
def centroid_accuracy(spark, d):
    return evaluate.accuracy(_predictions(spark, d))


@query("confusion", f"WITH {sql.CENTROIDS} SELECT label, predicted, count(*) AS n FROM preds GROUP BY ALL")
def confusion(spark, d):
    return evaluate.confusion(_predictions(spark, d))


@query("macro_f1", f"""WITH {sql.CENTROIDS}, k AS (SELECT label AS k FROM preds UNION SELECT predicted FROM preds),
    f AS (SELECT k, (SELECT count(*) FROM preds WHERE label = k AND predicted = k) AS tp, (SELECT count(*) FROM preds WHERE label = k) + (SELECT count(*) FROM preds WHERE predicted = k) AS sides FROM k)
    SELECT avg(coalesce(2.0::DOUBLE * tp / nullif(sides, 0), 0)) AS macro_f1, count(*) AS n_labels FROM f""", "macro_f1")
def macro_f1(spark, d):
    return evaluate.macro_f1(_predictions(spark, d))


@query("coverage", f"""WITH {sql.COUNTS}, s AS (SELECT source_index, count(*) AS e, sum(n) AS f, count(*) FILTER (n = 0) AS m, count(*) FILTER (n > 1) AS d, bool_and(n = 1) AS c FROM pc GROUP BY 1)
    SELECT count(*) AS n_sources, sum(e)::BIGINT AS n_expected, sum(f)::BIGINT AS n_found, count(*) FILTER (c) AS n_complete, sum(m)::BIGINT AS n_missing, sum(d)::BIGINT AS n_duplicate FROM s""")
def coverage(spark, d):
    return evaluate.coverage(_vectors(spark, d), _policies(spark))


@query("missing_pairs", f"WITH {sql.COUNTS} SELECT * FROM pc WHERE n = 0 ORDER BY source_index, policy_id LIMIT 50")
def missing_pairs(spark, d):
    return evaluate.first_pairs(_vectors(spark, d), _policies(spark), True)


@query("duplicate_pairs", f"WITH {sql.COUNTS} SELECT * FROM pc WHERE n > 1 ORDER BY source_index, policy_id LIMIT 50")
def duplicate_pairs(spark, d):
    return evaluate.first_pairs(_vectors(spark, d), _policies(spark), False)


@query("pairwise_policy_dist", f"WITH {sql.COMPLETE} SELECT * FROM dist", "d")
def pairwise_policy_dist(spark, d):
    return evaluate.pairwise_distances(_complete(spark, d), 3)


@query("pairwise_summary", f"WITH {sql.COMPLETE} SELECT pair, count(*) AS n, avg(d) AS mean, median(d) AS median FROM dist GROUP BY pair", "mean median")
def pairwise_summary(spark, d):
    return evaluate.pairwise_distances(_complete(spark, d), 3).groupBy("pair").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"))


@query("pairwise_first_of_duplicates", f"""WITH {sql.VECTORS}, f AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY source_index, policy_id ORDER BY row_index) = 1), c AS (SELECT source_index FROM f GROUP BY 1 HAVING count(*) = 3)
    SELECT a.source_index, 'p' || a.policy_id || '_vs_p' || b.policy_id AS pair, list_distance(a.v, b.v) AS d FROM f a JOIN f b ON a.source_index = b.source_index AND a.policy_id < b.policy_id WHERE a.source_index IN (SELECT source_index FROM c)""", "d")
def pairwise_first_of_duplicates(spark, d):
    return evaluate.pairwise_distances(_vectors(spark, d), 3)


@query("within_source_margin", f"WITH {sql.COMPLETE} SELECT a.row_index, count(*) AS n, max(list_distance(a.v, b.v)) - min(list_distance(a.v, b.v)) AS margin FROM vectors a JOIN vectors b ON a.source_index = b.source_index AND a.row_index <> b.row_index GROUP BY a.row_index", "margin")
def within_source_margin(spark, d):
    return evaluate.within_source_margin(_complete(spark, d))


@query("retrieval_applicable", f"WITH {sql.VECTORS} SELECT bool_or(n > 1) AS applicable FROM (SELECT count(*) AS n FROM vectors GROUP BY source_index, policy_id)")
def retrieval_applicable(spark, d):
    return evaluate.retrieval_applicable(_vectors(spark, d)).select("applicable")


@query("spearman_quantity_price", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
    SELECT count(*) AS n, covar_pop(a, b) * count(*) / (sqrt(var_pop(a) * count(*)) * sqrt(var_pop(b) * count(*)) + 1e-12) AS spearman FROM r""", "spearman")
def spearman_quantity_price(spark, d):
    return evaluate.spearman(tables.load(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("spearman_by_flag", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0::DOUBLE AS b FROM lineitem)
    SELECT l_returnflag, count(*) AS n, covar_pop(a, b) * count(*) / (sqrt(var_pop(a) * count(*)) * sqrt(var_pop(b) * count(*)) + 1e-12) AS spearman FROM r GROUP BY l_returnflag""", "spearman")
def spearman_by_flag(spark, d):
    return evaluate.spearman(tables.load(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), "l_quantity", "l_discount", "l_returnflag")


@query("regression_metrics", "SELECT count(*) AS n, 1 - sum((o_totalprice - p) * (o_totalprice - p)) / (var_pop(o_totalprice) * count(*)) AS r2, sqrt(avg((o_totalprice - p) * (o_totalprice - p))) AS rmse FROM (SELECT o_totalprice, 1000.0::DOUBLE * (o_custkey % 100) AS p FROM orders)", "r2 rmse", digits=4)
def regression_metrics(spark, d):
    return evaluate.regression_metrics(tables.load(spark, d, "orders").select("o_totalprice", (1000.0 * (F.col("o_custkey") % 100)).alias("p")), "o_totalprice", "p")


@query("group_size_histogram", "SELECT group_size, count(*) AS n_groups FROM (SELECT o_custkey, count(*) AS group_size FROM orders GROUP BY 1) GROUP BY 1")
def group_size_histogram(spark, d):
    return evaluate.group_size_histogram(tables.load(spark, d, "orders"), "o_custkey")


@query("dense_group_index", "SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS number FROM orders")
def dense_group_index(spark, d):
    return metadata.dense_numbers(tables.load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("policy_by_row_order", "SELECT vec_id AS row_index, vec_id // 4 AS source_key, CASE WHEN min(n) OVER () = max(n) OVER () THEN row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) - 1 END AS policy_id FROM (SELECT vec_id, count(*) OVER (PARTITION BY vec_id // 4) AS n FROM embeddings)")
def policy_by_row_order(spark, d):
    return metadata.infer_policy(tables.load(spark, d, "embeddings").select(F.col("vec_id").alias("row_index"), F.expr("vec_id div 4").alias("source_key")))


@query("label_names", "SELECT c_nationkey::BIGINT AS policy_id, coalesce(arg_min(c_mktsegment, c_custkey) FILTER (c_acctbal > 0), 'policy_' || c_nationkey) AS policy_name FROM customer GROUP BY c_nationkey")
def label_names(spark, d):
    rows = tables.load(spark, d, "customer").select(F.col("c_custkey").alias("row_index"), F.col("c_nationkey").cast("bigint").alias("policy_id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("policy_name"))
    return metadata.first_names(rows)


@query("neighbor_consistency", f"""WITH {sql.KNN(5, sql.COS('a.v', 'b.v'))},
    ring AS (SELECT row_index AS i, row_number() OVER (ORDER BY row_index) - 1 AS pos, count(*) OVER () - 1 AS others, cast('0x' || substr(md5(row_index::VARCHAR), 1, 15) AS BIGINT) AS skip FROM vectors),
    places AS (SELECT i, (pos + 1 + (skip + m * greatest(others // 5, 1)) % others) % (others + 1) AS pos FROM (SELECT *, unnest(range(0, least(5, others))) AS m FROM ring)),
    drawn AS (SELECT p.i, r.i AS j FROM places p JOIN ring r USING (pos)),
    x AS (SELECT row_index, 'label' AS feature, label::DOUBLE AS x FROM vectors UNION ALL SELECT row_index, 'first', v[1] FROM vectors),
    e AS (SELECT n.i, a.feature, avg(abs(a.x - b.x)) AS e FROM near n JOIN x a ON a.row_index = n.i JOIN x b ON b.row_index = n.j AND b.feature = a.feature GROUP BY ALL),
    r AS (SELECT n.i, a.feature, avg(abs(a.x - b.x)) AS r FROM drawn n JOIN x a ON a.row_index = n.i JOIN x b ON b.row_index = n.j AND b.feature = a.feature GROUP BY ALL),
    q AS (SELECT feature, e / greatest(r, 1e-3) AS ratio FROM e JOIN r USING (i, feature)), t AS (SELECT feature, quantile_cont(ratio, 0.99) AS top FROM q GROUP BY 1)
    SELECT feature, count(*) AS n, avg(greatest(0, least(ratio, top))) AS ratio_mean, median(greatest(0, least(ratio, top))) AS ratio_median FROM q JOIN t USING (feature) GROUP BY feature""", "ratio_mean ratio_median")
def neighbor_consistency(spark, d):
    v = _vectors(spark, d)
    x = v.select("row_index", F.explode(F.create_map(F.lit("label"), F.col("label").cast("double"), F.lit("first"), F.get("embedding", F.lit(0)))).alias("feature", "x"))
    return evaluate.neighbor_consistency(v, x, 5)


@query("clustering_metrics", f"""WITH {sql.VECTORS}, parts AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vectors), m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM parts GROUP BY ALL),
    c AS (SELECT label, n, list(m ORDER BY pos) AS c FROM m GROUP BY label, n), g AS (SELECT list(m ORDER BY pos) AS g FROM (SELECT pos, avg(x) AS m FROM parts GROUP BY pos)),
    s AS (SELECT v.label, avg(list_distance(v.v, c.c)) AS s, sum(pow(list_distance(v.v, c.c), 2)) AS w FROM vectors v JOIN c USING (label) GROUP BY 1), p AS (SELECT * FROM s JOIN c USING (label)),
    w AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM p a JOIN p b ON a.label <> b.label GROUP BY a.label)
    SELECT sum(n)::BIGINT AS n, count(*) AS k, sum(n * pow(list_distance(c, (SELECT g FROM g)), 2)) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)) AS calinski_harabasz, (SELECT avg(r) FROM w) AS davies_bouldin FROM p""", "calinski_harabasz davies_bouldin")
def clustering_metrics(spark, d):
    return evaluate.clustering_metrics(_vectors(spark, d), "label")


@query("silhouette", f"""WITH {sql.VECTORS}, m AS (SELECT a.row_index, a.label AS own, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM vectors a JOIN vectors b ON a.row_index <> b.row_index GROUP BY ALL),
    s AS (SELECT row_index, min(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM m GROUP BY 1) SELECT row_index, coalesce((b - a) / greatest(a, b), 0) AS silhouette FROM s""", "silhouette")
def silhouette(spark, d):
    return evaluate.silhouette(_vectors(spark, d), "label")


# gates, targets and losses


@query("cond_box_join", f"WITH {sql.CONDITIONS} SELECT a.wid AS i, b.wid AS j FROM cond a JOIN cond b ON a.wid <> b.wid AND a.bucket = b.bucket AND abs(a.speed_mean - b.speed_mean) <= 2 AND abs(a.dist_mean - b.dist_mean) <= 5 AND abs(a.vrel_mean - b.vrel_mean) <= 1")
def cond_box_join(spark, d):
    return pairs.box_pairs(features.conditions(_kin(spark, d)))


_MED = lambda c: f"quantile_disc({c}, 0.5)"


_SCALED = {c: f"{c} / s_{c}" for c in ("speed_mean", "dist_mean", "vrel_mean")}


@query("cond_knn_join", f"""WITH {sql.CONDITIONS}, m AS (SELECT {', '.join(f'{_MED(c)} AS m_{c}' for c in _SCALED)} FROM cond),
    s AS (SELECT {', '.join(f'greatest({_MED(f"abs({c} - m_{c})")}, 1e-6) AS s_{c}' for c in _SCALED)} FROM cond, m),
    z AS (SELECT wid, bucket, {', '.join(f'{e} AS z_{c}' for c, e in _SCALED.items())} FROM cond, s),
    p AS (SELECT x.wid AS i, y.wid AS j, sqrt({' + '.join(f'(x.z_{c} - y.z_{c}) * (x.z_{c} - y.z_{c})' for c in _SCALED)}) AS d
        FROM z x JOIN z y ON x.bucket = y.bucket AND x.wid <> y.wid),
    n AS (SELECT i, count(*) AS n, sum(d) AS total FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) <= 5) GROUP BY i),
    o AS (SELECT count(*) - 1 AS others FROM cond)
    SELECT c.wid AS i, coalesce(n.n, o.others) AS n, n.total, n.i IS NULL AS fallback FROM cond c CROSS JOIN o LEFT JOIN n ON n.i = c.wid WHERE o.others > 0""", "total", digits=4)
def cond_knn_join(spark, d):
    return pairs.condition_knn(features.conditions(_kin(spark, d)), 5).groupBy("i", "fallback").agg(F.count("*").alias("n"), F.sum("d").alias("total"))


@query("cond_fallback", f"""WITH {sql.CONDITIONS}, c AS (SELECT wid AS row_index, wid // 1000000 // 10 AS scope, * FROM cond), g AS (SELECT a.row_index AS i, b.row_index AS j FROM c a JOIN c b ON a.row_index <> b.row_index AND a.scope = b.scope AND a.bucket = b.bucket AND abs(a.speed_mean - b.speed_mean) <= 0.5 AND abs(a.dist_mean - b.dist_mean) <= 5 AND abs(a.vrel_mean - b.vrel_mean) <= 1),
    n AS (SELECT i, count(*) AS n FROM g GROUP BY i HAVING count(*) >= 8) SELECT c.row_index AS i, n.i IS NULL AS fallback, coalesce(n.n, (SELECT count(*) FROM c y WHERE y.scope = c.scope AND y.row_index <> c.row_index)) AS n_candidates FROM c LEFT JOIN n ON n.i = c.row_index""")
def cond_fallback(spark, d):
    cond = features.conditions(_kin(spark, d)).withColumn("scope", F.call_function("div", windows.scenario_of(F.col("wid")), F.lit(10)))
    # a row for each window, read by the gate and by the fallback: else both would make all windows from their frames
    cond = stored(cond.select("scope", "bucket", "wid", "speed_mean", "dist_mean", "vrel_mean"))
    rows = cond.select("scope", F.col("wid").alias("row_index"))
    box = pairs.box_pairs(cond, speed=0.5, scope="scope")
    gated = pairs.with_fallback(box, rows, 8).groupBy("i", "fallback").agg(F.count("*").alias("n_candidates"))
    return gated


@query("local_scale_sigma", f"WITH {sql.SIGMA} SELECT * FROM sigma", "sigma")
def local_scale_sigma(spark, d):
    return pairs.local_scales(pairs.scoped_pairs(_vectors(spark, d)))


@query("soft_targets", f"WITH {sql.TARGETS} SELECT i, j, p FROM targets", "p")
def soft_targets(spark, d):
    return pairs.soft_targets(pairs.kernel_logits(pairs.scoped_pairs(_vectors(spark, d)))).select("i", "j", "p")


@query("kernel_sym_tau", f"""WITH {sql.SIGMA}, tau AS (SELECT scope, greatest(quantile_disc(d, 0.5), 1e-3) AS tau FROM pairs GROUP BY scope)
    SELECT p.i, avg(-(p.d * p.d) / (a.sigma * b.sigma + 1e-8)) AS sym, avg(-p.d / tau.tau) AS tau FROM pairs p JOIN sigma a ON a.i = p.i JOIN sigma b ON b.i = p.j JOIN tau USING (scope) GROUP BY p.i""", "sym tau")
def kernel_sym_tau(spark, d):
    p = pairs.scoped_pairs(_vectors(spark, d))
    sym = pairs.kernel_logits(p, "sym").groupBy("i").agg(F.avg("logit").alias("sym"))
    return sym.join(pairs.kernel_logits(p, "tau").groupBy("i").agg(F.avg("logit").alias("tau")), "i")


@query("entropy_effk", f"WITH {sql.TARGETS} SELECT i, -sum(p * ln(p + 1e-8)) AS entropy, 1 / (sum(p * p) + 1e-8) AS effective_k FROM targets GROUP BY i", "entropy effective_k")
def entropy_effk(spark, d):
    return pairs.spread(pairs.soft_targets(pairs.kernel_logits(pairs.scoped_pairs(_vectors(spark, d)))))


_SIMS = f"""sims AS (SELECT a.scope, a.row_index AS i, b.row_index AS j, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) / 0.1 AS s, a.label = b.label AS pos FROM vectors a JOIN vectors b ON a.scope = b.scope)"""


@query("infonce_by_label", f"WITH {sql.VECTORS}, {_SIMS}, t AS (SELECT *, max(s) OVER (PARTITION BY i) AS m FROM sims WHERE i <> j) SELECT i, ln(sum(exp(s - m))) - ln(sum(exp(s - m)) FILTER (pos)) AS loss FROM t GROUP BY i HAVING count(*) FILTER (pos) > 0", "loss")
def infonce_by_label(spark, d):
    v = _vectors(spark, d)
    a = v.select("scope", "label", F.col("row_index").alias("i"))
    positives = a.join(v.select("scope", "label", F.col("row_index").alias("j")), ["scope", "label"]).where("i <> j")
    return pairs.infonce(pairs.similarities(v, 0.1), positives)


@query("soft_kl", f"""WITH {sql.TARGETS}, {_SIMS}, t AS (SELECT *, max(s) OVER (PARTITION BY i) AS m FROM sims), q AS (SELECT i, j, s - m - ln(sum(exp(s - m)) OVER (PARTITION BY i)) AS lq FROM t)
    SELECT i, -sum(p * lq) AS loss FROM q JOIN targets USING (i, j) GROUP BY i""", "loss")
def soft_kl(spark, d):
    v = _vectors(spark, d)
    return pairs.soft_kl(pairs.similarities(v, 0.1, keep_self=True), pairs.soft_targets(pairs.kernel_logits(pairs.scoped_pairs(v))))


@query("supcon", f"""WITH {sql.SCOPED}, {_SIMS}, r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5 AS pos FROM pairs), t AS (SELECT s.i, s.s, r.pos, max(s.s) OVER (PARTITION BY s.i) AS m FROM sims s JOIN r USING (i, j))
    SELECT i, ln(sum(exp(s - m))) - ln(sum(exp(s - m)) FILTER (pos)) AS loss FROM t GROUP BY i""", "loss")
def supcon(spark, d):
    v = _vectors(spark, d)
    return pairs.supcon(pairs.similarities(v, 0.1), pairs.scoped_pairs(v), 5)


@query("masked_l2", f"""WITH {sql.VECTORS}, m AS (SELECT *, list_transform(v, lambda x, k: CASE WHEN (row_index + k - 1) % 5 <> 0 THEN x END) AS u FROM vectors),
    p AS (SELECT a.row_index AS i, b.row_index AS j, list_filter(list_transform(range(1, len(a.u) + 1), lambda k: (a.u[k] - b.u[k]) * (a.u[k] - b.u[k])), lambda x: x IS NOT NULL) AS s FROM m a JOIN m b ON a.scope = b.scope AND a.row_index <> b.row_index)
    SELECT i, j, len(s) AS common, list_sum(s) / greatest(len(s), 1) AS d FROM p""", "d")
def masked_l2(spark, d):
    v = _vectors(spark, d).withColumn("u", F.transform("embedding", lambda x, k: F.when((F.col("row_index") + k) % 5 != 0, x)))
    both = v.select("scope", F.col("row_index").alias("i"), F.col("u").alias("a")).join(v.select("scope", F.col("row_index").alias("j"), F.col("u").alias("b")), "scope").where("i <> j")
    return both.select("i", "j", scalar.common_dims(F.col("a"), F.col("b")).cast("bigint").alias("common"), scalar.masked_mean_square(F.col("a"), F.col("b")).alias("d"))


@query("unit_vectors", f"WITH {sql.VECTORS} SELECT row_index, unnest(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))) AS x, generate_subscripts(v, 1) - 1 AS pos FROM vectors", "x")
def unit_vectors(spark, d):
    v = _vectors(spark, d).withColumn("n", F.sqrt(scalar.dot(F.col("embedding"), F.col("embedding"))))
    return v.select("row_index", F.posexplode("embedding").alias("pos", "x"), "n").select("row_index", (F.col("x") / F.greatest("n", F.lit(1e-12))).alias("x"), F.col("pos").cast("bigint").alias("pos"))


@query("sanitized_gap", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 10 > 1 THEN ln(1 + least(l_quantity - 10, 30.0::DOUBLE)) END AS d0 FROM lineitem", "d0")
def sanitized_gap(spark, d):
    return tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.sanitized_gap(F.col("l_quantity") - 10, 1.0, 30.0).alias("d0"))


@query("lower_median", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS low, median(l_extendedprice) AS middle, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY 1", "low middle iqr")
def lower_median(spark, d):
    r, price = tables.load(spark, d, "lineitem"), F.col("l_extendedprice")
    ends = {"low": (price, 0.5), "middle": (price, 0.5), "upper": (price, 0.75), "under": (price, 0.25)}
    found = selection.quantiles(r, ends, ("l_returnflag",), discrete=("low",))
    return found.select("l_returnflag", "low", "middle", (F.col("upper") - F.col("under")).alias("iqr"))


@query("imputed_minimum", "SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value END, min(value) FILTER (event_type <> 'error') OVER (), 0) AS value FROM events", "value")
def imputed_minimum(spark, d):
    e = tables.load(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    low = e.agg(F.min("value").alias("low"))
    return e.crossJoin(F.broadcast(low)).select("event_id", F.coalesce("value", "low", F.lit(0.0)).alias("value"))


# retrieval


def _retrieval_rows(spark, d):
    return _vectors(spark, d).withColumn("scenario_id", F.col("row_index") % 20)


_QUERY = f"""{sql.VECTORS}, c AS (SELECT v.row_index, v.policy_id, v.source_index, v.row_index % 20 AS scenario_id, {sql.COS('v.v', 'q.v')} AS distance FROM vectors v, (SELECT * FROM vectors WHERE row_index = 40) q WHERE v.row_index <> 40)"""


@query("retrieve_topk", f"WITH {_QUERY} SELECT row_index, policy_id, distance, false AS excluded, row_number() OVER (ORDER BY distance, row_index) AS rank FROM c ORDER BY distance, row_index LIMIT 5", "distance")
def retrieve_topk(spark, d):
    return _long(retrieve.retrieve(_retrieval_rows(spark, d), 40, 5).select("row_index", "policy_id", "distance", "excluded", "rank"))


@query("retrieve_exclude", f"""WITH {_QUERY}, x AS (SELECT row_index, distance, scenario_id = 0 AS s, source_index = 13 AS o FROM c), t AS (SELECT row_index, distance, false AS excluded, '' AS exclude_reason, row_number() OVER (ORDER BY distance, row_index) AS rank FROM x WHERE NOT s AND NOT o ORDER BY distance, row_index LIMIT 5)
    SELECT * FROM t UNION ALL SELECT row_index, distance, true, concat_ws(';', CASE WHEN s THEN 'same_scenario' END, CASE WHEN o THEN 'same_source' END), NULL FROM x WHERE s OR o""", "distance")
def retrieve_exclude(spark, d):
    rules = {"same_scenario": F.col("scenario_id") == F.col("q_scenario_id"), "same_source": F.col("source_index") == F.col("q_source_index")}
    return _long(retrieve.retrieve(_retrieval_rows(spark, d), 40, 5, exclude=rules).select("row_index", "distance", "excluded", "exclude_reason", "rank"))


@query("within_source_retrieve", f"WITH {sql.VECTORS} SELECT v.row_index, list_distance(v.v, q.v) AS distance, row_number() OVER (ORDER BY list_distance(v.v, q.v), v.row_index) AS rank FROM vectors v, (SELECT * FROM vectors WHERE row_index = 40) q WHERE v.row_index <> 40 AND v.source_index = q.source_index", "distance")
def within_source_retrieve(spark, d):
    return _long(retrieve.retrieve(_retrieval_rows(spark, d), 40, 5, "euclidean", within=("source_index",)).select("row_index", "distance", "rank"))


@query("hit_at_k", f"WITH {_QUERY}, t AS (SELECT policy_id, row_number() OVER (ORDER BY distance, row_index) AS rank FROM c ORDER BY distance, row_index LIMIT 5) SELECT bool_or(policy_id = q AND rank = 1) AS hit_at_1, bool_or(policy_id = q) AS hit_at_k, count(*) FILTER (policy_id = q) AS n_same, count(*) AS n FROM t, (SELECT policy_id AS q FROM vectors WHERE row_index = 40)")
def hit_at_k(spark, d):
    rows = _retrieval_rows(spark, d)
    own = rows.where("row_index = 40").select("policy_id").first()
    return retrieve.hits(retrieve.retrieve(rows, 40, 5), own and own["policy_id"]).drop("reason")


@query("best_hit_case", f"""WITH {sql.KNN(5, sql.COS('a.v', 'b.v'))}, h AS (SELECT i, count(*) FILTER (x.policy_id = y.policy_id) AS hits FROM near JOIN vectors x ON x.row_index = i JOIN vectors y ON y.row_index = j GROUP BY i)
    SELECT i AS row_index, hits FROM h ORDER BY hits DESC, i DESC LIMIT 1""")
def best_hit_case(spark, d):
    v = _vectors(spark, d)
    return retrieve.best_hit_case(pairs.knn(v, 5), v)


@query("best_separation_case", f"""WITH {sql.COMPLETE}, s AS (SELECT source_index, least(max(d) FILTER (pair = 'p0_vs_p2'), max(d) FILTER (pair = 'p1_vs_p2')) AS separation FROM dist GROUP BY 1)
    SELECT * FROM s ORDER BY separation DESC, source_index LIMIT 1""", "separation")
def best_separation_case(spark, d):
    return retrieve.best_separation_case(evaluate.pairwise_distances(_complete(spark, d), 3))


@query("interpretation", f"""WITH {sql.COMPLETE}, s AS (SELECT source_index, arg_min(pair, (round(d, 12), pair)) AS nearest, arg_min(pair, (-round(d, 12), pair)) AS farthest FROM dist GROUP BY 1)
    SELECT *, NOT contains(nearest, 'p2') AS p2_farthest FROM s""")
def interpretation(spark, d):
    return retrieve.interpretation(evaluate.pairwise_distances(_complete(spark, d), 3))


@query("distance_matrix", f"WITH {sql.COMPLETE} SELECT a.row_index AS i, b.row_index AS j, list_distance(a.v, b.v) AS d FROM vectors a JOIN vectors b ON a.source_index = 7 AND b.source_index = 7", "d")
def distance_matrix(spark, d):
    return retrieve.distance_matrix(_complete(spark, d), "source_index", 7)


@query("combined_score", f"""WITH {sql.COMPLETE}, s AS (SELECT source_index, min(d) AS low, max(d) AS high FROM dist GROUP BY 1)
    SELECT source_index, low, high, (low - min(low) OVER ()) / (max(low) OVER () - min(low) OVER ()) + (high - min(high) OVER ()) / (max(high) OVER () - min(high) OVER ()) AS score FROM s""", "low high score")
def combined_score(spark, d):
    s = evaluate.pairwise_distances(_complete(spark, d), 3).groupBy("source_index").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return retrieve.combined_score(s, ["low", "high"])


@query("replacement_query", f"WITH {sql.VECTORS}, s AS (SELECT source_index, min(row_index) AS row_index, count(DISTINCT policy_id) AS p, count(*) AS n FROM vectors GROUP BY 1) SELECT source_index, row_index FROM s WHERE p >= 3 OR n >= 3 ORDER BY p < 3, source_index LIMIT 1")
def replacement_query(spark, d):
    return retrieve.replacement_query(_vectors(spark, d))


@query("rollout_meta")
def rollout_meta(spark, d):
    return rollouts.rollout_meta(windows.window_rows(_windows(spark, d)), rollouts.policy_table(spark))


# iterative operators: tested against plain code


@query("policy_rollout")
def policy_rollout(spark, d):
    return rollouts.simulate(_windows(spark, d), rollouts.policy_table(spark))


@query("rollout_kinematics")
def rollout_kinematics(spark, d):
    return rollouts.kinematics_report(rollouts.simulate(_windows(spark, d), rollouts.policy_table(spark)))


@query("pca_projection")
def pca_projection(spark, d):
    return learn.pca(_vectors(spark, d))[0].select("row_index", F.abs(F.get("projection", F.lit(0))).alias("p0"), F.abs(F.get("projection", F.lit(1))).alias("p1"))


@query("kmeans")
def kmeans(spark, d):
    return learn.kmeans(_vectors(spark, d), 10)


@query("logreg")
def logreg(spark, d):
    v = _vectors(spark, d)
    return learn.policy_classifier(v.where("split = 'train'"), v.where("split <> 'train'"))


@query("probe")
def probe(spark, d):
    v = _vectors(spark, d).withColumn("y", F.col("label").cast("double"))
    return learn.probe(v.where("split = 'train'"), v.where("split <> 'train'"), "y", ridge=1.0)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["lead_vehicle"](spark, sf_dir)


from . import reports  # noqa: E402, F401  (registers its queries)

__all__ = ["ORACLES", "QUERIES", "entry"]
