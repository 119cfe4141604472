"""More named queries: gates and losses, evaluation views, case choice, and report tables, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import evaluate, features, learn, pairs, retrieve, windows
from ..sources import metadata, tables
from . import sql
from .queries import _QUERY, _SIGNALS, _SIMS, LEAST, _complete, _kin, _long, _retrieval_rows, _tracks, _vectors, _windows
from .registry import query

# gates, targets and losses


@query("gate_topm", f"WITH {sql.SCOPED} SELECT scope, i, j, d FROM pairs QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 16", "d")
def gate_topm(spark, d):
    return pairs.gate_top(pairs.scoped_pairs(_vectors(spark, d)), 16)


@query("uniform_targets", f"""WITH {sql.SCOPED}, g AS (SELECT * FROM pairs WHERE (i + j) % 7 = 0 AND i % 5 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn, count(*) OVER (PARTITION BY i) AS n FROM g), s AS (SELECT i, greatest(d, 1e-3) AS sigma FROM r WHERE rn = least(7, n)),
    e AS (SELECT g.i, g.j, -g.d / s.sigma AS l FROM g JOIN s USING (i)), f AS (SELECT *, exp(l - max(l) OVER (PARTITION BY i)) AS e FROM e), h AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS q FROM f)
    SELECT i, j, q / (sum(q) OVER (PARTITION BY i) + 1e-8) AS p FROM h
    UNION ALL SELECT i, j, 1.0::DOUBLE / (n - 1) AS p FROM pairs JOIN (SELECT scope, count(*) AS n FROM vectors GROUP BY 1) USING (scope) WHERE i NOT IN (SELECT i FROM g)""", "p")
def uniform_targets(spark, d):
    v = _vectors(spark, d)
    gated = pairs.scoped_pairs(v).where("(i + j) % 7 = 0 AND i % 5 <> 0")
    return pairs.uniform_rows(pairs.soft_targets(pairs.kernel_logits(gated)), v)


@query("kernel_anchor_tau", f"WITH {sql.SCOPED} SELECT i, avg(-d / tau) AS logit FROM pairs JOIN (SELECT i, greatest(quantile_disc(d, 0.5), 1e-3) AS tau FROM pairs GROUP BY i) USING (i) GROUP BY i", "logit")
def kernel_anchor_tau(spark, d):
    return pairs.kernel_logits(pairs.scoped_pairs(_vectors(spark, d)), "anchor_tau").groupBy("i").agg(F.avg("logit").alias("logit"))


@query("common_dim_stats", f"""WITH {sql.VECTORS}, m AS (SELECT scope, row_index, list_transform(v, lambda x, k: (row_index * k) % 5 <> 0) AS u FROM vectors),
    p AS (SELECT a.scope, len(list_filter(range(1, len(a.u) + 1), lambda k: a.u[k] AND b.u[k])) AS c FROM m a JOIN m b ON a.scope = b.scope AND a.row_index <> b.row_index)
    SELECT scope, avg(c) AS mean, quantile_cont(c, 0.1) AS p10, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.9) AS p90 FROM p GROUP BY scope""", "mean p10 p50 p90")
def common_dim_stats(spark, d):
    v = _vectors(spark, d).withColumn("u", F.transform("embedding", lambda x, k: F.when((F.col("row_index") * (k + 1)) % 5 != 0, x)))
    both = v.select("scope", F.col("row_index").alias("i"), F.col("u").alias("a")).join(v.select("scope", F.col("row_index").alias("j"), F.col("u").alias("b")), "scope").where("i <> j")
    return pairs.common_dim_stats(both.withColumn("common", scalar.common_dims(F.col("a"), F.col("b"))))


@query("batch_std_norm", f"""WITH {sql.VECTORS}, parts AS (SELECT scope, row_index, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM vectors),
    n AS (SELECT row_index, pos, (x - avg(x) OVER w) / (coalesce(stddev_samp(x) OVER w, 0) + 1e-6) AS x FROM parts WINDOW w AS (PARTITION BY scope, pos))
    SELECT row_index, pos, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, x)) AS x FROM n""", "x")
def batch_std_norm(spark, d):
    n = pairs.normalized(_vectors(spark, d), "batch_std", 2.0).select("row_index", F.posexplode("embedding").alias("pos", "x"))
    return n.withColumn("pos", F.col("pos").cast("bigint"))


@query("hybrid_loss", f"""WITH {sql.TARGETS}, {_SIMS}, t AS (SELECT *, max(s) OVER (PARTITION BY i) AS m FROM sims), q AS (SELECT i, j, s - m - ln(sum(exp(s - m)) OVER (PARTITION BY i)) AS lq FROM t),
    a AS (SELECT i, -sum(p * lq) AS loss FROM q JOIN targets USING (i, j) GROUP BY i), r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5 AS pos FROM pairs),
    u AS (SELECT s.i, s.s, r.pos, max(s.s) OVER (PARTITION BY s.i) AS m FROM sims s JOIN r USING (i, j)), b AS (SELECT i, ln(sum(exp(s - m))) - ln(sum(exp(s - m)) FILTER (pos)) AS loss FROM u GROUP BY i)
    SELECT scope, soft, sup, 0.7 * soft + 0.3 * sup AS loss FROM (SELECT i // 64 AS scope, avg(loss) AS soft FROM a GROUP BY 1) JOIN (SELECT i // 64 AS scope, avg(loss) AS sup FROM b GROUP BY 1) USING (scope)""", "soft sup loss")
def hybrid_loss(spark, d):
    v = _vectors(spark, d)
    # one join of the vectors, and one shuffle of their pairs, for both losses
    near = pairs.similarities(pairs.scoped_pairs(v, ends=True), 0.1, keep_self=True, paired=True)
    soft = pairs.soft_kl(pairs.soft_targets(pairs.kernel_logits(near)))
    return pairs.hybrid(soft, pairs.supcon(near, None, 5), v, 0.7, 0.3)


# evaluation


@query("feature_names", """SELECT name, count(*) AS n FROM (SELECT CASE o_custkey % 20 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 3 THEN 'thw_mean' WHEN 8 THEN 'jerk_p95' WHEN 15 THEN 'speed_norm' ELSE 'feature_' || (o_custkey % 20) END AS name FROM orders) GROUP BY 1""")
def feature_names(spark, d):
    name = metadata.feature_name(F.col("o_custkey") % 20, ["alpha", "beta"])
    return tables.load(spark, d, "orders").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("evaluation_views", f"WITH {sql.VECTORS} SELECT row_index, 'train' AS role FROM vectors WHERE split = 'train' UNION ALL SELECT row_index, 'eval' FROM vectors WHERE split = 'val'")
def evaluation_views(spark, d):
    return evaluate.evaluation_views(_vectors(spark, d), "val")


@query("evaluation_holdout", "SELECT vec_id AS row_index, CASE WHEN cast('0x' || substr(md5('holdout_' || vec_id), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.3 THEN 'eval' ELSE 'train' END AS role FROM embeddings")
def evaluation_holdout(spark, d):
    return evaluate.evaluation_views(_vectors(spark, d), holdout=0.3)


@query("neighbor_consistency_cond", f"""WITH {sql.VECTORS}, x AS (SELECT scope, row_index, policy_id, v, 'f0' AS feature, v[1] AS x FROM vectors UNION ALL SELECT scope, row_index, policy_id, v, 'f1', v[2] FROM vectors WHERE v[2] > -0.05),
    g AS (SELECT a.row_index AS i, a.feature, count(b.row_index) AS n FROM x a LEFT JOIN x b ON a.scope = b.scope AND a.feature = b.feature AND a.policy_id = b.policy_id AND a.row_index <> b.row_index GROUP BY ALL),
    p AS (SELECT a.row_index AS i, b.row_index AS j, a.feature, abs(a.x - b.x) AS gap, round({sql.COS('a.v', 'b.v')}, 12) AS d FROM x a JOIN g ON g.i = a.row_index AND g.feature = a.feature
        JOIN x b ON a.scope = b.scope AND a.feature = b.feature AND a.row_index <> b.row_index AND (g.n < 16 OR a.policy_id = b.policy_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY i, feature ORDER BY d, j) AS a, row_number() OVER (PARTITION BY i, feature ORDER BY md5(i || '-' || j), j) AS b FROM p),
    q AS (SELECT i, feature, avg(gap) FILTER (a <= 5) / greatest(avg(gap) FILTER (b <= 5), 1e-3) AS ratio FROM r GROUP BY ALL),
    t AS (SELECT feature, quantile_cont(ratio, 0.99) AS hi FROM q GROUP BY 1), u AS (SELECT feature, greatest(0, least(ratio, hi)) AS z FROM q JOIN t USING (feature)),
    c AS (SELECT feature, count(*) AS n, avg(n) AS mean_cond_candidates, avg((n < 16)::INT::DOUBLE) AS frac_fallback FROM g GROUP BY 1)
    SELECT c.feature, c.n, avg(z) AS ratio_mean, median(z) AS ratio_median, c.mean_cond_candidates, c.frac_fallback, 'ok' AS note FROM u JOIN c USING (feature) GROUP BY ALL""", "ratio_mean ratio_median mean_cond_candidates frac_fallback")
def neighbor_consistency_cond(spark, d):
    v = _vectors(spark, d)
    f1 = F.when(F.get("embedding", F.lit(1)) > -0.05, F.get("embedding", F.lit(1)))
    xs = v.select("row_index", F.explode(F.array(F.struct(F.lit("f0").alias("feature"), F.get("embedding", F.lit(0)).alias("x")), F.struct(F.lit("f1").alias("feature"), f1.alias("x")))).alias("f")).select("row_index", "f.*")
    a = v.select("scope", "policy_id", F.col("row_index").alias("i"))
    gate = a.join(v.select("scope", "policy_id", F.col("row_index").alias("j")), ["scope", "policy_id"]).where("i <> j")
    return evaluate.conditioned_consistency(v, xs, gate, 5, 16)


@query("clustering_report")
def clustering_report(spark, d):
    return evaluate.clustering_report(_vectors(spark, d), 10, learn.kmeans, 2)


# cases and report tables


@query("first_valid_case", f"WITH {sql.VECTORS}, s AS (SELECT source_index, min(row_index) AS f, count(*) AS n FROM vectors WHERE row_index > 10 GROUP BY 1) SELECT min(f) AS row_index FROM s WHERE n >= 3")
def first_valid_case(spark, d):
    return retrieve.first_valid_case(_vectors(spark, d).where("row_index > 10"))


_PARTS = ("sep", "yaw_curv", "jerk_diff", "endpoint_diff", "hit_cnt")
_END = lambda x: f"sqrt((c.v[4] - {x}.v[4]) * (c.v[4] - {x}.v[4]) + (c.v[5] - {x}.v[5]) * (c.v[5] - {x}.v[5]))"


@query("human_readable_case", f"""WITH {sql.COMPLETE}, near AS (SELECT a.row_index AS i, b.row_index AS j, row_number() OVER (PARTITION BY a.row_index ORDER BY round({sql.COS('a.v', 'b.v')}, 12), b.row_index) AS rank FROM vectors a JOIN vectors b ON a.row_index <> b.row_index QUALIFY rank <= 5),
    h AS (SELECT i, count(*) FILTER (x.policy_id = y.policy_id) AS hits FROM near JOIN vectors x ON x.row_index = i JOIN vectors y ON y.row_index = j GROUP BY i),
    c AS (SELECT a.source_index, c.row_index, least(list_distance(c.v, a.v), list_distance(c.v, b.v)) AS sep, coalesce(h.hits, 0)::DOUBLE AS hit_cnt,
        (abs(c.v[1] - a.v[1]) + abs(c.v[2] - a.v[2]) + abs(c.v[1] - b.v[1]) + abs(c.v[2] - b.v[2])) / 2 AS yaw_curv, (abs(c.v[3] - a.v[3]) + abs(c.v[3] - b.v[3])) / 2 AS jerk_diff, ({_END('a')} + {_END('b')}) / 2 AS endpoint_diff
        FROM vectors a JOIN vectors b ON a.source_index = b.source_index AND a.policy_id = 0 AND b.policy_id = 1 JOIN vectors c ON c.source_index = a.source_index AND c.policy_id = 2 LEFT JOIN h ON h.i = c.row_index)
    SELECT *, {' + '.join(f'(CASE WHEN max({p}) OVER () - min({p}) OVER () > 1e-8 THEN ({p} - min({p}) OVER ()) / (max({p}) OVER () - min({p}) OVER ()) ELSE 0 END)' for p in _PARTS)} AS score FROM c ORDER BY round(score, 12) DESC, source_index LIMIT 1""", " ".join((*_PARTS, "score")))
def human_readable_case(spark, d):
    v = _complete(spark, d)
    stats = v.select("row_index", *(F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(("rms_yaw", "rms_curvature", "rms_jerk", "x", "y"))))
    return retrieve.human_readable_case(retrieve.case_components(v, pairs.knn(v, 5), stats))


@query("case_table", f"""WITH {_QUERY}, u AS (SELECT row_index, distance, row_number() OVER (ORDER BY distance, row_index) AS rank FROM c WHERE scenario_id <> 0 ORDER BY distance, row_index LIMIT 5),
    a AS (SELECT 'retrieved' AS role, row_index, rank, distance, false AS excluded, '' AS exclude_reason FROM u UNION ALL SELECT 'excluded', row_index, NULL, distance, true, 'same_scenario' FROM c WHERE scenario_id = 0 UNION ALL SELECT 'query', 40, 0, 0.0::DOUBLE, false, '')
    SELECT a.*, v.policy_id, v.source_index, v.row_index % 20 AS scenario_id, v.policy_id = q.policy_id AS same_policy, v.source_index = q.source_index AS same_source, v.row_index % 20 = 0 AS same_scenario, v.label
    FROM a JOIN vectors v USING (row_index), (SELECT * FROM vectors WHERE row_index = 40) q""", "distance")
def case_table(spark, d):
    rows = _retrieval_rows(spark, d)
    found = retrieve.retrieve(rows, 40, 5, exclude={"same_scenario": F.col("scenario_id") == F.col("q_scenario_id")})
    same = {"same_policy": "policy_id", "same_source": "source_index", "same_scenario": "scenario_id"}
    return _long(retrieve.case_table(rows, found, 40, same, rows.select("row_index", "label")))


_MEASURES = ("mean_speed", "rms_jerk", "min_thw")


@query("style_fingerprint", f"""WITH {_SIGNALS}, s AS (SELECT wid, avg(speed) AS mean_speed, sqrt(avg(jerk * jerk)) AS rms_jerk, min(thw) AS min_thw FROM signals GROUP BY wid), q AS (SELECT * FROM s ORDER BY wid LIMIT 1),
    n AS (SELECT s.wid FROM s, q WHERE s.wid <> q.wid ORDER BY round(sqrt({' + '.join(f'(s.{c} - q.{c}) * (s.{c} - q.{c})' for c in _MEASURES)}), 9), s.wid LIMIT 3),
    ids AS (SELECT wid FROM q UNION SELECT wid FROM n UNION SELECT s.wid FROM s, q WHERE s.wid // 1000000 = q.wid // 1000000)
    SELECT wid AS row_index, scenario_id, start, front_id, mean_speed, rms_jerk, min_thw FROM (SELECT DISTINCT wid, scenario_id, start, front_id FROM win) JOIN ids USING (wid) JOIN s USING (wid)""", " ".join(_MEASURES))
def style_fingerprint(spark, d):
    w = _windows(spark, d)
    meta = windows.window_rows(w).select(F.col("wid").alias("row_index"), "scenario_id", "start", "front_id")
    stats = windows.signal_summary(windows.replay_signals(w)).select(F.col("wid").alias("row_index"), *_MEASURES)
    query_index = stats.agg(F.min("row_index")).first()[0]
    if query_index is None:
        return retrieve.fingerprint(meta, stats, meta)
    space = meta.join(stats, "row_index").withColumn("embedding", F.array(*_MEASURES))
    own = space.where(F.col("row_index") == query_index)
    return retrieve.fingerprint(meta, stats, own, retrieve.retrieve(space, query_index, 3, "euclidean"), retrieve.retrieve(space, query_index, 1, "euclidean", within=("scenario_id",)), space.join(own.select("scenario_id"), "scenario_id", "left_semi"))


@query("retrieval_diagnostics", f"""WITH {sql.VECTORS}, s AS (SELECT source_index, count(*) AS n FROM vectors GROUP BY 1), t AS (SELECT source_index, count(*) AS n, count(DISTINCT policy_id) AS p FROM vectors WHERE split = 'train' GROUP BY 1)
    SELECT 'rows' AS section, 'total' AS key, sum(n)::BIGINT AS value FROM s UNION ALL SELECT 'rows', 'after_split', coalesce(sum(n), 0)::BIGINT FROM t UNION ALL SELECT 'sources', 'total', count(*) FROM s UNION ALL SELECT 'sources', 'after_split', count(*) FROM t
    UNION ALL SELECT 'group_size_total', n::VARCHAR, count(*) FROM s GROUP BY n UNION ALL SELECT 'group_size_after_split', n::VARCHAR, count(*) FROM t GROUP BY n
    UNION ALL SELECT 'policy', policy_id::VARCHAR, count(*) FROM vectors WHERE split = 'train' GROUP BY policy_id UNION ALL SELECT 'sources', 'all_policies', count(*) FILTER (p >= 3) FROM t""")
def retrieval_diagnostics(spark, d):
    return retrieve.diagnostics(_vectors(spark, d), "train")


_GAPS = ", ".join(f"count({c}) AS {n}_valid_count, min({c}) AS {n}_min, max({c}) AS {n}_max, " + ", ".join(f"quantile_cont({c}, {p / 100}) AS {n}_p{p}" for p in (1, 50, 99)) for c, n in (("raw", "d0_raw"), ("d0", "d0_sanitized")))


@query("dataset_report", f"""WITH {sql.KINEMATICS}, kept AS (SELECT scenario_id FROM tracks WHERE is_ego GROUP BY 1 HAVING min(sqrt(vx * vx + vy * vy)) FILTER (valid) >= 5.5),
    sp AS (SELECT sqrt(vx * vx + vy * vy) AS v FROM tracks WHERE is_ego AND valid AND scenario_id IN (SELECT scenario_id FROM kept)),
    s AS (SELECT wid, sum(v_rel * v_rel) + 1e-3 AS p, sum(v_rel * d) AS vd, sum(v_rel) AS sv, sum(d * d) + 1e-3 AS q, sum(d) AS sd, count(*) + 1e-3::DOUBLE AS r, sum(v_rel * a) AS va, sum(d * a) AS da, sum(a) AS sa FROM kin WHERE following GROUP BY wid HAVING count(*) >= 18),
    b AS (SELECT *, p * (q * r - sd * sd) - vd * (vd * r - sd * sv) + sv * (vd * sd - q * sv) AS det FROM s),
    g AS (SELECT wid, (p * (da * r - sd * sa) - va * (vd * r - sd * sv) + sv * (vd * sa - da * sv)) / det AS kd, (p * (q * sa - da * sd) - vd * (vd * sa - da * sv) + va * (vd * sd - q * sv)) / det AS c FROM b),
    w AS (SELECT k.wid, {sql.SPLIT(chr(39) + 'scenario_' + chr(39) + ' || k.scenario_id')} AS split, k.cf, kd, CASE WHEN abs(kd) >= 1e-3 THEN -c / kd END AS raw, CASE WHEN raw > 1 THEN ln(1 + least(raw, 200.0::DOUBLE)) END AS d0
        FROM (SELECT wid, scenario_id, avg(following::INT::DOUBLE) AS cf FROM kin GROUP BY ALL) k LEFT JOIN g USING (wid))
    SELECT * FROM (SELECT avg(v) AS speed_mean, stddev_pop(v) AS speed_std, min(v) AS speed_min, max(v) AS speed_max FROM sp),
        (SELECT count(*) AS total_windows, {', '.join(f"count(*) FILTER (split = '{x}') AS {x}_count" for x in ('train', 'val', 'test'))}, {_GAPS}, count(*) FILTER (abs(kd) < 1e-3) AS kd_small_count, count(*) FILTER (d0 IS NULL) AS d0_nan_count,
            avg(cf) AS cf_mean, stddev_pop(cf) AS cf_std, quantile_cont(cf, 0.1) AS cf_p10, quantile_cont(cf, 0.5) AS cf_p50, quantile_cont(cf, 0.9) AS cf_p90 FROM w)""",
    "speed_mean speed_std speed_min speed_max d0_raw_min d0_raw_max d0_raw_p1 d0_raw_p50 d0_raw_p99 d0_sanitized_min d0_sanitized_max d0_sanitized_p1 d0_sanitized_p50 d0_sanitized_p99 cf_mean cf_std cf_p10 cf_p50 cf_p90", digits=4)
def dataset_report(spark, d):
    ego = _tracks(spark, d).where("is_ego and valid").withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    kept = ego.groupBy("scenario_id").agg(F.min("speed").alias("low")).where("low >= 5.5")
    k = _kin(spark, d)
    cf = k.groupBy("wid", "scenario_id").agg(F.avg(F.when(F.col("following"), 1.0).otherwise(0.0)).alias("cf_valid_frac"))
    rows = cf.join(features.ridge_gains(k, LEAST), "wid").withColumn("split", scalar.split_of(F.concat(F.lit("scenario_"), F.col("scenario_id").cast("string"))))
    return features.dataset_report(ego.join(kept, "scenario_id", "left_semi"), rows)
