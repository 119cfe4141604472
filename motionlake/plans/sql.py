"""Common table expressions of the SQL equivalents."""

PI = "3.141592653589793::DOUBLE"
WRAP = lambda x: f"(({x}) - 2 * {PI} * floor((({x}) + {PI}) / (2 * {PI})))"
SPLIT = lambda key: f"(CASE WHEN cast('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.8 THEN 'train' WHEN cast('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.9 THEN 'val' ELSE 'test' END)"

TRACKS = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
tracks AS (
    SELECT user_id // 5 AS scenario_id, user_id % 5 AS track_id, (user_id // 5) % 5 = user_id % 5 AS is_ego, t, event_type <> 'error' AS valid,
           12.0::DOUBLE * (user_id % 5) + 0.9::DOUBLE * t + 0.6::DOUBLE * (value % 10.0::DOUBLE) AS x, 0.2::DOUBLE * ((event_id % 11) - 5) AS y,
           6.0::DOUBLE + 0.5::DOUBLE * (value % 10.0::DOUBLE) AS vx, 0.1::DOUBLE * ((event_id % 7) - 3) AS vy
    FROM e)"""
LEADS = f"""{TRACKS},
ego AS (
    SELECT *, CASE WHEN coalesce(lead(valid) OVER w, false) THEN lead(x) OVER w - x ELSE vx END AS mx, CASE WHEN coalesce(lead(valid) OVER w, false) THEN lead(y) OVER w - y ELSE vy END AS my
    FROM tracks WHERE is_ego WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY t)),
ahead AS (
    SELECT o.scenario_id, o.track_id, sqrt((o.x - g.x) * (o.x - g.x) + (o.y - g.y) * (o.y - g.y)) AS d
    FROM tracks o JOIN ego g ON o.scenario_id = g.scenario_id AND o.t = g.t
    WHERE o.valid AND g.valid AND NOT o.is_ego AND (o.x - g.x) * g.mx + (o.y - g.y) * g.my > 0),
per AS (SELECT scenario_id, track_id, avg(d) AS mean_dist, count(*) AS n_frames FROM ahead WHERE d < 100 GROUP BY ALL),
leads AS (
    SELECT scenario_id, track_id AS front_id, mean_dist, n_frames FROM per WHERE mean_dist < 999
    QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY mean_dist, track_id) = 1)"""
ALIGNED = f"""{LEADS},
aligned AS (
    SELECT g.scenario_id, l.front_id, row_number() OVER (PARTITION BY g.scenario_id ORDER BY g.t) - 1 AS k,
           g.x, g.y, g.vx, g.vy, f.x AS fx, f.y AS fy, f.vx AS fvx, f.vy AS fvy
    FROM tracks g JOIN leads l USING (scenario_id) JOIN tracks f ON f.scenario_id = g.scenario_id AND f.t = g.t AND f.track_id = l.front_id
    WHERE g.is_ego AND g.valid AND f.valid)"""
WINDOWS = f"""{ALIGNED},
starts AS (SELECT scenario_id, unnest(range(0, n - 19, 5)) AS start FROM (SELECT scenario_id, count(*) AS n FROM aligned GROUP BY 1) WHERE n >= 20),
win AS (
    SELECT a.scenario_id * 1000000 + s.start AS wid, a.scenario_id, s.start, a.k - s.start AS i, a.* EXCLUDE (scenario_id, k)
    FROM aligned a JOIN starts s ON a.scenario_id = s.scenario_id AND a.k >= s.start AND a.k < s.start + 20)"""
KINEMATICS = f"""{WINDOWS},
k1 AS (SELECT *, sqrt(vx * vx + vy * vy) AS v, sqrt(fvx * fvx + fvy * fvy) AS fv, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) AS d FROM win),
k2 AS (
    SELECT *, v - fv AS v_rel, coalesce(v - lag(v) OVER w, 0) AS a, coalesce(fv - lag(fv) OVER w, 0) AS fa, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy
    FROM k1 WINDOW w AS (PARTITION BY wid ORDER BY i)),
k3 AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) < 1e-6 THEN atan2(vy, vx) ELSE atan2(dy, dx) END AS heading FROM k2),
kin AS (
    SELECT *, coalesce(a - lag(a) OVER w, 0) AS jerk, coalesce({WRAP('heading - lag(heading) OVER w')}, 0) AS yaw, d / (v + 1e-3::DOUBLE) AS thw,
           v > 5.5 AND d >= 8 AND d <= 60 AND abs(v_rel) < 6 AS following
    FROM k3 WINDOW w AS (PARTITION BY wid ORDER BY i))"""
CONDITIONS = f"""{KINEMATICS},
cond AS (
    SELECT wid, avg(v) AS speed_mean, avg(d) AS dist_mean, avg(v_rel) AS vrel_mean, avg(CASE WHEN following THEN 1.0::DOUBLE ELSE 0 END) AS cf_valid_frac,
           (cf_valid_frac > 0.2)::INT + (cf_valid_frac > 0.6)::INT AS bucket
    FROM kin GROUP BY wid)"""
CORE = f"""{KINEMATICS},
core AS (
    SELECT wid, quantile_cont(abs(a), 0.95) AS acc_abs_p95, quantile_cont(abs(a), 0.99) AS acc_abs_p99, sqrt(avg(a * a)) AS acc_rms,
           quantile_cont(abs(jerk), 0.95) AS jerk_abs_p95, quantile_cont(abs(jerk), 0.99) AS jerk_abs_p99, sqrt(avg(jerk * jerk)) AS jerk_rms,
           sqrt(avg(yaw * yaw)) AS yaw_rate_rms, quantile_cont(abs(yaw), 0.95) AS yaw_rate_abs_p95, sum(abs(yaw)) AS heading_change_total,
           avg(CASE WHEN following THEN 1.0::DOUBLE ELSE 0 END) AS cf_valid_frac
    FROM kin GROUP BY wid)"""
VECTORS = f"""
vectors AS (
    SELECT vec_id AS row_index, embedding::DOUBLE[] AS v, label::BIGINT AS label, (label % 3)::BIGINT AS policy_id, vec_id // 3 AS source_index,
           vec_id // 64 AS scope, {SPLIT('vec_id::VARCHAR')} AS split
    FROM embeddings)"""
DOT = lambda a, b: f"list_dot_product({a}, {b})"
COS = lambda a, b: f"(CASE WHEN {DOT(a, a)} = 0 OR {DOT(b, b)} = 0 THEN 1 ELSE 1 - {DOT(a, b)} / (sqrt({DOT(a, a)}) * sqrt({DOT(b, b)})) END)"
KNN = lambda k, d, order="": f"""{VECTORS},
near AS (
    SELECT a.row_index AS i, b.row_index AS j, {d} AS d, row_number() OVER (PARTITION BY a.row_index ORDER BY round({d}, 12) {order}, b.row_index) AS rank
    FROM vectors a JOIN vectors b ON a.row_index <> b.row_index QUALIFY rank <= {k})"""  # noqa: E731
SCOPED = f"""{VECTORS},
pairs AS (SELECT a.scope, a.row_index AS i, b.row_index AS j, list_distance(a.v, b.v) AS d FROM vectors a JOIN vectors b ON a.scope = b.scope AND a.row_index <> b.row_index)"""
SIGMA = f"""{SCOPED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn, count(*) OVER (PARTITION BY i) AS n FROM pairs),
sigma AS (SELECT i, greatest(d, 1e-3) AS sigma FROM ranked WHERE rn = least(7, n))"""
TARGETS = f"""{SIGMA},
logits AS (SELECT p.*, -p.d / s.sigma AS logit FROM pairs p JOIN sigma s USING (i)),
e0 AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY i)) AS e FROM logits),
p0 AS (SELECT *, e / sum(e) OVER (PARTITION BY i) AS q FROM e0),
targets AS (SELECT scope, i, j, d, logit, q / (sum(q) OVER (PARTITION BY i) + 1e-8) AS p FROM p0)"""
CENTROIDS = f"""{VECTORS},
parts AS (SELECT policy_id AS label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vectors WHERE split = 'train'),
cents AS (SELECT label, n, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m, count(*) AS n FROM parts GROUP BY ALL) GROUP BY label, n),
preds AS (
    SELECT v.row_index, v.policy_id AS label, c.label AS predicted, round(list_distance(v.v, c.c), 12) AS distance
    FROM vectors v CROSS JOIN cents c WHERE v.split <> 'train' QUALIFY row_number() OVER (PARTITION BY v.row_index ORDER BY distance, c.label) = 1)"""
COUNTS = f"""{VECTORS},
pc AS (
    SELECT s.source_index, p.policy_id, count(v.row_index) AS n
    FROM (SELECT DISTINCT source_index FROM vectors) s CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS policy_id) p LEFT JOIN vectors v ON v.source_index = s.source_index AND v.policy_id = p.policy_id
    GROUP BY ALL)"""
COMPLETE = f"""
vectors AS (SELECT vec_id AS row_index, embedding::DOUBLE[] AS v, (vec_id % 3)::BIGINT AS policy_id, vec_id // 3 AS source_index FROM embeddings),
full_sources AS (SELECT source_index FROM vectors GROUP BY 1 HAVING count(DISTINCT policy_id) = 3),
dist AS (
    SELECT a.source_index, 'p' || a.policy_id || '_vs_p' || b.policy_id AS pair, list_distance(a.v, b.v) AS d
    FROM vectors a JOIN vectors b ON a.source_index = b.source_index AND a.policy_id < b.policy_id WHERE a.source_index IN (SELECT source_index FROM full_sources))"""
