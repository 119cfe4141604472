"""Operators against plain NumPy code, written from their definitions, and their edge cases."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionlake.functions import scalar
from motionlake.operators import evaluate, features, lead, learn, pairs, retrieve, rollouts, windows
from motionlake.sources import metadata, records, sinks, tables, tfrecords
from motionlake.streaming import events


def frames_of(spark, ego, front, wid=1):
    rows = [(wid, 1, 0, n, 7, *map(float, e), *map(float, f)) for n, (e, f) in enumerate(zip(ego, front, strict=True))]
    return spark.createDataFrame(rows, "wid long, scenario_id long, start long, i long, front_id long, x double, y double, vx double, vy double, fx double, fy double, fvx double, fvy double")


def moving(n=40, seed=0):
    rng = np.random.default_rng(seed)
    v, h = 9 + np.cumsum(rng.normal(0, 0.2, n)), np.cumsum(rng.normal(0, 0.1, n))
    ego = np.stack([np.cumsum(v * np.cos(h)) * 0.1, np.cumsum(v * np.sin(h)) * 0.1, v * np.cos(h), v * np.sin(h)], 1)
    front = ego + np.stack([20 + rng.normal(0, 1, n), rng.normal(0, 1, n), rng.normal(0, 0.5, n), np.zeros(n)], 1)
    return ego, front


def wrapped(x):
    return (x + np.pi) % (2 * np.pi) - np.pi


def test_style_features_against_numpy(spark):
    ego, front = moving()
    r = features.style_features(windows.kinematics(frames_of(spark, ego, front)), 5).first()
    v, fv = np.hypot(*ego[:, 2:].T), np.hypot(*front[:, 2:].T)
    a, fa = np.diff(v, prepend=v[0]), np.diff(fv, prepend=fv[0])
    jerk, d = np.diff(a, prepend=a[0]), np.hypot(*(front - ego)[:, :2].T)
    m = (v > 5.5) & (d >= 8) & (d <= 60) & (abs(v - fv) < 6)
    assert r["acc_abs_p95"] == pytest.approx(np.percentile(abs(a), 95)) and r["jerk_rms"] == pytest.approx(np.sqrt((jerk**2).mean()))
    assert r["cf_valid_frac"] == pytest.approx(m.mean()) and r["thw_iqr"] == pytest.approx(np.subtract(*np.percentile((d / (v + 1e-3))[m], [75, 25])))
    x = np.stack([(v - fv)[m], d[m], np.ones(m.sum())], 1)
    kv, kd, b = np.linalg.solve(x.T @ x + 1e-3 * np.eye(3), x.T @ a[m])
    assert r["closing_gain_kv"] == pytest.approx(kv, rel=1e-6) and r["gap_gain_kd"] == pytest.approx(kd, rel=1e-6)
    gap = -b / kd if abs(kd) >= 1e-3 else None
    assert r["desired_gap_d0"] == (pytest.approx(np.log1p(min(gap, 200))) if gap is not None and gap > 1 else None)
    best = max(((np.corrcoef(a[m][max(k, 0) : len(a[m]) + min(k, 0)], fa[m][max(-k, 0) : len(a[m]) - max(k, 0)])[0, 1], -k) for k in range(-10, 11)))
    assert r["acc_sync_corr"] == pytest.approx(best[0]) and r["acc_sync_lag"] == -best[1]
    dv = np.diff(v)
    s = np.sign(dv[abs(dv) > 1e-3])
    assert r["speed_control_oscillation"] == pytest.approx((s[1:] * s[:-1] < 0).mean())


def test_constant_speed_and_short_windows(spark):
    ego = np.stack([np.arange(25) * 1.0, np.zeros(25), np.full(25, 10.0), np.zeros(25)], 1)
    r = windows.replay_signals(frames_of(spark, ego, ego + [30, 0, 0, 0])).agg(F.max(F.abs("accel")).alias("a"), F.max(F.abs("yaw")).alias("y"), F.count("*").alias("n")).first()
    assert (r["a"], r["y"], r["n"]) == (0, 0, 25)
    style = features.style_features(windows.kinematics(frames_of(spark, ego, ego + [30, 0, 0, 0]))).first()
    assert style["acc_sync_corr"] is None and style["speed_control_oscillation"] == 0
    few = features.style_features(windows.kinematics(frames_of(spark, ego[:3], ego[:3] + [500, 0, 0, 0]))).first()
    assert few["thw_p50"] is None and few["closing_gain_kv"] is None and few["cf_valid_frac"] == 0
    long = spark.range(30).select(F.lit(1).cast("long").alias("scenario_id"), F.lit(2).alias("front_id"), F.col("id").alias("k"), *(F.lit(0.0).alias(c) for c in ("x", "y", "vx", "vy", "fx", "fy", "fvx", "fvy")))
    got = windows.window_rows(windows.sliding(long, 20, 5)).collect()
    assert sorted((r["start"], r["window_len"]) for r in got) == [(0, 20), (5, 20), (10, 20)]
    assert windows.sliding(long, 31, 5).count() == 0


def test_signals_against_numpy(spark):
    ego, front = moving(seed=3)
    ego[:, 2:] = 9 * np.stack([np.cos(np.arange(40) * 0.9), np.sin(np.arange(40) * 0.9)], 1)  # headings that wrap
    rows = windows.replay_signals(frames_of(spark, ego, front)).orderBy("i").toPandas()
    speed, heading = np.hypot(*ego[:, 2:].T), np.unwrap(np.arctan2(ego[:, 3], ego[:, 2]))
    accel, yaw = np.gradient(speed, 0.1), np.gradient(heading, 0.1)
    for name, want in (("speed", speed), ("heading", heading), ("accel", accel), ("jerk", np.gradient(accel, 0.1)), ("yaw", yaw), ("curvature", yaw / speed)):
        assert np.allclose(rows[name], want)
    start = windows.aligned_to_start(frames_of(spark, ego, front)).orderBy("i").toPandas()
    assert abs(start["ax"][0]) + abs(start["ay"][0]) == 0


def plain_rollout(ego, front, p, dt=0.1):
    target, a_max, a_min, jerk, clip, alpha, kp, kd = p
    x, y, vx, vy = ego[0]
    a, aim, out = 0.0, np.arctan2(ego[0, 3], ego[0, 2]), [ego[0]]
    for t in range(len(ego) - 1):
        v = np.hypot(vx, vy)
        gap = max(np.hypot(front[t, 0] - x, front[t, 1] - y), 0.5)
        want = kp * (gap / max(v, 1e-3) - target) - kd * (v - np.hypot(*front[t, 2:]))
        a = np.clip(a + np.clip(want - a, -jerk, jerk), a_min, a_max)
        own = np.arctan2(vy, vx) if v > 1e-3 else np.arctan2(ego[t, 3], ego[t, 2])
        turn = np.arctan2(ego[t + 1, 3], ego[t + 1, 2])
        aim = aim + (1 - alpha) * wrapped(turn - aim) if alpha > 0 else turn
        h = own + np.clip(wrapped(aim - own), -clip, clip)
        v = max(v + a * dt, 0.0)
        vx, vy = v * np.cos(h), v * np.sin(h)
        x, y = x + vx * dt, y + vy * dt
        out.append((x, y, vx, vy))
    return np.array(out)


def test_rollouts_against_a_plain_loop(spark):
    ego, front = moving(15, 5)
    got = rollouts.simulate(frames_of(spark, ego, front), rollouts.policy_table(spark)).orderBy("policy_id", "i").toPandas()
    for name, p in rollouts.POLICIES.items():
        assert np.allclose(got[got["policy_name"] == name][["x", "y", "vx", "vy"]], plain_rollout(ego, front, p), atol=1e-9)
    assert len(got) == 45
    table = rollouts.policy_table(spark, ("aggressive",), {"aggressive": {"a_max": 1.0}}).first()
    assert table["a_max"] == 1.0 and table["kp_thw"] == 1.5
    for bad in (("nobody",), ("aggressive",)):
        with pytest.raises(ValueError):
            rollouts.policy_table(spark, bad, {"aggressive": {"nothing": 1.0}})


def vector_rows(spark, x, **extra):
    names = list(extra)
    rows = [(i, list(map(float, v)), *(extra[n][i] for n in names)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_index long, embedding array<double>" + "".join(f", {n} long" for n in names))


def test_knn_blocks_and_ties(spark):
    x = np.random.default_rng(1).normal(size=(90, 8))
    x[5] = x[0] + 1e-4
    v = vector_rows(spark, x)
    for block in (2048, 20):
        got = {(r["i"], r["rank"]): r["j"] for r in pairs.knn(v, 4, block=block).collect()}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - unit @ unit.T
        np.fill_diagonal(d, np.inf)
        order = np.argsort(d, axis=1)[:, :4]
        assert all(got[i, n + 1] == order[i, n] for i in range(90) for n in range(4)) and got[0, 1] == 5
    same = pairs.knn(vector_rows(spark, np.ones((5, 2))), 2, "l2").collect()
    assert {(r["i"], r["rank"], r["j"]) for r in same if r["i"] == 3} == {(3, 1, 0), (3, 2, 1)}
    assert pairs.knn(vector_rows(spark, np.zeros((1, 2))), 3).count() == 0
    few = pairs.knn(vector_rows(spark, [[0, 0], [1, 0]]), 3).collect()
    assert len(few) == 2 and all(r["d"] == 1.0 for r in few)  # a zero vector is at distance 1
    with pytest.raises(ValueError):
        pairs.knn(v, 2, "manhattan")


def aligned_set(spark, drop=(), repeat=()):
    rng = np.random.default_rng(0)
    keys = [(s, p) for s in range(30) for p in range(3) if (s, p) not in drop] + list(repeat)
    x = [np.eye(8)[p] * 10 * (p + 1) + rng.normal(0, 0.01, 8) for _, p in keys]
    return vector_rows(spark, x, source_index=[s for s, _ in keys], policy_id=[p for _, p in keys])


def test_aligned_statistics(spark):
    policies, rows = spark.range(3).withColumnRenamed("id", "policy_id"), aligned_set(spark)
    c = evaluate.coverage(rows, policies).first()
    assert (c["n_missing"], c["n_duplicate"], c["n_complete"]) == (0, 0, 30)
    assert not evaluate.retrieval_applicable(rows).first()["applicable"]
    assert evaluate.within_source_margin(rows).agg(F.min("margin")).first()[0] > 0
    gaps = aligned_set(spark, {(0, 2)}, [(0, 0)])
    c = evaluate.coverage(gaps, policies).first()
    assert (c["n_missing"], c["n_duplicate"], c["n_complete"], c["n_found"]) == (1, 1, 29, 90)
    assert evaluate.first_pairs(gaps, policies, True).collect()[0][:2] == (0, 2) and evaluate.pairwise_distances(gaps, 3).count() == 87
    assert evaluate.macro_f1(evaluate.nearest_centroid(rows, rows, "policy_id")).first()["macro_f1"] == 1
    assert learn.policy_classifier(rows, rows).where("label = predicted").count() == 90


def test_recall_of_a_lonely_label(spark):
    v = vector_rows(spark, np.random.default_rng(2).normal(size=(7, 3)), label=[0, 0, 0, 1, 1, 1, 2])
    assert {r["row_index"]: r["recall"] for r in evaluate.recall_at_k(v, "label", 3).collect()}[6] == 1.0


def test_retrieval(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    rows = vector_rows(spark, x, scenario_id=[i % 20 for i in range(60)], policy_id=[i % 3 for i in range(60)]).withColumn("split", F.when(F.col("scenario_id") % 5 == 0, "test").otherwise("train"))
    near = retrieve.retrieve(rows, 0, 5, exclude={"same_scenario": F.col("scenario_id") == F.col("q_scenario_id")}).collect()
    kept = [r for r in near if not r["excluded"]]
    assert len(kept) == 5 and [r["rank"] for r in kept] == [1, 2, 3, 4, 5] and sorted(r["distance"] for r in kept) == [r["distance"] for r in kept]
    assert {r["row_index"] for r in near if r["excluded"]} == {20, 40}
    within = retrieve.retrieve(rows, 0, 5, "euclidean", split="train", within=("scenario_id",)).collect()
    assert {r["row_index"] for r in within} == {20, 40}
    assert all(r["split"] == "train" for r in retrieve.retrieve(rows, 0, 9, split="train").collect())
    assert retrieve.find_query(rows, 7) == 7
    with pytest.raises(ValueError):
        retrieve.find_query(rows, 99)
    none = retrieve.hits(retrieve.retrieve(rows.where("row_index = 0"), 0), 1).first()
    assert none["hit_at_k"] is None and none["reason"] == "no candidates" and retrieve.hits(retrieve.retrieve(rows, 0), None).first()["reason"] == "no policy"


def test_probe_notes_and_ridge(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 0.1 * rng.normal(size=80)
    rows = vector_rows(spark, x).join(spark.createDataFrame(list(enumerate(map(float, y))), "row_index long, y double"), "row_index")
    train, test = rows.where("row_index < 60"), rows.where("row_index >= 60")
    r = learn.probe(train, test, "y", ridge=1.0).first()
    xc, yc = x[:60] - x[:60].mean(0), y[:60] - y[:60].mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    p = (x[60:] - x[:60].mean(0)) @ w + y[:60].mean()
    assert r["rmse"] == pytest.approx(np.sqrt(((p - y[60:]) ** 2).mean()), rel=1e-6) and r["spearman"] > 0.95
    assert learn.probe(train.limit(2), test, "y").first()["note"].startswith("skipped_small_n")
    assert learn.probe(train.withColumn("y", F.lit(1.0)), test, "y").first()["note"] == "skipped_low_variance"


def test_pca_holdout_sample_and_encoder(spark):
    x = np.random.default_rng(5).normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1] + 4
    got, shares = learn.pca(vector_rows(spark, x))
    p = np.array([r["projection"] for r in got.orderBy("row_index").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(abs(p), abs(u[:, :2] * s[:2])) and shares == pytest.approx(list(s[:2] ** 2 / (s**2).sum()))
    rows = vector_rows(spark, x)
    assert learn.holdout(rows).groupBy("split").count().orderBy("split").collect() == [("test", 10), ("train", 40)]
    assert learn.sample(rows, 7).count() == 7 and learn.kmeans(rows, 3).select("cluster").distinct().count() == 3
    rng = np.random.default_rng(6)
    w = {"w_ih": rng.normal(size=(12, 4)), "w_hh": rng.normal(size=(12, 4)), "b_ih": rng.normal(size=12), "b_hh": rng.normal(size=12), "w1": rng.normal(size=(5, 4)), "b1": rng.normal(size=5), "w2": rng.normal(size=(3, 5)), "b2": rng.normal(size=3)}
    seqs = [(n, [[float(v) for v in rng.normal(size=4)] for _ in range(n + 1)]) for n in range(6)]
    out = learn.encode(spark.createDataFrame(seqs, "row_index long, frames array<array<double>>"), w).collect()
    alone = learn.gru_forward(np.array([seqs[2][1]]), np.array([3]), w)[0]
    assert np.allclose(next(r["embedding"] for r in out if r["row_index"] == 2), alone, atol=1e-6)


def test_metadata_precedence(spark):
    base = spark.range(4).withColumnRenamed("id", "row_index")
    table = spark.createDataFrame([(0, "1", "a"), (1, "x", "b"), (2, "2", None)], "row_index long, policy_id string, policy_name string")
    side = {"policy_id": spark.createDataFrame([(0, "9"), (3, "8")], "row_index long, value string")}
    got = {r["row_index"]: r for r in metadata.resolve(base, table, side).collect()}
    assert [(got[i]["policy_id"], got[i]["policy_id_from"]) for i in range(4)] == [(9, "side_file"), (None, "none"), (2, "table"), (8, "side_file")]
    assert got[0]["policy_name"] == "a" and got[2]["policy_name_from"] == "none"
    uneven = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "row_index long, source_key string")
    assert all(r["policy_id"] is None for r in metadata.infer_policy(uneven).collect())


def _field(n, kind, payload):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    return varint(n << 3 | kind) + (varint(payload) if kind == 0 else varint(len(payload)) + payload if kind == 2 else payload)


def test_tfrecord_scenarios(spark, tmp_path):
    state = b"".join(_field(n, 1, struct.pack("<d", v)) for n, v in ((2, 1.5), (3, -2.0))) + b"".join(_field(n, 5, struct.pack("<f", v)) for n, v in ((9, 4.0), (10, 0.5))) + _field(11, 0, 1)
    message = _field(5, 2, b"scene") + _field(6, 0, 1) + _field(2, 2, _field(3, 2, state)) + _field(2, 2, _field(3, 2, state) + _field(3, 2, b""))
    entry = lambda value: _field(1, 2, _field(1, 2, b"key") + _field(2, 2, _field(1, 2, _field(1, 2, value))))
    wrapper = _field(1, 2, entry(b"\xff\xffjunk") + entry(message))
    frame = tfrecords.framed
    (tmp_path / "b.tfrecord").write_bytes(frame(message) + frame(wrapper) + frame(b"\x07nonsense") + b"\x01cut")
    rows = records.read_scenarios(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["scenario_id"], r["fault"]) for r in rows] == [("scene", None), ("scene", None), (None, None), (None, "cut tail")]
    long = tables.nested_to_tracks(records.read_scenarios(spark, str(tmp_path)).where("position = 0")).collect()
    assert len(long) == 3 and sum(r["is_ego"] for r in long) == 2 and {r["x"] for r in long} == {1.5, 0.0} and sum(r["valid"] for r in long) == 2
    assert tables.discover(spark, f"{tmp_path}/*.tfrecord", 1)[0].endswith("b.tfrecord")


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([(3, 0.5, None)], "n long, mean double, note string")
    sinks.write_summary(one, str(tmp_path / "s"))
    assert {r["key"]: r["value"] for r in spark.read.csv(str(tmp_path / "s/summary.csv"), header=True).collect()} == {"n": "3", "mean": "0.5", "note": None}
    sinks.write_json(one.select(F.struct("n", "mean").alias("all")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["all"]["n"] == 3
    sinks.write_table(spark.range(4).withColumn("split", F.lit("train")), str(tmp_path / "t"), "split")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert "| 1 |" in sinks.report(one, spark.createDataFrame([(1,)], "rank int"))


def test_lead_ties_and_filters(spark):
    rows = [(1, k, k == 0, t, True, float(x), 0.0, 6.0, 0.0) for t in range(3) for k, x in ((0, t), (1, t + 10), (2, t + 10), (3, t - 5))]
    t = spark.createDataFrame(rows, "scenario_id long, track_id long, is_ego boolean, t long, valid boolean, x double, y double, vx double, vy double")
    r = lead.lead_tracks(t).first()
    assert (r["front_id"], r["mean_dist"], r["n_frames"]) == (1, 10.0, 3)
    assert not lead.speed_filter(t.withColumn("valid", F.lit(False))).first()["kept"]
    assert lead.lead_tracks(t.where("track_id in (0, 3)")).count() == 0


def test_loss_fallbacks(spark):
    v = vector_rows(spark, np.random.default_rng(3).normal(size=(12, 3)), scope=[0] * 12)
    gate = spark.createDataFrame([(0, 1), (0, 2)], "i long, j long")
    full = pairs.with_fallback(gate, v, 2).groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in full} == {i: 2 if i == 0 else 11 for i in range(12)}
    p = pairs.soft_targets(pairs.kernel_logits(pairs.scoped_pairs(v), "tau")).groupBy("i").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in p)
    cond = spark.createDataFrame([(i, float(i), 1.0, 0.0, int(i == 4)) for i in range(5)], "wid long, speed_mean double, dist_mean double, vrel_mean double, bucket int")
    for mode in ("mad", "iqr", "std"):
        got = pairs.condition_knn(cond, 2, mode).collect()
        assert {r["j"] for r in got if r["i"] == 4} == {0, 1, 2, 3} and all(r["fallback"] == (r["i"] == 4) for r in got)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    batch = tables.load(spark, sf_dir, "events")
    batch.write.parquet(str(tmp_path / "events"))
    stream = events.read_events(spark, str(tmp_path / "events"))
    got = events.drain(events.hopping(stream), "hops")
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
    assert sorted(got.select("event_type", "start", "n").collect()) == sorted(want.collect())


@pytest.fixture(scope="module")
def evaluated(spark):
    def run(values, build):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
        return [r[0] for r in rows.orderBy("i").select(build(F.col("x"))).collect()]

    return run


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=20))
def test_angles_buckets_and_clips(evaluated, values):
    got = evaluated(values, scalar.wrap_angle)
    assert np.allclose([np.cos(g) for g in got], np.cos(values), atol=1e-9) and all(-np.pi - 1e-9 <= g <= np.pi + 1e-9 for g in got)
    assert evaluated(values, scalar.bucket_of) == [(v > 0.2) + (v > 0.6) for v in values]
    assert evaluated(values, lambda c: scalar.clip(c, -1.0, 2.0)) == [max(-1.0, min(2.0, v)) for v in values]


def test_scalar_edges(evaluated):
    assert evaluated([0.2, 0.6, 0.61], scalar.bucket_of) == [0, 1, 2]
    assert evaluated([float("nan"), float("inf"), 2.0], scalar.finite_or_zero) == [0.0, 0.0, 2.0]
    assert evaluated([1.0, -3.0, float("nan"), 500.0], lambda c: scalar.sanitized_gap(c, log=False)) == [None, None, None, 200.0]
    with pytest.raises(ValueError):
        scalar.split_of(F.lit("a"), (0.5, 0.1, 0.1))


def test_late_windows_of_a_long_scenario_stay_apart(spark):
    """Scenario 1 at frame 1,000,000 and scenario 2 at frame 0 are two windows."""
    names = ("x", "y", "vx", "vy", "fx", "fy", "fvx", "fvy")
    long = spark.range(1_000_040).select(F.lit(1).cast("long").alias("scenario_id"), F.col("id").alias("k"))
    both = long.unionByName(spark.range(40).select(F.lit(2).cast("long").alias("scenario_id"), F.col("id").alias("k")))
    frames = both.select("*", F.lit(7).cast("long").alias("front_id"), *(F.lit(1.0).alias(c) for c in names))
    cut = windows.sliding(frames, 40, 500_000)
    got = cut.groupBy("wid", windows.scenario_of(F.col("wid")).alias("s")).agg(F.count("*").alias("n"), F.min("scenario_id").alias("low"), F.max("scenario_id").alias("high"), F.max("start").alias("start")).collect()
    assert sorted((r["s"], r["low"], r["high"], r["start"], r["n"]) for r in got) == [(1, 1, 1, 0, 40), (1, 1, 1, 500_000, 40), (1, 1, 1, 1_000_000, 40), (2, 2, 2, 0, 40)]
    assert {r["wid"] for r in got} >= {1_000_000, 1_500_000, 2_000_000}
