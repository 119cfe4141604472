"""Losses, views and scans against plain values, and odd inputs of the report operators."""

import hashlib
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from motionlake.operators import evaluate, pairs, retrieve
from motionlake.sources import metadata, sinks


def test_scans_of_side_files(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("scenario_id,start\n7,0\n7,20\n")
    table, warning = metadata.scan_metadata(spark, str(tmp_path / "meta.csv"), 2)
    assert [tuple(r) for r in table.collect()] == [("7", "0"), ("7", "20")] and warning is None
    table, warning = metadata.scan_metadata(spark, str(tmp_path / "meta.csv"), 3)
    assert table is None and "2 rows" in warning
    for text, want in (('["a", "b"]', ["a", "b"]), ('{"a": 1}', None), ("[1]", None), ("[", None)):
        (tmp_path / "names.json").write_text(text)
        names, warning = metadata.scan_feature_names(spark, str(tmp_path / "names.json"))
        assert names == want and (warning is None) == (want is not None)
    (tmp_path / "policies.json").write_text('{"0": "calm", "2": "fast", "x": "?"}')
    assert {tuple(r) for r in metadata.scan_policy_names(spark, str(tmp_path / "policies.json")).collect()} == {(0, "calm"), (2, "fast")}


def test_rollout_sink(spark, tmp_path):
    frames, meta = spark.createDataFrame([(0, 1.5), (1, 2.5)], "row_index long, x double"), spark.createDataFrame([(0, 3)], "row_index long, policy_id long")
    names = spark.createDataFrame([(1, "b"), (0, "a")], "policy_id long, policy_name string")
    sinks.write_rollouts(frames, meta, names, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "rollouts.parquet")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "meta.csv")).columns == ["row_index", "policy_id"]
    assert json.loads(spark.read.text(str(tmp_path / "policy_names.json")).first()[0]) == {"0": "a", "1": "b"}
    sinks.write_features(frames, str(tmp_path), frames)
    assert spark.read.parquet(str(tmp_path / "feat.parquet")).count() == spark.read.parquet(str(tmp_path / "feat_legacy.parquet")).count() == 2


def test_hybrid_guards_what_is_not_finite(spark):
    rows = spark.createDataFrame([(s, s * 10 + i) for s in range(3) for i in range(2)], "scope long, row_index long")
    loss = lambda values: spark.createDataFrame(values, "i long, loss double")
    out = pairs.hybrid(loss([(0, 1.0), (1, 3.0), (10, float("nan")), (20, float("inf"))]), loss([(0, 4.0), (10, 1.0), (20, 1.0)]), rows, 0.5, 2.0)
    assert {r["scope"]: r["loss"] for r in out.collect()} == {0: 9.0, 1: 0.0, 2: 1e4}


def test_norms_and_clips(spark):
    v = spark.createDataFrame([(0, 1, [3.0, 4.0]), (0, 2, [3.0, 0.0])], "scope long, row_index long, embedding array<double>")
    value = lambda mode, **o: {r["row_index"]: r["embedding"] for r in pairs.normalized(v, mode, **o).collect()}
    assert value("none", clip_at=3.5) == {1: [3.0, 3.5], 2: [3.0, 0.0]}
    assert value("l2")[1] == pytest.approx([0.6, 0.8])
    assert value("batch_std")[1] == pytest.approx([0.0, 2**0.5 / 2], abs=1e-5)
    with pytest.raises(ValueError):
        pairs.normalized(v, "other")


def test_consistency_notes(spark):
    v = spark.createDataFrame([(0, i, [1.0, float(i)]) for i in range(6)], "scope long, row_index long, embedding array<double>")
    xs = spark.createDataFrame([(i, "same", 1.0) for i in range(6)] + [(i, "few", float(i)) for i in range(3)] + [(i, "ok", float(i)) for i in range(6)], "row_index long, feature string, x double")
    none = spark.createDataFrame([], "i long, j long")
    got = {r["feature"]: r for r in evaluate.conditioned_consistency(v, xs, none, 2).collect()}
    assert {k: r["note"] for k, r in got.items()} == {"same": "constant", "few": "too few", "ok": "ok"}
    assert got["ok"]["frac_fallback"] == 1.0 and got["ok"]["mean_cond_candidates"] == 0.0 and got["few"]["ratio_mean"] is None


def test_cases_without_groups(spark):
    rows = spark.createDataFrame([(4, 1, 0, [1.0]), (5, 2, 1, [2.0])], "row_index long, source_index long, policy_id long, embedding array<double>")
    assert retrieve.first_valid_case(rows).first()[0] == 4
    assert retrieve.human_readable_case(retrieve.case_components(rows, spark.createDataFrame([], "i long, j long"))).collect() == []
    assert evaluate.clustering_report(rows, 2, None).first()["silhouette"] is None
    log = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, 4.0)], "epoch long, tau double")
    assert evaluate.mean_of_logs(log, "epoch", ["tau"]).select("n", F.col("tau")).first()[:] == (3, 3.0)


def test_neighbours_are_found_once(spark, monkeypatch):
    """neighbor_consistency reads its ratios several times; the neighbours behind them are one job's work."""
    rows = [(i, [float(i % 7), float(i % 5) + 1.0], float(i)) for i in range(60)]
    v = spark.createDataFrame(rows, "row_index long, embedding array<double>, x double")
    out = evaluate.neighbor_consistency(v.select("row_index", "embedding"), v.select("row_index", F.lit("x").alias("feature"), "x"), 3)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString() and out.first()["n"] == 60


def _sent(spark):
    """Bytes shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_gated_pairs_carry_no_vectors(spark, monkeypatch):
    """conditioned_consistency sends a vector for each part of its scope, not for each pair; the values are those of plain code."""
    monkeypatch.setattr(evaluate, "PART", 24, raising=False)
    rnd, width, k, least = random.Random(3), 256, 3, 8
    scope = {i: i // 40 for i in range(100)}
    at = {i: [rnd.gauss(0, 1) for _ in range(width)] for i in scope}
    x = {"all": {i: rnd.random() for i in scope}, "some": {i: rnd.random() for i in scope if i % 3}}
    cand = {(i, j) for i in scope for j in scope if i != j and scope[i] == scope[j] and (i * j) % 4 in (1, 2)}
    v = spark.createDataFrame([(scope[i], i, e) for i, e in at.items()], "scope long, row_index long, embedding array<double>")
    xs = spark.createDataFrame([(i, f, value) for f, values in x.items() for i, value in values.items()], "row_index long, feature string, x double")
    gate = spark.createDataFrame(sorted(cand), "i long, j long")
    near, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _sent(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["feature"]: r for r in evaluate.conditioned_consistency(v, xs, gate, k, least, clip_at=0.9).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", near)
    assert _sent(spark) - before < 12 * len(scope) * width * 8
    cos = lambda a, b: round(1 - sum(map(float.__mul__, a, b)) / (math.hypot(*a) * math.hypot(*b)), 12)
    for f, values in x.items():
        ratios, counts = [], []
        for i in values:
            own = [j for j in values if (i, j) in cand]
            counts.append(len(own))
            pool = own if len(own) >= least else [j for j in values if j != i and scope[j] == scope[i]]
            gap = lambda key: statistics.mean(abs(values[i] - values[j]) for j in sorted(pool, key=key)[:k])  # noqa: B023, E731
            ratios.append(gap(lambda j: (cos(at[i], at[j]), j)) / max(gap(lambda j: (hashlib.md5(f"{i}-{j}".encode()).hexdigest(), j)), 1e-3))  # noqa: B023
        ratios.sort()
        place = 0.9 * (len(ratios) - 1)
        top = ratios[int(place)] + (place - int(place)) * (ratios[int(place) + 1] - ratios[int(place)])
        clipped = [min(r, top) for r in ratios]
        assert 0 < sum(c < least for c in counts) < len(counts) and got[f]["n"] == len(counts)
        want = (statistics.mean(clipped), statistics.median(clipped), statistics.mean(counts), statistics.mean(c < least for c in counts))
        assert got[f][2:6] == pytest.approx(want)
