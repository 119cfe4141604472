"""Joins through cells, the lag kernel and silhouettes against plain code."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionlake.operators import cells, evaluate, features, pairs

COND = "wid long, speed_mean double, dist_mean double, vrel_mean double, bucket int, scope int"


def conditions(rng, n):
    """A crowd, a line of ties, one point many times, and far rows."""
    rows = []
    for i in range(n):
        kind = i % 4
        p = [(rng.gauss(5, 0.01), rng.gauss(20, 0.02), rng.gauss(0, 0.01)), (float(rng.randrange(4)), 20.0, 0.0), (9.0, 30.0, 1.0), (rng.uniform(0, 30), rng.uniform(5, 80), rng.uniform(-5, 5))][kind]
        rows.append((i * 7 % (7 * n + 1), *p, rng.choice([0, 0, 0, 1]) if i else 2, rng.randrange(2)))
    return rows


@pytest.mark.parametrize("crowd", [2048, 5])
def test_boxes_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(cells, "CROWD", crowd)
    rows = conditions(random.Random(1), 160)
    got = pairs.box_pairs(spark.createDataFrame(rows, COND)).collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[4] == b[4] and all(abs(a[c] - b[c]) <= t for c, t in ((1, 2.0), (2, 5.0), (3, 1.0)))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_boxes_keep_their_tasks(spark):
    """A few KB that meet crowds stay in many tasks: AQE would join them into one."""
    rows = spark.range(400).select(F.col("id").alias("wid"), F.lit(0).alias("bucket"), F.lit(0).alias("scope"), *(F.col("id").cast("double").alias(c) for c in ("speed_mean", "dist_mean", "vrel_mean")))
    assert pairs.box_pairs(rows, scope="scope").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def crowded(spark, n):
    """n conditions, any two within a box."""
    at = lambda c: (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 2500).alias(c)
    return spark.range(n).select(F.col("id").alias("wid"), F.lit(0).alias("bucket"), *(at(c) for c in ("speed_mean", "dist_mean", "vrel_mean")))


def test_what_boxes_send_grows_with_the_rows(spark, monkeypatch):
    """Points go to a bounded number of blocks, not to every part of a crowd."""
    sent, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *args: sent.append(self) or plain(self, *args))
    monkeypatch.setattr(cells, "CROWD", 8)
    for n in (320, 1280):
        assert pairs.box_pairs(crowded(spark, n)).count() == n * (n - 1)
    points = [tiles.select(F.sum(F.size("left") + F.size("right"))).first()[0] for tiles in sent]
    assert len(points) == 2 and 0 < points[1] <= 4 * points[0] <= 4 * 320 * (cells.MOST + 1)


def test_boxes_are_small_in_files(spark, tmp_path):
    """The j of an i come in runs, each again for the next i, so that files hold less than half a byte for a pair."""
    pairs.box_pairs(crowded(spark, 2000)).coalesce(1).write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 2000 * 1999


@pytest.mark.parametrize(("run", "most", "held"), [(504, 16, 1 << 20), (7, 3, 1 << 20), (3, 1, 10)])
def test_boxes_of_blocks_equal_all_pairs(spark, monkeypatch, run, most, held):
    for name, value in (("CROWD", 9), ("RUN", run), ("MOST", most), ("HELD", held), ("PAIRS", 50)):
        monkeypatch.setattr(cells, name, value)
    rows = conditions(random.Random(5), 200)
    rows = [(r[0], r[1] * 2 if i % 3 else r[1], *r[2:]) for i, r in enumerate(rows)]
    base = pa.array([r[0] for r in rows])
    got = pairs.box_pairs(spark.createDataFrame(rows, COND), dist=2.5, scope="scope").collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[4:] == b[4:] and all(abs(a[c] - b[c]) <= t for c, t in ((1, 2.0), (2, 2.5), (3, 1.0)))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and want
    # the tile itself, with the sizes above (workers have those of the module)
    points = pa.StructArray.from_arrays([pa.array([float(r[c]) for r in rows]) for c in (1, 2, 3)] + [base], ["x", "y", "z", "id"])
    cut = len(rows) // 3
    left, right = (pa.ListArray.from_arrays(pa.array(x, pa.int32()), points) for x in ([0, 0, cut], [0, 5, len(rows)]))
    batch = pa.RecordBatch.from_arrays([left, right, pa.array([False, True])], ["left", "right", "both"])
    near = lambda a, b: all(abs(a[c] - b[c]) <= t for c, t in ((1, 2.0), (2, 2.5), (3, 1.0)))
    one, two = [(a[0], b[0]) for a in rows[:cut] for b in rows[5:] if near(a, b)], [(b[0], a[0]) for a in rows[:cut] for b in rows[5:] if near(a, b)]
    made = [p for out in cells._box_pairs(iter([batch]), (2.0, 2.5, 1.0)) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert sorted(made) == sorted(one + two)


def test_boxes_at_their_edges(spark):
    """A difference that rounds to a side counts, as in SQL, though the points are two cells apart; what is no number is near nothing."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.9999999999999998, 1.0, 0.0), (2, 4.0, 1.0, 0.0), (3, 4.0, 6.0, 1.0), (4, nan, 1.0, 0.0), (5, nan, 1.0, 0.0), (6, inf, 1.0, 0.0), (7, inf, 1.0, 0.0), (8, None, 1.0, 0.0)]
    got = pairs.box_pairs(spark.createDataFrame([(*r, 0, 0) for r in rows], COND)).collect()
    assert abs(rows[0][1] - rows[1][1]) <= 2.0 and sorted(map(tuple, got)) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert pairs.box_pairs(spark.createDataFrame([], COND)).count() == 0


def test_boxes_of_named_windows(spark):
    """Keys of windows of named scenarios are structs."""
    rows = spark.range(6).select(F.struct(F.format_string("s%d", F.col("id") % 2).alias("scenario_id"), F.col("id").alias("start")).alias("wid"), F.lit(0).alias("bucket"), *(F.lit(1.0).alias(c) for c in ("speed_mean", "dist_mean", "vrel_mean")))
    assert len({(tuple(r["i"]), tuple(r["j"])) for r in pairs.box_pairs(rows).collect()}) == 30


def scale(values, mode):
    ordered = sorted(values)
    low = lambda v: sorted(v)[(len(v) - 1) // 2]
    if mode == "mad":
        return max(low([abs(v - low(ordered)) for v in values]), 1e-6)
    return max(float(np.quantile(values, 0.75) - np.quantile(values, 0.25)) if mode == "iqr" else float(np.std(values, ddof=1)), 1e-6)


@pytest.mark.parametrize(("crowd", "mode", "scoped", "k"), [(2048, "mad", True, 5), (4, "iqr", True, 3), (2048, "std", False, 40), (9, "mad", False, 1)])
def test_condition_neighbours_equal_all_pairs(spark, monkeypatch, crowd, mode, scoped, k):
    monkeypatch.setattr(cells, "CROWD", crowd)
    rows = conditions(random.Random(2), 150)
    got = pairs.condition_knn(spark.createDataFrame(rows, COND), k, mode, "scope" if scoped else None).collect()
    want, fallback = set(), set()
    for s in (0, 1) if scoped else (None,):
        own = [r for r in rows if s is None or r[5] == s]
        scales = [scale([r[c] for r in own], mode) for c in (1, 2, 3)]
        for a in own:
            near = [(round(sum(((a[c] / z - b[c] / z) ** 2 for c, z in zip((1, 2, 3), scales, strict=True)), 0.0) ** 0.5, 12), b[0]) for b in own if b[0] != a[0] and b[4] == a[4]]
            want |= {(a[0], j, r) for r, (_, j) in enumerate(sorted(near)[:k], 1)}
            if not near:
                fallback |= {(a[0], b[0]) for b in own if b[0] != a[0]}
    assert fallback and {(r["i"], r["j"]) for r in got if r["fallback"]} == fallback
    assert {(r["i"], r["j"], r["rank"]) for r in got if not r["fallback"]} == want
    assert len(got) == len(want) + len(fallback)


def test_neighbours_of_the_whole_table(spark, sf_dir):
    """cond_knn_join looks at all windows of a bucket, not at those of ten scenarios."""
    from motionlake.plans.queries import ORACLES, QUERIES

    assert "scope" not in ORACLES["cond_knn_join"]
    plan = QUERIES["cond_knn_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "div 10)" not in plan


def test_one_point_many_times_is_one_point(spark, monkeypatch):
    """Rows at one point meet through their least ids: what is compared does not grow with their number."""
    met, plain = [], cells.meet

    def counting(*args):
        met.append(plain(*args))
        return met[-1]

    monkeypatch.setattr(cells, "meet", counting)
    rows = spark.range(3000).select(F.lit("g").alias("g"), "id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), (F.col("id") % 3 == 0).cast("double").alias("z"))
    got = cells.nearest(rows, "g", 4)
    assert got.count() == 12_000 and got.where("d > 0").count() == 0
    assert {tuple(r) for r in got.where("i = 3").select("j", "rank").collect()} == {(0, 1), (6, 2), (9, 3), (12, 4)}
    assert met[0].count() <= 10


def test_lag_kernel_equals_plain_correlations(spark):
    rng = random.Random(3)
    rows = [(w, i, (a := rng.gauss(0, 1)), 0.0 if w == 3 else a * 0.2 + rng.gauss(0, 1), rng.random() < 0.8) for w in range(5) for i in range(30)]
    rows += [(9, i, rng.gauss(0, 1), 1.0, i < 4) for i in range(30)]
    got = {r["wid"]: r for r in features.sync_lag(spark.createDataFrame(rows, "wid long, i long, a double, fa double, following boolean"), 10).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 9}
    for w in (0, 1, 2, 4):
        a, fa = (np.array([r[c] for r in rows if r[0] == w and r[4]]) for c in (2, 3))
        tried = []
        for lag in range(-10, 11):
            x, y = a[max(lag, 0) : len(a) + min(lag, 0)], fa[max(-lag, 0) : len(a) - max(lag, 0)]
            if len(x) >= 3 and x.std() > 1e-8 and y.std() > 1e-8:
                tried.append((round(float(((x - x.mean()) * (y - y.mean())).mean() / x.std() / y.std()), 12), -lag))
        assert got[w]["acc_sync_lag"] == -max(tried)[1] and got[w]["acc_sync_corr"] == pytest.approx(max(tried)[0])
    assert got[3]["acc_sync_lag"] is None and got[9]["acc_sync_lag"] is None


def test_silhouette_equals_plain_code(spark):
    rng = np.random.default_rng(4)
    x, labels = rng.normal(size=(90, 4)), [f"l{i % 4}" for i in range(89)] + ["alone"]
    rows = spark.createDataFrame([(i, l, [float(v) for v in p]) for i, (l, p) in enumerate(zip(labels, x, strict=True))], "row_index long, label string, embedding array<double>")
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    want = []
    for i in range(90):
        means = {l: np.mean([d[i, j] for j in range(90) if labels[j] == l and j != i]) for l in set(labels) if l != labels[i] or labels.count(l) > 1}
        own = means.pop(labels[i], None)
        want.append(0.0 if own is None else (min(means.values()) - own) / max(min(means.values()), own))
    for block in (2048, 20):
        got = {r["row_index"]: r["silhouette"] for r in evaluate.silhouette(rows, "label", block).collect()}
        assert [got[i] for i in range(90)] == pytest.approx(want)
    assert evaluate.silhouette(rows.where("row_index < 0"), "label").count() == 0
