"""Nearest neighbours by pivots against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import pairs, pivots


def plain(x, k, metric):
    d = pairs.distances(x, x, metric)
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[i, j], 12), j))
        out |= {(i, j, r) for r, j in enumerate(order[:k], 1)}
    return out


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_index long, embedding array<double>")


def clustered(rng, n, dim, spread):
    centres = rng.normal(size=(12, dim)) * 10
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("kind", ["clusters", "cloud", "ties"])
def test_neighbours_equal_all_pairs(spark, monkeypatch, metric, kind):
    monkeypatch.setattr(pivots, "PER_PIVOT", 16)
    rng = np.random.default_rng(7)
    x = {"clusters": clustered(rng, 400, 8, 0.3), "cloud": rng.normal(size=(300, 5)), "ties": rng.integers(0, 3, size=(300, 3)).astype(float)}[kind]
    x[5] = 0  # no direction
    got = pairs.knn(table(spark, x), 6, metric, block=32).collect()
    if kind == "ties" and metric == "l2":  # the matrix product rounds alike for equal vectors only
        d = pairs.distances(x, x, metric)
        assert len(got) == 6 * len(x) and all(sum(np.round(d[r["i"]], 6) < round(r["d"], 6)) <= r["rank"] for r in got)
    else:
        assert {(r["i"], r["j"], r["rank"]) for r in got} == plain(x, 6, metric)


def test_clusters_send_few_copies(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PER_PIVOT", 16)
    x = table(spark, clustered(np.random.default_rng(8), 2000, 16, 0.2))
    some = pivots.dealt(x, 5, "l2", 100, 2000)
    everything = pairs._all_blocks(x, 20)
    assert some.count() < everything.count() / 4
    assert some.groupBy("q", "c", "query").count().agg(F.max("count")).first()[0] <= 200


def test_few_vectors_and_more_neighbours_than_there_are(spark):
    x = np.random.default_rng(9).normal(size=(40, 3))
    got = pairs.knn(table(spark, x), 60, "l2", block=8).groupBy("i").count().collect()
    assert len(got) == 40 and all(r["count"] == 39 for r in got)
    assert pairs.knn(table(spark, x[:1]), 3, "l2", block=8).count() == 0


def test_what_is_sent_grows_with_the_table():
    """Every block meets every other: their number must not grow with the rows (600,000 vectors were 293 blocks)."""
    assert pairs.block_count(600_000, 64) == pairs.block_count(100_000, 64) == 16
    assert pairs.block_count(400, 64) == 1 and pairs.block_count(400, 64, 100) == 4
    assert 4096 * 8 * 100_000 / pairs.block_count(100_000, 4096) <= pairs.BYTES


@pytest.mark.parametrize("farthest", [False, True])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_tiles_keep_the_best(monkeypatch, metric, farthest):
    monkeypatch.setattr(pairs, "TILE", (64, 100))
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(400, 6)), rng.integers(0, 3, size=(300, 3)).astype(float), rng.normal(size=(300, 5)) * 1e-3 + 50):
        x[5] = 0
        ids = rng.permutation(len(x)) * 3
        got = list(zip(*(z.tolist() for z in pairs.best_of(ids, x, ids, x, 6, metric, farthest)[:2]), strict=True))
        want = []
        for r in range(len(x)):
            d = np.round(pairs._exact(np.repeat(x[[r]], len(x), 0), x, metric), 12) * (-1 if farthest else 1)
            want += [(ids[r], j) for _, j in sorted((d[c], ids[c]) for c in range(len(x)) if c != r)[:6]]
        assert got == want
