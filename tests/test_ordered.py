"""Running totals, dense numbers and draws against plain code."""

import random
from collections import defaultdict

from motionlake.functions.ordered import running_total
from motionlake.operators.evaluate import average_ranks, drawn_others
from motionlake.sources.metadata import dense_numbers


def test_running_total(spark):
    rng = random.Random(3)
    keys = [None, *sorted(f"k{rng.randrange(10**9)}é{n}" for n in range(5000))]
    amounts = {k: rng.randrange(9) for k in keys}
    want, total = {}, 0
    for k in keys:
        total += amounts[k]
        want[k] = total
    rows = spark.createDataFrame(rng.sample(list(amounts.items()), len(amounts)), "k string, n long")
    assert {r["k"]: r["t"] for r in running_total(rows, "k", "n", "t").collect()} == want
    assert running_total(rows.where("n < 0"), "k", "n", "t").isEmpty()


def test_ranks_and_numbers(spark):
    rng = random.Random(4)
    values = [rng.choice([None, float("nan"), -0.0, 0.0, 1.5, 1.5, rng.random()]) for _ in range(300)]
    known = sorted(v for v in values if v is not None and v == v)
    n_nan = sum(v is not None and v != v for v in values)
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    got = {r["i"]: r["r"] for r in average_ranks(rows, "x", "r").collect()}
    for i, v in enumerate(values):
        if v is None:
            assert i not in got
        elif v != v:
            assert got[i] == len(known) + (n_nan + 1) / 2
        else:
            assert got[i] == sum(w < v for w in known) + (known.count(v) + 1) / 2
    numbers = {r["i"]: r["number"] for r in dense_numbers(rows.where("x >= 0 AND x < 2"), "x").collect()}
    distinct = sorted({v for v in known if v >= 0})
    assert numbers == {i: distinct.index(v) for i, v in enumerate(values) if v is not None and v == v}


def test_draws(spark):
    for n, k in ((40, 5), (4, 5), (2, 1), (1, 3)):
        found = defaultdict(list)
        for r in drawn_others(spark.range(n).selectExpr("id * 7 - 9 AS row_index"), k).collect():
            found[r["i"]].append(r["j"])
        assert all(len(js) == len(set(js)) == min(k, n - 1) and i not in js for i, js in found.items())
        assert len(found) == (n if n > 1 else 0)
