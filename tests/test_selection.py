"""Order statistics by selection against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from motionlake.functions import selection
from motionlake.operators import learn


def values_of_any_kind(rng, n, kind):
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "ties":
        return [float(rng.choice([1, 1, 1, 2, 5])) for _ in range(n)]
    if kind == "close":
        return [1.0 + k * 2.0**-52 for k in rng.sample(range(4 * n), n)]
    if kind == "odd":
        return [rng.choice([0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, 3.0]) for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


def plain(rows):
    """Rows as sorted text; both zeros are one value."""
    return sorted(str(tuple(v + 0.0 if isinstance(v, float) else v for v in r)) for r in rows.collect())


def test_quantiles_equal_percentiles(spark):
    rng = random.Random(6)
    rows = []
    for kind in ("wide", "ties", "close", "odd", "gauss"):
        for x in values_of_any_kind(rng, rng.randrange(150, 300), kind):
            rows.append((kind, x, rng.choice([None, x, -x])))
    rows += [(None, 2.0, 1.0), (None, 4.0, None), ("none", None, None), ("one", 7.0, None)]
    table = spark.createDataFrame(rows, "kind string, x double, y double").repartition(5)
    for p in (0.0, 0.1, 0.99):
        got = selection.quantiles(table, {"a": (F.col("x"), p), "b": (F.col("y"), p)}, by=("kind",))
        want = table.groupBy("kind").agg(F.percentile("x", F.lit(p)).alias("a"), F.percentile("y", F.lit(p)).alias("b"))
        assert plain(got) == plain(want)
    got = selection.quantiles(table, {"a": (F.col("x"), 0.5)}, by=("kind",), discrete=True)
    want = table.groupBy("kind").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("a"))
    assert plain(got) == plain(want)


def test_quantiles_of_all_rows(spark):
    table = spark.range(10_001).select(F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double").alias("x"))
    ordered = sorted(r["x"] for r in table.collect())
    got = selection.quantiles(table, {"low": (F.col("x"), 0.01), "high": (-F.col("x"), 0.25)}).collect()
    assert [tuple(r) for r in got] == [(ordered[100], -ordered[7500])]
    assert [tuple(r) for r in selection.quantiles(table.where("x < 0"), {"low": (F.col("x"), 0.5)}).collect()] == [(None,)]
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert selection.quantiles(nan, {"m": (F.col("x"), 0.5)}).first()["m"] == 2.0 and math.isnan(selection.quantiles(nan, {"m": (F.col("x"), 1.0)}).first()["m"])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000])
def test_holdout_takes_the_smallest_hashes(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row_index")
    got = {r["row_index"]: r["split"] for r in learn.holdout(rows, 0.2, seed=3).collect()}
    hashes = sorted((r["h"], r["row_index"]) for r in rows.select("row_index", F.xxhash64("row_index", F.lit(3)).alias("h")).collect())
    take = min(max(round(n * 0.2), 1), max(n - 1, 0))
    assert got == {i: "test" if k < take else "train" for k, (_, i) in enumerate(hashes)}


def test_holdout_sorts_nothing_in_one_task(spark):
    plan = learn.holdout(spark.range(100).withColumnRenamed("id", "row_index"))._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_lower_median_holds_no_table_of_values(spark, sf_dir):
    from motionlake.plans.queries import QUERIES

    assert "percentile" not in QUERIES["lower_median"](spark, sf_dir)._jdf.queryExecution().toString()


def test_names_of_one_column_share_its_values(spark, monkeypatch):
    """Discrete and interpolated quantiles of a column store its values once, and later passes only what is near a wanted rank."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.uniform(1, 1000)) for _ in range(3000)] + [("c", None), ("c", None), (None, None), ("d", 5.0), ("d", 5.0), ("e", float("nan"))]
    table = spark.createDataFrame(rows, "kind string, x double").repartition(4)
    held, plain_stored = [], selection.stored

    def counting(df):
        out = plain_stored(df)
        held.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(selection, "stored", counting)
    x = F.col("x")
    got = selection.quantiles(table, {"low": (x, 0.5), "mid": (x, 0.5), "top": (x, 0.75), "ends": (x, 1.0)}, by=("kind",), discrete=("low", "ends"))
    want = table.groupBy("kind").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("low"), F.percentile("x", F.lit(0.5)).alias("mid"), F.percentile("x", F.lit(0.75)).alias("top"), F.max("x").alias("ends"),
    )
    assert plain(got) == plain(want)
    values = [n for columns, n in held if columns[:2] == ["g", "x"]]
    assert values[0] == len(rows) and 0 < sum(values[1:]) < len(rows) / 4


def test_passes_end_where_no_range_is_left(spark, monkeypatch):
    held, plain_stored = [], selection.stored
    monkeypatch.setattr(selection, "stored", lambda df: held.append(df) or plain_stored(df))
    table = spark.range(500).select((F.col("id") % 3).cast("double").alias("x"))
    assert tuple(selection.quantiles(table, {"m": (F.col("x"), 0.5), "top": (F.col("x"), 0.9)}).first()) == (1.0, 2.0)
    assert len(held) == 3  # values, counts and the ranges of one pass
