"""Gated candidates with their fallback: conditions are made once."""

import random

from pyspark.sql import functions as F

from motionlake.operators import features, pairs, windows
from motionlake.plans import queries


def odd_events(spark, path):
    """Frames of five scenarios, some of them null, without a value or there twice."""
    rng = random.Random(2)
    rows = [(n, n // 25, n % 25, rng.choice(["ok"] * 9 + ["error"]), rng.choice([rng.uniform(0, 9)] * 9 + [None])) for n in range(1500)]
    rows += rows[100:140] + [(9000 + n, None, n % 25, "ok", 1.0) for n in range(30)] + [(None, 70, 3, None, 2.0)]
    table = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double")
    table.withColumn("ts", F.timestamp_seconds("ts")).repartition(3).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_conditions_are_made_once(spark, tmp_path):
    """Neither the gate nor the fallback goes back to the frames."""
    d = odd_events(spark, tmp_path)
    got = queries.QUERIES["cond_fallback"](spark, d)
    assert "events.parquet" not in got._jdf.queryExecution().toString()
    cond = features.conditions(queries._kin(spark, d)).withColumn("scope", F.call_function("div", windows.scenario_of(F.col("wid")), F.lit(10)))
    rows = cond.select("scope", F.col("wid").alias("row_index"))
    want = pairs.with_fallback(pairs.box_pairs(cond, speed=0.5, scope="scope"), rows, 8).groupBy("i", "fallback").agg(F.count("*").alias("n_candidates"))
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(map(tuple, want.collect())) and len(found) > 5
