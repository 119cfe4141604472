"""Closed-loop roll-outs of a stream against those of whole windows."""

import random

import pytest
from pyspark.sql import functions as F

from motionlake.operators import rollouts
from motionlake.streaming import closed_loop

SCHEMA = "wid long, scenario_id long, start long, i long, front_id long, x double, y double, vx double, vy double, fx double, fy double, fvx double, fvy double"


def test_a_stream_drives_as_a_batch_does(spark, tmp_path):
    """Frames come in no order, over several batches and twice; the rows are those of the batch, each once."""
    rng = random.Random(1)
    rows = []
    for w in range(6):
        x, fx = 0.0, 20.0
        for i in range(25):
            v, fv, turn = (0.0 if w == 5 else rng.uniform(4, 12)), rng.uniform(4, 12), rng.uniform(-0.5, 0.5)
            x, fx = x + v * 0.1, fx + fv * 0.1
            rows.append((w, 1, w, i, 7, x, turn, v, turn, fx, 0.0, fv, 0.1))
    rows.append((99, 1, 99, 3, 7, *(0.0,) * 8))  # its first frame never comes
    whole = spark.createDataFrame(rows, SCHEMA)
    sent = rows + rng.sample(rows, 20)
    rng.shuffle(sent)
    for n in range(4):
        spark.createDataFrame(sent[n::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames"))
    made = closed_loop.drive(stream).writeStream.format("memory").queryName("driven").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    made.awaitTermination()
    assert len(made.recentProgress) >= 4
    got = {(r["wid"], r["policy_name"], r["i"]): r for r in spark.table("driven").collect()}
    assert spark.table("driven").count() == len(got) == 6 * 3 * 25
    for r in rollouts.simulate(whole.where("wid < 99"), rollouts.policy_table(spark)).collect():
        own = got[r["wid"], r["policy_name"], r["i"]]
        assert own["policy_id"] == r["policy_id"]
        assert [own[c] for c in ("x", "y", "vx", "vy")] == pytest.approx([r[c] for c in ("x", "y", "vx", "vy")], abs=1e-9)


def test_unknown_policies_are_refused(spark):
    with pytest.raises(ValueError):
        closed_loop.drive(spark.range(1).select(F.col("id").alias("wid")), ("nobody",))
