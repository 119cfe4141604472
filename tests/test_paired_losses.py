"""Losses over pairs that are made once, against those that join their similarities and targets."""

import random

import pytest
from pyspark.sql import functions as F

from motionlake.operators import pairs


def odd_vectors(spark):
    """Scopes with repeated ids, an id in two scopes, null ids, scopes and vectors, equal vectors, and a row alone."""
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    rows = [(scope, 100 * scope + n, vector()) for scope in (0, 1, 2) for n in range(14)]
    rows += [(0, 3, vector()), (0, 3, rows[3][2]), (1, 3, vector()), (1, 104, None), (1, 105, [1.0, None, 2.0, 0.0]), (2, 205, [0.0] * 4)]
    rows += [(2, None, vector()), (2, None, vector()), (None, 5, vector()), (3, 300, vector()), (4, 400, None), (4, 401, None)]
    return spark.createDataFrame(rows, "scope long, row_index long, embedding array<double>").repartition(5)


def plain(rows):
    return sorted(str(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows.collect())


def paired(v):
    return pairs.similarities(pairs.scoped_pairs(v, ends=True), 0.1, keep_self=True, paired=True)


def joined_logits(near):
    return near.join(pairs.local_scales(near), "i").withColumn("logit", -F.col("d") / F.col("sigma")).drop("sigma")


def test_paired_rows_are_those_of_both_joins(spark):
    v = odd_vectors(spark)
    assert plain(paired(v).select("scope", "i", "j", "s")) == plain(pairs.similarities(v, 0.1, keep_self=True))
    assert plain(paired(v).where("i <> j").select("scope", "i", "j", "d")) == plain(pairs.scoped_pairs(v))


def test_logits_without_a_join_equal_those_with_one(spark):
    near = pairs.scoped_pairs(odd_vectors(spark)).unionByName(spark.createDataFrame([(9, None, 1, 1.0), (9, None, 2, 2.0)], "scope long, i long, j long, d double"))
    assert plain(pairs.kernel_logits(near).select("i", "j", "d", "logit")) == plain(joined_logits(near).select("i", "j", "d", "logit"))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_paired_losses_equal_joined_ones(spark, k):
    v = odd_vectors(spark)
    near = pairs.scoped_pairs(v)
    soft = pairs.soft_kl(pairs.similarities(v, 0.1, keep_self=True), pairs.soft_targets(joined_logits(near)))
    assert plain(pairs.soft_kl(pairs.soft_targets(pairs.kernel_logits(paired(v))))) == plain(soft)
    assert plain(pairs.supcon(paired(v), None, k)) == plain(pairs.supcon(pairs.similarities(v, 0.1), near, k))


def test_hybrid_loss_joins_vectors_once(spark, sf_dir):
    """Pairs are shuffled by their anchor, and are not joined with each other."""
    from motionlake.plans import reports  # noqa: F401
    from motionlake.plans.queries import QUERIES

    df = QUERIES["hybrid_loss"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any(", j#" in line for line in joins)
    assert plan.count(" Exchange ") <= 10
    assert df.columns == ["scope", "soft", "sup", "loss"]
