"""Learned operators: probes, the linear policy classifier, projections, clusters and the sequence encoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import selection
from ..session import ship_package
from .evaluate import average_ranks


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("embedding"))


def policy_classifier(train: DataFrame, evaluated: DataFrame, label: str = "policy_id", c: float = 1.0) -> DataFrame:
    """row_index, label, predicted: multinomial logistic regression with an L2 penalty of 1 / (c n), intercept free."""
    rows = _features(train).withColumn("label", F.col(label).cast("double"))
    model = LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / (c * max(rows.count(), 1)), maxIter=200, tol=1e-9).fit(rows)
    out = model.transform(_features(evaluated))
    return out.select("row_index", F.col(label).alias("label"), F.col("prediction").cast("bigint").alias("predicted"))


def probe(train: DataFrame, evaluated: DataFrame, target: str, ridge: float = 0.0, least: int = 5) -> DataFrame:
    """One row: n_train, n_eval, spearman, r2, rmse, note of a linear probe of `target` from the embedding.

    Fewer than `least` rows or a constant target give NULLs and a note.
    """
    fit_on, test = train.where(F.col(target).isNotNull()), evaluated.where(F.col(target).isNotNull())
    s = fit_on.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("sd")).first()
    m = test.count()
    spark = train.sparkSession
    schema = "n_train long, n_eval long, spearman double, r2 double, rmse double, note string"
    if s["n"] < least or m < least:
        return spark.createDataFrame([(s["n"], m, None, None, None, f"skipped_small_n({s['n']},{m})")], schema)
    if (s["sd"] or 0) < 1e-8:
        return spark.createDataFrame([(s["n"], m, None, None, None, "skipped_low_variance")], schema)
    # Spark scales the target by its deviation before it applies the penalty
    model = LinearRegression(labelCol=target, regParam=ridge * s["sd"] / s["n"], standardization=False, solver="normal").fit(_features(fit_on))
    p = average_ranks(average_ranks(model.transform(_features(test)), target, "rt"), "prediction", "rp")
    e = F.col(target) - F.col("prediction")
    n = F.count("*")
    rank = F.covar_pop("rt", "rp") * n / (F.sqrt(F.var_pop("rt") * n) * F.sqrt(F.var_pop("rp") * n) + 1e-12)
    return p.agg(F.lit(s["n"]).cast("long").alias("n_train"), n.alias("n_eval"), rank.alias("spearman"), (1 - F.try_divide(F.sum(e * e), F.var_pop(target) * n)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.lit("").alias("note"))


def pca(rows: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """row_index, projection (array) and the explained shares. Centred first; signs are arbitrary."""
    f = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False)
    base = _features(rows)
    centred = f.fit(base).transform(base)
    model = PCA(k=k, inputCol="centred", outputCol="out").fit(centred)
    return model.transform(centred).select("row_index", vector_to_array("out").alias("projection")), list(model.explainedVariance)


def kmeans(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """row_index, cluster."""
    base = _features(rows)
    return KMeans(k=k, seed=seed, initSteps=5, maxIter=50).fit(base).transform(base).select("row_index", F.col("prediction").cast("bigint").alias("cluster"))


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A sampling operator: n rows by hash order, then by row_index; reruns agree."""
    return rows.orderBy(F.xxhash64("row_index", F.lit(seed)), "row_index").limit(n).orderBy("row_index")


def holdout(rows: DataFrame, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """rows with split train or test: the first clamp(round(n * ratio), 1, n - 1) in hash order are the test rows; a single row is train.
    The cut is selected from counts of hash ranges: no task sorts or holds the rows."""
    h = F.xxhash64("row_index", F.lit(seed))
    cut = selection.smallest(rows, h, ratio).agg(F.max("cut").alias("cut"))  # one row, also where there is no cut
    return rows.crossJoin(F.broadcast(cut)).withColumn("split", F.when(h <= F.col("cut"), "test").otherwise("train")).drop("cut")


def gru_forward(x: np.ndarray, lengths: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Unit embeddings of padded sequences (B, T, D): the last valid state of a one-layer GRU through a two-layer head."""
    h = np.zeros((len(x), weights["w_hh"].shape[1]))
    n = h.shape[1]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for t in range(x.shape[1]):
        gi = x[:, t] @ weights["w_ih"].T + weights["b_ih"]
        gh = h @ weights["w_hh"].T + weights["b_hh"]
        r, z = sigmoid(gi[:, :n] + gh[:, :n]), sigmoid(gi[:, n : 2 * n] + gh[:, n : 2 * n])
        new = np.tanh(gi[:, 2 * n :] + r * gh[:, 2 * n :])
        h = np.where((t < lengths)[:, None], (1 - z) * new + z * h, h)
    out = np.maximum(h @ weights["w1"].T + weights["b1"], 0) @ weights["w2"].T + weights["b2"]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(sequences: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """row_index, embedding of sequences (row_index, frames: array of arrays). Weights are a model's fixed size, broadcast."""
    ship_package(sequences.sparkSession)
    shared = sequences.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                seqs = [np.array(list(map(np.asarray, f)), float) for f in part["frames"]]
                lengths = np.array([len(s) for s in seqs])
                x = np.zeros((len(seqs), max(lengths.max(), 1), weights["w_ih"].shape[1]))
                for n, s in enumerate(seqs):
                    if len(s):
                        x[n, : len(s)] = s
                yield pd.DataFrame({"row_index": part["row_index"].to_numpy(), "embedding": list(gru_forward(x, lengths, shared.value).astype(np.float32))})

    return sequences.select("row_index", "frames").mapInPandas(run, "row_index long, embedding array<float>")
