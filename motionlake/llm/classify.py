"""Quality classifier: regularised quadratic discriminant analysis over transformed text statistics.

* Statistics are read off each whole text in one Arrow pass and transformed to be closer to normal
  (logs of counts, log-odds of shares). Labels, lang, source and ids are never inputs.
* Training: counts, sums and products of the statistics per class over all training rows, one
  aggregate; the driver gets d * (d + 3) / 2 + 1 numbers per class.
* Each class covariance is shrunk: (1 - a - b) * own + a * pooled + b * mean variance * identity.
* Score: the class log densities by Mahalanobis distance, from Cholesky factors computed once and sent
  with the scoring function; their difference and the log prior odds go through the logistic function.

Training rows are those with crc32(doc_id as text) mod 5 other than 0. Contradicting labels of one id are
left out. With one class only, the score is that class's share. Null text is the empty text, which has
statistics and a score like any other. Repeated rows are scored each, and an id labelled more than once counts once.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, materialize

STATISTICS = ("log_words", "log_word_chars", "symbol_share", "punct_share", "digit_share", "upper_share", "distinct_share", "line_repeat", "log_line_words", "high_share", "pipe_share", "end_share", "short_words", "top_word")


def _classes() -> np.ndarray:
    """One row per byte class, a 1 for each byte in it."""
    out = np.zeros((7, 256))
    for k, chars in enumerate((b"#*$%&<>@^~_=+\\/{}[]", b".,;:!?'\"()-", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"|", b"\n", b" \t\r\x0b\x0c\n")):
        out[k, list(chars)] = 1
    return out


_CLASSES = _classes()


def _odds(part: float, whole: float) -> float:
    """Log-odds of a share, with half a case added to both sides."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def text_statistics(text: str) -> list[float]:
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    symbols, punct, digits, upper, pipes, breaks, space = (_CLASSES @ counts).tolist()
    high = float(counts[128:192].sum())
    chars = len(data) - space
    words = data.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x]
    ends = sum(x.endswith((b".", b"!", b"?")) for x in lines)
    return [
        math.log1p(n), math.log((chars + 1) / (n + 1)), _odds(symbols, chars), _odds(punct, chars), _odds(digits, chars), _odds(upper, chars),
        math.log((len(seen) + 1) / (n + 1)) / (1 + math.log1p(n)), _odds(len(lines) - len(set(lines)), len(lines)), math.log((n + 1) / (breaks + 1)),
        _odds(high, chars), _odds(pipes, chars), _odds(ends, len(lines)), _odds(sum(len(w) <= 3 for w in words), n), _odds(max(seen.values(), default=0), n),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of the statistics) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [text_statistics(t or "") for t in batch["text"]]})

    sent = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return map_pandas(sent, run, "doc_id string, x array<double>").select(F.col("doc_id").cast("long").alias("doc_id"), "x")


class Qda:
    """Two Gaussian classes with shrunk covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.3, identity: float = 0.05):
        n = {c: m[0] for c, m in moments.items()}
        self.share = n.get(1, 0) / max(sum(n.values()), 1)
        self.fitted = min(n.get(0, 0), n.get(1, 0)) > 1
        if not self.fitted:
            return
        mean = {c: s / k for c, (k, s, _) in moments.items()}
        own = {c: p / k - np.outer(mean[c], mean[c]) for c, (k, _, p) in moments.items()}
        # statistics are put on one scale, so that the identity target weighs each alike
        both = sum(n[c] * own[c] for c in own) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
        unit = {c: v / np.outer(self.scale, self.scale) for c, v in own.items()}
        together = both / np.outer(self.scale, self.scale)
        self.mean = {c: m / self.scale for c, m in mean.items()}
        self.inverse_factor, self.log_norm = {}, {}
        for c, v in unit.items():
            shrunk = (1 - pooled - identity) * v + pooled * together + identity * max(np.trace(v) / len(v), 1e-3) * np.eye(len(v))
            factor = np.linalg.cholesky(shrunk)
            self.inverse_factor[c] = np.linalg.solve(factor, np.eye(len(v)))
            self.log_norm[c] = math.log(n[c]) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z = x / self.scale
        log = {c: self.log_norm[c] - 0.5 * (((z - self.mean[c]) @ self.inverse_factor[c].T) ** 2).sum(1) for c in (0, 1)}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(rows: DataFrame, **shrinkage) -> Qda:
    """rows: x and quality (0 or 1)."""
    d = len(STATISTICS)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    moments = {}
    for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *sums).collect():
        products = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        moments[r["quality"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), products)
    return Qda(moments, **shrinkage)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **shrinkage) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = materialize(with_statistics(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    training = rows.where(~held_out).join(known.select("doc_id", "quality"), "doc_id")
    model = fit(training, **shrinkage)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0), index=x.index)

    scored = rows.select("doc_id", held_out.alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
