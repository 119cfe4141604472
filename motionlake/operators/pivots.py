"""Exact nearest neighbours of a table among itself, with pivots in place of all blocks against all blocks.

1. PIVOTS vectors drawn by hash are pivots; each vector belongs to the cell of its nearest one. A cell's summary is its number of
   vectors, the largest distance to the pivot and the k + 1 smallest: a bounded table.
2. For each cell the summaries bound how far the k-th neighbour of any of its vectors can be: the (k + 1)-th smallest of
   largest distance + distance of the pivots + a small distance of the other cell.
3. A vector is a candidate for a cell unless the triangle inequality, or the plane half way between two pivots, puts it beyond
   that bound for all vectors of the cell. Cells are dealt into blocks of about `block` vectors, near cells together, large cells
   into several; a vector is sent once to each block of queries that may need it, and a block of queries only to blocks
   that hold a candidate of it.
4. Blocks are compared with NumPy as they are without pivots. No block holds more than about `block` queries and as many candidates.

Cosine distances are those of unit vectors, whose squared distance is twice as large. Vectors without a direction are at
distance 1 from all: they stand aside in a cell that every vector is a candidate for, and are candidates for every cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Pivots at most, and vectors of a cell at least on average. Distances have this relative slack for rounding.
PIVOTS, PER_PIVOT, SLACK = 1024, 64, 1e-6


def _points(batch: pd.DataFrame, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in which the metric is a Euclidean distance, and which of them have a direction."""
    x = np.stack(batch["embedding"].to_numpy()).astype(float)
    if metric != "cosine":
        return x, np.ones(len(x), bool)
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1.0)[:, None], size > 0


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def _summaries(base: DataFrame, pivots: np.ndarray, metric: str, k: int) -> pd.DataFrame:
    """cell, n, far, near (the k + 1 smallest distances, ascending): one row per cell with vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, float, np.ndarray]] = {}
        for batch in batches:
            x, directed = _points(batch, metric)
            d = _to_pivots(x[directed], pivots)
            cell = d.argmin(1)
            own = d[np.arange(len(d)), cell]
            for c in np.unique(cell):
                mine = own[cell == c]
                n, far, near = held.get(c, (0, 0.0, np.zeros(0)))
                held[c] = n + len(mine), max(far, mine.max()), np.sort(np.concatenate([near, mine]))[: k + 1]
            if not directed.all():
                held[-1] = held.get(-1, (0, 0.0, np.zeros(0)))[0] + int((~directed).sum()), 0.0, np.zeros(0)
        yield pd.DataFrame([(int(c), n, far, near.tolist()) for c, (n, far, near) in held.items()], columns=["cell", "n", "far", "near"])

    parts = base.select("embedding").mapInPandas(run, "cell int, n long, far double, near array<double>")
    small = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)  # k + 1 of each task
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), small.alias("near")).toPandas()


def _bounds(summary: pd.DataFrame, between: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell: its largest distance, and how far the k-th neighbour of its vectors can be. Empty cells have none."""
    m = len(between)
    far, most = np.full(m, -np.inf), np.full(m, -np.inf)
    cells = summary[summary["cell"] >= 0]
    far[cells["cell"]] = cells["far"]
    at = np.concatenate([np.full(len(near), c) for c, near in zip(cells["cell"], cells["near"], strict=True)] or [np.zeros(0, int)]).astype(int)
    near = np.concatenate([*map(np.asarray, cells["near"]), np.zeros(0)])
    for c in cells["cell"]:
        reach = between[c, at] + near
        most[c] = far[c] + np.partition(reach, k)[k] if len(reach) > k else np.inf
    return far, most


def _blocks(summary: pd.DataFrame, pivots: np.ndarray, block: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each cell. Small cells that lie near each other along the pivots' main axis share one."""
    sizes = dict(zip(summary["cell"], summary["n"], strict=True))
    _, _, axis = np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)
    along = pivots @ axis[0]
    out, at, room = {}, -1, 0
    for c in sorted((c for c in sizes if c >= 0), key=lambda c: along[c]) + [c for c in sizes if c < 0]:
        n = sizes[c]
        if n > block or n > room or c < 0:
            parts = -(-n // block)
            out[int(c)] = at + 1, parts
            at, room = at + parts, block - n if parts == 1 else 0
        else:
            out[int(c)] = at, 1
            room -= n
    return out


def dealt(base: DataFrame, k: int, metric: str, block: int, n: int) -> DataFrame:
    """row_index, embedding, q, c, query: queries and candidates of each pair of blocks that may hold neighbours. base: n rows (row_index, embedding)."""
    spark = base.sparkSession
    drawn = base.select("embedding").where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("row_index")).limit(max(1, min(PIVOTS, n // PER_PIVOT))).toPandas()
    pivots, directed = _points(drawn, metric)
    pivots = pivots[directed] if directed.any() else pivots[:1]
    between = _to_pivots(pivots, pivots)
    summary = _summaries(base, pivots, metric, k)
    far, most = _bounds(summary, between, k)
    blocks = _blocks(summary, pivots, block)
    shared = spark.sparkContext.broadcast((pivots, between, far, most, blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, between, far, most, blocks = shared.value
        aside = list(range(blocks[-1][0], sum(blocks[-1]))) if -1 in blocks else []
        used = np.array([c for c in range(len(pivots)) if c in blocks], int)
        of_cell = np.zeros((len(used), max(map(sum, blocks.values()))), np.float32)
        for x, c in enumerate(used):
            of_cell[x, blocks[c][0] : sum(blocks[c])] = 1
        for batch in batches:
            x, directed = _points(batch, metric)
            d = _to_pivots(x, pivots)
            cell = d.argmin(1)
            own = d[np.arange(len(d)), cell]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d[:, used] ** 2 - own[:, None] ** 2) / (2 * between[cell][:, used])
            least = np.fmax(d[:, used] - far[used], np.where(between[cell][:, used] > 0, plane, 0.0))
            wanted = least <= most[used] * (1 + SLACK) + SLACK
            first, parts = np.array([blocks[int(c) if has else -1] for c, has in zip(cell, directed, strict=True)]).T
            at = first + np.array([hash(i) for i in batch["row_index"].tolist()]) % parts
            sent = wanted.astype(np.float32) @ of_cell > 0  # to blocks
            sent[:, aside] = True
            sent[~directed] = True
            to = np.split(np.nonzero(sent)[1].astype(np.int32), np.cumsum(sent.sum(1))[:-1])
            rows = pd.DataFrame({"row_index": batch["row_index"].to_numpy(), "embedding": batch["embedding"].to_numpy(), "at": at, "to": to})
            yield rows

    held = stored(base.select("row_index", "embedding").mapInPandas(run, "row_index long, embedding array<double>, at int, to array<int>"))
    candidates = held.select("row_index", "embedding", F.explode("to").alias("q"), F.col("at").alias("c"), F.lit(False).alias("query"))
    pairs = held.select(F.explode("to").alias("q"), F.col("at").alias("c")).distinct()  # of blocks
    queries = held.select("row_index", "embedding", F.col("at").alias("q")).join(pairs, "q").select("row_index", "embedding", "q", "c", F.lit(True).alias("query"))
    return candidates.unionByName(queries)
