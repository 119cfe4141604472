"""Pair operators: neighbour graphs, condition gates and soft targets.

Pairs are edge rows (i, j, d). All-pairs work is bounded by a `scope` column (a mini-batch, a split), which is an
equi-join key; whole-table neighbour search goes block against block with NumPy, keeping k rows per
vector and block, so no task holds more than two blocks and no pair table is made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine_distance, dot, l2, length, unit
from ..functions.selection import quantiles
from ..session import ship_package, stored
from . import cells, pivots

METRICS = ("cosine", "l2")


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        ok = (na > 0)[:, None] & (nb > 0)[None, :]
        sim = (a @ b.T) / np.where(ok, np.outer(na, nb), 1.0)
        return np.where(ok, 1.0 - sim, 1.0)
    gram = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(gram, 0))


#: Blocks at most of tables whose blocks stay under BYTES, so that what is shuffled grows with the table; rows of a block at least.
BLOCKS, LEAST, BYTES = 16, 512, 32 << 20
#: Queries and candidates that are compared at once.
TILE = (512, 4096)


def block_count(rows: int, width: int, block: int | None = None) -> int:
    """Blocks for a table of vectors of `width` numbers. Every block meets every other, so a row is sent once for each block."""
    if block:
        return max(1, -(-rows // block))
    return max(1, min(BLOCKS, -(-rows // LEAST)), -(-rows * max(width, 1) * 8 // BYTES))


def _all_blocks(base: DataFrame, n: int) -> DataFrame:
    """Queries and candidates of every pair of n blocks."""
    own = base.withColumn("b", F.pmod(F.xxhash64("row_index"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("q", F.col("b")).withColumn("c", every).withColumn("query", F.lit(True))
    right = own.withColumn("c", F.col("b")).withColumn("q", every).withColumn("query", F.lit(False))
    return left.unionByName(right).drop("b")


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of a to the same rows of b."""
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    size = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.where(size > 0, 1.0 - (a * b).sum(1) / np.where(size > 0, size, 1.0), 1.0)


def best_of(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int, metric: str, farthest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, d of the k best candidates of each query, ties (to 12 digits) by j, never itself.

    A product in single precision leaves out candidates that are worse than a query's k-th so far by more than its rounding; the
    others get their distances in double precision. So all that is kept is exact, and only a tile is held.
    """
    sign = -1.0 if farthest else 1.0
    order = np.argsort(ci, kind="stable")
    ci, c = ci[order], c[order]
    if metric == "cosine":
        unit_of = lambda x: x / np.where((size := np.linalg.norm(x, axis=1)) > 0, size, 1.0)[:, None]
        a, b = unit_of(q), unit_of(c)
        offset_a, offset_b, factor = np.zeros(len(a)), np.ones(len(b)), -1.0
        zero = ~(a != 0).any(1)
    else:
        mid = c.mean(0)
        a, b = q - mid, c - mid
        offset_a, offset_b, factor = (a * a).sum(1), (b * b).sum(1), -2.0
        zero = np.zeros(len(a), bool)
    # a bound for the rounding of one product and its sums, whatever the order of the terms
    slack = (q.shape[1] + 8) * 2.0**-22 * (np.sqrt((a * a).sum(1)).max() + np.sqrt((b * b).sum(1)).max()) ** 2 + 1e-11
    if not np.isfinite(slack) or slack > 1e30:
        slack = np.inf  # beyond single precision: all candidates are compared exactly
    a32, b32 = (factor * a).astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    off32 = offset_b.astype(np.float32)
    out = []
    for q0 in range(0, len(q), TILE[0]):
        rows = np.arange(q0, min(q0 + TILE[0], len(q)))
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))  # query, candidate, distance
        limit = np.full(len(rows), np.inf)  # of sign * (product + offset of the candidate)
        at, step = 0, max(64, 4 * k)
        while at < len(c):
            part = slice(at, min(at + step, len(c)))
            at, step = part.stop, min(step * 4, TILE[1])
            s = a32[rows] @ b32[:, part]
            s += off32[part]
            if farthest:
                np.negative(s, out=s)
            near = ~(s > (limit + slack)[:, None].astype(np.float32))
            near[zero[rows]] = True
            x, y = np.divmod(np.flatnonzero(near), near.shape[1])
            y += part.start
            other = qi[rows][x] != ci[y]
            x, y = x[other], y[other]
            d = np.concatenate([_exact(q[rows[x[p : p + 65536]]], c[y[p : p + 65536]], metric) for p in range(0, len(x), 65536)] or [np.zeros(0)])
            x, y, d = (np.concatenate(z) for z in zip(held, (x, y, d), strict=True))
            by = np.lexsort((y, sign * np.round(d, 12), x))  # candidates stand by j
            x, y, d = x[by], y[by], d[by]
            first = np.searchsorted(x, x)
            keep = np.arange(len(x)) - first < k
            held = x, y, d = x[keep], y[keep], d[keep]
            full = np.flatnonzero(np.bincount(x, minlength=len(rows)) == k)
            last = d[np.searchsorted(x, full, side="right") - 1]
            reach = last + sign * 1e-12
            limit[full] = sign * (reach if metric == "cosine" else np.maximum(reach, 0.0) ** 2 - offset_a[rows[full]])
        x, y, d = held
        out.append((qi[rows][x], ci[y], d))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def knn(vectors: DataFrame, k: int, metric: str = "cosine", farthest: bool = False, block: int | None = None, scope: str | None = None) -> DataFrame:
    """i, j, d, rank (from 1) of the k nearest (or farthest) other vectors; ties by j. vectors: row_index, embedding.

    With fewer than k others, all of them. Distances that agree to 12 digits count as ties. A whole table of several blocks goes by
    pivots (see `pivots`), which leave out blocks without neighbours; the farthest, and those within a scope, go block against block.
    Blocks have `block` rows, or else as many as `block_count` says.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    ship_package(vectors.sparkSession)
    base = vectors.select("row_index", "embedding", (F.col(scope) if scope else F.lit(0)).cast("string").alias("scope"))
    size = base.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n = block_count(size["n"], size["width"] or 1, block)
    if n > 1 and not farthest and scope is None:
        both = pivots.dealt(base, k, metric, -(-size["n"] // n), size["n"]).withColumn("scope", F.lit("0"))
    else:
        both = _all_blocks(base, n)

    def best(group: pd.DataFrame) -> pd.DataFrame:
        q, c = group[group["query"]], group[~group["query"]]
        if not len(q) or not len(c):
            return pd.DataFrame({"i": [], "j": [], "d": []}).astype({"i": "int64", "j": "int64"})
        i, j, d = best_of(q["row_index"].to_numpy(), np.stack(q["embedding"].to_numpy()).astype(float), c["row_index"].to_numpy(), np.stack(c["embedding"].to_numpy()).astype(float), k, metric, farthest)
        return pd.DataFrame({"i": i, "j": j, "d": d})

    # a fixed number of partitions: AQE goes by bytes, and the work of a block grows faster than those
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope", "q", "c")
    near = both.groupBy("scope", "q", "c").applyInPandas(best, "i long, j long, d double")
    order = F.round("d", 12) * (-1.0 if farthest else 1.0)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(order, "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def scoped_pairs(vectors: DataFrame, metric: str = "l2", scope: str = "scope", ends: bool = False) -> DataFrame:
    """scope, i, j, d for all other vectors of the same scope. Cost grows with the square of a scope, so keep scopes bounded.
    ends: with the vectors and their lengths (x, y, x_norm, y_norm), and with pairs of an id and itself, which have no d."""
    more = [length(F.col("embedding")).alias("norm")] if ends else []
    rows = vectors.select(scope, "row_index", "embedding", *more)
    a = rows.withColumnsRenamed({"row_index": "i", "embedding": "x", "norm": "x_norm"})
    b = rows.withColumnsRenamed({"row_index": "j", "embedding": "y", "norm": "y_norm"})
    d = l2(F.col("x"), F.col("y")) if metric == "l2" else cosine_distance(F.col("x"), F.col("y"))
    if ends:
        return a.join(b, scope).withColumn("d", F.when(F.col("i") != F.col("j"), d))
    return a.join(b, scope).where("i <> j").select(scope, "i", "j", d.alias("d"))


def box_pairs(cond: DataFrame, speed: float = 2.0, dist: float = 5.0, vrel: float = 1.0, scope: str | None = None) -> DataFrame:
    """i, j whose conditions agree within the tolerances and whose buckets (and scopes, if given) are equal.

    A range join through cells of the three tolerances: blocks of points meet those of the 27 cells around their own, and the exact test is
    left over.
    """
    keys = ["bucket", *([scope] if scope else [])]
    rows = cond.select(*keys, F.col("wid").alias("id"), F.col("speed_mean").alias("x"), F.col("dist_mean").alias("y"), F.col("vrel_mean").alias("z"))
    return cells.within_box(rows, keys, (speed, dist, vrel)).select("i", "j")


def robust_scales(cond: DataFrame, mode: str = "mad", floor: float = 1e-6, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of `by`): a scale per condition: median absolute deviation (lower medians), interquartile range or
    sample deviation. Medians and quartiles are selected, not sorted."""
    names = ("speed_mean", "dist_mean", "vrel_mean")
    floored = lambda c: F.greatest(c, F.lit(floor))
    if mode == "iqr":
        ends = quantiles(cond, {f"{c}_{q}": (F.col(c), q / 100) for c in names for q in (25, 75)}, by)
        return ends.select(*by, *(floored(F.col(f"{c}_75") - F.col(f"{c}_25")).alias(f"s_{c}") for c in names))
    if mode == "std":
        return cond.groupBy(*by).agg(*(floored(F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias(f"s_{c}") for c in names))
    if mode != "mad":
        raise ValueError("mode must be mad, iqr or std")
    mid = quantiles(cond, {f"m_{c}": (F.col(c), 0.5) for c in names}, by, discrete=True)
    both = cond.join(mid, list(by)) if by else cond.crossJoin(F.broadcast(mid))
    off = both.select(*by, *(F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names))
    low = quantiles(off, {f"s_{c}": (F.col(c), 0.5) for c in names}, by, discrete=True)
    return low.select(*by, *(floored(f"s_{c}").alias(f"s_{c}") for c in names))


def condition_knn(cond: DataFrame, k: int, mode: str = "mad", scope: str | None = None) -> DataFrame:
    """i, j, d, rank, fallback: the k nearest of the same bucket by scaled distance. An anchor alone in its bucket is
    gated with all others, unranked, as a last resort. cond: wid, three conditions, bucket. With a scope, scales, buckets and the last
    resort hold within each of its values, which must not be null."""
    rows = stored(cond.withColumn("scope", F.col(scope) if scope else F.lit(0)).select("scope", "wid", "speed_mean", "dist_mean", "vrel_mean", "bucket"))
    names = ("speed_mean", "dist_mean", "vrel_mean")
    scales = robust_scales(rows, mode, by=("scope",))
    scaled = rows.join(scales, "scope").select(F.struct("scope", "bucket").alias("gate"), F.col("wid").alias("id"), *((F.col(c) / F.col(f"s_{c}")).alias(a) for c, a in zip(names, cells.AXES, strict=True)))
    near = cells.nearest(stored(scaled), "gate", k).select("i", "j", "d", "rank", F.lit(False).alias("fallback"))
    # at most one anchor for each bucket of a scope, which AQE broadcasts if they are few
    lonely = rows.groupBy("scope", "bucket").agg(F.count("*").alias("n"), F.max("wid").alias("i")).where("n = 1").select("scope", "i")
    rest = rows.select("scope", F.col("wid").alias("j")).join(lonely, "scope").where("i <> j")
    rest = rest.select("i", "j", F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("fallback"))
    return near.unionByName(rest)


def with_fallback(pairs: DataFrame, rows: DataFrame, least: int = 1) -> DataFrame:
    """pairs (i, j) of anchors that have `least` of them; other anchors of rows (scope, row_index) get all non-self rows of
    their scope, marked `fallback`."""
    counts = pairs.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    good = pairs.join(counts.select("i"), "i", "left_semi").select("i", "j", F.lit(False).alias("fallback"))
    poor = rows.select("scope", F.col("row_index").alias("i")).join(counts.select("i"), "i", "left_anti")
    rest = poor.join(rows.select("scope", F.col("row_index").alias("j")), "scope").where("i <> j").select("i", "j", F.lit(True).alias("fallback"))
    return good.unionByName(rest)


def local_scales(pairs: DataFrame, k: int = 7, floor: float = 1e-3, each: bool = False) -> DataFrame:
    """i, sigma: the distance of the k-th nearest (or of the last, with fewer). each: all pairs with the sigma of their i, if it has one."""
    if each:
        own = Window.partitionBy("i")
        rank = F.row_number().over(own.orderBy(F.col("d").asc_nulls_last(), "j"))
        kth = F.when(F.col("i").isNotNull() & (F.col("_rank") == F.least(F.lit(k), F.count("d").over(own))), F.greatest("d", F.lit(floor)))
        ranked = pairs.withColumn("_rank", rank).withColumn("_kth", kth).withColumn("sigma", F.max("_kth").over(own))
        return ranked.where("sigma is not null").drop("_rank", "_kth")
    w = Window.partitionBy("i").orderBy("d", "j")
    ranked = pairs.where("d is not null").withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("i"))})
    return ranked.where(F.col("rn") == F.least(F.lit(k), F.col("n"))).select("i", F.greatest("d", F.lit(floor)).alias("sigma"))


def kernel_logits(pairs: DataFrame, kind: str = "row", k: int = 7, alpha: float = 1.0, floor: float = 1e-3, eps: float = 1e-8) -> DataFrame:
    """pairs with `logit`: row (local scale of i), sym (of both), tau or anchor_tau (lower median of the scope's or the anchor's distances)."""
    if kind in ("tau", "anchor_tau"):
        by = "scope" if kind == "tau" else "i"
        tau = pairs.groupBy(by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("tau"))
        return pairs.join(tau, by).withColumn("logit", -F.col("d") / F.greatest("tau", F.lit(floor))).drop("tau")
    if kind == "row":
        return local_scales(pairs, k, floor, each=True).withColumn("logit", -F.col("d") / F.col("sigma") * alpha).drop("sigma")
    if kind != "sym":
        raise ValueError("kind must be row, sym, tau or anchor_tau")
    sigma = local_scales(pairs, k, floor)
    out = pairs.join(sigma, "i").join(sigma.select(F.col("i").alias("j"), F.col("sigma").alias("sigma_j")), "j")
    return out.withColumn("logit", -(F.col("d") * F.col("d")) / (F.col("sigma") * F.col("sigma_j") + eps) * alpha).drop("sigma", "sigma_j")


def soft_targets(logits: DataFrame, eps: float = 1e-8) -> DataFrame:
    """pairs with p: the softmax of the logits per anchor, renormalised."""
    w = Window.partitionBy("i")
    e = logits.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(w))
    return p.withColumn("p", F.col("p") / (F.sum("p").over(w) + eps)).drop("e")


def gate_top(pairs: DataFrame, most: int) -> DataFrame:
    """pairs of the `most` nearest of each anchor; ties by j."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return pairs.where("d is not null").withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def uniform_rows(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """targets (i, j, p), and 1 / (B - 1) for every other row of the scope of anchors that have none. rows: scope, row_index."""
    bare = rows.select("scope", F.col("row_index").alias("i")).join(targets.select("i").distinct(), "i", "left_anti")
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n")).where("n > 1")
    rest = bare.join(sizes, "scope").join(rows.select("scope", F.col("row_index").alias("j")), "scope").where("i <> j")
    return targets.select("i", "j", "p").unionByName(rest.select("i", "j", (1.0 / (F.col("n") - 1)).alias("p")))


def common_dim_stats(pairs: DataFrame, column: str = "common") -> DataFrame:
    """scope, mean, p10, p50, p90 of the dimensions that the two vectors of a pair share."""
    q = F.percentile(column, F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    out = pairs.groupBy("scope").agg(F.avg(column).alias("mean"), q.alias("q"))
    return out.select("scope", "mean", *(F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((10, 50, 90))))


def normalized(vectors: DataFrame, mode: str, clip_at: float = 0.0) -> DataFrame:
    """vectors (scope, row_index, embedding) as they are (none), at unit length (l2), or each dimension over its sample deviation in the
    scope, about its mean (batch_std); then clipped to -clip_at .. clip_at if that is over 0."""
    if mode == "l2":
        out = vectors.withColumn("embedding", unit(F.col("embedding")))
    elif mode == "batch_std":
        parts = vectors.select("scope", "row_index", F.posexplode("embedding").alias("pos", "x"))
        ends = parts.groupBy("scope", "pos").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
        ends = ends.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("ends"))
        scaled = F.zip_with("embedding", "ends", lambda x, e: (x - e["m"]) / (e["s"] + 1e-6))
        out = vectors.join(ends, "scope").withColumn("embedding", scaled).select(*vectors.columns)
    elif mode == "none":
        out = vectors
    else:
        raise ValueError("mode must be none, l2 or batch_std")
    if clip_at > 0:
        out = out.withColumn("embedding", F.transform("embedding", lambda x: F.greatest(F.lit(-clip_at), F.least(F.lit(clip_at), x))))
    return out


def hybrid(soft: DataFrame, sup: DataFrame, rows: DataFrame, w_soft: float = 1.0, w_sup: float = 1.0) -> DataFrame:
    """scope, soft, sup, loss: the weighted sum of two mean losses (i, loss) of a scope; 0 for NaN and NULL, 10000 for infinities."""
    scope = rows.select("scope", F.col("row_index").alias("i"))
    mean = lambda x, name: x.join(scope, "i").groupBy("scope").agg(F.avg("loss").alias(name))
    both = mean(soft, "soft").join(mean(sup, "sup"), "scope", "full")
    loss = w_soft * F.coalesce("soft", F.lit(0.0)) + w_sup * F.coalesce("sup", F.lit(0.0))
    return both.withColumn("loss", F.when(F.isnan(loss), 0.0).when(F.abs(loss) == float("inf"), 1e4).otherwise(loss))


def spread(targets: DataFrame, eps: float = 1e-8) -> DataFrame:
    """i, entropy, effective_k of each anchor's targets."""
    return targets.groupBy("i").agg((-F.sum(F.col("p") * F.log(F.col("p") + eps))).alias("entropy"), (1 / (F.sum(F.col("p") * F.col("p")) + eps)).alias("effective_k"))


def similarities(vectors: DataFrame, temperature: float, keep_self: bool = False, paired: bool = False) -> DataFrame:
    """scope, i, j, s: dot products of unit vectors over the temperature. paired: vectors are the pairs of scoped_pairs with their
    ends, which are not joined again and keep d."""
    if paired:
        s = dot(unit(F.col("x"), norm=F.col("x_norm")), unit(F.col("y"), norm=F.col("y_norm"))) / temperature
        return (vectors if keep_self else vectors.where("i <> j")).select("scope", "i", "j", "d", s.alias("s"))
    u = vectors.withColumn("embedding", unit(F.col("embedding")))
    a = u.select("scope", F.col("row_index").alias("i"), F.col("embedding").alias("x"))
    b = u.select("scope", F.col("row_index").alias("j"), F.col("embedding").alias("y"))
    pairs = a.join(b, "scope")
    if not keep_self:
        pairs = pairs.where("i <> j")
    return pairs.select("scope", "i", "j", (dot(F.col("x"), F.col("y")) / temperature).alias("s"))


def infonce(sims: DataFrame, positives: DataFrame | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """i, loss: minus the log share of the positives' mass among positives and negatives (all others without negatives).
    Anchors without positives are left out. Without positives, sims are marked: `pos` (true or null), and `times`, how often a row counts."""
    if positives is None:
        marked = sims
    else:
        marked = sims.join(positives.select("i", "j", F.lit(True).alias("pos")), ["i", "j"], "left").withColumn("times", F.lit(1))
    if negatives is not None:
        marked = marked.join(negatives.select("i", "j", F.lit(True).alias("neg")), ["i", "j"], "left").where("pos or neg")
    # sums of windows in the order of the rows, which need no table of anchors beside the sorted pairs
    own = Window.partitionBy("i")
    top = marked.withColumn("_top", F.max("s").over(own))
    mass = F.col("times") * F.exp(F.col("s") - F.col("_top"))
    sums = {"n": F.count("pos"), "all": F.sum(mass), "mass": F.sum(F.when(F.col("pos"), mass).otherwise(0.0))}
    out = top.select("i", *(x.over(own).alias(name) for name, x in sums.items()), F.row_number().over(own.orderBy("j")).alias("nth"))
    return out.where("nth = 1 and n > 0").select("i", (F.log("all") - F.log("mass")).alias("loss"))


def soft_kl(sims_with_self: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """i, loss: cross entropy of the targets against the log-softmax over all columns, the own one included. Without targets, sims have
    them as p, which is null for pairs that are no targets."""
    w = Window.partitionBy("i")
    top = sims_with_self.withColumn("_top", F.max("s").over(w))
    log_q = top.withColumn("lq", F.col("s") - F.col("_top") - F.log(F.sum(F.exp(F.col("s") - F.col("_top"))).over(w)))
    if targets is None:
        # ids may be repeated: each p of an i and j meets each lq of both, as in a join; sums of windows, as in infonce
        met = log_q.withColumn("lq", F.sum("lq").over(Window.partitionBy("i", "j")))
        out = met.select("i", (-F.sum(F.col("p") * F.col("lq")).over(w)).alias("loss"), F.row_number().over(w.orderBy("j")).alias("nth"))
        return out.where("nth = 1").select("i", "loss")
    return log_q.join(targets.select("i", "j", "p"), ["i", "j"]).groupBy("i").agg((-F.sum(F.col("p") * F.col("lq"))).alias("loss"))


def supcon(sims: DataFrame, pairs: DataFrame | None, k: int) -> DataFrame:
    """i, loss: InfoNCE whose positives are the k nearest by feature distance and whose negatives are the other candidates.
    Without pairs, sims have their distances as d, which is null for pairs that are no candidates."""
    if pairs is None:
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("d").asc_nulls_last(), "j"))
        same = Window.partitionBy("i", "j")
        ranked = sims.withColumn("_rank", F.when(F.col("d").isNotNull(), rank))
        # ids may be repeated: a row of i and j meets each positive and each negative of both
        marked = ranked.withColumns({"near": F.count_if(F.col("_rank") <= k).over(same), "far": F.count_if(F.col("_rank") > k).over(same)}).where("near + far > 0")
        times = F.greatest("near", F.lit(1)) * F.greatest("far", F.lit(1))
        return infonce(marked.select("i", "j", "s", F.when(F.col("near") > 0, True).alias("pos"), times.alias("times")))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    ranked = pairs.where("d is not null").select("i", "j", rank.alias("rank"))
    return infonce(sims, ranked.where(F.col("rank") <= k), ranked.where(F.col("rank") > k))
