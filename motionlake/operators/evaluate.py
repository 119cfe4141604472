"""Evaluation queries over vectors: recall, centroids, coverage, within-source statistics, correlation and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running_total
from ..functions.scalar import cosine_distance, dot, l2
from ..functions.selection import quantiles
from ..session import ship_package, stored
from ..sources.metadata import dense_numbers
from .pairs import TILE, _all_blocks, block_count, knn

#: Rows or so of a scope that an anchor meets at once.
PART = 256


def recall_at_k(vectors: DataFrame, label: str, k: int) -> DataFrame:
    """row_index, label, recall: same-label neighbours among the k nearest (cosine, never itself) over min(k, members);
    1 for a label's only member."""
    names = vectors.select(F.col("row_index").alias("i"), F.col(label).alias("label"))
    members = names.groupBy("label").agg((F.count("*") - 1).alias("n_pos"))
    near = knn(vectors, k).join(names, "i").join(names.select(F.col("i").alias("j"), F.col("label").alias("other")), "j")
    hits = near.groupBy("i").agg(F.count_if(F.col("label") == F.col("other")).alias("same"))
    out = names.join(hits, "i", "left").join(members, "label")
    recall = F.when(F.col("n_pos") == 0, 1.0).otherwise(F.coalesce("same", F.lit(0)) / F.greatest(F.least(F.lit(k), F.col("n_pos")), F.lit(1)))
    return out.select(F.col("i").alias("row_index"), "label", recall.alias("recall"))


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """label, n, centroid: means per dimension, aggregated before any vector is put together again."""
    parts = vectors.select(F.col(label).alias("label"), F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(train: DataFrame, evaluated: DataFrame, label: str) -> DataFrame:
    """row_index, label, predicted, distance: Euclidean; lower labels win ties. Centroids are one row per label, broadcast."""
    c = centroids(train, label).select(F.col("label").alias("predicted"), "centroid")
    rows = evaluated.select("row_index", F.col(label).alias("label"), "embedding").crossJoin(F.broadcast(c))
    best = rows.groupBy("row_index", "label").agg(F.min(F.struct(F.round(l2(F.col("embedding"), F.col("centroid")), 12).alias("d"), "predicted")).alias("b"))
    return best.select("row_index", "label", F.col("b.predicted").alias("predicted"), F.col("b.d").alias("distance"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """label (NULL for all), n, accuracy: one aggregate with grouping sets."""
    right = F.avg(F.when(F.col("label") == F.col("predicted"), 1.0).otherwise(0.0))
    return predictions.rollup("label").agg(F.count("*").alias("n"), right.alias("accuracy"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def macro_f1(predictions: DataFrame) -> DataFrame:
    """One row, macro_f1 and n_labels: over labels that occur as true or predicted; 0 where undefined."""
    cells = confusion(predictions)
    side = F.array(F.struct(F.col("label").alias("k"), F.lit(1).alias("true")), F.struct(F.col("predicted").alias("k"), F.lit(0).alias("true")))
    per = cells.select("n", (F.col("label") == F.col("predicted")).alias("hit"), F.explode(side).alias("s")).groupBy("s.k").agg(F.sum(F.when(F.col("hit") & (F.col("s.true") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    return per.agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("both").cast("double")), F.lit(0.0))).alias("macro_f1"), F.count("*").alias("n_labels"))


def pair_counts(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """source_index, policy_id, n over all sources and expected policies (policy_id)."""
    counts = rows.groupBy("source_index", "policy_id").agg(F.count("*").alias("n"))
    expected = rows.select("source_index").distinct().crossJoin(F.broadcast(policies))
    return expected.join(counts, ["source_index", "policy_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """One row: n_sources, n_expected, n_found, n_complete, n_missing, n_duplicate."""
    per = pair_counts(rows, policies).groupBy("source_index").agg(F.count("*").alias("e"), F.sum("n").alias("f"), F.count_if(F.col("n") == 0).alias("m"), F.count_if(F.col("n") > 1).alias("d"), F.bool_and(F.col("n") == 1).alias("c"))
    return per.agg(F.count("*").alias("n_sources"), F.sum("e").alias("n_expected"), F.sum("f").alias("n_found"), F.count_if("c").alias("n_complete"), F.sum("m").alias("n_missing"), F.sum("d").alias("n_duplicate"))


def first_pairs(rows: DataFrame, policies: DataFrame, missing: bool, limit: int = 50) -> DataFrame:
    """The first missing or duplicate (source, policy) pairs: a report of at most `limit` rows."""
    return pair_counts(rows, policies).where("n = 0" if missing else "n > 1").orderBy("source_index", "policy_id").limit(limit)


def _first_rows(rows: DataFrame) -> DataFrame:
    """The row of the lowest row_index per source and policy."""
    return rows.groupBy("source_index", "policy_id").agg(F.min_by(F.struct("row_index", "embedding"), "row_index").alias("r")).select("source_index", "policy_id", "r.*")


def complete_sources(rows: DataFrame, n_policies: int) -> DataFrame:
    """source_index, n: sources that have every policy."""
    return rows.groupBy("source_index").agg(F.countDistinct("policy_id").alias("p"), F.count("*").alias("n")).where(F.col("p") >= n_policies).select("source_index", "n")


def pairwise_distances(rows: DataFrame, n_policies: int, metric=l2) -> DataFrame:
    """source_index, pair (p<a>_vs_p<b>, a < b), d inside each source that has all policies; the first of duplicates counts."""
    first = _first_rows(rows).join(complete_sources(rows, n_policies).select("source_index"), "source_index", "left_semi")
    a = first.select("source_index", F.col("policy_id").alias("p"), F.col("embedding").alias("x"))
    b = first.select("source_index", F.col("policy_id").alias("q"), F.col("embedding").alias("y"))
    name = F.concat(F.lit("p"), F.col("p").cast("string"), F.lit("_vs_p"), F.col("q").cast("string"))
    return a.join(b, "source_index").where("p < q").select("source_index", name.alias("pair"), metric(F.col("x"), F.col("y")).alias("d"))


def within_source_margin(rows: DataFrame) -> DataFrame:
    """row_index, n, margin: the spread of a row's distances to the other rows of its source; rows alone are left out."""
    a = rows.select("source_index", F.col("row_index").alias("i"), F.col("embedding").alias("x"))
    b = rows.select("source_index", F.col("row_index").alias("j"), F.col("embedding").alias("y"))
    d = a.join(b, "source_index").where("i <> j").withColumn("d", l2(F.col("x"), F.col("y")))
    return d.groupBy(F.col("i").alias("row_index")).agg(F.count("*").alias("n"), (F.max("d") - F.min("d")).alias("margin"))


def retrieval_applicable(rows: DataFrame) -> DataFrame:
    """One row, applicable and reason: whether any source and policy has more than one row."""
    per = rows.groupBy("source_index", "policy_id").agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("applicable"))
    return out.withColumn("reason", F.when(F.col("applicable"), "several samples per source and policy").otherwise("one sample per source and policy"))


def average_ranks(rows: DataFrame, value: str, out: str, by: str | None = None) -> DataFrame:
    """rows with average-tie ranks of a value, NULLs left out. Without `by`, ranks come from counts of distinct
    values, summed by ranges: no task sorts all values."""
    keys = [by] if by else []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if by:
        w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        totals = counts.withColumn("_total", F.sum("_n").over(w))
    else:
        totals = running_total(counts, value, "_n", "_total")
    ranks = totals.withColumn(out, F.col("_total") - (F.col("_n") - 1) / 2.0).drop("_n", "_total")
    return rows.join(ranks, [*keys, value])


def pearson(x: str, y: str, eps: float = 1e-12) -> Column:
    """Aggregate: correlation with eps added to the denominator, so a constant gives 0."""
    return F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y) + eps)


def spearman(rows: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """by (if given), n, spearman. The epsilon is added to the product of root sums of squares."""
    ranked = average_ranks(average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx", by), y, "_ry", by)
    top = F.covar_pop("_rx", "_ry") * F.count("*")
    low = F.sqrt(F.var_pop("_rx") * F.count("*")) * F.sqrt(F.var_pop("_ry") * F.count("*")) + 1e-12
    return ranked.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), (top / low).alias("spearman"))


def regression_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """n, r2, rmse; r2 is NULL for a constant truth."""
    e = F.col(truth) - F.col(predicted)
    return rows.agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count("*"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def drawn_others(vectors: DataFrame, k: int) -> DataFrame:
    """i, j: k different other rows for every row, each other row as likely as any: n * k rows, never all pairs.

    Rows stand in a ring by row_index. From a hashed place behind its own, a row takes k places that are even steps apart.
    """
    ring = dense_numbers(vectors.select(F.col("row_index").cast("bigint").alias("i")), "i", "at")
    others = ring.agg((F.count("*") - 1).alias("others"))
    begin = F.conv(F.substring(F.md5(F.col("i").cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    takes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(k).cast("bigint"), F.col("others")) - 1))
    rows = ring.crossJoin(F.broadcast(others)).where("others > 0").withColumn("begin", begin).withColumn("m", takes)
    step = F.greatest(F.expr(f"others div {k}"), F.lit(1))
    place = F.pmod(F.col("at") + 1 + F.pmod(F.col("begin") + F.col("m") * step, F.col("others")), F.col("others") + 1)
    return rows.select("i", place.alias("at")).join(ring.withColumnRenamed("i", "j"), "at").select("i", "j")


def neighbor_consistency(vectors: DataFrame, features: DataFrame, k: int, clip_at: float = 0.99, floor: float = 1e-3, candidates: DataFrame | None = None) -> DataFrame:
    """feature, n, ratio_mean, ratio_median: a feature's mean absolute difference to the k nearest (cosine) over that to k
    hash-drawn others, clipped at the quantile `clip_at`.

    features: row_index, feature, x (NULL left out). candidates: pairs (i, j) that both choices are limited to.
    """
    if candidates is None:
        near, drawn = knn(vectors, k), drawn_others(vectors, k)
    else:
        near = _gated(vectors, candidates, k)
        draw = F.md5(F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string")).cast("binary"))
        drawn = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(draw, "j"))).where(F.col("rank") <= k)
    xs = features.where("x is not null")

    def mean_gap(pairs: DataFrame, name: str) -> DataFrame:
        a = pairs.select("i", "j").join(xs.select(F.col("row_index").alias("i"), "feature", F.col("x").alias("xi")), "i")
        both = a.join(xs.select(F.col("row_index").alias("j"), "feature", F.col("x").alias("xj")), ["j", "feature"])
        return both.groupBy("i", "feature").agg(F.avg(F.abs(F.col("xi") - F.col("xj"))).alias(name))

    ratio = mean_gap(near, "e").join(mean_gap(drawn, "r"), ["i", "feature"]).select("feature", (F.col("e") / F.greatest("r", F.lit(floor))).alias("ratio"))
    ratio = stored(ratio)  # read four times below
    top = quantiles(ratio, {"top": (F.col("ratio"), clip_at)}, by=("feature",))
    clipped = ratio.join(F.broadcast(top), "feature").withColumn("ratio", F.greatest(F.lit(0.0), F.least("ratio", "top")))
    middle = quantiles(clipped, {"ratio_median": (F.col("ratio"), 0.5)}, by=("feature",))
    return clipped.groupBy("feature").agg(F.count("*").alias("n"), F.avg("ratio").alias("ratio_mean")).join(middle, "feature")


def conditioned_consistency(vectors: DataFrame, features: DataFrame, candidates: DataFrame, k: int, least: int = 1, clip_at: float = 0.99, floor: float = 1e-3, least_std: float = 1e-8) -> DataFrame:
    """feature, n, ratio_mean, ratio_median, mean_cond_candidates, frac_fallback, note: neighbor_consistency with both choices
    limited to an anchor's candidates.

    vectors: scope, row_index, embedding. features: row_index, feature, x (NULL left out). candidates: i, j inside scopes, each pair once. An anchor
    with fewer than `least` candidates that have the feature falls back to all other rows of its scope; candidates are counted
    before that. Features of k + 1 values or fewer, or of nearly one value, have NULL ratios and a note.

    Vectors are sent once for each part (PART rows at most or so) of a scope that they look into, never for each pair. What a part leaves of its
    pairs are at most 2 * k for each anchor and feature.
    """
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = features.where("x is not null").groupBy("row_index").agg(F.collect_list(F.struct("feature", "x")).alias("xs"))
    parts = vectors.groupBy("scope").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row_index"), F.col("parts")).cast("int")
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    rows = vectors.select("scope", "row_index", "embedding").join(values, "row_index").join(parts, "scope")
    rows = stored(rows.select("scope", "parts", part.alias("part"), "row_index", "embedding", norm.alias("norm"), "xs"))
    i, j = F.col("row_index").alias("i"), F.col("row_index").alias("j")
    # whom of a part an anchor may meet
    placed = candidates.select("i", "j").join(rows.select(j, "scope", "part"), "j").repartition(tasks, "scope", "part")
    lists = stored(placed.groupBy("scope", "part", "i").agg(F.collect_list("j").alias("js")))
    named = rows.select("scope", "part", j, F.transform("xs", lambda x: x["feature"]).alias("names"))
    gated = lists.join(named, ["scope", "part"]).where(F.array_contains("js", F.col("j"))).select("i", F.explode("names").alias("feature"))
    counts = gated.groupBy("i", "feature").agg(F.count("*").alias("n_cand"))
    anchors = rows.select(i, F.explode("xs").alias("x")).select("i", "x.feature", F.col("x.x").alias("xi"))
    anchors = stored(anchors.join(counts, ["i", "feature"], "left").withColumn("n_cand", F.coalesce("n_cand", F.lit(0))))
    # an anchor asks the parts of its candidates for some features, and all parts of its scope for those that fall back
    of_anchor = lambda such: anchors.where(such).groupBy("i").agg(F.collect_list(F.struct("feature", F.col("xi").alias("x"))).alias("xs"))
    rich = of_anchor(F.col("n_cand") >= least).join(lists, "i")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    poor = of_anchor(F.col("n_cand") < least).join(rows.select(i, "scope", every), "i").withColumn("js", F.lit(None).cast(lists.schema["js"].dataType))
    asks = rich.unionByName(poor).join(rows.select(i, F.col("embedding").alias("p"), F.col("norm").alias("p_norm")), "i")
    # a fixed number of partitions: AQE goes by bytes, and pairs are far more than the vectors that they come from
    asks = asks.repartition(tasks, "scope", "part")
    found = rows.select("scope", "part", j, F.col("embedding").alias("q"), F.col("norm").alias("q_norm"), F.col("xs").alias("ys"))
    may = F.when(F.col("js").isNull(), F.col("i") != F.col("j")).otherwise(F.array_contains("js", F.col("j")))
    shared = F.exists("xs", lambda x: F.exists("ys", lambda y: y["feature"] == x["feature"]))
    met = asks.join(found, ["scope", "part"]).where(may & shared)
    both = lambda x: F.transform(F.filter("ys", lambda y: y["feature"] == x["feature"]), lambda y: F.struct(x["feature"].alias("feature"), F.abs(x["x"] - y["x"]).alias("gap")))
    # one distance and draw for each pair, whatever number of features it is for
    d = F.round(cosine_distance(F.col("p"), F.col("q"), norms=(F.col("p_norm"), F.col("q_norm"))), 12)
    draw = F.unhex(F.md5(F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string")).cast("binary")))
    pool = met.select("scope", "part", "i", "j", d.alias("d"), draw.alias("draw"), F.flatten(F.transform("xs", both)).alias("gaps"))
    pool = pool.select("scope", "part", "i", "j", "d", "draw", F.explode("gaps").alias("g")).select("scope", "part", "i", "j", "d", "draw", "g.*")

    def first(pairs: DataFrame, *by: str) -> DataFrame:
        of = Window.partitionBy(*by)
        ranked = pairs.withColumns({"near": F.row_number().over(of.orderBy("d", "j")), "any": F.row_number().over(of.orderBy("draw", "j"))})
        return ranked.where(F.least("near", "any") <= k)

    ranked = first(first(pool, "scope", "part", "i", "feature").select("i", "j", "feature", "d", "draw", "gap"), "i", "feature")
    mean = lambda c: F.avg(F.when(F.col(c) <= k, F.col("gap")))
    ratio = stored(ranked.groupBy("feature", "i").agg((mean("near") / F.greatest(mean("any"), F.lit(floor))).alias("ratio")).drop("i"))  # read four times below
    top = quantiles(ratio, {"top": (F.col("ratio"), clip_at)}, by=("feature",))
    clipped = ratio.join(F.broadcast(top), "feature").select("feature", F.greatest(F.lit(0.0), F.least("ratio", "top")).alias("ratio"))
    middle = quantiles(clipped, {"h": (F.col("ratio"), 0.5)}, by=("feature",))
    ratios = clipped.groupBy("feature").agg(F.avg("ratio").alias("m")).join(middle, "feature")
    per = anchors.groupBy("feature").agg(F.count("*").alias("n"), F.stddev_pop("xi").alias("s"), F.avg("n_cand").alias("c"), F.avg(F.when(F.col("n_cand") < least, 1.0).otherwise(0.0)).alias("f"))
    note = F.when(F.col("n") <= k + 1, "too few").when(F.col("s") < least_std, "constant").otherwise("ok")
    ok = lambda c: F.when(F.col("note") == "ok", F.col(c))
    out = per.join(ratios, "feature", "left").withColumn("note", note)
    return out.select("feature", "n", ok("m").alias("ratio_mean"), ok("h").alias("ratio_median"), ok("c").alias("mean_cond_candidates"), ok("f").alias("frac_fallback"), "note")


def evaluation_views(rows: DataFrame, eval_split: str = "test", holdout: float | None = None) -> DataFrame:
    """row_index, role (train or eval; a row can have both with eval_split "all"). With `holdout`, that share of rows by their hashed index is
    evaluated and the rest trains; else the column `split` decides and other splits are left out."""
    if holdout is not None:
        u = F.conv(F.substring(F.md5(F.concat(F.lit("holdout_"), F.col("row_index").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
        return rows.select("row_index", F.when(u < holdout, "eval").otherwise("train").alias("role"))
    evaluated = rows if eval_split == "all" else rows.where(F.col("split") == eval_split)
    return rows.where("split = 'train'").select("row_index", F.lit("train").alias("role")).unionByName(evaluated.select("row_index", F.lit("eval").alias("role")))


def _gated(vectors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    v = vectors.select("row_index", "embedding")
    d = candidates.select("i", "j").join(v.select(F.col("row_index").alias("i"), F.col("embedding").alias("x")), "i").join(v.select(F.col("row_index").alias("j"), F.col("embedding").alias("y")), "j")
    d = d.select("i", "j", cosine_distance(F.col("x"), F.col("y")).alias("d"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def clustering_metrics(vectors: DataFrame, label: str) -> DataFrame:
    """One row: n, k, calinski_harabasz, davies_bouldin of vectors under their labels; NULL with fewer than two labels."""
    c = centroids(vectors, label)
    whole = centroids(vectors.withColumn("_all", F.lit(0)), "_all").select(F.col("centroid").alias("mean"))
    d = vectors.select(F.col(label).alias("label"), "embedding").join(F.broadcast(c), "label").withColumn("d", l2(F.col("embedding"), F.col("centroid")))
    inside = d.groupBy("label").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"))
    per = inside.join(c, "label").crossJoin(F.broadcast(whole)).withColumn("between", F.col("n") * F.pow(l2(F.col("centroid"), F.col("mean")), F.lit(2.0)))
    a, b = per.select("label", "s", "centroid"), per.select(F.col("label").alias("other"), F.col("s").alias("s2"), F.col("centroid").alias("c2"))
    worst = a.crossJoin(F.broadcast(b)).where("label <> other").groupBy("label").agg(F.max(F.try_divide(F.col("s") + F.col("s2"), l2(F.col("centroid"), F.col("c2")))).alias("r"))
    totals = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("between").alias("sb"), F.sum("w").alias("sw"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    ch = F.try_divide(F.col("sb") * (F.col("n") - F.col("k")), F.col("sw") * F.nullif(F.col("k") - 1, F.lit(0)))
    return totals.crossJoin(db).select("n", "k", ch.alias("calinski_harabasz"), "davies_bouldin")


def clustering_report(vectors: DataFrame, k: int, cluster, seeds: int = 5) -> DataFrame:
    """One row: silhouette, calinski_harabasz, davies_bouldin, each the mean over `seeds` clusterings; NULL with fewer than max(10, k + 1)
    vectors. cluster(vectors, k, seed) gives row_index, cluster."""
    found, made = None, [f"_cluster{seed}" for seed in range(seeds if vectors.count() >= max(10, k + 1) else 0)]
    rows = vectors.select("row_index", "embedding")
    for seed, name in enumerate(made):
        rows = rows.join(cluster(vectors, k, seed).select("row_index", F.col("cluster").alias(name)), "row_index")
    rows = stored(rows) if made else rows
    means = stored(silhouettes(rows, made).groupBy("t").agg(F.avg("silhouette").alias("silhouette"))) if made else None
    for t, name in enumerate(made):
        one = clustering_metrics(rows, name).crossJoin(means.where(F.col("t") == t).select("silhouette"))
        found = one if found is None else found.unionByName(one)
    names = ("silhouette", "calinski_harabasz", "davies_bouldin")
    if found is None:
        return vectors.agg(*(F.lit(None).cast("double").alias(c) for c in names))
    return found.agg(*(F.avg(c).alias(c) for c in names))


def mean_of_logs(log: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, n and the means of per-batch statistics; NULL and NaN entries are left out of a column's mean."""
    return log.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns))


def _label_sums(group: pd.DataFrame) -> pd.DataFrame:
    """Of a block of queries and one of candidates: sums and numbers of distances of each query to the candidates of each label."""
    a, b = group[group["query"]], group[~group["query"]]
    if not len(a) or not len(b):
        return pd.DataFrame(columns=["i", "t", "own", "other", "total", "n"])
    keys = pd.factorize(pd.Series(list(map(tuple, b["labels"]))))
    order = np.argsort(keys[0], kind="stable")  # candidates of equal labels stand together
    code, b = keys[0][order], b.iloc[order]
    qi, ci = a["row_index"].to_numpy(), b["row_index"].to_numpy()
    x, y = (np.stack(z["embedding"].to_numpy()).astype(float) for z in (a, b))
    mid = y.mean(0)
    x, y = x - mid, y - mid
    # one product gives squared distances
    x = np.hstack([-2 * x, (x * x).sum(1)[:, None], np.ones((len(x), 1))])
    y = np.ascontiguousarray(np.hstack([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]]).T)
    total, count = np.zeros((len(a), len(keys[1]))), np.tile(np.bincount(code, minlength=len(keys[1])), (len(a), 1))
    shared = bool(np.isin(qi, ci).any())
    for q in range(0, len(a), TILE[0]):
        for c in range(0, len(b), TILE[1]):
            of, here = slice(q, q + TILE[0]), slice(c, c + TILE[1])
            d = x[of] @ y[:, here]
            np.maximum(d, 0, out=d)
            np.sqrt(d, out=d)
            if shared:
                row, at = np.nonzero(qi[of, None] == ci[None, here])
                d[row, at] = 0
                np.subtract.at(count, (row + q, code[at + c]), 1)
            held, first = np.unique(code[here], return_index=True)
            total[of, held] += np.add.reduceat(d, first, axis=1)
    parts = []
    for t in range(len(a["labels"].iloc[0])):
        own = np.array([labels[t] for labels in a["labels"]], object)
        at, names = pd.factorize(np.array([labels[t] for labels in keys[1]], object))  # -1: no label
        mark = (at[:, None] == np.arange(len(names))[None, :]).astype(float)
        n = count @ mark
        row, column = np.nonzero((n > 0) & np.array([o is not None for o in own])[:, None])
        parts.append(pd.DataFrame({"i": qi[row], "t": t, "own": own[row], "other": np.asarray(names, object)[column], "total": (total @ mark)[row, column], "n": n[row, column].astype(int)}))
    return pd.concat(parts)


def silhouettes(vectors: DataFrame, labels: list[str], block: int | None = None) -> DataFrame:
    """t (the number of a label column), row_index, silhouette (Euclidean) for several labellings of the same vectors, whose distances are
    computed once: mean distances to the own and the nearest other label; 0 for a label's only member.

    Blocks of vectors meet each other (see `block_count`) and give a sum of distances for each row and label: what is shuffled are
    rows of vectors and n * labels * blocks sums, never a row for each pair, and a task holds a tile of distances."""
    ship_package(vectors.sparkSession)
    base = vectors.select("row_index", F.array(*(F.col(c).cast("string") for c in labels)).alias("labels"), "embedding").where(F.exists("labels", lambda x: x.isNotNull()))
    size = base.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    both = _all_blocks(base, block_count(size["n"], size["width"] or 1, block))
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q", "c")
    parts = both.groupBy("q", "c").applyInPandas(_label_sums, "i long, t int, own string, other string, total double, n long")
    means = parts.groupBy("i", "t", "own", "other").agg((F.sum("total") / F.sum("n")).alias("m"))
    per = means.groupBy("i", "t").agg(F.min(F.when(F.col("own") == F.col("other"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select("t", F.col("i").alias("row_index"), s.alias("silhouette"))


def silhouette(vectors: DataFrame, label: str, block: int | None = None) -> DataFrame:
    """row_index, silhouette of one labelling (see `silhouettes`)."""
    return silhouettes(vectors, [label], block).select("row_index", "silhouette")


def group_size_histogram(rows: DataFrame, key: str) -> DataFrame:
    """group_size, n_groups."""
    return rows.groupBy(key).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups"))


def minmax(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Columns scaled to 0..1 within each group; 0 where the range is at most 1e-8."""
    w = Window.partitionBy(by)
    scaled = lambda c: F.when(F.max(c).over(w) - F.min(c).over(w) > 1e-8, F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))).otherwise(0.0)
    return rows.withColumns({c: scaled(c) for c in columns})


def gram(vectors: DataFrame) -> DataFrame:
    """i, j, s: dot products of a small set of vectors (a report)."""
    a = vectors.select(F.col("row_index").alias("i"), F.col("embedding").alias("x"))
    b = vectors.select(F.col("row_index").alias("j"), F.col("embedding").alias("y"))
    return a.crossJoin(F.broadcast(b)).select("i", "j", dot(F.col("x"), F.col("y")).alias("s"))
