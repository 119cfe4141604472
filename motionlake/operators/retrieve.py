"""Retrieval of a query's nearest rows with exclusion rules, and the choices made on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine_distance, l2

DISTANCES = {"euclidean": l2, "cosine": lambda a, b: cosine_distance(a, b, 1e-8)}


def find_query(rows: DataFrame, scenario_id, start: int | None = None) -> int:
    """row_index of the first row of a scenario (and start); an error if there is none."""
    found = rows.where(F.col("scenario_id") == scenario_id)
    if start is not None:
        found = found.where(F.col("start") == start)
    first = found.agg(F.min("row_index")).first()[0]
    if first is None:
        raise ValueError(f"no row of scenario {scenario_id}")
    return first


def retrieve(rows: DataFrame, query_index: int, k: int = 5, distance: str = "cosine", exclude: dict[str, Column] | None = None, split: str = "all", within: tuple[str, ...] = (), split_col: str = "split") -> DataFrame:
    """The k nearest rows of one query (not itself), then the excluded ones: rows with distance, excluded,
    exclude_reason and rank (NULL for the excluded). Ties by row_index.

    exclude: reason to a condition over `q_<column>` (the query's) and the candidate's columns. within: columns that
    candidates share with the query; these ignore the split.
    """
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {sorted(DISTANCES)}")
    query = rows.where(F.col("row_index") == query_index).limit(1).select(*(F.col(c).alias(f"q_{c}") for c in rows.columns))
    near = rows.where(F.col("row_index") != query_index)
    if split != "all" and not within:
        near = near.where(F.col(split_col) == split)
    both = near.crossJoin(F.broadcast(query))
    for c in within:
        both = both.where(F.col(c).eqNullSafe(F.col(f"q_{c}")))
    both = both.withColumn("distance", DISTANCES[distance](F.col("embedding"), F.col("q_embedding")))
    reasons = [F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in (exclude or {}).items()]
    both = both.withColumn("exclude_reason", F.concat_ws(";", *reasons) if reasons else F.lit(""))
    both = both.withColumn("excluded", F.col("exclude_reason") != "").drop(*(f"q_{c}" for c in rows.columns))
    top = both.where("not excluded").orderBy("distance", "row_index").limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "row_index")))
    return top.unionByName(both.where("excluded").withColumn("rank", F.lit(None).cast("int")))


def hits(retrieved: DataFrame, policy: int | None) -> DataFrame:
    """One row: hit_at_1, hit_at_k, n_same, n, reason; NULL with a reason when the policy is missing or nothing was retrieved."""
    kept = retrieved.where("not excluded")
    if policy is None:
        return kept.agg(F.lit(None).cast("boolean").alias("hit_at_1"), F.lit(None).cast("boolean").alias("hit_at_k"), F.lit(None).cast("bigint").alias("n_same"), F.count("*").alias("n"), F.lit("no policy").alias("reason"))
    same = F.col("policy_id") == policy
    out = kept.agg(F.bool_or(same & (F.col("rank") == 1)).alias("hit_at_1"), F.bool_or(same).alias("hit_at_k"), F.count_if(same).alias("n_same"), F.count("*").alias("n"))
    return out.withColumn("n_same", F.when(F.col("n") > 0, F.col("n_same"))).withColumn("reason", F.when(F.col("n") == 0, "no candidates"))


def same_policy_hits(near: DataFrame, rows: DataFrame) -> DataFrame:
    """row_index, hits among a neighbour table's j with the same policy."""
    p = rows.select("row_index", "policy_id")
    both = near.join(p.select(F.col("row_index").alias("i"), F.col("policy_id").alias("pi")), "i").join(p.select(F.col("row_index").alias("j"), F.col("policy_id").alias("pj")), "j")
    return both.groupBy(F.col("i").alias("row_index")).agg(F.count_if(F.col("pi") == F.col("pj")).alias("hits"))


def best_hit_case(near: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: the query with the most same-policy neighbours; the largest index of equals."""
    return same_policy_hits(near, rows).agg(F.max(F.struct("hits", "row_index")).alias("b")).select("b.row_index", "b.hits")


def separations(distances: DataFrame) -> DataFrame:
    """source_index, separation: how far policy 2 stands from 0 and 1, the lesser. distances: source_index, pair, d."""
    wide = distances.groupBy("source_index").pivot("pair", ["p0_vs_p2", "p1_vs_p2"]).agg(F.min("d"))
    return wide.where("p0_vs_p2 is not null and p1_vs_p2 is not null").select("source_index", F.least("p0_vs_p2", "p1_vs_p2").alias("separation"))


def best_separation_case(distances: DataFrame) -> DataFrame:
    return separations(distances).agg(F.max(F.struct("separation", (-F.col("source_index")).alias("o"))).alias("b")).select((-F.col("b.o")).alias("source_index"), F.col("b.separation").alias("separation"))


def combined_score(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `score`: the sum of the columns, each scaled to 0..1 over all rows (0 where the range is at most 1e-8)."""
    ends = rows.agg(*(F.min(c).alias(f"_l_{c}") for c in columns), *(F.max(c).alias(f"_h_{c}") for c in columns))
    part = lambda c: F.when(F.col(f"_h_{c}") - F.col(f"_l_{c}") > 1e-8, F.try_divide(F.col(c) - F.col(f"_l_{c}"), F.col(f"_h_{c}") - F.col(f"_l_{c}"))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(ends)).withColumn("score", sum((part(c) for c in columns), F.lit(0.0))).select(*rows.columns, "score")


def replacement_query(rows: DataFrame, n_policies: int = 3) -> DataFrame:
    """The first row (by source, row) of a source with every policy, else of a source with n_policies rows or more; one row."""
    per = rows.groupBy("source_index").agg(F.countDistinct("policy_id").alias("p"), F.count("*").alias("n"), F.min("row_index").alias("row_index"))
    rank = F.when(F.col("p") >= n_policies, 0).when(F.col("n") >= n_policies, 1)
    return per.withColumn("tier", rank).where("tier is not null").orderBy("tier", "source_index").limit(1).select("source_index", "row_index")


def distance_matrix(rows: DataFrame, group: str, value) -> DataFrame:
    """i, j, d inside one group, the diagonal included."""
    own = rows.where(F.col(group) == value)
    a = own.select(F.col("row_index").alias("i"), F.col("embedding").alias("x"))
    b = own.select(F.col("row_index").alias("j"), F.col("embedding").alias("y"))
    return a.crossJoin(b).select("i", "j", l2(F.col("x"), F.col("y")).alias("d"))


def interpretation(distances: DataFrame) -> DataFrame:
    """source_index, farthest, nearest (pairs; the first name of equals), p2_farthest."""
    key = F.struct(F.round("d", 12).alias("d"), "pair")
    per = distances.groupBy("source_index").agg(F.min(key).alias("low"), F.min(F.struct((-F.round("d", 12)).alias("d"), "pair")).alias("high"))
    return per.select("source_index", F.col("high.pair").alias("farthest"), F.col("low.pair").alias("nearest"), (~(F.col("low.pair").contains("p2"))).alias("p2_farthest"))


def first_valid_case(rows: DataFrame, least: int = 3, key: str = "source_index") -> DataFrame:
    """One row, row_index: the first row of the first source, by its first row, that has `least` rows; else the first row of all."""
    per = rows.groupBy(key).agg(F.min("row_index").alias("first"), F.count("*").alias("n"))
    return per.agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("first"))), F.min("first")).alias("row_index"))


def case_components(rows: DataFrame, near: DataFrame, stats: DataFrame | None = None, metric=l2) -> DataFrame:
    """source_index, row_index (of policy 2), sep, hit_cnt, yaw_curv, jerk_diff, endpoint_diff for sources with policies 0, 1 and 2.

    Of several rows of one policy the last counts. near: neighbours (i, j) of all rows. stats: row_index, rms_yaw, rms_curvature,
    rms_jerk, x, y (the end point); without it those components are 0.
    """
    last = rows.where("policy_id in (0, 1, 2)").groupBy("source_index").agg(*(F.max(F.when(F.col("policy_id") == p, F.col("row_index"))).alias(f"r{p}") for p in range(3)))
    out = last.where("r0 is not null and r1 is not null and r2 is not null")
    names = ("rms_yaw", "rms_curvature", "rms_jerk", "x", "y")
    own = rows.select("row_index", "embedding")
    own = own.join(stats.select("row_index", *names), "row_index", "left") if stats is not None else own.withColumns({c: F.lit(0.0) for c in names})
    for p in range(3):
        out = out.join(own.select(F.col("row_index").alias(f"r{p}"), F.struct("embedding", *names).alias(f"s{p}")), f"r{p}")
    off = lambda c, p: F.abs(F.coalesce(F.col(f"s2.{c}"), F.lit(0.0)) - F.coalesce(F.col(f"s{p}.{c}"), F.lit(0.0)))
    end = lambda p: F.coalesce(F.sqrt(F.pow(F.col("s2.x") - F.col(f"s{p}.x"), 2) + F.pow(F.col("s2.y") - F.col(f"s{p}.y"), 2)), F.lit(0.0))
    hits = same_policy_hits(near, rows).select(F.col("row_index").alias("r2"), F.col("hits").cast("double").alias("hit_cnt"))
    return out.join(hits, "r2", "left").select(
        "source_index", F.col("r2").alias("row_index"), F.least(metric(F.col("s2.embedding"), F.col("s0.embedding")), metric(F.col("s2.embedding"), F.col("s1.embedding"))).alias("sep"),
        F.coalesce("hit_cnt", F.lit(0.0)).alias("hit_cnt"), ((off("rms_yaw", 0) + off("rms_curvature", 0) + off("rms_yaw", 1) + off("rms_curvature", 1)) / 2).alias("yaw_curv"),
        ((off("rms_jerk", 0) + off("rms_jerk", 1)) / 2).alias("jerk_diff"), ((end(0) + end(1)) / 2).alias("endpoint_diff"),
    )


def human_readable_case(components: DataFrame) -> DataFrame:
    """One row: the components with the largest sum of their five parts, each scaled to 0..1; the first source of equals."""
    scored = combined_score(components, ["sep", "yaw_curv", "jerk_diff", "endpoint_diff", "hit_cnt"])
    return scored.orderBy(F.desc(F.round("score", 12)), "source_index").limit(1)


def case_table(rows: DataFrame, retrieved: DataFrame, query_index: int, same: dict[str, str], stats: DataFrame) -> DataFrame:
    """The table of a query and what was retrieved for it: role, row_index, rank, distance, excluded, exclude_reason, a flag per
    entry of `same` (name: column that agrees with the query's) and the columns of stats (row_index, ...)."""
    known = [*dict.fromkeys(same.values())]
    own = rows.where(F.col("row_index") == query_index).limit(1).select("row_index", *known)
    query = own.select(*(F.col(c).alias(f"q_{c}") for c in known))
    found = retrieved.select("row_index", "rank", "distance", "excluded", "exclude_reason").join(rows.select("row_index", *known), "row_index").withColumn("role", F.when(F.col("excluded"), "excluded").otherwise("retrieved"))
    first = own.withColumns({"rank": F.lit(0), "distance": F.lit(0.0), "excluded": F.lit(False), "exclude_reason": F.lit(""), "role": F.lit("query")})
    both = found.unionByName(first).crossJoin(F.broadcast(query))
    flags = [F.col(c).eqNullSafe(F.col(f"q_{c}")).alias(name) for name, c in same.items()]
    return both.select("role", "row_index", "rank", "distance", "excluded", "exclude_reason", *known, *flags).join(stats, "row_index", "left")


def fingerprint(meta: DataFrame, stats: DataFrame, *chosen: DataFrame) -> DataFrame:
    """Metadata and statistics of all rows that stand in any of the chosen sets (row_index), each once."""
    ids = chosen[0].select("row_index")
    for c in chosen[1:]:
        ids = ids.union(c.select("row_index"))
    return meta.join(ids.distinct(), "row_index", "left_semi").join(stats, "row_index")


def diagnostics(rows: DataFrame, split: str = "all", n_policies: int = 3, source: str = "source_index") -> DataFrame:
    """section, key, value: row and source counts before and after a split, histograms of source sizes, rows per policy,
    and sources with all policies after the split."""
    after = rows if split == "all" else rows.where(F.col("split") == split)
    entry = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("bigint").alias("value"))
    out = None
    for name, part in (("total", rows), ("after_split", after)):
        per = part.groupBy(source).agg(F.count("*").alias("n"))
        sums = entry(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v")), "rows", F.lit(name), F.col("v"))
        sums = sums.unionByName(entry(per.agg(F.count("*").alias("v")), "sources", F.lit(name), F.col("v")))
        sizes = entry(per.groupBy("n").agg(F.count("*").alias("v")), f"group_size_{name}", F.col("n"), F.col("v"))
        out = sums.unionByName(sizes) if out is None else out.unionByName(sums).unionByName(sizes)
    policies = entry(after.groupBy("policy_id").agg(F.count("*").alias("v")), "policy", F.col("policy_id"), F.col("v"))
    full = after.groupBy(source).agg(F.countDistinct("policy_id").alias("p")).agg(F.count_if(F.col("p") >= n_policies).alias("v"))
    return out.unionByName(policies).unionByName(entry(full, "sources", F.lit("all_policies"), F.col("v")))
