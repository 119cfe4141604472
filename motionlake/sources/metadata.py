"""Row metadata with provenance: side files come before table columns, and these before inferred values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import running_total
from ..functions.scalar import to_int
from ..session import stored

NUMBERS = ("policy_id", "source_index", "start", "window_len")


def resolve(base: DataFrame, table: DataFrame | None = None, side: dict[str, DataFrame] | None = None) -> DataFrame:
    """base (row_index) with the metadata columns, and `<column>_from` naming where each value came from.

    side: column name to a frame (row_index, value). Values that don't convert to a number are NULL.
    """
    out, side = base.select("row_index"), side or {}
    known = [c for c in (table.columns if table is not None else []) if c != "row_index"]
    if table is not None:
        out = out.join(table.select("row_index", *(F.col(c).alias(f"_t_{c}") for c in known)), "row_index", "left")
    for name, frame in side.items():
        out = out.join(frame.select("row_index", F.col("value").alias(f"_s_{name}")), "row_index", "left")
    for name in sorted({*known, *side}):
        cast = to_int if name in NUMBERS else (lambda c: c.cast("string"))
        parts = [(cast(F.col(f"_{k}_{name}")), k) for k in ("s", "t") if f"_{k}_{name}" in out.columns]
        origin = F.lit("none")
        for value, k in reversed(parts):
            origin = F.when(value.isNotNull(), {"s": "side_file", "t": "table"}[k]).otherwise(origin)
        out = out.withColumns({name: F.coalesce(*(v for v, _ in parts)), f"{name}_from": origin})
    return out.select(*(c for c in out.columns if not c.startswith("_")))


def infer_policy(rows: DataFrame, source: str = "source_key") -> DataFrame:
    """rows (row_index, source) with policy_id by order within the source; NULL unless all sources have one size of 2 or more."""
    sizes = rows.groupBy(source).agg(F.count("*").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    order = F.row_number().over(Window.partitionBy(source).orderBy("row_index")).cast("bigint") - 1
    one_size = (F.col("low") == F.col("high")) & (F.col("low") >= 2)
    return rows.crossJoin(F.broadcast(sizes)).withColumn("policy_id", F.when(one_size, order)).drop("low", "high")


def dense_numbers(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """rows with 0-based numbers of distinct keys in order: numbered on the distinct keys by ranges, joined back."""
    numbers = running_total(rows.select(key).distinct().withColumn("_one", F.lit(1).cast("bigint")), key, "_one", name)
    return rows.join(numbers.select(key, (F.col(name) - 1).alias(name)), key)


def first_names(rows: DataFrame, key: str = "policy_id", name: str = "policy_name") -> DataFrame:
    """key, name: the name at the lowest row_index, or policy_<id>."""
    found = rows.groupBy(key).agg(F.min_by(name, F.when(F.col(name).isNotNull(), F.col("row_index"))).alias("found"))
    return found.select(key, F.coalesce("found", F.concat(F.lit("policy_"), F.col(key).cast("string"))).alias(name))


#: Names of features that older files knew by their number alone.
LEGACY_NAMES = {0: "rel_speed_mean", 3: "thw_mean", 8: "jerk_p95", 15: "speed_norm"}


def feature_name(number: Column, names: list[str] | None = None) -> Column:
    """The name of a feature's number: from the list, else a legacy name, else feature_<number>."""
    legacy = F.create_map(*(F.lit(x) for pair in LEGACY_NAMES.items() for x in pair))
    listed = F.get(F.array(*map(F.lit, names)), number.cast("int")) if names else F.lit(None).cast("string")
    return F.coalesce(listed, F.element_at(legacy, number.cast("int")), F.concat(F.lit("feature_"), number.cast("string")))


def scan_metadata(spark: SparkSession, path: str, n: int) -> tuple[DataFrame | None, str | None]:
    """A CSV with a header as text columns, if it has n rows; else None and a warning."""
    table = spark.read.option("header", True).csv(path)
    found = table.count()
    return (table, None) if found == n else (None, f"{path} has {found} rows, not {n}: left out")


def _json(spark: SparkSession, path: str):
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    try:
        return json.loads(rows[0][0]) if rows else None
    except json.JSONDecodeError:
        return None


def scan_feature_names(spark: SparkSession, path: str) -> tuple[list[str] | None, str | None]:
    """A JSON list of texts; else None and a warning."""
    names = _json(spark, path)
    good = isinstance(names, list) and all(isinstance(x, str) for x in names)
    return (names, None) if good else (None, f"{path} is no list of names: left out")


def scan_policy_names(spark: SparkSession, path: str) -> DataFrame:
    """policy_id, policy_name of a JSON object from numbers to names; keys that are no numbers go."""
    names = _json(spark, path)
    rows = [(str(k), str(v)) for k, v in names.items()] if isinstance(names, dict) else []
    return spark.createDataFrame(rows, "k string, policy_name string").select(to_int(F.col("k")).alias("policy_id"), "policy_name").where("policy_id is not null")


#: Columns that a window's key is made of, and what stands for a missing one.
KEY_FIELDS = {"scenario_id": "", "start": 0, "window_len": 0, "front_id": ""}


def canonical(base: DataFrame, table: DataFrame | None = None, side: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The metadata of base (row_index 0 to n - 1, split), where each column came from (column, source), and warnings (warning).

    table: rows (position in its file, any metadata columns, as text or typed). One of another length than base is left out. Its rows are numbered anew in the
    order of (row_index, or the position where that is missing; the window's key; position): where row_index is 0 to n - 1 that changes nothing, else a
    warning tells. side: column name to (row_index, value), which comes before the table. Then source_index is inferred from equal source keys,
    policy_id from the order within sources of one size, and policy_name from policy_id. Two tables are stored on the way, nothing is collected: what holds for the table as a whole is
    an aggregate of one row, broadcast; ranks go by ranges of keys.
    """
    side, has = side or {}, set(table.columns if table is not None else [])
    if table is None:
        table = base.select(F.lit(None).cast("bigint").alias("position")).where("false")
    n = base.agg(F.count("*").alias("n"))
    size = table.agg(F.count("*").alias("m")).crossJoin(F.broadcast(n))
    fits = table.crossJoin(F.broadcast(size)).where("m = n")
    number = to_int(F.col("row_index")) if "row_index" in has else F.lit(None).cast("bigint")
    key = {c: (F.coalesce(to_int(F.col(c)), F.lit(0)) if c in NUMBERS else F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in has else F.lit(d) for c, d in KEY_FIELDS.items()}
    rows = fits.withColumn("_order", F.struct(F.coalesce(number, F.col("position")).cast("bigint").alias("at"), *(v.alias(c) for c, v in key.items()), F.col("position").cast("bigint").alias("position")))
    complete = rows.agg(F.min("_order.at").alias("low"), F.max("_order.at").alias("high"), F.countDistinct("_order.at").alias("k"), F.count("*").alias("m"))
    numbered = dense_numbers(rows, "_order", "_number")
    columns = sorted((has - {"row_index", "position"}) | set(KEY_FIELDS))
    cast = lambda c: to_int(F.col(c)).cast("bigint") if c in NUMBERS else F.col(c).cast("string")
    given = numbered.select(F.col("_number").alias("row_index"), *((key[c] if c in KEY_FIELDS else cast(c)).alias(f"_t_{c}") for c in columns), F.lit(True).alias("_has"))
    out = base.select("row_index", F.col("split").alias("_split")).join(given, "row_index", "left")
    for name, frame in side.items():
        out = out.join(frame.select("row_index", (to_int(F.col("value")).cast("bigint") if name in NUMBERS else F.col("value").cast("string")).alias(f"_s_{name}")), "row_index", "left")
    whole = {c: KEY_FIELDS.get(c) for c in columns}
    named = sorted({*whole, *side, "source_index", "policy_id", "policy_name"} - {"split", "source_key"})
    for c in named:
        kind = "bigint" if c in NUMBERS else "string"
        own = [F.col(f"_{k}_{c}") for k in "st" if f"_{k}_{c}" in out.columns]
        default = F.lit(KEY_FIELDS.get(c)).cast(kind)
        out = out.withColumn(c, F.coalesce(*(own[:1] if c in side else own), default))  # a side file decides even where it has no value
    out = out.withColumn("split", F.coalesce(F.col("_t_split") if "split" in has else F.col("_split"), F.col("_split"), F.lit("all")))
    made = F.concat_ws("|", *(F.col(c).cast("string") for c in KEY_FIELDS))
    out = out.withColumn("source_key", F.when(F.col("_has"), F.coalesce("_t_source_key", F.lit(""))).otherwise(made) if "source_key" in has else made)
    out = stored(out.select("row_index", *named, "split", "source_key", F.coalesce("_has", F.lit(False)).alias("_has")))

    # what is missing as a whole is inferred
    known = out.agg(F.count("source_index").alias("_indexed"), F.countDistinct("source_key").alias("_keys"), F.count("*").alias("_rows"))
    out = dense_numbers(out, "source_key", "_group").crossJoin(F.broadcast(known))
    lacks_index = (F.col("_keys") < F.col("_rows")) if "source_index" not in has | set(side) else (F.col("_indexed") == 0) & F.lit(False)
    out = out.withColumn("_inferred", lacks_index).withColumn("source_index", F.when(F.col("_inferred"), F.col("_group")).otherwise(F.col("source_index")))
    sizes = out.where("source_index is not null").groupBy("source_index").agg(F.count("*").alias("c")).agg(F.min("c").alias("_least"), F.max("c").alias("_most"))
    policies = out.agg(F.count("policy_id").alias("_with_policy"), F.count("policy_name").alias("_with_name"))
    out = out.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(policies))
    place = F.row_number().over(Window.partitionBy("source_index").orderBy("row_index")).cast("bigint") - 1
    even = (F.col("_with_policy") == 0) & (F.col("_least") == F.col("_most")) & (F.col("_least") >= 2)
    out = out.withColumn("_ordered", F.coalesce(even, F.lit(False))).withColumn("policy_id", F.when(F.col("_ordered") & F.col("source_index").isNotNull(), place).otherwise(F.col("policy_id")))
    derived = F.col("_with_name") == 0
    out = out.withColumn("_derived", derived).withColumn("policy_name", F.when(derived, F.concat(F.lit("policy_"), F.col("policy_id").cast("string"))).otherwise(F.col("policy_name")))
    out = stored(out.withColumn("policy_name", F.coalesce("policy_name", F.lit(""))))

    facts = out.agg(*(F.max(c).alias(c) for c in ("_has", "_inferred", "_ordered", "_derived"))).crossJoin(F.broadcast(size)).crossJoin(F.broadcast(complete.select("low", "high", "k")))
    was = lambda c: F.coalesce(F.col(c), F.lit(False))
    says = [
        (F.lit(bool(has)) & (F.col("m") != F.col("n")), F.format_string("the table has %d rows, not %d: left out", F.col("m"), F.col("n"))),
        (was("_has") & ~((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("k") == F.col("n"))), F.lit("row_index is not 0 to n - 1: numbered anew")),
        (was("_inferred"), F.lit("source_index inferred from source_key")), (was("_ordered"), F.lit("policy_id inferred from the order within sources")),
    ]
    warnings = facts.select(F.explode(F.array_compact(F.array(*(F.when(c, text) for c, text in says)))).alias("warning"))
    from_table = lambda c: F.when(was("_has"), F.lit("table")) if c in has else F.lit(None).cast("string")
    late = {"source_index": F.when(was("_inferred"), "inferred"), "policy_id": F.when(was("_ordered"), "inferred"), "policy_name": F.when(was("_derived"), "derived")}
    origin = lambda c: F.coalesce(late.get(c, F.lit(None).cast("string")), F.lit("side_file") if c in side else F.lit(None).cast("string"), from_table(c), F.lit("key_fields" if c == "source_key" else "base" if c == "split" else "default" if c in KEY_FIELDS else "none"))
    names = [*named, "split", "source_key"]
    provenance = facts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), origin(c).alias("source")) for c in names))).alias("p")).select("p.*")
    return out.select("row_index", *named, "split", "source_key"), provenance, warnings
