"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all sizes;
   none may pass twice its size. Sharing the excess again by weight ends at min(2 * size, level * weight),
   and the level is read off prefix sums over the sources in the order in which they reach their caps.
2. Every document of a source is to be copied target / size times: a whole part and a fraction.
3. Pivotal rounding, weighted by size: of two documents with fractions, mass moves at random from one to
   the other (size times fraction is kept, and so is each one's expectation) until one is integral.
4. A reduction tree does this at scale: documents are dealt by hash to blocks of about `block` rows, a
   fold over each block leaves one undecided document, and the undecided go on to the next level, until each
   source has one block. The last undecided document of a source is rounded at random by its fraction.
   So the words taken from a source differ from its target by less than one document's size.

Randomness is hashed from doc_id, size and level, so reruns and retries agree. Null text: size 0,
copied by its fraction and taking nothing. Repeated rows are numbered and decided each, and so are different rows of one id. A source without
words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, uniform, unpacked, word_count

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Sources beyond which the targets are joined by a salted shuffle, not broadcast.
BROADCAST_SOURCES = 50_000
#: Marks (of 8 bytes) of rows that repeat an id, text and source, up to which they are broadcast.
BROADCAST_REPEATED = 1_000_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, ratio, n_rows from rows (source, size). One row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (SHARE * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the level of the first source that does not reach its cap holds; those of later ones are lower
    per = per.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    per = per.withColumn("level", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    per = per.withColumn("target", target)
    return per.select("source", "source_size", "n_rows", "target", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("ratio"))


def _with_targets(rows: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """rows with their source's target; `targets` has n_sources rows, counted before."""
    if n_sources <= BROADCAST_SOURCES:
        dim, on = F.broadcast(targets.withColumnRenamed("source", "_source")), F.lit(True)
    else:
        dim = targets.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        rows, on = rows.withColumn("_at", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")), F.col("_salt") == F.col("_at")
    return rows.join(dim, F.col("source").eqNullSafe(F.col("_source")) & on).drop("_source", "_salt", "_at")


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of (doc_id, dup, size, p, u): each with p 0 or 1, and one left between.

    State: done (decided items) and held (the one undecided). Sizes are over 0.
    """

    def settle(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["dup"].alias("dup"), x["size"].alias("size"), p.cast("double").alias("p"), x["u"].alias("u"))

    def step(s: Column, x: Column) -> Column:
        h = s["held"]
        weight = lambda v: v["size"].cast("double")
        to_h = F.least(1 - h["p"], x["p"] * weight(x) / weight(h))  # h can gain so much, x pays
        to_x = F.least(h["p"], (1 - x["p"]) * weight(x) / weight(h))  # h can lose so much, x gains
        gains = x["u"] * (to_h + to_x) < to_x
        moved = F.when(gains, to_h).otherwise(-to_x)
        hp, xp = h["p"] + moved, x["p"] - moved * weight(h) / weight(x)
        # which of the two became integral follows from which limit held, not from a comparison of rounded sums
        h_done = F.when(gains, 1 - h["p"] <= x["p"] * weight(x) / weight(h)).otherwise(h["p"] <= (1 - x["p"]) * weight(x) / weight(h))
        whole_h = settle(h, F.when(gains, 1.0).otherwise(0.0))
        whole_x = settle(x, F.when(gains, 0.0).otherwise(1.0))
        inside = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        return F.struct(
            F.concat(s["done"], F.array(F.when(h_done, whole_h).otherwise(whole_x))).alias("done"),
            F.when(h_done, settle(x, inside(xp))).otherwise(settle(h, inside(hp))).alias("held"),
        )

    first = F.get(items, F.lit(0))
    none = F.slice(F.transform(items, lambda x: settle(x, x["p"])), 1, 0)
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.struct(none.alias("done"), settle(first, first["p"]).alias("held")), step)


def pivotal(rows: DataFrame, n_most: int, block: int = 48) -> DataFrame:
    """doc_id, dup, copied (0 or 1) for rows (source, n_rows, doc_id, dup, size, p). n_most: the largest n_rows.

    The number of blocks follows a source's own rows. Rows of size 0 move no mass: each is rounded by itself.
    """
    alone = uniform(F.lit(0), F.col("doc_id"), F.col("dup"), F.col("size")) < F.col("p")
    decided = [rows.where("size = 0").select("doc_id", "dup", alone.cast("int").alias("copied"))]
    todo, most, level = rows.where("size > 0"), n_most, 0
    item = F.struct("u", "doc_id", "dup", "size", "p")
    while True:
        level += 1
        blocks = F.ceil(F.col("n_rows") / block)
        todo = todo.withColumn("u", uniform(F.lit(level), F.col("doc_id"), F.col("dup"), F.col("size")))
        place = F.pmod(F.xxhash64(F.lit(100 + level), F.col("doc_id"), F.col("dup")), blocks)
        packed = todo.groupBy("source", place.alias("place"), "n_rows").agg(F.array_sort(F.collect_list(item)).alias("items"))
        folded = materialize(packed.select("source", "n_rows", _fold(F.col("items")).alias("f")))
        decided.append(folded.select(F.explode("f.done").alias("x")).select("x.doc_id", "x.dup", F.col("x.p").cast("int").alias("copied")))
        last = math.ceil(most / block) <= 1
        left = folded.select("source", F.ceil(F.col("n_rows") / block).alias("n_rows"), "f.held.*")
        if last:
            decided.append(left.select("doc_id", "dup", alone.cast("int").alias("copied")))
            break
        todo, most = left.select("source", "n_rows", "doc_id", "dup", "size", "p"), math.ceil(most / block)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """dup tells the rows of one doc_id apart: by text and source, and by a number where all of them agree. Null ids are dealt by text."""
    same = Window.partitionBy("doc_id", "_text", "source").orderBy(F.lit(0))
    rows = docs.withColumn("_text", F.xxhash64("text")).withColumn("_same", F.row_number().over(same))
    return rows.withColumn("_dup", F.xxhash64("_text", "source", "_same")).drop("_text", "_same")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, dup, size, source_size, target, copies, taken for every row of docs (doc_id, text, source)."""
    numbered = _numbered(docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size")))
    sizes = materialize(numbered.select("doc_id", "source", "size", F.col("_dup").alias("dup")))
    targets = materialize(source_targets(sizes))
    seen = targets.agg(F.count("*"), F.max("n_rows")).first()
    rows = _with_targets(sizes, targets, seen[0])
    whole = F.floor("ratio")
    fractional = rows.select("source", "n_rows", "doc_id", "dup", "size", (F.col("ratio") - whole).alias("p"))
    chosen = pivotal(fractional, max(seen[1] or 1, 1))
    chosen = chosen.withColumnsRenamed({"doc_id": "_doc", "dup": "_dup"})
    both = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("dup") == F.col("_dup")))
    copies = (whole + F.col("copied")).cast("int")
    return both.select("doc_id", "dup", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs, whatever their names are.

    Only rows that repeat an id, text and source are numbered by a shuffle; the others are number 1.
    """
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias("taken_doc"), F.col("dup").alias("taken_dup"), "copies")
    mark = F.xxhash64("doc_id", F.xxhash64("text"), "source")
    repeated = materialize(docs.groupBy(mark.alias("mark")).count().where("count > 1").select("mark"))
    rows, n = packed(docs, "source").withColumns({"digest": F.xxhash64("text"), "mark": mark}), repeated.count()
    first = rows.withColumn("same", F.lit(1))
    if n:
        few = F.broadcast(repeated) if n <= BROADCAST_REPEATED else repeated
        numbered = rows.join(few, "mark", "left_semi").withColumn("same", F.row_number().over(Window.partitionBy("doc_id", "digest", "source").orderBy(F.lit(0))))
        first = first.join(few, "mark", "left_anti").unionByName(numbered)
    both = first.withColumn("dup", F.xxhash64("digest", "source", "same")).join(taken, F.col("doc_id").eqNullSafe(F.col("taken_doc")) & (F.col("dup") == F.col("taken_dup")))
    return unpacked(both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)
