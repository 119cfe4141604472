"""Filter interaction audit by a Walsh-Hadamard transform, in DataFrame functions only.

K filters judge every document once. Their failures make a mask of K bits, and everything the audit asks
follows from how many documents of a part have each mask:

1. Each part and label class is one aggregate of 2^K signed sums: W[s] adds -1 for a document that fails an odd number
   of the filters in s, and +1 for others. They combine before the shuffle, so a part may hold any share of the rows.
2. The transform is its own inverse up to 2^K: cell m is the sum of W[s] with the sign of m and s, over 2^K, exactly.
3. Every order of the filters is read off the cells. A document that fails k filters is removed by each of
   them in K! / k of the orders, which gives the Shapley sums in closed form.

"Duplicate" is a filter over the table: a document fails it if a smaller id has the same text, removed or not. Copies are
counted by digest, part and label before the least id of a digest is joined to them, so a text that fills
a third of the table is a few rows.

Null text: empty, and equal to other empty texts. A null id is larger than all ids. Rows that repeat an id are documents of their own, and
the least id's rows are no duplicates of each other. Null part: the empty string. Labels may repeat an id: it counts as
good or toxic if any of its rows says so; labels without an id or document count nowhere. An empty table gives an
empty result. Columns besides doc_id, text and the part are ignored.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, word_list

#: Conditions by letter, on the text and its list of words; None stands for the duplicate filter.
FILTERS: dict[str, object] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
    "E": None,
}


def parity_sign(a: Column, b: int) -> Column:
    """-1 if a and b share an odd number of bits, else 1."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(F.lit(b))) % 2)


def fail_masks(docs: DataFrame, part: str, filters: dict) -> DataFrame:
    """doc_id, digest (of the text), part, mask: bit i is set if the text fails the i-th filter; the duplicate filter's bit is 0."""
    # the words stand in a column of their own, or each condition would split the text again
    split = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).withColumn("words", word_list(F.col("text")))
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        if condition is not None:
            mask = mask + F.when(condition(F.col("text"), F.col("words")), 1 << i).otherwise(0)
    return split.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "part", mask.cast("int").alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """digest, part, mask, good, toxic, doc_id, n: rows of masks by label, counted."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = masks.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    both = rows.join(known, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_counts(rows: DataFrame, bit: int | None) -> DataFrame:
    """part, good, toxic, mask, n: with the duplicate filter's bit set where a smaller id has the text."""
    keys = ["digest", "part", "good", "toxic", "mask"]
    if bit is None:
        return rows.groupBy(*keys[1:]).agg(F.sum("n").alias("n"))
    # the rows of the least id in each group of copies are told apart from its other rows
    per_id = rows.withColumn("own", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")))
    groups = materialize(per_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct("own", "n")).alias("low"), F.min("own").alias("own")))
    least = groups.groupBy("digest").agg(F.min("own").alias("first")).withColumnRenamed("digest", "least_digest")
    both = groups.join(least, F.col("digest") == F.col("least_digest"))
    # an id may stand in one group once only: rows are counted by id, digest, part and mask
    first = F.when(F.col("own") == F.col("first"), F.col("low.n")).otherwise(0)
    sides = F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + (1 << bit)).alias("mask"), (F.col("n") - first).alias("n")))
    return both.select("part", "good", "toxic", F.explode(sides).alias("x")).where("x.n > 0").select("part", "good", "toxic", "x.mask", "x.n")


def walsh_sums(counts: DataFrame, k: int) -> DataFrame:
    """part, good, toxic, w: the 2^k signed sums of each part and label class."""
    sums = [F.sum(F.col("n") * parity_sign(F.col("mask"), s)) for s in range(1 << k)]
    return counts.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("w"))


def inverted(w: Column, k: int) -> Column:
    """The cells of an array of signed sums: the number of documents with each mask."""
    sign = lambda m, s: 1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)
    cells = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    cell = lambda m: F.aggregate(F.transform(w, lambda x, s: x * sign(m, s)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(cells, lambda m: F.shiftright(cell(m), k))  # exact: the sums of a class are multiples of 2^k


def steps(letters: str) -> list[dict]:
    """Each order of the filters and each of its steps: before is the mask of the filters that came earlier."""
    out = []
    for order in itertools.permutations(range(len(letters))):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": name, "step": step, "before": before, "own": 1 << i})
            before |= 1 << i
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for
    each part, order of the filters and step. labels: rows (doc_id, quality, toxic)."""
    k, letters = len(filters), "".join(filters)
    table_wide = [i for i, f in enumerate(filters.values()) if f is None]
    if len(table_wide) > 1 or any(len(x) != 1 for x in filters):
        raise ValueError("filters have names of one letter, and one of them at most is the duplicate filter")
    counts = mask_counts(labelled(fail_masks(docs, part, filters), labels), table_wide[0] if table_wide else None)
    cells = walsh_sums(counts, k).select("part", "good", "toxic", F.posexplode(inverted(F.col("w"), k)).alias("mask", "n"))
    one = lambda who: F.sum(F.when(who, F.col("n")).otherwise(0))
    per_mask = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), one(F.col("good")).alias("good"), one(F.col("toxic")).alias("toxic"))
    per_part = per_mask.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # 2^k of each part

    plan = F.from_json(F.lit(json.dumps(steps(letters))), "array<struct<filter_order string, step int, before int, own int>>")
    rows = per_part.select("part", "cells", F.explode(plan).alias("s")).select("part", "cells", "s.*")
    fails = lambda x, c: x["mask"].bitwiseAND(F.col(c)) != 0

    def total(where, value=lambda x: x["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x), value(x)).otherwise(F.lit(0)).cast("long"))

    here = lambda x: fails(x, "own") & ~fails(x, "before")
    orders = math.factorial(k)
    portions = F.array(*(F.lit(orders // max(i, 1)).cast("long") for i in range(k + 1)))
    share = lambda x: F.get(portions, F.bit_count(x["mask"]))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x, "own") & ~fails(x, "before")).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: fails(x, "own") & fails(x, "before")).alias("redundant"),
        total(lambda x: x["mask"] == F.col("own")).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        total(lambda x: fails(x, "own"), lambda x: x["n"] * share(x)).alias("shapley"),
    )
