"""Exact order statistics by selection: the k-th value of any number of rows, from counts of ranges, without sorting or holding them.

Each pass counts the rows of each range (at most CELLS or so), finds the range that holds the wanted rank by a running sum over the
counts, and cuts that range anew for the next pass. Counts combine before their shuffle, so a group may hold all
rows, and rows of one value are one count. Doubles are first cut by their logarithm, so values of any scale take the same number of
passes; three even cuts then leave one value, and passes end where no range is left to cut. The driver sees how many rows are left. The values
are stored once, and again where half of them or more have fallen out; each pass, which is a job, stores its few ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Ranges that a range is cut into, as a power of two.
CELLS = 18
#: First ranges between two powers of two.
STEPS = 64


def _first_cut(x: Column, kind: str) -> Column:
    """A number that never falls where x grows: of the logarithm for doubles, of the highest bits for longs."""
    if kind == "long":
        return F.shiftright(x, 44).cast("int")
    size = F.floor(F.log2(F.abs(x)) * STEPS).cast("int") + 2000 * STEPS
    most = 8000 * STEPS
    return F.when(F.isnan(x), most + 1).when(x == float("inf"), most).when(x == float("-inf"), -most).when(x == 0, 0).when(x > 0, size).otherwise(-size)


def _even_cut(x: Column, low: Column, high: Column, kind: str) -> Column:
    """The number of x's part of low .. high, cut evenly."""
    if kind == "long":
        return F.call_function("div", x - low, F.shiftright(high - low, CELLS) + 1).cast("int")
    return F.when(high > low, F.floor((x - low) / (high - low) * float(1 << CELLS))).otherwise(0).cast("int")


def _ranked(values: DataFrame, wanted: Callable[[DataFrame], DataFrame], kind: str = "double") -> tuple[DataFrame, DataFrame]:
    """g, t, value: for wanted ranks (g, t, rank: from 0) the value of that rank among rows (g, x) of the group g; and g, n: the values of each
    group, also of those that have only nulls. wanted: a function from totals (g, n) to rows (g, t, rank)."""
    values = stored(values)
    counted = stored(values.groupBy("g", _first_cut(F.col("x"), kind).alias("b")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    totals = counted.groupBy("g").agg(F.sum("n").alias("n"))
    picks = wanted(totals.where("n > 0")).select("g", "t", "rank")
    keys, size, done = ["g"], counted.agg(F.sum("n")).first()[0], []
    for i in range(4):
        if i:
            # a pick's range is (from, to) of the pass before
            ranges = picks.select("g", "from", "to", "held").distinct()
            left = ranges.agg(F.sum("held")).first()[0]
            if left is None:
                break
            inside = values.join(ranges.withColumnRenamed("g", "own"), (F.col("g") == F.col("own")) & F.col("x").between(F.col("from"), F.col("to")))
            if left <= size / 2:
                inside = stored(inside.select("g", "x", "from", "to"))
                values, size = inside.select("g", "x"), left
            counted = inside.groupBy("g", "from", "to", _even_cut(F.col("x"), F.col("from"), F.col("to"), kind).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            keys = ["g", "from", "to"]
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        summed = counted.select(*keys, "n", "low", "high", upto.alias("upto"))
        here = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        found = stored(picks.select(*keys, "t", "rank").join(summed, keys).where(here).select("g", "t", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("low").alias("from"), F.col("high").alias("to"), F.col("n").alias("held")))
        done.append(found.where("from = to").select("g", "t", F.col("from").alias("value")))
        picks = found.where("from <> to")
    rest = picks.select("g", "t", F.raise_error(F.lit("a range of several values is left")).cast(values.schema["x"].dataType).alias("value"))
    return reduce(DataFrame.unionByName, [*done, rest]), totals


def ranked_values(values: DataFrame, wanted: Callable[[DataFrame], DataFrame], kind: str = "double") -> DataFrame:
    """g, t, value: for wanted ranks (g, t, rank: from 0, as a function of n) the value of that rank among rows (g, x) of the group g.
    wanted: a function from totals (g, n) to rows (g, t, rank)."""
    return _ranked(values, wanted, kind)[0]


def quantiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]], by: tuple[str, ...] = (), discrete: bool | tuple[str, ...] = False) -> DataFrame:
    """The columns of `by`, and under each name the exact quantile of a column: interpolated as `percentile` does it, or as
    `percentile_disc` (the lower median at 0.5), all or those named. Names that share a column object share its values. Null values count
    nowhere; groups without any value have null. Without `by`, one row. NaN is larger than all numbers."""
    columns = list({id(c): c for c, _ in wanted.values()}.values())
    place_of = {id(c): k for k, c in enumerate(columns)}
    asked = [(name, place_of[id(c)], float(p), discrete is True or (bool(discrete) and name in discrete)) for name, (c, p) in wanted.items()]
    own = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    parts = [F.struct(F.lit(k).alias("c"), c.cast("double").alias("x")) for k, c in enumerate(columns)]
    values = rows.select(own.alias("by"), F.explode(F.array(*parts)).alias("v")).select(F.struct("by", "v.c").alias("g"), "v.x")

    def ranks(totals: DataFrame) -> DataFrame:
        places = []
        for k, (_, c, p, disc) in enumerate(asked):
            place = p * (F.col("n") - 1)
            ends = (F.greatest(F.ceil(p * F.col("n")), F.lit(1)) - 1,) if disc else (F.floor(place), F.ceil(place))
            places += [F.struct(F.lit(c).alias("c"), F.lit(2 * k + t).alias("t"), r.cast("bigint").alias("rank")) for t, r in enumerate(ends)]
        return totals.select("g", F.explode(F.array(*places)).alias("r")).where("r.c = g.c").select("g", "r.t", "r.rank")

    found, totals = _ranked(values, ranks)
    each, out = [], []
    for k, (name, c, p, disc) in enumerate(asked):
        each.append(F.max(F.when(F.col("t") == 2 * k, F.col("value"))).alias(f"_low_{k}"))
        low = F.col(f"_low_{k}")
        if disc:
            out.append(low.alias(name))
            continue
        each += [F.max(F.when(F.col("t") == 2 * k + 1, F.col("value"))).alias(f"_high_{k}"), F.max(F.when(F.col("g.c") == c, F.col("n"))).alias(f"_n_{k}")]
        high, place = F.col(f"_high_{k}"), p * (F.col(f"_n_{k}") - 1)
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    # a group without any value has a total but no picks
    both = totals.join(found, "g", "left")
    if not by:
        return both.agg(*each).select(*out)
    return both.groupBy(F.col("g.by").alias("by")).agg(*each).select(*(F.col("by").getField(c).alias(c) for c in by), *out)


def smallest(rows: DataFrame, key: Column, share: float) -> DataFrame:
    """One row, cut: the clamp(round(n * share), 1, n - 1)-th smallest of a long key of n rows; none for fewer than two rows."""
    values = rows.select(F.lit(0).alias("g"), key.cast("bigint").alias("x"))
    take = F.greatest(F.least(F.bround(F.col("n") * share), F.col("n") - 1), F.lit(1))
    return ranked_values(values, lambda totals: totals.where("n > 1").select("g", F.lit(0).alias("t"), (take - 1).cast("bigint").alias("rank")), "long").select(F.col("value").alias("cut"))
