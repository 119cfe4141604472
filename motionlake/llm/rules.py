"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a statistic of a document and a direction: values above the rule's cutoff reject. A cutoff
is chosen per rule and stratum (declared languages and "other", by length class) from labelled holdouts:
it is the strictest value of a fixed grid for which the exact binomial test says that at most `alpha`
of the good documents are rejected, P(Bin(n, alpha) <= k) <= delta / m, where k of the n good labelled
documents lie beyond the cutoff and m = strata * rules (Bonferroni). A grid is tested in a fixed sequence from lenient
to strict: k only grows along it, so the first failure ends it and its values cost no correction of their own.
With `risk` the false rejection over all rules together, alpha is risk / rules.

Strata with too few good labels to certify anything are pooled with others: by length class, then with all that
are left, then with the smallest pool that has enough. Pools follow from the numbers n alone, never from k, and
each stratum is in one pool, so there are never more tests than m and the risk over all documents holds. In a
pool of several strata it holds for the pool, not for each stratum. Only where all labels together are too few is
nothing certified and nothing rejected.

The certified table has one row per stratum at most, and strata are bounded by the parameters, so
it is broadcast. Rows of `labels` whose labels contradict each other are left out of the holdout. A text counts
once in a stratum, however many rows or copies of it are labelled: n and k are numbers of different texts.

Null text: no words. Empty table: empty result. Extra columns pass through `measured`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, materialize, packed, unpacked, word_list

SYMBOLS = "#*$%&|<>"
LANGUAGES = ("de", "en", "es", "fr")
LENGTH_EDGES = (200, 1000)
#: name -> (statistic, grid of cutoffs from lenient to strict)
RULES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1D)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.17, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1D)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08]),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1D)", [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "mean_word": ("word_chars / greatest(n_words, 1D)", [30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0]),
}
PREFIX = "_rule_"


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed and the digest `text`, each under PREFIX.

    Repeated windows are found inside the row: hashes of the 3-word windows are sorted, and only a text
    in which two neighbours agree is sorted again with positions, to count the words that they cover.
    """
    p = PREFIX
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.withColumns({f"{p}words": word_list(F.col("text")), f"{p}lines": lines})
    out = out.withColumns({f"{p}n_words": F.size(f"{p}words").cast("long"), f"{p}n_lines": F.size(f"{p}lines").cast("long")})
    # windows of a text of n words: the sizes agree since both slices and the base are cut to n - 2
    m = f"greatest(size({p}words) - 2, 0)"
    win = f"zip_with(zip_with(slice({p}words, 1, {m}), slice({p}words, 2, {m}), (a, b) -> xxhash64(a, b)), slice({p}words, 3, {m}), (h, c) -> xxhash64(h, c))"
    out = out.withColumn(f"{p}win", F.expr(win))
    out = out.withColumn(f"{p}sorted", F.expr(f"array_sort({p}win)"))
    # hashes that occur twice or more; most texts have few or none
    out = out.withColumn(f"{p}twice", F.expr(f"exists(zip_with(slice({p}sorted, 1, greatest(size({p}sorted) - 1, 0)), slice({p}sorted, 2, greatest(size({p}sorted) - 1, 0)), (a, b) -> a = b), x -> x)"))
    pairs = f"array_sort(transform({p}win, (h, i) -> struct(h, i)))"
    out = out.withColumn(f"{p}pairs", F.when(F.col(f"{p}twice"), F.expr(pairs)))
    k = f"size({p}pairs)"
    # position of each window that equals a neighbour in the sorted order, else -1
    hit = f"zip_with(zip_with({p}pairs, concat(array(struct(0L as h, -1 as i)), slice({p}pairs, 1, {k} - 1)), (x, y) -> struct(x.h as h, x.i as i, y.i >= 0 and x.h = y.h as b)), concat(slice({p}pairs, 2, {k} - 1), array(struct(0L as h, -1 as i))), (x, y) -> if(x.b or (y.i >= 0 and x.h = y.h), x.i, -1))"
    out = out.withColumn(f"{p}hits", F.expr(f"array_sort(filter({hit}, i -> i >= 0))"))
    gap = f"zip_with({p}hits, slice({p}hits, 2, size({p}hits) - 1), (a, b) -> if(b is null, 3, least(3, b - a)))"
    out = out.withColumn(f"{p}n_repeat_words", F.coalesce(F.expr(f"aggregate({gap}, 0, (s, x) -> s + x)"), F.lit(0)).cast("long"))
    out = out.withColumns({
        f"{p}word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        f"{p}n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
    })
    out = out.withColumn(f"{p}base_failed", (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words")))
    out = out.withColumn(f"{p}text", F.xxhash64(text))
    return out.drop(*(f"{p}{x}" for x in ("words", "lines", "win", "sorted", "twice", "pairs", "hits")))


def _stat(rule: str) -> Column:
    expression = RULES[rule][0]
    for name in ("n_symbols", "word_chars", "n_repeat_words", "n_dup_lines", "n_lines", "n_words"):
        expression = expression.replace(name, f"double({PREFIX}{name})")
    return F.expr(expression)


def _stratum() -> Column:
    lang = F.coalesce(F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")), F.lit("other"))
    n = F.col(f"{PREFIX}n_words")
    return F.concat_ws("/", lang, sum(((n >= e).cast("int") for e in LENGTH_EDGES), F.lit(0)).cast("string"))


STRATA = [f"{lang}/{n}" for lang in (*LANGUAGES, "other") for n in range(len(LENGTH_EDGES) + 1)]


def pooled(sizes: dict[str, int], least: int) -> dict[str, str]:
    """The pool of each stratum, from numbers of good texts alone: strata of `least` or more stand alone, the smaller
    ones of a length class go together, and what is too small then joins the smallest pool that isn't."""
    small = [s for s in STRATA if sizes.get(s, 0) < least]
    pools = {s: s for s in STRATA} | {s: f"any/{s.split('/')[1]}" for s in small}
    total: dict[str, int] = {}
    for s, p in pools.items():
        total[p] = total.get(p, 0) + sizes.get(s, 0)
    rest = {p for p, n in total.items() if n < least}
    enough = sorted((n, p) for p, n in total.items() if p not in rest)
    if sum(total[p] for p in rest) >= least or not enough:
        home = "any"
    else:
        home = enough[0][1]
    return {s: home if p in rest else p for s, p in pools.items()}


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact up to rounding: terms by their ratios, summed in the log domain."""
    first = n * F.lit(math.log1p(-p))
    odds = math.log(p) - math.log1p(-p)
    zero = F.struct(first.alias("term"), first.alias("total"))

    def more(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1).cast("double") / j) + odds
        high, lowest = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(lowest - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, zero, more, lambda s: s["total"])


def certified(holdout: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per stratum: a cutoff per rule, null where no grid value is certified. holdout: measured good documents,
    of which copies of a text are one trial."""
    rules = list(RULES)
    alpha = risk / len(rules)
    level = math.log(delta / (len(STRATA) * len(rules)))
    least = math.ceil(level / math.log1p(-alpha))  # with fewer texts, not even k = 0 certifies
    beyond = [F.sum((_stat(r) > F.lit(c)).cast("long")).alias(f"{r}_{i}") for r in rules for i, c in enumerate(RULES[r][1])]
    stats = [c for c in holdout.columns if c.startswith(PREFIX) and c != f"{PREFIX}text"]
    once = lambda by, rows: rows.groupBy(by, f"{PREFIX}text").agg(*(F.first(c).alias(c) for c in stats))
    texts = materialize(once("_stratum", holdout.withColumn("_stratum", _stratum())))
    pools = pooled({r["_stratum"]: r["count"] for r in texts.groupBy("_stratum").count().collect()}, least)
    named = F.create_map(*(F.lit(x) for pair in pools.items() for x in pair))
    # a text that stands in several strata of a pool counts once there
    counts = materialize(once("_pool", texts.withColumn("_pool", named[F.col("_stratum")])).groupBy("_pool").agg(F.count("*").alias("_n"), *beyond))
    picked = []
    for r in rules:
        # rejections above the mean n * alpha can't be certified, so the tail is summed up to there only
        tried = [F.when(F.col(f"{r}_{i}") <= F.col("_n") * alpha, F.when(log_binomial_tail(F.col("_n"), F.col(f"{r}_{i}"), alpha) <= level, F.lit(c))) for i, c in enumerate(RULES[r][1])]
        picked.append(F.array_min(F.array(*tried)).alias(f"_cut_{r}"))
    return counts.select(F.explode(F.filter(F.array(*map(F.lit, STRATA)), lambda s: named[s] == F.col("_pool"))).alias("_stratum"), F.col("_pool"), F.col("_n").alias("_pool_texts"), *picked)


def judged(measured_docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """measured_docs with `_kept`: false if base_failed or beyond any certified cutoff of its stratum; with `_stratum`, and with `_pool` and
    `_pool_texts`: the strata for which together the risk is guaranteed, and from how many different good texts (null where nothing is certified)."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 and hi = 1").select(F.col("doc_id").alias("_labelled"))
    stats = measured_docs.select("doc_id", "lang", *(c for c in measured_docs.columns if c.startswith(PREFIX)))
    cuts = certified(stats.where(~F.col(f"{PREFIX}base_failed")).join(good, F.col("doc_id") == F.col("_labelled"), "left_semi"), risk, delta)
    out = measured_docs.withColumn("_stratum", _stratum()).join(F.broadcast(cuts), "_stratum", "left")
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | F.coalesce(_stat(r) > F.col(f"_cut_{r}"), F.lit(False))
    return out.withColumn("_kept", ~F.col(f"{PREFIX}base_failed") & ~beyond).drop(*(f"_cut_{r}" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, guaranteed_for, guaranteed_texts for every
    row. The false rejection is limited for guaranteed_for as a whole: the stratum itself where it has texts enough, else a pool of strata."""
    p = PREFIX
    narrow = materialize(measured(docs.select("doc_id", "lang", "text")).drop("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(narrow, labels, **risk).select("doc_id", *(F.col(p + x).alias(x) for x in names), F.col("_kept").alias("kept"), F.col("_stratum").alias("stratum"), F.col("_pool").alias("guaranteed_for"), F.col("_pool_texts").alias("guaranteed_texts"))


def keep_good(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """The rows of docs that pass, with the columns of docs, whatever their names are."""
    rows = materialize(measured(packed(docs, "lang")).drop("text"))  # the text is in the row
    return unpacked(judged(rows, labels, **risk).where("_kept"), docs)
