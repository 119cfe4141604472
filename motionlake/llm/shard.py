"""Sharding by sampled splitters, in DataFrame functions only.

Every record has a 64-bit key: the high 40 bits digest its text, the low 24 bits its id. Equal texts
are neighbours in key order, and yet a text that fills a third of the table can still be cut by id.

1. A size-weighted sample draws each record floor(rate * size + u) times, so a key is drawn in
   proportion to the bytes behind it; the expected number of draws is a parameter (`sample`).
2. Quantiles of the sampled keys are the splitters. A splitter moves down to the start of its text
   (groups of equal texts stay whole) unless its text was drawn as two splitters or more: that text
   overfills its range, and the range is cut evenly by id digest.
3. Exact bytes and rows of each range come from one aggregate; ranges above twice their share are
   subdivided and counted again. Ranges then follow each other along the byte line, and range r goes
   to the shard in which its middle byte lies.
4. A slot is the rows of earlier ranges of the shard plus the row number within the range.

The driver sees one row per range (`ranges_per_shard` * shards at first), never one per record.
Null texts have size 8 and text_crc32 of the empty text. Repeated rows get slots of their own.
An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_array, materialize, uniform

ID_BITS = 24


def _key() -> Column:
    high = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), ID_BITS), ID_BITS)
    return high.bitwiseOR(F.xxhash64(F.lit(7), F.col("doc_id")).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def _range_of(splitters: list[int]) -> Column:
    """The number of splitters that are <= key, found in two steps of about sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    heads = splitters[step - 1 :: step]
    padded = [splitters[i : i + step] for i in range(0, len(splitters), step)] + [[]]
    rows = F.from_json(F.lit(str(padded)), "array<array<bigint>>")
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= F.col("key")))
    block = below(long_array(heads))
    return block * step + below(F.get(rows, block))


def _snapped(quantiles: list[int]) -> list[int]:
    """Splitters at starts of texts, and even cuts by id inside texts that were drawn repeatedly."""
    drawn: dict[int, int] = {}
    for q in quantiles:
        drawn[q >> ID_BITS] = drawn.get(q >> ID_BITS, 0) + 1
    out = set()
    for text, n in drawn.items():
        start = text << ID_BITS
        if n == 1:
            out.add(start)
        else:
            out.update(start + (i << ID_BITS) // n for i in range(n))
            if start + (1 << ID_BITS) < 1 << 63:
                out.add(start + (1 << ID_BITS))
    return sorted(out)


def _subdivided(splitters: list[int], totals: dict[int, int], share: float) -> list[int]:
    """More splitters, evenly by key, inside ranges of over two shares."""
    edges = [-(1 << 63), *splitters, (1 << 63) - 1]
    extra = []
    for r, size in totals.items():
        n = min(int(size // share), edges[r + 1] - edges[r])
        if size > 2 * share and n > 1:
            extra += [edges[r] + (edges[r + 1] - edges[r]) * i // n for i in range(1, n)]
    return sorted({*splitters, *extra})


def shard_by_size(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 48, sample: int = 60_000, refine: int = 2) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key().alias("key")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = shards * ranges_per_shard
    splitters: list[int] = []
    if total:
        copies = F.floor(F.col("size") * F.lit(sample / total) + uniform(F.col("key"), F.col("doc_id"))).cast("int")
        drawn = rows.withColumn("copies", copies).where("copies > 0").select(F.explode(F.array_repeat("key", F.col("copies"))).alias("key"))
        quantiles = drawn.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20_000)).first()[0]
        splitters = _snapped(quantiles or [])

    def counted() -> DataFrame:
        return rows.groupBy(_range_of(splitters).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))

    ranges = counted().collect() if total else []
    for _ in range(refine):
        finer = _subdivided(splitters, {r["range"]: r["bytes"] for r in ranges}, total / n if n else 1)
        if finer == splitters:
            break
        splitters, ranges = finer, None
        ranges = counted().collect()
    # one entry per range: its shard and the rows that lie before it in that shard
    shard_of, base, before, filled = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1), 0, [0] * shards
    for r in sorted(ranges, key=lambda r: r["range"]):
        s = min(shards - 1, (2 * before + r["bytes"]) * shards // (2 * total))
        shard_of[r["range"]], base[r["range"]] = s, filled[s]
        before, filled[s] = before + r["bytes"], filled[s] + r["rows"]
    placed = rows.withColumn("range", _range_of(splitters))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.get(long_array(shard_of), F.col("range")).cast("int").alias("shard"),
        (F.get(long_array(base), F.col("range")) + rank - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
