"""Line dedup by a segment-partition edit join.

A line (between line feeds) with a word repeats an earlier one if both are equal, or if their edit distance
(insertions, deletions, substitutions of code points) is at most one for each `per_edit` characters of the
shorter line, and at most `threshold`: one edit from 20 characters on and two from 40 on; shorter lines repeat only if
equal. Of equal lines the first in the order (doc_id, text digest, position) stays. Of different lines, one goes only if it is
within the threshold of one that stays and comes before it, so nothing is lost along chains of small changes: lines are taken in the order of a
hash of the document in which they first stand, then of their own digest, and a line stays unless one that stays is near.
That order keeps the lines of one document together, and being random it settles in few rounds. Blank lines stay.

* Equal lines are one node: an aggregate by a 128-bit digest, which combines before its shuffle.
* Segments: a line of length n that allows t edits is cut into t + 1 even segments. A line within t edits
  keeps at least one segment whole, at a place that differs by few characters. So every line is indexed
  under (its length, segment number, segment), and probes the lengths n - t .. n with the
  substrings that the match-aware window allows: 12 for t = 2.
* Candidates meet in an equi-join on the hashed key. The join's condition also compares parities of
  character counts in 64 classes: an edit changes at most two, so no pair within the threshold is lost.
* A key of more than HEAVY index entries doesn't meet its probes. Its lines, all of one length, are cut anew where they differ: a bounded sample of
  them tells at which characters, and each of the t + 1 new segments gets an even share of the differences. Any cuts let a pair share one
  segment, so no pair is lost, and lines that agree in all but a twentieth are told apart by that twentieth. Keys that are
  still heavy are cut again, LEVELS times; those of the last level are joined as they are, and their lines differ in little.
  Index entries are made different first, so a line that stands in many tasks is met once and makes no key heavy by itself.
* Candidates are confirmed on the lines themselves by a banded bit-parallel edit distance. Their texts
  are fetched by a broadcast of the candidates' ids while these are few (`BROADCAST_IDS`), and by a shuffle
  join beyond.

Null texts have no lines. Rows that repeat a doc_id and text are treated alike: their lines stay or go together.
Empty tables give empty results. `deduped` passes extra columns through, whatever their names are, and drops documents that had a
word and have none left; their lines stand elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, map_pandas, materialize, packed, unpacked

THRESHOLD, PER_EDIT = 2, 20
#: Index entries beyond which a key is heavy, how often heavy keys are cut anew, and lines that tell where, about.
HEAVY, LEVELS, SAMPLE = 256, 4, 128
BROADCAST_IDS, BROADCAST_CUTS = 2_000_000, 20_000
#: Characters of lines whose keys are made at once, and lines that a task remembers.
CHUNK, SEEN = 1_000_000, 300_000


def segments(n: int, threshold: int) -> list[tuple[int, int]]:
    """Start and length of each of the threshold + 1 even segments of a line of n characters."""
    k = threshold + 1
    short, longer = n // k, n % k
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def windows(n: int, length: int, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Segment, start and size of the substrings that a line of n characters looks up among lines of `length`, which is
    no more. spans: start and size of the segments of those, one more than the errors allowed."""
    more, out, threshold = n - length, [], len(spans) - 1
    for i, (at, size) in enumerate(spans):
        rest = threshold - i  # errors right of the segment; i errors left of it
        low, high = max(at - i, at + more - rest, 0), min(at + i, at + more + rest, n - size)
        out += [(i, p, size) for p in range(low, high + 1)]
    return out


def probes(n: int, threshold: int, per_edit: int = 1) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings that a line of n characters looks up."""
    out = []
    for length in range(max(n - threshold, 1), n + 1):
        t = min(threshold, length // per_edit)
        if 0 < t < length and n - length <= t:
            out += [(length, *w) for w in windows(n, length, segments(length, t))]
    return out


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance of a and b is at most threshold: a band of 2 * threshold + 1 diagonals as bits.

    Bit k at column j stands for row j - threshold + k. d0 marks cells that equal their diagonal
    neighbour, vp and vn the vertical differences. The distance is followed down the lowest diagonal, and then
    along the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > threshold:
        return False
    front = 0
    while front < m and a[front] == b[front]:
        front += 1
    while n > front and m > front and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b, n, m = a[front:n], b[front:m], n - front, m - front
    if not m:
        return n <= threshold
    width = 2 * threshold + 1
    full = (1 << width) - 1
    # row r of a at column j is bit r - j + threshold: masks slide down one bit a column
    place: dict[str, int] = {}
    for r, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << (r + threshold)
    vp, vn, distance = full ^ ((1 << threshold) - 1), 0, threshold
    # at column -1, bit k stands for row k - threshold - 1: rows below 0 differ by +1 each, none above
    for j, c in enumerate(b):
        match = place.get(c, 0) >> j & full
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        bottom = j + threshold  # the row of the lowest diagonal
        if bottom < n:
            distance += not d0 >> (width - 1) & 1
        else:
            k = n - 1 - j + threshold
            distance += (hp >> k & 1) - (hn >> k & 1)
        if distance > 3 * threshold:
            return False
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
    return distance <= threshold


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), pos, line_id for every line with a word."""
    at = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return at.where(_has_word(F.col("line"))).select("doc_id", "digest", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line_id"))


def _places(threshold: int, per_edit: int, probing: bool):
    """A function of a line's length: (indexed length, segment, start, size) of its index entries or probes."""
    known: dict[int, list] = {}

    def places(n: int) -> list:
        if n not in known:
            t = min(threshold, n // per_edit)
            known[n] = probes(n, threshold, per_edit) if probing else [(n, i, at, size) for i, (at, size) in enumerate(segments(n, t))] if 0 < t < n else []
        return known[n]

    return places


def _keys(docs: DataFrame, threshold: int, per_edit: int, probing: bool) -> DataFrame:
    """key, id, n, parity: index entries or probes of each line that allows an edit, once per task and line."""

    def entries(lines: list[str], ids: list[int], places) -> pd.DataFrame:
        digest, sizes = xxhash.xxh3_64_intdigest, [len(x) for x in lines]
        keys, per = [], []
        for line, n in zip(lines, sizes, strict=True):
            at = places(n)
            per.append(len(at))
            keys += [digest(line[p : p + size].encode(), length << 6 | i) for length, i, p, size in at]
        code = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.int32) % 61
        parity = np.bincount(np.repeat(np.arange(len(lines)), sizes) * 64 + code, minlength=64 * len(lines)).reshape(-1, 64) & 1
        packed = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64).ravel()
        own = np.repeat(np.arange(len(lines)), per)
        return pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "id": np.array(ids, np.uint64).view(np.int64)[own], "n": np.array(sizes, np.int32)[own], "parity": packed[own]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, places = xxhash.xxh3_64_intdigest, _places(threshold, per_edit, probing)
        seen: set[int] = set()
        lines, ids, room = [], [], CHUNK
        for batch in batches:
            for text in batch["text"]:
                for line in (text or "").split("\n"):
                    if len(line) >= per_edit and places(len(line)):
                        h = digest(line.encode())
                        if h not in seen:
                            seen.add(h)
                            lines.append(line)
                            ids.append(h)
                            room -= len(line)
                if room < 0:
                    yield entries(lines, ids, places)
                    lines, ids, room = [], [], CHUNK
                    if len(seen) > SEEN:
                        seen.clear()
        if lines:
            yield entries(lines, ids, places)

    return map_pandas(docs.select("text"), run, "key long, id long, n int, parity long")


def cuts(lines: list[str], t: int) -> list[int]:
    """Starts of t + 1 segments of lines of one length, after the first: each has an even share of what differs between the lines."""
    n = len(lines[0])
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").reshape(len(lines), n)
    differ = np.min([(chars != row).mean(0) for row in chars[:8]], axis=0)  # a line unlike all others tells nothing
    share = np.cumsum(differ + 1e-3 / n)
    found = np.searchsorted(share, share[-1] * np.arange(1, t + 1) / (t + 1)) + 1
    low, high = np.arange(1, t + 1), n - np.arange(t, 0, -1)
    return np.clip(np.maximum.accumulate(found - low) + low, low, high).tolist()


def _cut_anew(index: DataFrame, heavy: DataFrame, lines: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """key, length, starts (of segments after the first) for each heavy key (key, count)."""
    few = index.join(heavy, "key").where(F.pmod(F.xxhash64("id", "key"), F.col("count")) < SAMPLE).select("key", "id")

    @F.pandas_udf("array<int>")
    def starts(groups: pd.Series) -> pd.Series:
        return pd.Series([cuts(list(g), min(threshold, len(g[0]) // per_edit)) for g in groups])

    grouped = few.join(lines, "id").groupBy("key").agg(F.array_sort(F.collect_list("line")).alias("some"))  # SAMPLE lines or so of each key
    # a key without a line in the sample is cut evenly
    made = grouped.select("key", F.length(F.get("some", F.lit(0))).alias("length"), starts("some").alias("starts"))
    rest = index.join(heavy, "key", "left_semi").groupBy("key").agg(F.min("n").alias("own"))
    both = rest.join(made.withColumnRenamed("key", "cut_key"), F.col("key") == F.col("cut_key"), "left")
    return both.select("key", F.col("own").alias("length"), "starts")


def _finer(rows: DataFrame, threshold: int, per_edit: int, probing: bool) -> DataFrame:
    """Keys by the cuts of each heavy key. rows: key, id, n, parity, length, starts, line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, line_id, n, parity, length, starts, line in zip(*(batch[c] for c in ("key", "id", "n", "parity", "length", "starts", "line")), strict=True):
                ends = [*starts, length] if starts is not None else [at + size for at, size in segments(length, min(threshold, length // per_edit))]
                spans = [(x, y - x) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
                for i, p, size in windows(n, length, spans) if probing else [(i, *x) for i, x in enumerate(spans)]:
                    finer = xxhash.xxh3_64_intdigest(line[p : p + size].encode(), (key * 2654435761 + i + 1) & (1 << 64) - 1)
                    out.append((finer, line_id, n, parity))
            made = pd.DataFrame(out, columns=["key", "id", "n", "parity"])
            yield made.assign(key=made["key"].astype(np.uint64).to_numpy().view(np.int64))

    return map_pandas(rows, run, "key long, id long, n int, parity long")


def _lines(docs: DataFrame, ids: DataFrame, per_edit: int) -> DataFrame:
    """id, line for rows (id), which are different."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            found = dict.fromkeys(line for text in batch["text"] for line in (text or "").split("\n") if len(line) >= per_edit)
            yield pd.DataFrame({"line": list(found), "id": np.array([digest(x.encode()) for x in found], np.uint64).view(np.int64)}, columns=["line", "id"])

    return map_pandas(docs.select("text"), lines, "line string, id long").join(few, "id", "left_semi").groupBy("id", "line").count().select("id", "line")


def _met(index: DataFrame, probe: DataFrame, heavy: DataFrame, threshold: int) -> DataFrame:
    """a, b of pairs that meet under a light key; for heavy keys, the probes alone (a null): key, b, b_n, b_parity."""
    light = index.join(heavy, "key", "left_anti").select("key", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("parity").alias("a_parity"))
    light = light.unionByName(heavy.select("key"), allowMissingColumns=True)
    probe = probe.withColumnsRenamed({"key": "_key", "id": "b", "n": "b_n", "parity": "b_parity"})
    near = F.bit_count(F.col("a_parity").bitwiseXOR(F.col("b_parity"))) <= 2 * threshold
    # of two lines with one length, the larger id probes the smaller
    once = (F.col("a_n") < F.col("b_n")) | (F.col("a") < F.col("b"))
    met = light.join(probe, (F.col("key") == F.col("_key")) & (F.col("a").isNull() | ((F.col("a") != F.col("b")) & once & near)))
    only = lambda c: F.when(F.col("a").isNull(), F.col(c)).alias(c)
    return met.select("a", "b", *map(only, ("key", "b_n", "b_parity")))


def candidates(docs: DataFrame, threshold: int, per_edit: int, levels: int = LEVELS) -> DataFrame:
    """a, b: ids of different lines that share a segment, or several if it is a common one, and nearly all parities."""
    index, probe, lines, found, done = materialize(_keys(docs, threshold, per_edit, False).distinct()), _keys(docs, threshold, per_edit, True), None, [], []
    for level in range(levels + 1):
        heavy = materialize(index.groupBy("key").count().where(F.col("count") > (HEAVY if level < levels else 1 << 62)))
        met = materialize(_met(index, probe, heavy, threshold).distinct())
        found.append(met.where("a is not null").select("a", "b"))
        done += [index, heavy, met]
        if heavy.isEmpty():
            break
        index = index.join(heavy, "key", "left_semi")
        probe = met.where("a is null").withColumnsRenamed({"b": "id", "b_n": "n", "b_parity": "parity"}).drop("a")
        if lines is None:
            wanted = materialize(index.select("id").union(probe.select("id")).distinct())
            lines = materialize(_lines(docs, wanted, per_edit))
            done += [wanted, lines]
        anew = materialize(_cut_anew(index, heavy, lines, threshold, per_edit))
        done.append(anew)
        at = F.broadcast(anew) if anew.count() <= BROADCAST_CUTS else anew
        columns = ("key", "id", "n", "parity", "length", "starts", "line")
        index = materialize(_finer(index.join(at, "key").join(lines, "id").select(*columns), threshold, per_edit, False).distinct())
        probe = materialize(_finer(probe.join(at, "key").join(lines, "id").select(*columns), threshold, per_edit, True).distinct())
        done.append(probe)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out = materialize(out.distinct())
    discard(*done)
    return out


def links(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """a, b: line ids (128-bit digests) of different lines within the threshold."""
    pairs = candidates(docs, threshold, per_edit)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    known = materialize(_lines(docs, wanted, per_edit))
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([within(p, q, min(threshold, min(len(p), len(q)) // per_edit)) for p, q in zip(x, y, strict=True)], dtype=bool)

    name = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    out = materialize(both.where(close("x", "y")).select(name("x").alias("a"), name("y").alias("b")))
    discard(pairs, wanted, known)
    return out


def followers(links: DataFrame, order: DataFrame) -> DataFrame:
    """line_id of every line that goes: one within the threshold of a line that stays and comes before it. links: a, b; order: line_id, rank.

    A line before which no undecided one is near stays, and those near it go; so on with the rest. The order being
    random, the rounds grow with the logarithm of the lines. Each round writes what is left to the shared folder.
    """
    rank = lambda x: order.select(F.col("line_id").alias(x), F.struct("rank", F.col("line_id")).alias(f"{x}_rank"))
    ranked = links.join(rank("a"), "a").join(rank("b"), "b")
    first = F.col("a_rank") < F.col("b_rank")
    edges = materialize(ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("after")).distinct())
    gone = []
    while not edges.isEmpty():
        stay = edges.select("before").distinct().join(edges.select(F.col("after").alias("before")), "before", "left_anti")
        gone.append(materialize(edges.join(stay, "before", "left_semi").select(F.col("after").alias("line_id")).distinct()))
        rest = edges.join(gone[-1].select(F.col("line_id").alias("after")), "after", "left_anti").join(gone[-1].select(F.col("line_id").alias("before")), "before", "left_anti")
        done, edges = edges, materialize(rest)
        discard(done)
    out = order.select("line_id").limit(0)
    for x in gone:
        out = out.unionByName(x)
    return out


def dropped_lines(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, digest, dropped (positions, ascending), n_near (of them, those equal to no line that stays) for texts that lose lines."""
    found = materialize(occurrences(docs))
    first = materialize(found.groupBy("line_id").agg(F.min(F.struct("doc_id", "digest", "pos")).alias("first")))
    order = first.select("line_id", F.xxhash64("first.doc_id", "first.digest").alias("rank"))
    near = followers(links(docs, threshold, per_edit), order).withColumn("near", F.lit(True))
    stays = first.join(near, "line_id", "left").select("line_id", "first", F.coalesce("near", F.lit(False)).alias("near"))
    stays = materialize(stays)  # so that the join that follows can split a common line
    discard(first)
    mark = found.join(stays, "line_id").where(F.col("near") | ~F.struct("doc_id", "digest", "pos").eqNullSafe(F.col("first")))
    return mark.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("dropped"), F.countDistinct(F.when(F.col("near"), F.col("pos"))).alias("n_near"))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, n_lines (with a word), n_kept, n_near, dropped (positions) for every row of docs."""
    lines = F.coalesce(F.size(F.filter(F.split("text", "\n", -1), _has_word)), F.lit(0))
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines"))
    gone = dropped_lines(docs.select("doc_id", "text"), threshold, per_edit).withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return both.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), dropped.alias("dropped"))


def deduped(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """docs with the lines that stay, and with the columns of docs; n_chars, where there is one, follows the text."""
    gone = dropped_lines(docs.select("doc_id", "text"), threshold, per_edit).withColumnsRenamed({"doc_id": "gone_doc", "digest": "gone_digest"}).drop("n_near")
    own = packed(docs).withColumn("digest", F.xxhash64("text"))
    both = own.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & (F.col("digest") == F.col("gone_digest")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))  # by a hash set, however many go
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    same = F.col("dropped").isNull()
    out = both.withColumn("left", F.when(~same, left)).where(same | _has_word(F.col("left")))
    changed = {"text": F.coalesce("left", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return unpacked(out, docs, changed)
