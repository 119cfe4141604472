"""Near-duplicate documents by a chosen-path set similarity join.

Texts are lower-cased (A-Z) and become sets of distinct 5-word shingles; a text of fewer words is one
shingle. Equal sets are one node of the join from the start, so groups of copies never meet each other.

* Trees: at each node a document chooses the token of its set that is least under the node's own
  hash, and goes to the child that the token names. Two documents choose alike with the odds of their similarity.
  A document follows its path alone, so one pass over the texts gives every tree's path.
* A node of at most `leaf` sets is compared exhaustively. A larger one branches, down to `depth` levels.
* `trees` independent trees are made. A pair at similarity s shares a leaf at level d of one tree with odds s^d,
  so of pairs at 0.85, the share missed is 0.15^12 < 2e-10 where nodes are small at once, and
  (1 - 0.85^3)^12 < 2e-5 where all three levels are needed.
* A node still larger at the last level is dealt into blocks of about `leaf` sets, each with some pivots of the node.
  Their links join what is one component for the most part. Then every member of such nodes gives its prefix,
  its rarest tokens, of which two sets at the threshold share one at least; by these tokens, pairs that
  aren't yet in one component meet. No pair inside a component is made, and no other pair of the nodes is lost.
* A set has BITS bits, each of the least value under a hash of its own; two sets at similarity s differ in about (1 - s) / 2 of them. Members of a
  leaf that differ from all others in it by more than five deviations over what the threshold allows have no link there, and neither their
  texts nor pairs of them are sent on. So a pair at the threshold is left out with odds of about 10^-6, unlike ones nearly always.
* Links are confirmed on full sets, made again from the whole texts; a leaf gives a spanning forest
  of its links, never all pairs. Leaves with the same members in several trees are compared once.

Null, empty and blank texts have empty sets and are linked with nothing. Rows that repeat a doc_id share a
verdict; a null id joins its group but is no component's name unless the group has no other. An empty
table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, map_pandas, materialize, packed, unpacked
from .components import components

#: Buckets of token counts that order prefixes; giant nodes in whose blocks a set stands; pivots of a giant node.
BUCKETS, MERGES, PIVOTS = 1 << 18, 3, 8
#: Bits of a set, a multiple of 64; deviations that a pair at the threshold may stray.
BITS, DEVIATIONS = 512, 5
#: Sets whose marks of 8 bytes are broadcast at most.
BROADCAST_IDS = 2_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHIFT = np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> _SHIFT)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out * _MIX[0] + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def tree_paths(tokens: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Node names (trees, depth) on the paths of a set."""
    seeds = _mixed(np.arange(1, trees + 1, dtype=np.uint64) * _MIX[0])
    out = np.empty((trees, depth), np.uint64)
    rows = max(1, min(trees, 1_000_000 // len(tokens)))
    for d in range(depth):
        for a in range(0, trees, rows):
            s = seeds[a : a + rows]
            h = (tokens[None, :] ^ s[:, None]) * _MIX[1]
            h ^= h >> np.uint64(29)
            h *= _MIX[2]
            seeds[a : a + rows] = _mixed(tokens[h.argmin(1)] + s * _MIX[0])
        out[:, d] = seeds
    return out


_SEEDS = (_mixed(np.arange(1, BITS + 1, dtype=np.uint64) * _MIX[0]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def set_bits(tokens: np.ndarray) -> np.ndarray:
    """BITS bits of a set, as longs: one of the least value under each of as many hashes of 32 bits."""
    short, out = (tokens >> np.uint64(32)).astype(np.uint32), np.empty(BITS, np.uint8)
    rows = max(1, min(BITS, 32_768 // len(tokens)))  # what stays in a core's cache
    for a in range(0, BITS, rows):
        h = short[None, :] * _SEEDS[a : a + rows, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        out[a : a + rows] = (h.min(1) >> np.uint32(9)).astype(np.uint8) & 1
    return np.packbits(out).view(np.int64)


def most_differing(percent: int) -> int:
    """Bits in which two sets at the threshold differ at most, but for odds of about 10^-6."""
    p = (1 - percent / 100) / 2
    return math.ceil(BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def sketches(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, sid (set digest, null for the empty set), paths, bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, sids, paths, bits = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text)
                bits.append(set_bits(s) if len(s) else None)
                counts.append(len(s))
                sids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                paths.append(tree_paths(s, trees, depth).ravel().view(np.int64) if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n_shingles": counts, "sid": sids, "paths": paths, "bits": bits})

    sent = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return map_pandas(sent, run, "doc_id string, digest long, n_shingles long, sid binary, paths array<bigint>, bits array<bigint>").withColumn("doc_id", F.col("doc_id").cast("long"))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[list[dict]]:
    """Runs of rows with one key from a stream sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_dict("records"):
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _forest(members: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links of one leaf that join its members' components; with labels and sides, only of pairs that need it."""
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    labels: dict[bytes, int] = {}
    for i, m in enumerate(members):
        if m.get("label") is not None:
            parent[i] = labels.setdefault(m["label"], i)
    out = []
    for i, a in enumerate(members):
        for j in range(i):
            b = members[j]
            if (a["side"] or b["side"]) and root(i) != root(j) and _linked(a["set"], b["set"], percent):
                parent[root(i)] = root(j)
                out.append((a["sid"], b["sid"]))
    return out


def _likely(places: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The rows of places (leaf, sid, side, label) that have another in their leaf whose bits are near; each sid once a leaf."""
    most = most_differing(percent)
    dealt = places.join(reps.select("sid", "bits"), "sid").select("leaf", "sid", "side", "label", "bits").repartition("leaf").sortWithinPartitions("leaf", "sid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, "leaf"):
            members: dict[bytes, dict] = {}
            for m in group:
                known = members.setdefault(bytes(m["sid"]), m)
                known["side"] = known["side"] or m["side"]
            rows = list(members.values())
            bits, side = np.stack([m["bits"] for m in rows]).view(np.uint64), np.array([m["side"] for m in rows], bool)
            near = np.zeros(len(rows), bool)
            for i in range(1, len(rows)):
                close = (np.bitwise_count(bits[:i] ^ bits[i]).sum(1) <= most) & (side[:i] | side[i])
                near[:i] |= close
                near[i] |= close.any()
            yield pd.DataFrame([(rows[i]["leaf"], rows[i]["sid"], rows[i]["side"], rows[i]["label"]) for i in np.flatnonzero(near)], columns=["leaf", "sid", "side", "label"])

    return map_pandas(dealt, run, "leaf long, sid binary, side boolean, label binary")


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (sid, ...) with the text of each set's representative, as often as its row stands in docs. While the sets
    are few, a broadcast of their marks leaves out other texts before the shuffle."""
    own = materialize(wanted.join(reps.select("sid", "doc", F.col("digest").alias("_digest")), "sid").withColumn("_mark", F.xxhash64("doc", "_digest")))
    texts = docs.select("doc_id", "text").withColumn("digest", F.xxhash64("text"))
    if own.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(own.select("_mark")), F.xxhash64("doc_id", "digest") == F.col("_mark"), "left_semi")
    return texts.join(own, texts["doc_id"].eqNullSafe(own["doc"]) & (texts["digest"] == own["_digest"])).select("text", *wanted.columns)


def _compared(places: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links inside each leaf. places: rows (leaf, sid, side, label)."""
    sets = _likely(places, reps, percent).groupBy("sid").agg(F.collect_list(F.struct("leaf", "side", "label")).alias("at"))
    found = _texts(docs, reps, sets).select("sid", "text", F.explode("at").alias("x"))
    dealt = found.select("x.leaf", "x.side", "x.label", "sid", "text").repartition("leaf").sortWithinPartitions("leaf", "sid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, "leaf"):
            members: dict[bytes, dict] = {}
            for m in group:
                m["sid"] = bytes(m["sid"])
                known = members.setdefault(m["sid"], m)
                known["side"] = known["side"] or m["side"]
            for m in members.values():
                m["set"] = shingle_set(m.pop("text"))
                m["label"] = None if m["label"] is None else bytes(m["label"])
            yield pd.DataFrame(_forest(list(members.values()), percent), columns=["a", "b"])

    return map_pandas(dealt, run, "a binary, b binary")


def _dealt(giants: DataFrame, leaf: int) -> DataFrame:
    """Rows (node, sid): members of giant nodes in blocks of about `leaf`, with some pivots of the node in each block,
    so that the links of one node's blocks meet. A set is dealt in MERGES of its nodes at most."""
    few = giants.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(F.struct("tree", "node", "n"))), 1, MERGES).alias("at"))
    rows = few.select("sid", F.explode("at").alias("x")).select("sid", "x.node", "x.n")
    own = lambda salt, n: F.pmod(F.xxhash64("sid", "node", F.lit(salt)), n)
    blocks = F.ceil(F.col("n") / leaf)
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    into = F.when(own(1, F.ceil(F.col("n") / PIVOTS)) == 0, every).otherwise(F.array(own(2, blocks)))
    return rows.select("node", "sid", F.explode(into).alias("block")).select(F.xxhash64("node", "block").alias("node"), "sid")


def _prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """token, sid, label, bits, size, pos: the tokens of which two sets at the threshold share one at least.

    Tokens stand in one order for all sets. The first size - ceil(size * percent / 100) + 1 of each set are a prefix;
    sets that share none are below the threshold whatever the order is. Rare tokens come first, by counts in buckets
    over every eighth set: they only make prefixes meet less often.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = np.concatenate([np.zeros(0, np.uint64), *map(shingle_set, batch["text"])])
            bucket, k = np.unique(tokens % np.uint64(BUCKETS), return_counts=True)
            yield pd.DataFrame({"bucket": bucket.astype(np.int64), "k": k.astype(np.int64)})

    eighth = texts.where(F.pmod(F.xxhash64("sid"), F.lit(8)) == 0).select("text")
    sums = map_pandas(eighth, counted, "bucket long, k long").groupBy("bucket").agg(F.sum("k").alias("k")).where("k > 1").toArrow()
    common = np.zeros(BUCKETS, np.int32)
    common[sums["bucket"].to_numpy()] = np.minimum(sums["k"].to_numpy(), 2**31 - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            firsts, sizes, bits = [], [], []
            for text in batch["text"]:
                s = shingle_set(text)
                bits.append(set_bits(s))
                n = len(s) + percent * len(s) // -100 + 1
                firsts.append(s[np.argsort(common[s % np.uint64(BUCKETS)], kind="stable")[:n]])
                sizes.append(len(s))
            per = [len(x) for x in firsts]
            own = batch[["sid", "label"]].assign(size=sizes, bits=bits).loc[np.repeat(batch.index.to_numpy(), per)].reset_index(drop=True)
            yield own.assign(token=np.concatenate(firsts).view(np.int64), pos=np.concatenate([np.arange(n, dtype=np.int32) for n in per]))[["token", "sid", "label", "bits", "size", "pos"]]

    return map_pandas(texts, run, "token long, sid binary, label binary, bits array<bigint>, size int, pos int")


def _stars(giants: DataFrame, named: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, leaf: int) -> DataFrame | None:
    """Rows (leaf, sid, side, label) of what is left to compare among members of giant nodes, or None.

    Of a pair in two components, both prefixes hold its first common token. Of each token, the sets outside the
    token's largest component meet all sets with other labels; sets inside it never meet each other. Lengths, the
    places of the token and the bits drop pairs that can't reach the threshold within the join, so that pages of one template
    that are unlike otherwise give no rows. A set with its partners is a star, cut into leaves.
    """
    labels = giants.select("node", "sid").join(named.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("component", "sid"))
    mixed = materialize(labels.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("node"))
    rest = materialize(labels.join(mixed, "node", "left_semi").select("sid", "label").distinct())
    if rest.isEmpty():
        return None
    texts = materialize(_texts(docs, reps, rest).dropDuplicates(["sid"]))
    rows = materialize(_prefixes(texts, percent))
    shares = rows.groupBy("token", "label").agg(F.count("*").alias("k"))
    top = shares.groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n")).where("top.k < n")
    rows = materialize(rows.join(materialize(top.select("token", F.col("top.label").alias("main"))), "token"))
    a, b = (rows.select("token", "main", *(F.col(c).alias(f"{c}_{x}") for c in ("sid", "label", "bits", "size", "pos"))) for x in "ab")
    b = b.withColumnsRenamed({"token": "_token", "main": "_main"})
    together = F.col("size_a") + F.col("size_b")
    shared = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    near = (shared * (100 + percent) >= percent * together) & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    differ = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    near = near & (differ <= most_differing(percent))
    once = (F.col("label_b") == F.col("main")) | (F.col("sid_a") < F.col("sid_b"))
    met = a.where("label_a <> main").join(b, (F.col("token") == F.col("_token")) & (F.col("label_a") != F.col("label_b")) & once & near)
    pairs = materialize(met.select("sid_a", "label_a", "sid_b", "label_b").distinct())
    many = materialize(pairs.groupBy("sid_a").agg(F.ceil(F.count("*") / (4 * leaf)).alias("chunks")))
    placed = pairs.join(many, "sid_a").withColumn("leaf", F.xxhash64("sid_a", F.pmod(F.xxhash64("sid_b"), F.col("chunks"))))
    side = lambda x, own: placed.select("leaf", F.col(f"sid_{x}").alias("sid"), F.lit(own).alias("side"), F.col(f"label_{x}").alias("label"))
    stars = materialize(side("a", True).distinct().unionByName(side("b", False)))
    discard(mixed, rest, texts, rows, pairs, many)
    return None if stars.isEmpty() else stars


def _classes(docs: DataFrame, percent: int, trees: int, depth: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows; and sid, doc, digest, label for every different set: its first document and its component."""
    sketched = materialize(sketches(docs, trees, depth))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")).alias("r")
    reps = materialize(sketched.where("sid is not null").groupBy("sid").agg(first, F.first("paths").alias("paths"), F.first("bits").alias("bits")).select("sid", F.col("r.doc_id").alias("doc"), F.col("r.digest").alias("digest"), "paths", "bits"))
    path = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("paths", t * depth + 1, depth))
    todo = reps.select("sid", F.posexplode(path).alias("tree", "path"))
    places, giants, done = [], None, []
    for d in range(depth):
        todo = todo.withColumn("node", F.get("path", F.lit(d)))
        counts = materialize(todo.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        found = materialize(todo.join(counts, "node"))
        done += [counts, found]
        places.append(found.where(F.col("n") <= leaf).select("node", "sid"))
        todo = found.where(F.col("n") > leaf).select("sid", "tree", "path", "node", "n")
        if todo.isEmpty():
            break
        if d + 1 == depth:
            giants = todo
            places.append(_dealt(giants, leaf))
        else:
            todo = todo.select("sid", "tree", "path")
    at = places[0]
    for p in places[1:]:
        at = at.unionByName(p)
    # leaves of several trees with the same members: the one of the least name stands for all
    marks = at.groupBy("node").agg(F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("n"))
    chosen = marks.where("n > 1").groupBy("mark", "n").agg(F.min("node").alias("node")).select("node")
    at = at.join(chosen, "node", "left_semi").select(F.col("node").alias("leaf"), "sid", F.lit(True).alias("side"), F.lit(None).cast("binary").alias("label"))
    links = materialize(_compared(at, reps, docs, percent))
    named = materialize(components(links))
    stars = _stars(giants, named, reps, docs, percent, leaf) if giants is not None else None
    if stars is not None:
        more = materialize(_compared(stars, reps, docs, percent))
        if not more.isEmpty():
            named = materialize(components(links.unionByName(more)))
        discard(stars, more)
    discard(*done, links)
    classes = reps.select("sid", "doc", "digest").join(named.withColumnRenamed("node", "sid"), "sid", "left")
    return sketched, classes.select("sid", "doc", "digest", F.coalesce("component", "sid").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = 12, depth: int = 3, leaf: int = 64) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id, kept for every row of docs."""
    sketched, classes = _classes(docs, percent, trees, depth, leaf)
    least = classes.groupBy("label").agg(F.min("doc").alias("component_id"))
    names = materialize(classes.join(least, "label").select("sid", "component_id"))
    # documents without shingles stay aside: a join would send them all to the partition of the null key
    joined = sketched.where("sid is not null").join(names, "sid").select("doc_id", "digest", "n_shingles", "component_id")
    alone = sketched.where("sid is null").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 85, trees: int = 12, depth: int = 3, leaf: int = 64) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: of each group the row that is first by doc_id (nulls last),
    then by text digest, and once if it is repeated. Rows without a word are in no group and stay."""
    sketched, classes = _classes(docs.select("doc_id", "text"), percent, trees, depth, leaf)
    heads = classes.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "digest")).alias("h"))
    heads = heads.select(F.col("h.doc").alias("head"), F.col("h.digest").alias("head_digest"))
    times = sketched.groupBy(F.col("doc_id").alias("own"), F.col("digest").alias("own_digest")).agg(F.count("*").alias("times"))
    same = [F.col("head").eqNullSafe(F.col("own")), F.col("head_digest") == F.col("own_digest")]
    heads = materialize(heads.join(times, same).select("head", "head_digest", "times"))
    rows = packed(docs).withColumn("digest", F.xxhash64("text"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    out = rows.where(~blank).join(heads, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("digest") == F.col("head_digest")))
    if not heads.where("times > 1").isEmpty():  # repeated rows: one of them
        out = out.where("times = 1").unionByName(out.where("times > 1").dropDuplicates(["head", "head_digest"]))
    return unpacked(out, docs).unionByName(docs.where(blank))
