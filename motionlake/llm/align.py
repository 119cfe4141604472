"""Cross-tokenizer alignment by an event sweep.

1. Every text is encoded by both tokenizers. A token is an event at the byte where it ends; token bytes are known from the vocabularies, so
   an event is its id. The events of a text are cut into blocks of BLOCK bytes of text, one row for each side and block.
2. Event rows are dealt by document and sorted by (document, block, side) within partitions. A machine runs over them: where both sides have an
   end, the tokens since the last such place are a group, and its last two are linked. Its state is the open group and the sums of the
   document, however long the text is.
3. How often an id pair is linked in the whole corpus is summed by pair, with partial sums before the shuffle. Each document keeps its different
   pairs with their numbers. The most frequent pairs, HOT at most, are looked up in a broadcast table; the rest
   of each document's pairs meets the table of pairs in a shuffle join. So n_best and count_sum are exact.

A text that is null or empty, or whose tokens' bytes aren't a space and the text on either side, has no tokens: zeros, and '' for the groups.
Repeated rows are documents of their own, and count as such. An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_pandas, materialize
from .token_count import PATTERN

#: Bytes of text whose events stand in one row; pairs that are broadcast at most; pairs that a task holds before it puts out their sums.
BLOCK, HOT, FLUSH = 1 << 16, 1_000_000, 2_000_000
_coders: dict[int, object] = {}


def byte_of_char() -> dict[str, int]:
    """The byte that each character stands for in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file. Merges of ids in order let the ranks be the ids, so that the text is encoded as the file's own library does,
    with strings of special tokens as plain text."""

    def __init__(self, blob: bytes):
        import tiktoken

        spec, to_byte = json.loads(blob), byte_of_char()
        pre, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without normaliser or prefix space is needed")
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ids = {token: i for token, i in vocab.items() if token not in added}
        made = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(made) + 256 != len(ids):
            raise ValueError("a vocabulary of bytes and merges in the order of their ids is needed")
        ranks = {bytes(to_byte[c] for c in token): i for token, i in ids.items()}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.model = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A sentencepiece model with byte fallback; it adds the space itself."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n, piece = self.model.get_piece_size(), self.model.id_to_piece
        self.tokens = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _coder(kind: type, blob: bytes):
    """The tokenizer, one a worker process and file."""
    if (key := hash(blob)) not in _coders:
        _coders[key] = kind(blob)
    return _coders[key]


def _packed(ids: np.ndarray) -> bytes:
    return zstandard.compress(ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32).tobytes(), 1)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(blob)
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def events(docs: DataFrame, blob_a, blob_b, block: int = BLOCK) -> DataFrame:
    """row, doc_id (as text), block, side, n, ids: the end events of both sides. A document without tokens has one row of no events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coder(ByteLevel, blob_a.value), _coder(Pieces, blob_b.value)
        sizes = [np.array([len(t) for t in side.tokens], np.int64) for side in (a, b)]
        for batch in batches:
            out = []
            texts = [t or "" for t in batch["text"]]
            for row, doc_id, text, *sides in zip(batch["row"].tolist(), batch["doc_id"], texts, a.encode(texts), b.encode(texts), strict=True):
                whole = b" " + text.encode()
                if not text or any(b"".join(map(side.tokens.__getitem__, ids)) != whole for side, ids in zip((a, b), sides, strict=True)):
                    out.append((row, doc_id, 0, 0, 0, b""))
                    continue
                for side, ids in enumerate(sides):
                    ids = np.array(ids, np.int64)
                    ends = np.cumsum(sizes[side][ids])
                    cuts = np.searchsorted(ends, np.arange(block, len(whole), block), "right").tolist()  # an end at a cut is before it
                    for i, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(ids)], strict=True)):
                        if y > x:
                            out.append((row, doc_id, i, side, y - x, _packed(ids[x:y])))
            yield pd.DataFrame(out, columns=["row", "doc_id", "block", "side", "n", "ids"])

    sent = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    return map_pandas(sent, run, "row long, doc_id string, block int, side int, n int, ids binary")


class _Digits:
    """Ids as decimal digits with a mark after each, for many ids at once."""

    def __init__(self, n: int):
        width = len(str(n))
        self.digits = np.zeros((n, width + 1), np.uint8)
        for i in range(n):
            own = str(i).encode()
            self.digits[i, : len(own)] = np.frombuffer(own, np.uint8)

    def __call__(self, ids: np.ndarray, marks: np.ndarray) -> bytes:
        out = self.digits[ids]
        out[:, -1] = marks
        flat = out.ravel()
        return flat[flat != 0].tobytes()


class Sweep:
    """The machine of one document. Blocks arrive in order of their place in the text; both sides of one are joined before they are swept."""

    def __init__(self, row, doc_id, sizes, digits):
        self.row, self.doc_id, self.sizes, self.digits = row, doc_id, sizes, digits
        self.n, self.n_groups, self.n_links = [0, 0], 0, 0
        self.sha, self.pairs, self.ended = hashlib.sha256(), [], False
        self.block, self.start = -1, [0, 0]
        self.open = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # tokens since the last place where both ended

    def add(self, block: int, side: int, ids: np.ndarray) -> None:
        if block != self.block:
            self.sweep()
            self.block = block
        self.n[side] += len(ids)
        self.open[side] = np.concatenate([self.open[side], ids])

    def sweep(self) -> None:
        """Close the groups that end among the tokens held; tokens after the last one stay held, and both sides start from its end."""
        a, b = self.open
        if not len(a) or not len(b):
            return
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        last_a, last_b = np.isin(ends_a, ends_b, kind="sort"), np.isin(ends_b, ends_a, kind="sort")
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        if not len(at_a):
            return
        a, b, self.open = a[: at_a[-1] + 1], b[: at_b[-1] + 1], [a[at_a[-1] + 1 :], b[at_b[-1] + 1 :]]
        last_a, last_b = last_a[: len(a)], last_b[: len(b)]
        # tokens of all groups in one list, A's before B's in each: a token's place is its own number and the other side's tokens before it
        before_a = np.concatenate([[0], np.cumsum(last_a)[:-1]])  # groups before each token
        before_b = np.concatenate([[0], np.cumsum(last_b)[:-1]])
        many_b, many_a = np.concatenate([[0], at_b + 1]), at_a + 1
        place_a, place_b = np.arange(len(a)) + many_b[before_a], np.arange(len(b)) + many_a[before_b]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        marks[place_a], marks[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        if self.ended:
            self.sha.update(b";")
        self.sha.update(self.digits(ids, marks)[:-1])
        self.ended = True
        self.pairs.append(np.unique(a[at_a] << 32 | b[at_b], return_counts=True))
        self.n_groups += len(at_a)
        self.n_links += len(at_a)

    def result(self) -> tuple:
        self.sweep()
        pairs, times = _summed(self.pairs)
        return self.row, self.doc_id, *self.n, self.n_groups, self.n_links, self.sha.hexdigest() if self.ended else "", pairs.tobytes(), times.tobytes()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, ascending, and the sum of each."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, own = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, own, np.concatenate([t for _, t in parts]))
    return pairs, sums


def swept(found: DataFrame, blob_a, blob_b) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times: one row per document, with its different linked pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = [_coder(ByteLevel, blob_a.value).tokens, _coder(Pieces, blob_b.value).tokens]
        sizes, digits = [np.array([len(t) for t in side], np.int64) for side in tokens], _Digits(max(map(len, tokens)))
        columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        now = None
        for batch in batches:
            out = []
            for row, doc_id, block, side, n, ids in zip(*(batch[c] for c in ("row", "doc_id", "block", "side", "n", "ids")), strict=True):
                if now is None or row != now.row:
                    out += [now.result()] if now else []
                    now = Sweep(row, doc_id, sizes, digits)
                if n:
                    now.add(block, side, _unpacked(ids, n))
            yield pd.DataFrame(out, columns=columns)
        if now:
            yield pd.DataFrame([now.result()], columns=columns)

    dealt = found.repartition("row").sortWithinPartitions("row", "block", "side")
    return map_pandas(dealt, run, "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def pair_counts(documents: DataFrame) -> DataFrame:
    """pair, links, best: how often each pair of ids (A's above the lowest 32 bits, B's below) is linked, and whether no pair with its B id is linked more often."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, room = [], FLUSH
        for batch in batches:
            new = [(_longs(p), _longs(t)) for p, t in zip(batch["pairs"], batch["times"], strict=True)]
            if new:
                held.append(_summed(new))
                room -= len(held[-1][0])
            if room < 0:
                held = [_summed(held)]
                if len(held[0][0]) > FLUSH // 2:
                    yield pd.DataFrame(dict(zip(("pair", "links"), held.pop(), strict=True)))
                room = FLUSH - sum(len(p) for p, _ in held)
        if held:
            yield pd.DataFrame(dict(zip(("pair", "links"), _summed(held), strict=True)))

    counted = map_pandas(documents.where("n_links > 0").select("pairs", "times"), sums, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    # a B id has as many rows as A ids: a window over it holds at most a vocabulary
    same = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counted.withColumn("best", F.col("links") == F.max("links").over(same))


def _frequent(pairs: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, links, best of the most frequent pairs, `hot` at most: all down to a level of frequency."""
    level = F.floor(8 * F.log2(F.col("links").cast("double")))
    least, room = None, hot
    for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if r["count"] > room:
            break
        least, room = r["level"], room - r["count"]
    rows = pairs.where(level >= (least if least is not None else 1 << 20)).select("pair", "links", "best").toArrow()
    pair, links, best = (rows[c].to_numpy() for c in ("pair", "links", "best"))
    order = np.argsort(pair)
    return pair[order], links[order], best[order]


def align_tokens(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row. The tokenizers are paths on the driver: a byte-level
    BPE file and a sentencepiece model."""
    sc = docs.sparkSession.sparkContext
    blobs = []
    for path in (tokenizer_a, tokenizer_b):
        with open(path, "rb") as f:
            blobs.append(sc.broadcast(f.read()))
    documents = materialize(swept(events(docs, *blobs, block), *blobs))
    pairs = materialize(pair_counts(documents))
    frequent = sc.broadcast(_frequent(pairs, hot))

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, links, best = frequent.value
        for batch in batches:
            out = []
            for row, own, times in zip(batch["row"].tolist(), map(_longs, batch["pairs"]), map(_longs, batch["times"]), strict=True):
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                hit = known[at] == own if len(known) else np.zeros(len(own), bool)
                at, n, rest = at[hit], times[hit], ~hit
                # one row of the sums of pairs that are known, under a pair that no other row has, then the rest
                rows = np.zeros((1 + int(rest.sum()), 5), np.int64)
                rows[:, 0] = row
                rows[0, 1:] = -1 - row, 0, n[best[at]].sum(), (n * links[at]).sum()
                rows[1:, 1], rows[1:, 2] = own[rest], times[rest]
                out.append(rows)
            yield pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 5), np.int64), columns=["row", "pair", "n", "known_best", "known_sum"])

    used = map_pandas(documents.where("n_links > 0").select("row", "pairs", "times"), looked_up, "row long, pair long, n long, known_best long, known_sum long")
    each = used.join(pairs, "pair", "left")
    n_best = F.col("known_best") + F.when(F.col("best"), F.col("n")).otherwise(0)
    count_sum = F.col("known_sum") + F.col("n") * F.coalesce("links", F.lit(0))
    total = each.groupBy("row").agg(F.sum(n_best).alias("n_best"), F.sum(count_sum).alias("count_sum"))
    out = documents.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(total, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
