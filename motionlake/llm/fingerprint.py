"""Document fingerprints from prefix polynomial hashes.

A text's prefix hash holds, for two moduli, the sum of (code point + 1) * base^i over each prefix. Two
spans are equal when their differences of prefix sums agree after aligning the powers, so any span equality is
two lookups, and the longest common extension from a pair of places is a binary search.

* fingerprint: the length and the prefix hashes at the quarters of the text. Equal texts have equal
  fingerprints; texts of equal length that differ collide with odds of about 2^-62.
* likeness of two prefix hashes: the characters that agree over the longer length. Those of the longest common
  extensions from the starts and from the ends agree, and those of every window of WINDOW characters that stands
  anywhere in the other text, so moved spans count and so does all that lies between edits. Of the two
  texts' counts the lesser is taken, so that one span can't answer for its many repeats. 1 for equal texts, two
  empty ones included, and below 1 for all others.

`edited_neighbours` works on documents in descending doc_id, nulls last, ties by text digest. Id ranges
of bounded bytes are dealt out, each sorted in its task and read as a stream; the first document of each
range travels to the range before it as well, so that every document meets its next one. The driver sees
one row per range.

Null text is the empty text. Repeated rows follow each other. One document is its own next.
An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_array, map_pandas

MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Characters of the windows that likeness looks for anywhere in the other text.
WINDOW = 24
_powers = {s: [np.ones(1, np.uint64) for _ in MODULI] for s in (1, -1)}


def powers(k: int, n: int, sign: int = 1) -> np.ndarray:
    """Powers 0..n (or 0..-n) at least of base k, doubled as longer texts come."""
    known = _powers[sign]
    while len(known[k]) <= n:
        have = known[k]
        step = np.uint64(pow(BASES[k], sign * len(have), MODULI[k]))
        known[k] = np.concatenate([have, have * step % np.uint64(MODULI[k])])
    return known[k]


class PrefixHash:
    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(code)
        self.sums, self._windows, self._parts = [], None, None
        for k, m in enumerate(MODULI):
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(code * powers(k, self.n)[: self.n] % np.uint64(m), out=out[1:])
            self.sums.append(out % np.uint64(m))

    def spans_equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        for k, m in enumerate(MODULI):
            a, b, p = self.sums[k], other.sums[k], powers(k, max(i, j))
            if (int(a[i + length]) - int(a[i])) * int(p[j]) % m != (int(b[j + length]) - int(b[j])) * int(p[i]) % m:
                return False
        return True

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The longest length at which the spans from i and from j agree."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.spans_equal(i + low, other, j + low, mid - low) else (low, mid - 1)
        return low

    def extension_back(self, i: int, other: PrefixHash, j: int) -> int:
        """The longest length at which the spans that end before i and before j agree."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.spans_equal(i - mid, other, j - mid, mid - low) else (low, mid - 1)
        return low

    @classmethod
    def joined(cls, a: PrefixHash, i: int, b: PrefixHash, j: int) -> PrefixHash:
        """The hash of a's first i characters and b's first j after them, from both prefix arrays."""
        out = cls.__new__(cls)
        out.n, out.sums, out._windows, out._parts = i + j, [], None, (a, i, b, j)
        for k, m in enumerate(MODULI):
            head, m = a.sums[k][: i + 1], np.uint64(m)
            out.sums.append(np.concatenate([head, (b.sums[k][1 : j + 1] * powers(k, i)[i] + head[-1]) % m]))
        return out

    def _window_hashes(self, first: int, last: int) -> np.ndarray:
        parts = []
        for k, m in enumerate(MODULI):
            s, m = self.sums[k], np.uint64(m)
            # differences below 2 * m times powers below m fit in 64 bits
            parts.append((s[first + WINDOW : last + WINDOW] + m - s[first:last]) * powers(k, last, -1)[first:last] % m)
        return parts[0] << np.uint64(31) | parts[1]

    def windows(self) -> np.ndarray:
        """Hashes of all windows of WINDOW characters, moved to power 0; both moduli in one number. Of joined texts, only
        the windows across the seam are new."""
        if self._windows is None:
            n = max(self.n - WINDOW + 1, 0)
            if self._parts is None:
                self._windows = self._window_hashes(0, n)
            else:
                a, i, b, j = self._parts
                head, tail = a.windows()[: max(i - WINDOW + 1, 0)], b.windows()[: max(j - WINDOW + 1, 0)]
                self._windows = np.concatenate([head, self._window_hashes(len(head), n - len(tail)), tail])
        return self._windows

    def agreeing(self, other: PrefixHash, front: int, back: int) -> int:
        """Characters among the first front, the last back, or in a window that other has too."""
        # windows inside the front or the back add nothing
        first, last = max(front - WINDOW + 1, 0), max(self.n - max(back, WINDOW - 1), 0)
        mine, theirs = self.windows()[first:last], other.windows()
        # a table of low bits leaves few windows of either text to compare in full
        low = np.uint64((1 << (8 * len(theirs)).bit_length()) - 1)
        seen = np.zeros(int(low) + 1, bool)
        bits = theirs & low
        seen[bits] = True
        at = np.flatnonzero(seen[mine & low])
        if len(at):
            wanted = mine[at]
            seen[:] = False
            seen[wanted & low] = True
            there = np.sort(theirs[seen[bits]])
            at = first + at[there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted]
        covered = np.zeros(self.n, bool)
        if len(at):
            change = np.zeros(self.n + 1, np.int64)
            change[at] += 1
            change[at + WINDOW] -= 1
            covered = np.cumsum(change[:-1]) > 0
        covered[:front] = True
        covered[self.n - back :] = True
        return int(covered.sum())

    def likeness(self, other: PrefixHash) -> float:
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        front = self.extension(0, other, 0)
        if front == longer:
            return 1.0
        back = min(self.extension_back(self.n, other, other.n), shorter - front)
        return min(self.agreeing(other, front, back), other.agreeing(self, front, back), longer - 1) / longer

    def digest(self) -> str:
        """Length, then both hashes at each quarter."""
        at = [self.n * q // 4 for q in (1, 2, 3, 4)]
        return f"{self.n:x}-" + "".join(f"{int(s[i]):08x}" for i in at for s in self.sums)


def half_replaced(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of following."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def edited_neighbours(docs: DataFrame, range_bytes: int = 4 << 20, most_ranges: int = 4096) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    n = max(1, min(most_ranges, (size["b"] or 0) // range_bytes + 1, size["n"]))
    splitters = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    splitters = sorted(set(splitters or []))
    step = max(1, int(len(splitters) ** 0.5))
    rows = F.from_json(F.lit(str([splitters[i : i + step] for i in range(0, len(splitters), step)] + [[]])), "array<array<bigint>>")
    below = lambda xs: F.coalesce(F.size(F.filter(xs, lambda s: s <= F.col("doc_id"))), F.lit(0))
    block = below(long_array(splitters[step - 1 :: step]))
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    # null ids stand in the lowest range, after all others
    dealt = dealt.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(block * step + below(F.get(rows, block))))
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id", "digest")
    heads = sorted(dealt.groupBy("range").agg(F.max(order).alias("h")).collect(), key=lambda r: r["range"])
    top = max((r["range"] for r in heads), default=0)
    head_id, head_digest, goes_to = [0] * (top + 1), [0] * (top + 1), [0] * (top + 1)
    for below_it, r in zip([heads[-1], *heads[:-1]] if heads else [], heads, strict=True):
        # the next lower range's first document follows this range's last; the highest follows the lowest
        head_id[below_it["range"]], head_digest[below_it["range"]] = below_it["h"]["doc_id"], below_it["h"]["digest"]
        goes_to[below_it["range"]] = r["range"]
    is_head = F.get(long_array(head_id), F.col("range")).eqNullSafe(F.col("doc_id")) & (F.get(long_array(head_digest), F.col("range")) == F.col("digest"))
    places = F.when(is_head, F.array("range", F.get(long_array(goes_to), F.col("range")).cast("int"))).otherwise(F.array("range"))
    both = dealt.select("doc_id", "text", "digest", F.posexplode(places).alias("guest", "range"))
    dealt_out = both.repartition(max(1, len(heads)), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.desc("digest"))
    sent = dealt_out.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "guest", "range")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # range, doc_id, text, hash of the document that waits for its next
        for batch in batches:
            out = []
            for doc_id, text, guest, at in zip(batch["doc_id"], batch["text"], batch["guest"].tolist(), batch["range"].tolist(), strict=True):
                if guest and (held is None or held[0] != at):
                    continue  # more heads with the same id and text
                own = PrefixHash(text)
                if held is not None:
                    edited = half_replaced(held[2], text)
                    cut = held[3].n // 2
                    changed = PrefixHash.joined(held[3], held[3].n - cut, own, min(cut, own.n))
                    out.append((held[1], held[3].n, hashlib.sha256(edited.encode()).hexdigest(), held[3].digest(), changed.digest(), held[3].likeness(changed), held[3].likeness(own)))
                held = None if guest else (at, doc_id, text, own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    done = map_pandas(sent, run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
