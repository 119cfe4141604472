"""Byte-level BPE by prefix dynamic programming.

The byte-pair encoding of a text without its last token is the encoding of that shorter text. So every
prefix of a piece has one last token, and storing that token per prefix stores every prefix's encoding.
The last token of prefix i is the one token that ends at i and that may follow the last token of the
prefix before it: two tokens may stand side by side when merging their bytes afresh gives the two again.

* append: go on from the stored prefixes; nothing before the new bytes changes.
* edit: keep the prefixes before the edit, and encode from there on; when the last tokens of a
  maximal token length in a row are those stored before, the rest of the old table follows unchanged.

Vocabulary entries that merging can't reach never stand in an encoding, except that a piece which is an
entry itself is that one token, as in the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas

#: The pattern that splits a text into pieces, for vocabularies of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 600_000


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank, as rank files have them."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


class PrefixTable:
    """The last token of every prefix of one piece; prefixes[i] is of the first i + 1 bytes."""

    def __init__(self, coder: BpeCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.coder.extend(self.data, self.last, start)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start:end. Returns the number of prefixes encoded again beyond the new bytes."""
        old, tail = self.last, self.data[end:]
        self.data, self.last = self.data[:start] + new + tail, old[:start]
        shift, at, agreed = len(new) - (end - start), start + len(new), 0
        self.coder.extend(self.data[:at], self.last, start)
        done = at
        while done < len(self.data) and agreed < 2 * self.coder.longest:
            self.coder.extend(self.data[: done + 1], self.last, done)
            # tokens that reach back into the edit can't vouch for the old table
            same = self.last[done] == old[done - shift] and done + 1 - len(self.coder.token[self.last[done]]) >= at
            agreed, done = agreed + 1 if same else 0, done + 1
        if done < len(self.data):
            self.last += old[done - shift :]
        return done - at

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes, by merges alone."""
        out, i = [], len(self.data) if end is None else end
        while i:
            out.append(self.last[i - 1])
            i -= len(self.coder.token[self.last[i - 1]])
        return out[::-1]


class BpeCoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.longest = max(map(len, ranks))
        self.halves = {r: self._halves(t) for t, r in ranks.items()}
        #: tokens that merging reaches
        self.live = {t: r for t, r in ranks.items() if len(t) == 1 or self.halves[r]}
        self.merged = {h: r for r, h in self.halves.items() if h}
        self.beside: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, or None if merging its bytes ends otherwise."""
        parts, own = [token[i : i + 1] for i in range(len(token))], self.rank[token]
        while len(parts) > 2:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
            if best >= own:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends in a, b.

        Undo the merges of both from the latest on: at each point of that history, a merge across the
        border that comes before the merge just undone would have been made first.
        """
        known = self.beside.get((a, b))
        if known is not None:
            return known
        left, right, before, good = a, b, len(self.token) + 1, True
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                good = False
                break
            # the later merge of the two is undone first; of equal ones, the left merge was made first
            if left > right:
                if (h := self.halves[left]) is not None:
                    before, left = left, h[1]
                elif (h := self.halves[right]) is not None:
                    before, right = right + 1, h[0]
                else:
                    break
            elif (h := self.halves[right]) is not None:
                before, right = right + 1, h[0]
            elif (h := self.halves[left]) is not None:
                before, left = left, h[1]
            else:
                break
        if len(self.beside) >= MEMO:
            self.beside.clear()
        self.beside[a, b] = good
        return good

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Append to last the last tokens of the prefixes from start on."""
        live, longest, may_follow = self.live, self.longest, self.may_follow
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                t = live.get(data[begin:end])
                if t is not None and (begin == 0 or may_follow(last[begin - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token for the byte at {end - 1}")

    def piece(self, text: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit integers."""
        got = self.memo.get(text)
        if got is None:
            data = text.encode()
            whole = self.rank.get(data)
            ids = [whole] if whole is not None else PrefixTable(self, data).ids()
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[text] = np.asarray(ids, "<u4").tobytes()
        return got

    def encode(self, text: str, split: regex.Pattern) -> bytes:
        piece, memo = self.piece, self.memo
        return b"".join([memo.get(w) or piece(w) for w in split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, BpeCoder] = {}


def coder_for(blob: bytes) -> BpeCoder:
    """One coder a worker process and vocabulary, so that its memo outlives a task."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _coders:
        _coders[key] = BpeCoder(load_ranks(blob))
    return _coders[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids (binary: little-endian 32-bit), n_tokens, decoded (binary) for every row; null text is empty.

    vocabulary: path of a rank file on the driver; its bytes (under 1 MB) are broadcast.
    """
    return _encoded(docs, vocabulary, pattern, "doc_id string, ids binary, n_tokens long, decoded binary", lambda ids, out: (ids, out))


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_documents gives. Rows are
    independent: no shuffle, repeated rows and null ids stay as they are, an empty table stays empty."""
    return _encoded(docs, vocabulary, pattern, "doc_id string, ids_sha256 string, n_tokens long, decoded_sha256 string", lambda ids, out: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(out).hexdigest()))


def _encoded(docs: DataFrame, vocabulary: str, pattern: str, schema: str, made) -> DataFrame:
    with open(vocabulary, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, split = coder_for(blob.value), regex.compile(pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = coder.encode(text or "", split)
                a, b = made(ids, coder.decode(ids))
                rows.append((doc_id, a, len(ids) // 4, b))
            yield pd.DataFrame(rows, columns=names)

    # ids pass as text: pandas would turn long ids beside a null into inexact numbers
    out = map_pandas(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
