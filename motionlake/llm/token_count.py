"""Token counts from distinct pre-tokens: no ids are made.

1. Each task counts its pre-tokens and the counts are summed by pre-token: the distinct table.
2. The pieces of each distinct pre-token are counted once, with the tokenizer's own model.
3. Documents count their pre-tokens again. Frequent pre-tokens (at most `hot`, chosen by a frequency
   cutoff, so their size is bounded) are joined from a broadcast table as the document is read; the
   others are joined to the distinct table by a shuffle, one row per document and pre-token.
4. A document's tokens are the sum of frequency times pieces.

Null and empty texts have no tokens. Repeated rows are counted each. An empty table stays empty.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, materialize

#: What a byte-level tokenizer file with use_regex splits by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FLUSH = 300_000

_models: dict[int, object] = {}


def _model(blob: str):
    """The tokenizer, one a worker process and file."""
    key = hash(blob)
    if key not in _models:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core
        from tokenizers import Tokenizer

        _models[key] = Tokenizer.from_str(blob)
    return _models[key]


class Splitter:
    """Splits as the tokenizer does: its added tokens first (they are one token each), then the pattern."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"]["use_regex"] or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without normaliser or prefix space is needed")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.find = regex.compile(PATTERN).findall

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of added tokens between them."""
        if self.cut is None or not any(a in text for a in self.added):
            return self.find(text), 0
        parts = self.cut.split(text)
        return [w for part in parts for w in self.find(part)], len(parts) - 1


def distinct_pretokens(docs: DataFrame, blob) -> DataFrame:
    """pretoken, total, pieces: one row per distinct pre-token of the table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, seen = Splitter(blob.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen.update(split(text)[0])
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"pretoken": list(seen.keys()), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"pretoken": list(seen.keys()), "n": list(seen.values())}, columns=["pretoken", "n"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(blob.value)
        for batch in batches:
            made = [len(e) for e in model.encode_batch(batch["pretoken"].tolist(), add_special_tokens=False)]
            yield batch.assign(pieces=made)

    summed = map_pandas(docs.select("text"), count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("total"))
    return map_pandas(summed, pieces, "pretoken string, total long, pieces int")


def _frequent(distinct: DataFrame, hot: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, at most `hot` of them and of 200 characters each."""
    short = distinct.where(F.length("pretoken") <= 200)
    step = F.floor(8 * F.log2(F.col("total").cast("double")))
    level, room = None, hot
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if r["count"] > room:
            break
        level, room = r["step"], room - r["count"]
    if level is None:
        return {}
    return {r["pretoken"]: r["pieces"] for r in short.where(step >= level).select("pretoken", "pieces").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, hot: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. tokenizer: path of a tokenizer file on the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())
    distinct = materialize(distinct_pretokens(docs, blob))
    frequent = spark.sparkContext.broadcast(_frequent(distinct, hot))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, known = Splitter(blob.value), frequent.value
        for batch in batches:
            rows, ids, words, counts, sums, sizes = [], [], [], [], [], []
            for row, doc_id, text in zip(batch["row"].tolist(), batch["doc_id"], batch["text"], strict=True):
                found, total = split(text) if text else ([], 0)
                seen = Counter(found)
                rest = []
                for w, n in seen.items():
                    p = known.get(w)
                    if p is None:
                        rest.append(w)
                    else:
                        total += p * n
                # one row of the known sum under a key that no pre-token has, then the rest
                rows += [row] * (1 + len(rest))
                ids += [doc_id] + [None] * len(rest)
                words += [f"a a {row}", *rest]
                counts += [0, *(seen[w] for w in rest)]
                sums += [total] + [0] * len(rest)
                sizes += [len(text.encode()) if text else 0] + [0] * len(rest)
            yield pd.DataFrame({"row": rows, "doc_id": ids, "word": words, "n": counts, "known": sums, "bytes": sizes})

    # ids pass as text: pandas would turn long ids beside a null into inexact numbers
    numbered = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    used = map_pandas(numbered, frequencies, "row long, doc_id string, word string, n long, known long, bytes long")
    joined = used.join(distinct.select(F.col("pretoken").alias("word"), "pieces"), "word", "left")
    summed = joined.groupBy("row").agg(F.max("doc_id").cast("long").alias("doc_id"), F.max("bytes").alias("n_bytes"), F.sum(F.col("known") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
