"""Chat formatting: records of many layouts become turns by schema fingerprints, are rendered with a template, and can be read back.

1. A record is a JSON object. The paths of its nested fields, as far as any layout names them, are sorted and hashed:
   that fingerprint selects the layout, a declaration of which paths hold which turns. Optional fields give a layout several fingerprints.
   Fields that no layout names change nothing. A record that no layout fits is returned with a null layout and isn't formatted.
2. Turns of a conversation are ordered by (turn, nulls last; place in the record; role; text), so ties have a defined order. They are
   dealt by conversation and sorted within partitions, so a task holds one turn and one part at a time, however
   long a conversation is.
3. The template puts a turn between <|im_start|> with the role and <|im_end|>. In texts and roles, every `<`, backslashes, `|`
   gets one more backslash: what is left never holds a mark, and taking one away again gives the text. Roles escape line feeds and
   backslashes as well. Spans of assistant texts are the loss mask.
4. The output has rows of at most PART characters (or one turn); nearly every conversation is one row. Reading back parses
   rows as they lie; only conversations of several rows are dealt by id and sorted again.

Null text or role: empty. Null conversation ids are one conversation. Repeated rows are turns of their own. Records that are null, or no JSON object, have
no layout. An empty table gives an empty result. Columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, materialize

START, END = "<|im_start|>", "<|im_end|>"
#: Characters after which a conversation goes on in another row.
PART = 1 << 20


@dataclass(frozen=True)
class Say:
    """One turn of a role: the fields at the paths, those that are there and not empty, with a blank line between."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each object of a list, with its role and text fields; names replaces the layout's own role names."""

    items: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Pairs:
    """A list of [user, assistant]."""

    items: str


@dataclass(frozen=True)
class Layout:
    name: str
    needs: tuple[str, ...]
    turns: tuple[Say | Each | Pairs, ...]
    may: tuple[str, ...] = ()


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("turn", ("role",), (Each("", "role", "text"),), may=("text",)),
    Layout("messages", ("messages[].role", "messages[].content"), (Say("system", ("system",)), Each("messages", "role", "content")), may=("system",)),
    Layout("message_parts", ("messages[].role", "messages[].content[].text"), (Each("messages", "role", "content"),), may=("messages[].content[].type", "messages[].content")),
    Layout("speakers", ("conversations[].from", "conversations[].value"), (Say("system", ("system",)), Each("conversations", "from", "value", SPEAKERS)), may=("system",)),
    Layout("instruction", ("instruction", "output"), (Say("system", ("system",)), Pairs("history"), Say("user", ("instruction", "input")), Say("assistant", ("output",))), may=("system", "input", "history[][]", "history[]")),
    Layout("completion", ("prompt", "completion"), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("completion",))), may=("system",)),
    Layout("response", ("prompt", "response"), (Say("system", ("system",)), Pairs("history"), Say("user", ("prompt",)), Say("assistant", ("response",))), may=("system", "history[][]", "history[]")),
    Layout("prompt_messages", ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content"), (Each("prompt", "role", "content"), Each("completion", "role", "content"))),
    Layout("question", ("question", "answer"), (Say("system", ("system",)), Say("user", ("context", "question")), Say("assistant", ("answer",))), may=("system", "context")),
)


def field_paths(value, at: str = "") -> set[str]:
    """The paths of the leaves of a JSON value; a list adds [], whatever it holds."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


class Layouts:
    """Layouts by the fingerprints of the records that they fit."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.named = {p for layout in layouts for p in (*layout.needs, *layout.may)}
        self.by_print: dict[int, Layout] = {}
        for layout in layouts:
            for n in range(len(layout.may) + 1):
                for some in itertools.combinations(layout.may, n):
                    if self.by_print.setdefault(self._hash({*layout.needs, *some}), layout) is not layout:
                        raise ValueError(f"two layouts fit records with {sorted({*layout.needs, *some})}")

    @staticmethod
    def _hash(paths: set[str]) -> int:
        return xxhash.xxh3_64_intdigest("\n".join(sorted(paths)).encode())

    def fingerprint(self, record) -> int:
        return self._hash(field_paths(record) & self.named)

    def turns(self, raw: str | None) -> tuple[int | None, str | None, list[tuple[str, str]]]:
        """Fingerprint, layout's name and (role, text) of each turn of a record; no name if none fits."""
        try:
            record = json.loads(raw) if raw is not None else None
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return None, None, []
        mark = self.fingerprint(record)
        layout = self.by_print.get(mark)
        return (mark, layout.name, [t for part in layout.turns for t in _said(record, part)]) if layout else (mark, None, [])


def _text(value) -> str:
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):  # a message in parts
        return "".join(_text(v.get("text")) if isinstance(v, dict) else _text(v) for v in value)
    return json.dumps(value, ensure_ascii=False)


def _said(record: dict, part: Say | Each | Pairs) -> list[tuple[str, str]]:
    if isinstance(part, Say):
        found = [_text(record[p]) for p in part.paths if p in record]
        return [(part.role, "\n\n".join(x for x in found if x))] if found and (part.role != "system" or any(found)) else []
    if isinstance(part, Pairs):
        return [turn for pair in record.get(part.items) or [] for turn in zip(("user", "assistant"), map(_text, pair), strict=False)]
    names = dict(part.names)
    objects = [x for x in record[part.items] if isinstance(x, dict)] if part.items else [record]
    return [(names.get(role := _text(x.get(part.role)), role), _text(x.get(part.text))) for x in objects]


_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A text without `<|`: one more backslash in each `<`, backslashes, `|`."""
    return _MARK.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the start and end of its text."""
    head, body = f"{START}{_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn."""
    at = 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        end = formatted.find(END, line + 1)
        if not formatted.startswith(START, at) or line < 0 or end < 0 or not formatted.startswith("\n", end + len(END)):
            raise ValueError(f"no turn begins at character {at}")
        yield _read_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def turn_records(table: DataFrame) -> DataFrame:
    """conv_id, turn, record: rows by turn (conv_id, turn, role, text) as records of the layout `turn`."""
    return table.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, layout, fingerprint, seq, role, text for rows (conv_id, turn, record); a record that no layout fits is one row without layout, role and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Layouts(layouts)
        for batch in batches:
            out = []
            for conv_id, turn, record in zip(batch["conv_id"], batch["turn"], batch["record"], strict=True):
                mark, name, turns = known.turns(record)
                mark = None if mark is None else f"{mark:016x}"
                out += [(conv_id, turn, name, mark, i, role, text) for i, (role, text) in enumerate(turns)] if name else [(conv_id, turn, None, mark, 0, None, None)]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "layout", "fingerprint", "seq", "role", "text"])

    # ids pass as text: pandas would turn long ids beside a null into inexact numbers
    sent = records.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "record")
    made = map_pandas(sent, run, "conv_id string, turn string, layout string, fingerprint string, seq int, role string, text string")
    return made.withColumns({c: F.col(c).cast(records.schema[c].dataType) for c in ("conv_id", "turn")})


def format_turns(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, last, formatted, loss (start and end of each assistant text in `formatted`) from rows (conv_id, turn, layout, seq, role, text)."""
    kind = turns.schema["conv_id"].dataType
    order = ["conv_id", F.col("turn").asc_nulls_last(), "seq", "role", "text"]
    dealt = turns.where("layout is not null").repartition("conv_id").sortWithinPartitions(*order).select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, pieces, loss, size = None, 0, [], [], 0
        for batch in batches:
            out = []
            for conv_id, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                if pieces and (conv_id != now or size >= part):
                    out.append((now, number, conv_id != now, "".join(pieces), loss))
                    number, pieces, loss, size = number + 1, [], [], 0
                if conv_id != now:
                    now, number = conv_id, 0
                piece, start, end = rendered(role, text)
                if role == "assistant":
                    loss.append({"start": size + start, "end": size + end})
                pieces.append(piece)
                size += len(piece)
            yield pd.DataFrame(out, columns=["conv_id", "part", "last", "formatted", "loss"])
        if pieces:
            yield pd.DataFrame([(now, number, True, "".join(pieces), loss)], columns=["conv_id", "part", "last", "formatted", "loss"])

    made = map_pandas(dealt, run, "conv_id string, part int, last boolean, formatted string, loss array<struct<start: int, end: int>>")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the rows of format_turns alone."""
    kind = formatted.schema["conv_id"].dataType

    class Sums:
        def __init__(self, conv_id):
            self.conv_id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
            self.turns, self.under = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, loss) -> None:
            self.chars += len(text)
            for role, said in parsed(text):
                self.n += 1
                self.turns.update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                self.loss += len(said)
                self.under.update(said.encode())

        def row(self) -> tuple:
            return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.under.hexdigest(), self.chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, columns = None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for conv_id, number, text, loss in zip(batch["conv_id"], batch["part"], batch["formatted"], batch["loss"], strict=True):
                if number == 0:
                    out += [sums.row()] if sums else []
                    sums = Sums(conv_id)
                sums.add(text, loss)
            yield pd.DataFrame(out, columns=columns)
        if sums:
            yield pd.DataFrame([sums.row()], columns=columns)

    rows = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    whole = (F.col("part") == 0) & F.col("last")
    several = rows.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    made = map_pandas(rows.where(whole), run, schema).unionByName(map_pandas(several, run, schema))
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def message_records(table: DataFrame, more: list[tuple[int, list[tuple[str, str]]]]) -> DataFrame:
    """conv_id, turn, record for a few given conversations, as records of the layout `messages`. table gives the types."""
    spark = table.sparkSession
    rows = [(str(conv_id), json.dumps({"messages": [{"role": role, "content": text} for role, text in turns]}, ensure_ascii=False)) for conv_id, turns in more]
    made = spark.createDataFrame(rows, "conv_id string, record string")
    return made.select(F.col("conv_id").cast(table.schema["conv_id"].dataType).alias("conv_id"), F.lit(0).cast(table.schema["turn"].dataType).alias("turn"), "record")


def format_table(table: DataFrame, more: list[tuple[int, list[tuple[str, str]]]] = ()) -> DataFrame:
    """The digests of read_back for a table of rows by turn, and for more conversations (id, turns): formatted, written in the shared folder, and read again."""
    records = turn_records(table)
    if more:
        records = records.unionByName(message_records(table, more))
    return read_back(materialize(format_turns(canonical_turns(records))))
