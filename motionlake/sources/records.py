"""TFRecord files of scenario messages, as DataFrames.

Records come from the data source of `tfrecords`, which splits large files, checks both checksums and names what can't be read.
A payload is a scenario message, or a wrapper whose byte values are tried in turn; the first candidate
that reads as a valid scenario counts, and others give a NULL record. Only the fields in use are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .tfrecords import SPLIT_BYTES, read_records

SCENARIO = "scenario_id string, sdc_track_index int, tracks array<struct<states array<struct<valid boolean, center_x double, center_y double, velocity_x double, velocity_y double>>>>"
SCHEMA = f"path string, position long, fault string, {SCENARIO}"
#: Field numbers of the public scenario and track messages.
SCENARIO_ID, SDC_INDEX, TRACKS, STATES = 5, 6, 2, 3
#: Features, feature entry, entry value, byte list and value of the public wrapper message.
WRAPPER_PATH = (1, 1, 2, 1, 1)
STATE_FIELDS = {2: "center_x", 3: "center_y", 9: "velocity_x", 10: "velocity_y", 11: "valid"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                raise ValueError("field beyond the message")
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def scenario(data: bytes) -> dict | None:
    """A valid scenario, or None."""
    out: dict = {"scenario_id": None, "sdc_track_index": 0, "tracks": []}
    try:
        for number, value in fields(data):
            if number == SCENARIO_ID:
                out["scenario_id"] = value.decode()
            elif number == SDC_INDEX:
                out["sdc_track_index"] = value
            elif number == TRACKS:
                states = []
                for n, v in fields(value):
                    if n == STATES:
                        state = dict.fromkeys(STATE_FIELDS.values(), 0.0) | {STATE_FIELDS[k]: x for k, x in fields(v) if k in STATE_FIELDS}
                        states.append(state | {"valid": bool(state["valid"])})
                out["tracks"].append({"states": states})
    except (ValueError, IndexError, struct.error, AttributeError, UnicodeDecodeError, TypeError):
        return None
    return out if out["tracks"] and 0 <= out["sdc_track_index"] < len(out["tracks"]) else None


def _byte_values(data: bytes) -> Iterator[bytes]:
    """Byte values of a wrapper example, in order."""
    level = [data]
    for number in WRAPPER_PATH:
        inside = []
        for message in level:
            try:
                inside += [v for n, v in fields(message) if n == number and isinstance(v, bytes)]
            except (ValueError, IndexError, struct.error):
                continue
        level = inside
    yield from level


def decode(payload: bytes) -> dict | None:
    found = scenario(payload)
    if found is None:
        found = next((s for s in map(scenario, _byte_values(payload)) if s is not None), None)
    return found


def read_scenarios(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, faults: str = "rows") -> DataFrame:
    """path, position (first byte), fault, and the scenario's columns: one row per record. Scenario columns are NULL where nothing
    decodes, and where a fault says why the record couldn't be read."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = {"scenario_id": None, "sdc_track_index": None, "tracks": None}
        for batch in batches:
            rows = [{"path": name, "position": at, "fault": fault, **((payload is not None and decode(bytes(payload))) or none)} for name, at, payload, fault in batch.itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows)

    return read_records(spark, path, split_bytes, faults).mapInPandas(run, SCHEMA)


def faults(records: DataFrame) -> DataFrame:
    """path, fault, n, first, last: what could not be read in each file, with the first and last byte positions."""
    return records.where("fault is not null").groupBy("path", "fault").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))
