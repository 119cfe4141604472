"""The TFRecord source against plain code: checksums, splits, faults, and the way from a file to style features."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from motionlake.operators import features, lead, windows
from motionlake.sources import records, tables, tfrecords


def plain_crc(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (tfrecords.POLYNOMIAL if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def test_checksums():
    assert tfrecords.crc32c(b"123456789") == 0xE3069283
    assert tfrecords.crc32c(b"") == 0 and tfrecords.crc32c(bytes(32)) == 0x8A9136AA
    rng = random.Random(1)
    for n in (1, 7, 8, 255, 256, 511, 512, 513, 1024, 5000, 16_384, 20_001):
        data = rng.randbytes(n)
        assert tfrecords.crc32c(data) == plain_crc(data)


def test_starts_are_found_at_any_byte():
    rng = random.Random(2)
    junk, record = rng.randbytes(1000), tfrecords.framed(b"payload")
    assert tfrecords.starts(junk + record + junk).tolist() == [1000]
    assert tfrecords.starts(bytes(500)).tolist() == [] and tfrecords.starts(b"short").tolist() == []


def ranges(data, split):
    """Rows of all ranges of a file, in order."""
    out = []
    for at in range(0, len(data), split or len(data)):
        frames = tfrecords.Frames(lambda p, n: data[p : p + n], len(data))
        out += list(frames.records(at, min(at + (split or len(data)), len(data))))
    return out


def test_ranges_give_what_one_pass_gives(monkeypatch):
    """Whatever is damaged, ranges of any size give the same rows once."""
    monkeypatch.setattr(tfrecords, "CHUNK", 64)
    rng = random.Random(3)
    for turn in range(150):
        payloads = [rng.randbytes(rng.choice([0, 1, 5, 40, 200])) for _ in range(rng.randrange(1, 12))]
        data = bytearray(b"".join(map(tfrecords.framed, payloads)))
        for _ in range(turn % 4):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        data = bytes(data[: len(data) - (rng.randrange(20) if turn % 3 == 0 else 0)])
        whole = ranges(data, 0)
        if not turn % 4 and turn % 3:
            assert [p for _, p, _ in whole] == payloads
        assert {p for _, p, f in whole if not f} <= set(payloads)
        assert sum(f is None for _, _, f in whole) >= len(payloads) - 2 * (turn % 4) - 1
        for split in (1, 13, 50, 117, 1000):
            assert ranges(data, split) == whole, (turn, split)


def test_faults_are_named(spark, tmp_path):
    payloads = [bytes([i]) * (i * 50) for i in range(40)]
    parts = [bytearray(tfrecords.framed(p)) for p in payloads]
    at = [sum(map(len, parts[:i])) for i in range(41)]
    parts[7][3] ^= 1  # a length
    parts[20][100] ^= 1  # a payload
    data = b"".join(parts)
    (tmp_path / "a.tfrecord").write_bytes(data[:-5])
    (tmp_path / "b.tfrecord").write_bytes(b"")
    (tmp_path / "c.tfrecord").write_bytes(b"".join(map(tfrecords.framed, payloads)))
    for split in (0, 700, 5000):
        rows = tfrecords.read_records(spark, f"{tmp_path}/*.tfrecord", split)
        assert split != 700 or rows.rdd.getNumPartitions() > 40
        got = {(r["path"].rsplit("/", 1)[-1], r["position"]): (r["payload"], r["fault"]) for r in rows.collect()}
        want = {("c.tfrecord", at[i]): (bytearray(p), None) for i, p in enumerate(payloads)} | {("a.tfrecord", at[i]): (bytearray(p), None) for i, p in enumerate(payloads)}
        want |= {("a.tfrecord", at[7]): (None, "length checksum"), ("a.tfrecord", at[20]): (None, "payload checksum"), ("a.tfrecord", at[39]): (None, "cut tail")}
        assert got == want and rows.count() == len(want)
        found = records.faults(rows).collect()
        assert sorted((r["fault"], r["n"], r["first"], r["last"]) for r in found) == [("cut tail", 1, at[39], at[39]), ("length checksum", 1, at[7], at[7]), ("payload checksum", 1, at[20], at[20])]
    with pytest.raises(Exception, match=f"a.tfrecord: .* checksum of the record at byte {at[7]}"):
        tfrecords.read_records(spark, f"{tmp_path}/a.tfrecord", 0, "fail").count()
    spark.dataSource.register(tfrecords.TFRecordSource)
    assert spark.read.format("tfrecord").load(str(tmp_path / "c.tfrecord")).count() == 40
    with pytest.raises(FileNotFoundError):
        tfrecords.read_records(spark, f"{tmp_path}/none*")


def field(n, kind, payload):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    return varint(n << 3 | kind) + (varint(payload) if kind == 0 else varint(len(payload)) + payload if kind == 2 else payload)


def state_message(x, y, vx, vy, valid=1):
    return b"".join(field(n, 1, struct.pack("<d", v)) for n, v in ((2, x), (3, y))) + b"".join(field(n, 5, struct.pack("<f", v)) for n, v in ((9, vx), (10, vy))) + field(11, 0, valid)


def scenario_message(name, tracks):
    return field(5, 2, name.encode()) + field(6, 0, 0) + b"".join(field(2, 2, b"".join(field(3, 2, state_message(*s)) for s in states)) for states in tracks)


def test_a_record_file_becomes_style_features(spark, tmp_path):
    """Scenarios have names, not numbers: the windows' keys are structs, and features equal those of numbered scenarios."""
    rng = random.Random(4)
    names, messages = ["7e1b-x", "scene/9", "ümlaut"], []
    for _ in names:
        ego, front, x, fx = [], [], 0.0, 30.0
        for t in range(60):
            v, fv = 8 + 2 * rng.random(), 9 + 2 * rng.random()
            x, fx = x + v * 0.1, fx + fv * 0.1
            ego.append((x, 0.1 * rng.random(), v, 0.1))
            front.append((fx, 0.1, fv, 0.0, int(t != 30)))
        messages.append((ego, front))
    data = b"".join(tfrecords.framed(scenario_message(n, m)) for n, m in zip(names, messages, strict=True))
    (tmp_path / "scenes.tfrecord").write_bytes(data + b"tail")

    def made(found):
        tracks = tables.nested_to_tracks(found)
        cut = windows.sliding(lead.aligned_frames(tracks, lead.lead_tracks(tracks)), 20, 5).cache()
        return windows.window_rows(cut), features.style_features(windows.kinematics(cut).cache(), 15)

    found = records.read_scenarios(spark, str(tmp_path), 1000)
    assert [r["fault"] for r in found.where("fault is not null").collect()] == ["cut tail"]
    rows, style = made(found)
    by_number = found.withColumn("scenario_id", F.array_position(F.array(*map(F.lit, names)), F.col("scenario_id")))
    _, numbered = made(by_number)
    got = {(names.index(r["wid"]["scenario_id"]) + 1, r["wid"]["start"]): tuple(r)[1:] for r in style.collect()}
    want = {(r["wid"] // 1_000_000, r["wid"] % 1_000_000): tuple(r)[1:] for r in numbered.collect()}
    assert len(got) == 3 * 8 and got == want
    assert any(r is not None for values in got.values() for r in values[-9:])
    keys = rows.select(windows.scenario_of(F.col("wid"), packed=False).alias("s"), "scenario_id", "start", "window_len").collect()
    assert len(keys) == 24 and all(r["s"] == r["scenario_id"] and r["window_len"] == 20 for r in keys)
