"""TFRecord files as a Spark data source: any number of tasks read one file, and what can't be read is reported.

A record is its length (8 bytes), a checksum of the length, the payload and a checksum of the payload. A partition is a range of
bytes; it holds the records that start in it. Nothing is indexed beforehand: a task finds the first record of its range by the
checksum of a length, tried at every byte at once, and by what follows it (the next length's checksum, the file's end, or the payload's own
checksum), so the odds of a false start are about 2^-64 a byte. A payload that holds framed records itself could be taken for some: read such files
with splitBytes = 0, one partition a file.

Each record gives (path, position, payload, fault); position is its first byte. Faults have no payload:
`length checksum` (reading goes on at the next record that can be found), `payload checksum` (the next record follows), and `cut tail`. A fault on
the edge of two ranges is reported once, by the range that reads up to it. With faults = "fail" the first one ends the job and names file and byte.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

SCHEMA = "path string, position long, payload binary, fault string"
SPLIT_BYTES, CHUNK, BATCH_BYTES = 64 << 20, 1 << 20, 16 << 20
#: The reflected Castagnoli polynomial, and the mask's rotation and sum.
POLYNOMIAL, ROTATED, ADDED = 0x82F63B78, 15, 0xA282EAD8
#: File systems that Python workers open themselves; files of others go through Spark's own reader, one task a file.
OPEN_SCHEMES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _tables() -> np.ndarray:
    """Row k: the checksum of each byte followed by k zero bytes, without the inversions."""
    out = np.zeros((8, 256), np.uint32)
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), rows >> np.uint32(1))
    out[0] = rows
    for k in range(1, 8):
        out[k] = (out[k - 1] >> np.uint32(8)) ^ out[0][out[k - 1] & 255]
    return out


TABLES = _tables()


def _after_zeros(n: int) -> np.ndarray:
    """What n zero bytes make of each byte of a checksum: (4, 256)."""
    step = lambda t, x: t[0][x & 255] ^ t[1][x >> np.uint32(8) & 255] ^ t[2][x >> np.uint32(16) & 255] ^ t[3][x >> np.uint32(24)]
    one = np.stack([(v >> np.uint32(8)) ^ TABLES[0][v & 255] for v in (np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4))])
    out = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    while n:
        if n & 1:
            out = step(one, out)
        one, n = step(one, one), n >> 1
    return out


_zeros: dict[int, np.ndarray] = {}


def crc32c(data: bytes | memoryview) -> int:
    """The Castagnoli checksum: of a long payload in lanes of equal length side by side, which are then joined in pairs."""
    data = np.frombuffer(data, np.uint8)
    n, state = len(data), np.array([0xFFFFFFFF], np.uint32)
    lanes = 1 << max(0, (n // 256).bit_length() - 1)
    if lanes > 1:
        size = n // lanes
        block, data = data[: lanes * size].reshape(lanes, size), data[lanes * size :]
        state = np.zeros(lanes, np.uint32)
        state[0] = 0xFFFFFFFF
        for column in np.ascontiguousarray(block.T):
            state = (state >> np.uint32(8)) ^ TABLES[0][(state ^ column) & 255]
        while len(state) > 1:  # the left of each pair is followed by as many bytes as the right one has
            if size not in _zeros:
                _zeros[size] = _after_zeros(size)
            t, left = _zeros[size], state[::2]
            state = t[0][left & 255] ^ t[1][left >> np.uint32(8) & 255] ^ t[2][left >> np.uint32(16) & 255] ^ t[3][left >> np.uint32(24)] ^ state[1::2]
            size *= 2
    value, table = int(state[0]), TABLES[0].tolist() if len(data) else ()
    for byte in data.tolist():
        value = value >> 8 ^ table[(value ^ byte) & 255]
    return value ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> ROTATED | crc << (32 - ROTATED)) + ADDED) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    """A payload as a record."""
    size = len(payload).to_bytes(8, "little")
    return size + masked(crc32c(size)).to_bytes(4, "little") + payload + masked(crc32c(payload)).to_bytes(4, "little")


def starts(data: bytes) -> np.ndarray:
    """Places at which 8 bytes are followed by their own masked checksum, all tried at once."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - 11
    if n <= 0:
        return np.zeros(0, np.int64)
    crc = np.zeros(n, np.uint32)
    for i in range(8):
        crc ^= TABLES[7 - i][b[i : n + i] ^ np.uint8(255 if i < 4 else 0)]
    crc = ~crc
    crc = (crc >> np.uint32(ROTATED) | crc << np.uint32(32 - ROTATED)) + np.uint32(ADDED)
    said = sum(b[8 + i : n + 8 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    return np.flatnonzero(crc == said)


class Frames:
    """The records of one file. read(at, n) gives up to n bytes; size is the file's."""

    def __init__(self, read, size: int):
        self._read, self.size, self._at, self._held = read, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """n bytes at a place, read ahead in chunks."""
        if not self._at <= at or at + n > self._at + len(self._held):
            self._at, self._held = at, self._read(at, min(max(n, CHUNK), self.size - at))
        return self._held[at - self._at : at - self._at + n]

    def header(self, at: int) -> int | None:
        """The length of the record at a place, if its checksum holds."""
        if at + 12 > self.size:
            return None
        b = self.bytes(at, 12)
        return int.from_bytes(b[:8], "little") if masked(crc32c(b[:8])) == int.from_bytes(b[8:], "little") else None

    def payload(self, at: int, n: int) -> bytes | None:
        """The payload of the record at a place, if its checksum holds."""
        b = self.bytes(at + 12, n + 4)
        return b[:n] if masked(crc32c(memoryview(b)[:n])) == int.from_bytes(b[n:], "little") else None

    def found(self, at: int) -> bool:
        """Whether a record stands here for sure: a good length, and after it a good length, the file's end or a good payload."""
        n = self.header(at)
        if n is None or (end := at + 16 + n) > self.size:
            return False
        return end == self.size or self.header(end) is not None or self.payload(at, n) is not None

    def first(self, at: int) -> int | None:
        """The first place from here on where a record stands for sure."""
        while at + 12 <= self.size:
            data = self._read(at, min(CHUNK + 11, self.size - at))
            for i in starts(data).tolist():
                if self.found(at + i):
                    return at + i
            at += CHUNK
        return None

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes | None, str | None]]:
        """position, payload, fault of the records that start in the range."""
        at = self.first(start) if start else 0
        while at is not None and at < self.size:
            if at >= end and self.found(at):
                return  # the next range finds it too
            n = self.header(at)
            if n is None and at + 12 <= self.size:
                yield at, None, "length checksum"
                at = self.first(at + 1)
            elif n is None or at + 16 + n > self.size:
                yield at, None, "cut tail"
                return
            else:
                payload = self.payload(at, n)
                yield at, payload, None if payload is not None else "payload checksum"
                at += 16 + n


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class TFRecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.split, self.fail = int(options.get("splitBytes", SPLIT_BYTES)), options.get("faults", "rows") == "fail"
        if "files" in options:
            self.files = json.loads(options["files"])
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(options["path"])
            info = system.get_file_info(path)
            found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
            head = options["path"].split("://")[0] + "://" if "://" in options["path"] else ""
            self.files = sorted([f"{head}{f.path}", f.size] for f in found if f.is_file and f.base_name[0] not in "._")

    def partitions(self) -> list[InputPartition]:
        return [Range(path, size, at, min(at + (self.split or size), size)) for path, size in self.files for at in range(0, size, self.split or max(size, 1))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as f:
            yield from batches(partition.path, Frames(lambda at, n: f.read_at(n, at), partition.size).records(partition.start, partition.end), self.fail)


def batches(path: str, records: Iterator[tuple[int, bytes | None, str | None]], fail: bool) -> Iterator[pa.RecordBatch]:
    """Records in Arrow batches of bounded bytes."""
    names, kinds = ["path", "position", "payload", "fault"], [pa.string(), pa.int64(), pa.binary(), pa.string()]
    rows, room = [], BATCH_BYTES
    for position, payload, fault in records:
        if fault and fail:
            raise ValueError(f"{path}: {fault} of the record at byte {position}")
        rows.append((path, position, payload, fault))
        room -= len(payload or b"") + 64
        if room < 0:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows, room = [], BATCH_BYTES
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class TFRecordSource(DataSource):
    """spark.read.format("tfrecord").option("splitBytes", ...).option("faults", "rows" or "fail").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TFRecordReader(self.options)


def files_of(spark: SparkSession, path: str) -> list[list]:
    """[uri, size] of the files that a path or glob names, in any file system that Spark reads."""
    jvm = spark._jvm.org.apache.hadoop.fs
    pattern = jvm.Path(path)
    system = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    for status in system.globStatus(pattern) or []:
        found += system.listStatus(status.getPath()) if status.isDirectory() else [status]
    uri = lambda f: str(f.getPath().toUri()).replace("file:/", "file:///", 1) if str(f.getPath().toUri()).startswith("file:/") else str(f.getPath().toUri())
    out = sorted([uri(f), f.getLen()] for f in found if f.isFile() and f.getPath().getName()[0] not in "._")
    if not out:
        raise FileNotFoundError(path)
    return out


def read_records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, faults: str = "rows") -> DataFrame:
    """path, position, payload, fault of every record of the files that a path or glob names. Empty files have none."""
    ship_package(spark)
    files = files_of(spark, path)
    if all(f.split("://")[0] in OPEN_SCHEMES for f, _ in files):
        spark.dataSource.register(TFRecordSource)
        return spark.read.format("tfrecord").option("files", json.dumps(files)).option("splitBytes", str(split_bytes)).option("faults", faults).load()

    def whole(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data = memoryview(content.as_buffer())
                yield from batches(name, Frames(lambda at, n, data=data: bytes(data[at : at + n]), len(data)).records(0, len(data)), faults == "fail")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, SCHEMA)
