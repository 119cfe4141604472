"""WARC files from legacy ARC records.

`parse_arc` reads an ARC stream: a version block (filedesc://) that declares version 1 or 2 and its fields,
then records, each a header line with the fields of that version and as many bytes as it declares, then a
line feed. `warc_record` synthesises the equivalent WARC record: an identifier (UUID version 8) made of the
record's key and digest, the ARC time as WARC-Date, `response` for HTTP answers and `resource` otherwise, block and
payload digests, or a `revisit` that names the record whose payload it repeats.

Files: Spark's text writer puts one record on each row, and the two blank lines that end a record are
the writer's line separator, so no task writes outside Spark's commit protocol and lost tasks leave nothing.
Reading back goes by declared lengths alone. Files are cut at `file_records` records.

Of rows with equal payloads of 1000 bytes or more, that with the largest id is the response (all rows, if the
id repeats) and the others are revisits. Null html is an empty payload. Rows with a null id are responses;
their identifiers say so. Empty tables give no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, materialize, shared_dir

#: The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
LEAST = 1000


class FormatError(ValueError):
    """A stream that isn't what its headers declare."""


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC stream, each with its header fields and `body`; the version block is not one of them."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the line feed between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise FormatError(f"header line at {at} doesn't end")
        parts = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        fields = ARC_FIELDS[version or 1]
        if parts[0].startswith("filedesc://") and version is None:
            length = int(parts[-1])
            body = data[end + 1 : end + 1 + length]
            version = int(body[:1])
            if version not in ARC_FIELDS:
                raise FormatError(f"version {version}")
        else:
            if len(parts) < len(fields):
                raise FormatError(f"{len(parts)} fields at {at}, version {version or 1} has {len(fields)}")
            # a URL may hold spaces, the other fields don't
            cut = len(parts) - len(fields) + 1
            record = dict(zip(fields, [" ".join(parts[:cut]), *parts[cut:]], strict=True))
            length = int(record["length"])
            body = data[end + 1 : end + 1 + length]
            yield record | {"version": version or 1, "body": body}
        if length < 0 or end + 1 + length > len(data):
            raise FormatError(f"record at {at} declares {length} bytes")
        at = end + 1 + length


def payload_of(body: bytes) -> bytes:
    """What follows the header of an HTTP answer, or all of anything else."""
    if not body.startswith(b"HTTP/"):
        return body
    head, found, rest = body.partition(b"\r\n\r\n")
    return rest if found else b""


def record_uuid(key: int | None, digest: bytes) -> uuid.UUID:
    """A version 8 UUID: the key's 64 bits, a mark of null keys and 57 bits of the digest."""
    bits = ((key or 0) & (1 << 64) - 1) << 58 | (key is None) << 57 | int.from_bytes(digest[:8], "big") >> 7
    high, mid, low = bits >> 74, bits >> 62 & 0xFFF, bits & (1 << 62) - 1
    return uuid.UUID(int=high << 80 | 8 << 76 | mid << 64 | 2 << 62 | low)


def key_of(value: str) -> int | None:
    """The key in an identifier <urn:uuid:...>."""
    n = uuid.UUID(value.strip("<>").removeprefix("urn:uuid:")).int
    bits = n >> 80 << 74 | (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    key = bits >> 58
    return None if bits >> 57 & 1 else key - (1 << 64) if key >> 63 else key


def warc_record(record: dict, key: int | None, repeats: int | None) -> bytes:
    """The WARC equivalent of an ARC record, without the blank lines that end it. repeats: key of the equal payload."""
    body = record["body"]
    payload = payload_of(body)
    digest = hashlib.sha1(payload).digest()
    http = body.startswith(b"HTTP/")
    kind = "revisit" if repeats is not None else "response" if http else "resource"
    block = body[: len(body) - len(payload)] if kind == "revisit" else body
    when = datetime.strptime(record["date"][:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {record['url']}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Record-ID: <urn:uuid:{record_uuid(key, digest)}>"]
    if record["ip"] not in ("", "-", "0.0.0.0"):
        lines.append(f"WARC-IP-Address: {record['ip']}")
    name = lambda d: "sha1:" + base64.b32encode(d).decode()
    lines += [f"WARC-Payload-Digest: {name(digest)}", f"WARC-Block-Digest: {name(hashlib.sha1(block).digest())}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_uuid(repeats, digest)}>"]
    lines += [f"Content-Type: {'application/http;msgtype=response' if http else record['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC stream; digests are checked."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise FormatError(f"no record at {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        at = end + 4 + int(headers["content-length"])
        block = data[end + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise FormatError(f"record {headers.get('warc-record-id')} doesn't end where it declares")
        if base64.b32decode(headers["warc-block-digest"].removeprefix("sha1:")) != hashlib.sha1(block).digest():
            raise FormatError(f"record {headers.get('warc-record-id')} has another block digest")
        yield headers, block
        at += 4


def arc_stream(pages: DataFrame) -> DataFrame:
    """key, digest (of the payload), arc (one ARC stream per page, with its version block): even ids in version 1, others in version 2."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"), html)
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    when = F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")

    def stream(version: int, between: list[Column]) -> Column:
        note = f"{version} 0 driver\nURL IP-address Archive-date Content-type {'Result-code Checksum Location Offset Filename ' if version == 2 else ''}Archive-length\n"
        head = f"filedesc://pages.arc 0.0.0.0 20010909014640 text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(note)}\n{note}\n"
        line = F.concat_ws(" ", url, F.lit("0.0.0.0"), when, F.lit("text/html"), *between, F.octet_length(body).cast("string"))
        return F.concat(F.lit(head), line, F.lit("\n"), body, F.lit("\n"))

    old = F.coalesce(F.col("page_id") % 2 == 0, F.lit(True))
    return pages.select(F.col("page_id").alias("key"), F.sha1(html.cast("binary")).alias("digest"), F.when(old, stream(1, [])).otherwise(stream(2, [F.lit(x) for x in ("200", "-", "-", "0", "pages.arc")])).alias("arc"))


def repeated(payloads: DataFrame, least: int = LEAST) -> DataFrame:
    """key, digest, repeats from rows (key, bytes, digest): the largest key of the same payload, for keys below it."""
    long = payloads.where(F.col("bytes") >= least).where("key is not null").select("key", "digest")
    top = long.groupBy("digest").agg(F.max("key").alias("repeats"), F.min("key").alias("low")).where("low < repeats").select("digest", "repeats")
    return long.join(top, "digest").where("key < repeats").groupBy("key", "digest").agg(F.max("repeats").alias("repeats"))


def convert(streams: DataFrame) -> DataFrame:
    """One row `value` per WARC record from rows (key, arc, repeats); records after a stream's first have no key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, arc, repeats in zip(batch["key"], batch["arc"], batch["repeats"], strict=True):
                for n, record in enumerate(parse_arc(arc.encode())):
                    own = int(key) if key is not None and not n else None
                    out.append(warc_record(record, own, int(repeats) if repeats is not None and not n else None).decode())
            yield pd.DataFrame({"value": out})

    sent = streams.select(F.col("key").cast("string").alias("key"), "arc", F.col("repeats").cast("string").alias("repeats"))
    return map_pandas(sent, run, "value string")


def write_warc(records: DataFrame, path: str, file_records: int = 2000) -> None:
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each record of the WARC files in path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for headers, block in read_warc(zlib.decompress(content, 31)):
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                    if headers["warc-type"] != "revisit" and hashlib.sha1(payload_of(block)).digest() != digest:
                        raise FormatError(f"record {headers['warc-record-id']} has another payload digest")
                    key, refers = key_of(headers["warc-record-id"]), headers.get("warc-refers-to")
                    out.append((None if key is None else str(key), int(headers["x-payload-length"]), digest.hex(), headers["warc-type"], refers and str(key_of(refers))))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    read = map_pandas(files, run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as WARC files in the shared folder by way of ARC records, and read the files back."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    payloads = materialize(pages.select(F.col("page_id").alias("key"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html).alias("digest")))
    repeats = repeated(payloads)
    both = arc_stream(pages).join(repeats, ["key", "digest"], "left")
    path = shared_dir(spark) + "/warc"
    write_warc(convert(both), path)
    return read_archives(spark, path)
