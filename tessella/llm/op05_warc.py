"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader takes one chunk of compressed bytes at a time, decompresses incrementally, starts a new member where one
ends, frames each record by its Content-Length, and verifies block and payload digests. It never holds more than one
record. Payloads that occur more than once are stored once: the row with the smallest id is a response, the others
are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, drop, id_in, id_out, maybe_broadcast, shared_path, stage, tuned
from .files import new_file, open_stream

CHUNK = 1 << 16
LEVEL = 5
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError(f"a header without a colon: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def encode_record(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header alone."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    name = lambda x: f"<{URN}{'none' if x is None else x}>"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page)), ("WARC-Date", DATE), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return encode_record(headers, http if revisit else http + payload)


def _members(stream, chunk: int) -> Iterator[bytes]:
    """The decompressed bytes of each gzip member."""
    held = b""
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not held and not (held := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(bytes(held)))
            held = unpack.unused_data
        yield b"".join(parts)


def read_records(stream, chunk: int = CHUNK) -> Iterator[Record]:
    """Records of an archive in order. Raises ValueError at a cut, a wrong length or a wrong digest."""
    for data in _members(stream, chunk):
        head, mark, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if not mark or not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        headers = _fields(lines)
        size = int(headers.get("content-length", -1))
        if size < 0 or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} isn't as long as it says")
        record = Record(headers, rest[:size])
        if (said := headers.get("warc-block-digest", "").removeprefix("sha1:")) and said != base32_sha1(record.block):
            raise ValueError(f"wrong block digest in {headers.get('warc-record-id')}")
        if headers.get("content-type", "").startswith("application/http"):
            http, _, record.payload = record.block.partition(b"\r\n\r\n")
            record.http = _fields(http.split(b"\r\n")[1:])
            if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest", "").removeprefix("sha1:")) and said != base32_sha1(record.payload):
                raise ValueError(f"wrong payload digest in {headers.get('warc-record-id')}")
        yield record


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(URN)
    return int(value) if value not in ("", "none") else None


def write_archives(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes one archive for each partition of df, and returns the manifest: archive, records.

    A null payload is empty. Of equal payloads of at least `least` bytes, the rows with the smallest id are responses
    and the others revisits of it; null ids come first. Rows that repeat an id are records each; where they repeat the
    smallest id and its payload, all of them are responses. A null url is about:blank. No rows make no archive.

    Who comes first is settled on digests alone; a payload then meets its verdict by its own id and digest, so that no
    task gets all payloads of one digest (the empty page's).
    """
    spark = tuned(df.sparkSession)
    folder = folder or shared_path(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(id_in(key).alias("page"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    names = rows.filter(F.octet_length("payload") >= least).select("page", "sha")
    same, same_path = stage(names.groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first"), "warc-same")
    again, _ = stage(names.join(maybe_broadcast(same, 64), "sha").filter("page <> first").distinct(), "warc-again")
    drop(spark, same_path)
    rows = rows.join(maybe_broadcast(again, 72), ["page", "sha"], "left")

    def write(batches):
        n, number = 0, TaskContext.get().partitionId()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        with new_file(folder, f"part{number:06d}.warc.gz") as (out, path):
            while batch is not None:
                for page, at, data, sha, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "sha", "first")), strict=True):
                    again = first is not None
                    real = lambda x: None if x == NULL_ID else x
                    out.write(page_record(real(page), at, data, base64.b32encode(sha).decode(), real(first), again))
                    n += 1
                batch = next(batches, None)
        yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["archive", "records"])

    manifest, _ = stage(rows.select("page", "url", "payload", "sha", "first").mapInArrow(write, "archive string, records long"), "warc-manifest")
    return manifest


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all archives that a manifest names: page_id, url, record_type, refers_to, payload_digest,
    payload_bytes, and with payloads the payload (null for a revisit). An archive is one task's work. A page without an
    id has null; repeated ids come as often as they were written; no archives give no rows."""
    count = max(1, manifest.count())
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads

    def read(batches):
        for b in batches:
            for path, said in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
                n, rows, held = 0, [], 0
                with open_stream(path) as stream:
                    for r in read_records(stream):
                        kind = r.headers["warc-type"]
                        row = [_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), kind, _page(r.headers.get("warc-refers-to")), r.headers["warc-payload-digest"].removeprefix("sha1:"), int(r.http["content-length"])]
                        rows.append([*row, None if kind == "revisit" else r.payload] if payloads else row)
                        n, held = n + 1, held + len(r.payload) * payloads + 100
                        if held > 4 << 20:
                            yield _batch(rows, payloads)
                            rows, held = [], 0
                if n != said:
                    raise ValueError(f"{path} has {n} records, not {said}")
                if rows:
                    yield _batch(rows, payloads)

    return manifest.select("archive", "records").repartition(count).mapInArrow(read, schema)


def _batch(rows: list, payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads them back."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}

SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
}
__all__ = ["QUERIES", "SQL", "Record", "encode_record", "id_out", "page_record", "read_archives", "read_records", "write_archives"]
