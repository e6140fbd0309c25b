"""WARC archives: a writer that refers repeated payloads to their first record, and a sequential reader.

Every record is a gzip member of its own.  Of rows with equal payloads of at least `min_revisit` bytes the one with the
smallest id becomes a response record and the others revisit it; that is found out on (id, digest) rows alone, before
the payloads move.  Each task writes archives of about `roll_bytes` under names that follow from its partition, first under
a temporary name, so a repeated task replaces its own files and leaves no halves.  The reader takes an archive as a
stream: it inflates member by member from blocks of 64 KB, frames the record by its Content-Length, and verifies the
framing and the digest; it holds one record at a time.

Edge cases: a null payload is an empty one; a null url leaves the target out; empty and very long payloads are written
alike; rows with equal ids and equal payloads are all responses if theirs is the smallest id; a row without an id becomes a
response whose record id names none and reads back as null, and no record refers to it; an empty table gives no archives and
no rows; further columns are ignored; ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.common import arrow_map, checkpoint, shared_folder, table

BLOCK = 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
COLUMNS = "page_id long, record_type string, target string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class BadRecord(ValueError):
    """A record whose framing, length or digest is wrong."""


class Folder:
    """Files in the shared folder: local paths and file: URIs, or any store that pyarrow opens by its URI."""

    def __init__(self, folder: str):
        self.local = re.sub(r"^file:/*", "/", folder) if folder.startswith("file:") else None if "://" in folder else folder
        if self.local is None:
            from pyarrow import fs

            self.store, self.base = fs.FileSystem.from_uri(folder)
        self.folder = self.local if self.local is not None else self.base

    def create(self) -> None:
        if self.local is not None:
            os.makedirs(self.folder, exist_ok=True)
        else:
            self.store.create_dir(self.folder, recursive=True)

    def write(self, name: str) -> BinaryIO:
        path = f"{self.folder}/{name}"
        return open(path, "wb") if self.local is not None else self.store.open_output_stream(path)  # noqa: SIM115

    def read(self, name: str) -> BinaryIO:
        path = f"{self.folder}/{name}"
        return open(path, "rb") if self.local is not None else self.store.open_input_stream(path)  # noqa: SIM115

    def rename(self, old: str, new: str) -> None:
        if self.local is not None:
            os.replace(f"{self.folder}/{old}", f"{self.folder}/{new}")
        else:
            self.store.move(f"{self.folder}/{old}", f"{self.folder}/{new}")


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    page_id = name[len("<urn:x-page:") : -1]
    return None if page_id == "none" else int(page_id)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def members(source: BinaryIO) -> Iterator[bytes]:
    """The inflated members of an archive, one at a time; an archive that ends within one is an error."""
    rest = source.read(BLOCK)
    while rest:
        gz, out = zlib.decompressobj(31), []
        while not gz.eof:
            if not rest:
                raise BadRecord("the archive ends within a member")
            out.append(gz.decompress(rest))
            rest = gz.unused_data if gz.eof else source.read(BLOCK)
        yield b"".join(out)
        rest = rest or source.read(BLOCK)


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(data: bytes) -> tuple:
    """A row of SCHEMA from the bytes of one record."""
    head, found, body = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise BadRecord("no record header")
    warc = fields(head)
    length = int(warc["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise BadRecord(f"the block of {warc.get('warc-record-id')} isn't {length} bytes long")
    http_head, _, payload = body[:length].partition(b"\r\n\r\n")
    http, digest = fields(http_head), warc["warc-payload-digest"].removeprefix("sha256:")
    page_id, size = id_of(warc["warc-record-id"]), int(http["content-length"])
    if warc["warc-type"] == "revisit":
        return page_id, "revisit", warc.get("warc-target-uri"), size, digest, id_of(warc["warc-refers-to"]), None
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise BadRecord(f"the payload of {page_id} doesn't fit its length or digest")
    return page_id, "response", warc.get("warc-target-uri"), size, digest, None, payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Writes the archives and returns one row for each: archive (its name in `folder`), records."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    marked = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    marked = marked.where((F.col("size") >= min_revisit) & F.col("page_id").isNotNull())
    firsts = marked.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = marked.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    ready = rows.withColumn("digest", F.sha2("payload", 256)).join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    Folder(folder).create()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, out, count, size, k = Folder(folder), TaskContext.get().partitionId(), None, 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, hidden = f"part-{part:06d}-{k:04d}.warc.gz", f".{uuid.uuid4().hex}"
                    out, count, size, k = store.write(hidden), 0, 0, k + 1
                data = member(record(page_id, url, payload, digest, refers_to), level)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    store.rename(hidden, name)
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            store.rename(hidden, name)
            done.append((name, count))
        yield pa.RecordBatch.from_pydict({"archive": pa.array([n for n, _ in done], pa.string()), "records": pa.array([c for _, c in done], pa.int64())})

    return checkpoint(arrow_map(ready, work, "archive string, records long"))


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives named in the column `archive`: COLUMNS, the payload null for revisits (or everywhere)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Folder(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        for part in batches:
            for name in part.column(0).to_pylist():
                rows, size = [], 0
                with store.read(name) as source:
                    for data in members(source):
                        row = parse(data)
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(data) if payloads else 200
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    # As many tasks as archives: a count that is given is not coalesced again, though the names are few bytes.
    names = archives.select("archive")
    return arrow_map(names.repartition(max(1, min(names.count(), 20_000))), work, COLUMNS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
