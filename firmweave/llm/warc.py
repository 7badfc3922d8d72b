"""WARC archives: one gzip member per record, written by tasks and read back in sequence.

``write_archives`` turns pages into records in archives of about
``ARCHIVE_BYTES`` in the shared folder and returns their list;
``read_archives`` reads any such list.  Both work with one record in memory.
An archive's name holds the attempt that wrote it and the list holds only what
the successful attempts reported, so a lost executor leaves no wrong record.

A record of type ``response`` holds an HTTP head and the payload.  Of records
with equal payloads of at least ``LEAST_SHARED`` bytes, the one with the smallest
page_id is the response and the others are ``revisit`` records: the HTTP head
alone, which still states the payload's length, with the payload's digest and
the response they refer to.

The reader inflates in small steps, cuts at the end of each gzip member, frames
the block by Content-Length and recomputes both digests.  Anything that does not
fit raises ``ValueError``.

Defined cases: missing html -> empty payload, always a response; a missing
page_id reads back as missing and comes after all others; rows that repeat the
smallest page_id are all responses; a missing url -> the page's urn; control
characters of a url are percent-encoded; an empty table -> no archive, no rows.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from firmweave.llm.tables import map_batches, materialize
from firmweave.session import scratch_dir

ARCHIVE_BYTES = 32 << 20
LEAST_SHARED = 100
STEP = 64 << 10
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" if ord(c) < 256 else c for c in url)


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
    revisit: bool,
) -> bytes:
    """One record as a gzip member."""
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {_clean(url) if url else _urn(page_id)[1:-1]}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return squeeze.compress(whole) + squeeze.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, inflated step by step, one at a time."""
    rest = b""
    inflate, parts = None, []
    while True:
        data = rest or stream.read(STEP)
        rest = b""
        if not data:
            break
        if inflate is None:
            inflate, parts = zlib.decompressobj(31), []
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as error:
            raise ValueError(f"damaged gzip member: {error}") from error
        if inflate.eof:
            rest = inflate.unused_data
            inflate = None
            yield b"".join(parts)
    if inflate is not None:
        raise ValueError("the archive ends within a gzip member")


def _head(raw: bytes, begin: int) -> tuple[str, dict[str, str], int]:
    """First line, fields in lower case, and where the block begins."""
    end = raw.find(b"\r\n\r\n", begin)
    if end < 0:
        raise ValueError("a head without an end")
    first, *lines = raw[begin:end].decode("utf-8").split("\r\n")
    fields = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields, end + 4


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one member."""
    version, fields, begin = _head(raw, 0)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    length = int(fields["content-length"])
    block = raw[begin : begin + length]
    if len(block) != length or raw[begin + length :] != b"\r\n\r\n":
        raise ValueError("the block does not fit its Content-Length")
    if fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("the block does not fit its digest")
    _, http, payload_at = _head(block, 0)
    said = int(http["content-length"])
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        payload = block[payload_at:]
        if len(payload) != said or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload does not fit its length or digest")
    elif kind != "revisit" or len(block) != payload_at:
        raise ValueError(f"unexpected record type or payload: {kind}")
    return _page(fields["warc-record-id"]), said, digest, kind, _page(fields.get("warc-refers-to"))


def read_stream(stream) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    for raw in members(stream):
        yield parse(raw)


def read_bytes(raw: bytes) -> list[tuple[int | None, int, str, str, int | None]]:
    return list(read_stream(io.BytesIO(raw)))


def _typed(pages: DataFrame) -> DataFrame:
    """Pages with digest, type and the response a revisit refers to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        base.where(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy(F.col("digest").alias("shared_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # written once: its size is then known, and a few shared payloads are joined map-side
    shared = materialize(shared, "warc-shared")
    joined = base.join(shared, F.col("digest") == F.col("shared_digest"), "left")
    revisit = F.col("shared_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "digest", revisit.alias("revisit"),
        F.when(revisit, F.col("first_id")).alias("first_id"),
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; (path, n_records) of each."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, held, records = None, 0, 0
        name = ""
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, revisit, first_id = (
                    batch.column(k)[row].as_py() for k in range(6)
                )
                if out is None:
                    name = f"p{context.partitionId():06d}-a{context.taskAttemptId()}-{len(done):05d}.warc.gz"
                    out, held, records = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                raw = record(page_id, url, payload, digest, first_id, revisit)
                out.write(raw)
                held += len(raw)
                records += 1
                if held >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{n}" for n, _ in done], pa.string()),
                pa.array([r for _, r in done], pa.int64()),
            ],
            names=["path", "n_records"],
        )

    return materialize(map_batches(_typed(pages), write, "path string, n_records long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of all archives in the column ``path``, in ``RECORD_SCHEMA``."""
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=fields
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for path in listed.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                rows = []
                with store.open_input_stream(place, compression=None) as stream:
                    for found in read_stream(stream):
                        rows.append(found)
                        if len(rows) == 2000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    tasks = max(1, archives.count())
    return map_batches(archives.select("path").repartition(tasks), read, RECORD_SCHEMA)


def through_archives(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives and read them back: one row per page."""
    return read_archives(write_archives(pages))
