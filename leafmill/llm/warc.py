"""WARC archives: one gzip member for each record, written by every task on its own and read back sequentially.

Writing: of records with equal payloads (equal SHA-1 digests, at least ``revisit_from`` bytes), that with the
smallest id is a ``response``; the others are ``revisit`` records that refer to it and hold HTTP headers only. The
ids of repeated payloads are found by an aggregation of digests and written as a table of its own, so that Spark
knows its size when it joins: it is broadcast if it is under Spark's threshold, and joined by shuffle, with AQE
splitting skewed partitions, beyond. Each task streams its rows into files of its own in the shared folder; only
files of tasks that succeeded are listed in the manifest, so a task that is run anew leaves nothing but a file that
no one reads.

Reading: a sequential reader inflates member by member in small steps, frames header and block by their lengths,
and verifies block and payload digests; memory is bounded by the largest record.

Defined cases: a null payload is an empty one, and is treated like other payloads. A null url writes no target. A
null id comes after all others: it is a revisit if another row has the payload, else a response. Rows with the
smallest id of a payload, repeated, are all responses. Control characters in urls are percent-encoded. An empty
table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import bounded_batches, new_path, shuffle_partitions, written

#: Bytes of a compressed archive after which a task begins another, bytes read at once, and records of a result batch.
ARCHIVE_BYTES, STEP_BYTES, BATCH_RECORDS = 256 << 20, 1 << 16, 512

#: Fixed values of the format.
_VERSION, _LINE, _GAP = b"WARC/1.1", b"\r\n", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d+|none)>")

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if revisit:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(refers_to)}
    headers |= {"WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return b"".join((_VERSION, _LINE, lines, _LINE, block, _GAP))


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own, without a time, so that reruns agree."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_members(file: BinaryIO, step: int = STEP_BYTES) -> Iterator[bytes]:
    """Inflates gzip members one after another; what follows a member's end starts the next."""
    rest = b""
    while rest or (rest := file.read(step)):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest and not (rest := file.read(step)):
                raise ValueError("the archive ends inside a gzip member")
            parts.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> Record:
    """Frames one record by its Content-Length and verifies what it says of its digests."""
    head, gap, rest = data.partition(_GAP)
    version, *lines = head.split(_LINE)
    if not gap or not version.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}
    length = int(headers["content-length"])
    if len(rest) != length + len(_GAP) or rest[length:] != _GAP:
        raise ValueError(f"record {headers.get('warc-record-id')}: its length is not {length}")
    block = rest[:length]
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError(f"record {headers.get('warc-record-id')}: its block has another digest")
    return Record(headers, block)


def payload_of(record: Record) -> tuple[bytes | None, int, str]:
    """Payload (None for revisits), its length and its digest; both are verified where the payload is there."""
    http, _, payload = record.block.partition(_GAP)
    said = record.headers["warc-payload-digest"].removeprefix("sha1:")
    length = next(int(line.partition(b":")[2]) for line in http.split(_LINE) if line.lower().startswith(b"content-length:"))
    if record.headers["warc-type"] == "revisit":
        return None, length, said
    if len(payload) != length or digest(payload) != said:
        raise ValueError(f"record {record.headers.get('warc-record-id')}: its payload has another length or digest")
    return payload, length, said


def _page(urn: str | None) -> int | None:
    m = _ID.fullmatch(urn or "")
    return int(m[1]) if m and m[1] != "none" else None


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_stream(path, compression=None)


def plan_records(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload, payload_sha1, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_sha1", F.unhex(F.sha1("payload")))
    seen = rows.where(F.octet_length("payload") >= revisit_from).groupBy("payload_sha1")
    repeated = written(seen.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(repeated, "payload_sha1", "left").select("page_id", "url", "payload", "payload_sha1", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, revisit_from: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, html as archives into the shared folder; returns the manifest: path, records, bytes."""
    bounded_batches(pages.sparkSession)
    folder = new_path(pages.sparkSession, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, path, records, size = [], None, "", 0, 0

        def close() -> None:
            out.close()
            done.append((path, records, size))

        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_sha1", "refers_to"))):
                if out is None or size >= archive_bytes:
                    if out is not None:
                        close()
                    task = TaskContext.get()
                    path = f"{folder}/{task.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, records, size = _open(path, write=True), 0, 0
                to = refers_to.as_py()
                data = member(record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), base64.b32encode(sha1.as_py()).decode(), to, to is not None, date))
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return written(plan_records(pages, revisit_from).mapInArrow(archive, MANIFEST), "manifest")


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reads the archives of a manifest back, each by one task from its start to its end, in as many tasks as archives up to four for each shuffle partition.

    A revisit has no payload of its own; its length and digest are those of the payload it refers to. Archives that
    aren't whole, or whose lengths or digests don't hold, end the task with an error that names the record.
    """
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in RECORDS.split(", ")])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    for data in read_members(file):
                        record = parse(data)
                        payload, length, said = payload_of(record)
                        h = record.headers
                        rows.append((_page(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], _page(h.get("warc-refers-to")), length, said, payload if with_payload else None))
                        held += len(payload or b"") * with_payload
                        if len(rows) >= BATCH_RECORDS or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
        yield batch_of(rows)

    paths = manifest.select("path")
    # a number that is stated isn't lowered by adaptive execution, however small the list of paths is
    tasks = max(1, min(paths.count(), 4 * shuffle_partitions(paths.sparkSession)))
    return paths.repartitionByRange(tasks, "path").mapInArrow(records, RECORDS)
