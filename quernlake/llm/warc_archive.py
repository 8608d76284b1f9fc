"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: every page is a record. Of pages with the same payload of at least REVISIT_BYTES bytes the one with the
smallest id is the response, the others are revisits that name it and its digest. The smallest id of each payload is a
pre-aggregated minimum that is joined back, its hot keys split at run time.

Reading splits files into chunks. A task looks for the magic in its chunk and, of what looks like a record, emits the
offset of the record and that of its successor, which its Content-Length tells. A payload may hold the magic, so these
are candidates only. In a chunk the successors are followed to the first offset beyond it; between chunks, pointer
jumping from the file's start squares the links each round and keeps what is reachable. Only records that the chain
from the start passes are parsed, so magic inside a payload is never a record. A chain that breaks before the file's
end raises an error. Offsets are all that moves between tasks; a task holds one chunk and one record.

Cases: a null payload is an empty one; null urls and ids are left out of the header and read as null. Equal rows are
all written; rows that share the smallest id are all responses, and so is a page without an id. A payload may hold whole
records, or headers that claim any length. Payloads of any length are written and read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.shared_files import opened, write_once
from quernlake.shared import new_path, write_shared

REVISIT_BYTES = 100
CHUNK_BYTES = 8 << 20
#: Bytes of a header at most; a longer one is not taken for a record.
HEADER_BYTES = 64 << 10
FILE_BYTES = 256 << 20
MAGIC = b"WARC/1.1\r\n"
#: No record is longer than 18 digits tell; a payload may claim any length.
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n", re.I)
_DATE = "2024-01-01T00:00:00Z"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to is given) has no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
        lines.append("WARC-Target-URI: " + uri)
        if unquote(uri) != url:  # the url has escapes of its own
            lines.append("X-Target: " + quote(url, safe=""))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:]) if k}


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, packed (the payload, compressed before the shuffle), size, digest, refers_to."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first != last").select("digest", "first")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([pa.compress(x.as_buffer(), "zstd", asbytes=True) for x in batch.column("payload")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("digest"), batch.column("size"), packed], ["page_id", "url", "digest", "size", "packed"])

    rows = rows.mapInArrow(pack, "page_id long, url string, digest string, size long, packed binary")
    return rows.join(first, "digest", "left").select("page_id", "url", "packed", "size", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, **columns) -> DataFrame:
    """Writes a record for each page and returns (file, bytes, records), one row a file."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "packed", "size", "digest", "refers_to")), strict=True))
        for number in range(1 << 30):
            first = next(rows, None)
            if first is None:
                return

            def records(out, first=first) -> tuple[int, int]:
                size = count = 0
                for page_id, url, packed, length, digest, refers_to in chain([first], rows):
                    made = record_bytes(page_id, url, pa.decompress(packed, length, "zstd", asbytes=True) if length else b"", digest, refers_to)
                    out.write(made)
                    size, count = size + len(made), count + 1
                    if size >= file_bytes:
                        break
                return size, count

            name = f"{folder}/part-{part:06d}-{number:04d}.warc"
            size, count = write_once(name, records)
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

    return write_shared(with_references(pages, **columns).mapInArrow(run, "file string, bytes long, records long"), "warc-files").frame


def _dealt(places: DataFrame, tasks: int) -> DataFrame:
    """(file, chunk, ...) over a task for each chunk, up to a limit: AQE would put rows this small into one task."""
    return places.repartition(max(1, min(tasks, 100_000)), "file_no", "chunk")


def _numbered(files: DataFrame) -> DataFrame:
    """file_no, file, bytes: the numbers are fixed once the table is written."""
    return write_shared(files.select("file", "bytes").where("bytes > 0").withColumn("file_no", F.monotonically_increasing_id()), "warc-numbers").frame


def _count_chunks(files: DataFrame, chunk_bytes: int) -> tuple[int, int]:
    """Of all files, and of the largest."""
    n = F.ceil(F.col("bytes") / chunk_bytes)
    return tuple(int(x or 0) for x in files.agg(F.sum(n), F.max(n)).first())


def candidates_in(data: bytes, start: int, size: int, end_of_file: int) -> dict[int, int]:
    """Offsets in [start, start + size) that look like records, and their successors inside the file or at its end; data begins at start."""
    found = {}
    at = data.find(MAGIC, 0, size + len(MAGIC) - 1)
    while 0 <= at < size:
        end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
        if end >= 0 and (length := _LENGTH.search(data, at + len(MAGIC) - 2, end + 2)):
            following = start + end + 4 + int(length[1]) + 4
            if following <= end_of_file:
                found[start + at] = following
        at = data.find(MAGIC, at + 1, size + len(MAGIC) - 1)
    return found


def record_links(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file_no, chunk, at, next): for each candidate the first offset of its chain beyond its chunk."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(chunk_bytes).cast("long"))
    places = _dealt(files.select("file_no", "file", "bytes", F.explode(starts).alias("chunk")), _count_chunks(files, chunk_bytes)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, file, size, chunk in zip(*(batch.column(c).to_pylist() for c in ("file_no", "file", "bytes", "chunk")), strict=True):
                store, path = opened(file)
                with store.open_input_file(path) as source:
                    source.seek(chunk)
                    found = candidates_in(source.read(chunk_bytes + HEADER_BYTES), chunk, chunk_bytes, size)
                beyond: dict[int, int] = {}
                for at in sorted(found, reverse=True):
                    beyond[at] = beyond.get(found[at], found[at]) if found[at] < chunk + chunk_bytes else found[at]
                # a chain that breaks inside the chunk keeps the offset where it broke, which no candidate has
                at = np.array(sorted(beyond), np.int64)
                yield pa.RecordBatch.from_pydict({"file_no": pa.array(np.full(len(at), number, np.int64)), "chunk": pa.array(np.full(len(at), chunk, np.int64)), "at": pa.array(at), "next": pa.array([beyond[x] for x in at.tolist()], pa.int64())})

    return places.mapInArrow(run, "file_no long, chunk long, at long, next long")


def chunk_entries(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file_no, chunk, at): where the chain from the file's start enters each chunk, by pointer jumping over (file_no, file, bytes)."""
    links = write_shared(record_links(files, chunk_bytes), "warc-links").frame
    reached = files.select("file_no", F.lit(0).cast("long").alias("at"))
    jump = links.select("file_no", "at", "next")
    most = _count_chunks(files, chunk_bytes)[1]
    step = 1
    while step < most:
        onward = reached.join(jump, ["file_no", "at"]).select("file_no", F.col("next").alias("at"))
        reached = write_shared(reached.union(onward).distinct(), "warc-reached").frame
        step *= 2
        if step < most:
            hop = jump.select("file_no", F.col("at").alias("next"), F.col("next").alias("over"))
            jump = write_shared(jump.join(hop, ["file_no", "next"], "left").select("file_no", "at", F.coalesce("over", "next").alias("next")), "warc-jumps").frame
    ended = files.join(reached.join(links, ["file_no", "at"]).select("file_no", F.col("next").alias("bytes")), ["file_no", "bytes"], "left_anti")
    if not ended.isEmpty():
        raise ValueError(f"the chain of records does not reach the end of {ended.first()['file']}")
    return reached.join(links.select("file_no", "at", "chunk"), ["file_no", "at"])


def read_archives(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest (bare hex), record_type, refers_to, payload (null for a revisit), file, at.

    The digest and length of a response are computed from what was read and compared with its header.
    """
    files = _numbered(files)
    entries = chunk_entries(files, chunk_bytes).join(files, "file_no").select("file_no", "file", "chunk", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, chunk, at in zip(*(batch.column(c).to_pylist() for c in ("file", "chunk", "at")), strict=True):
                store, path = opened(file)
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    size = source.size()
                    while at < min(size, chunk + chunk_bytes):
                        source.seek(at)
                        row, at_next = _read_record(source, file, at)
                        rows.append(row)
                        held += row[2]
                        at = at_next
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return _dealt(entries, _count_chunks(files, chunk_bytes)[0]).mapInArrow(run, _SCHEMA)


_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, at long"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def _read_record(source, file: str, at: int) -> tuple[tuple, int]:
    head = source.read(4096)
    if b"\r\n\r\n" not in head:
        head += source.read(HEADER_BYTES)
    end = head.find(b"\r\n\r\n")
    if end < 0 or not head.startswith(MAGIC):
        raise ValueError(f"no record at {at} of {file}")
    fields = parse_header(head[:end])
    length = int(fields["content-length"])
    source.seek(at + end + 4)
    block = source.read(length)
    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
    response = fields["warc-type"] == "response"
    if response and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
        raise ValueError(f"the payload at {at} of {file} is damaged")
    url = fields.get("x-target", fields.get("warc-target-uri"))
    row = (_page(fields.get("warc-record-id")), None if url is None else unquote(url), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), block if response else None, file, at)
    return row, at + end + 4 + length + 4
