"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A file `part-K-M.rec`, of about FILE_BYTES bytes at most, holds one record for each document, in ascending doc_id order within and across files:
    8 bytes  length of the data, little-endian
    4 bytes  masked CRC-32 of these 8 bytes
    n bytes  the ids, little-endian unsigned, of WIDTH bytes each
    4 bytes  masked CRC-32 of the data
The mask is that of the well-known record format: rotated right by 15 bits plus a constant, so a checksum of data
that holds checksums is sound. `part-K-M.idx` holds 32 bytes for each record: doc_id, place of the record, place of its
first id among the ids of the file, number of ids; doc_id is the smallest 64-bit integer for null.

Ids of a vocabulary of up to 65,536 entries take two bytes, others four.

Cases: null and empty texts have only the end id. Rows with the same id are all written, in the order of their texts'
hashes. An empty table writes no file. The place of a document among all ids is the sum over the files before it plus
its place in its own file: only one row a file reaches the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.library_ids import library_ids
from quernlake.llm.rows import id_and_text
from quernlake.llm.shared_files import opened, write_both
from quernlake.llm.words import steps
from quernlake.shared import new_path, write_shared

END_ID = 1
NULL_ID = -(2**63)
FILE_BYTES = 256 << 20
#: Bytes of text that are encoded at once: the more, the fewer words are looked up again.
STEP_BYTES = 8_000_000
_MASK = 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("at", "<i8"), ("start", "<i8"), ("n", "<i8")])


def _masked(crc: int) -> bytes:
    return struct.pack("<I", ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF)


def masked_crc(data: bytes) -> int:
    return struct.unpack("<I", _masked(zlib.crc32(data)))[0]


def frame(data: bytes) -> bytes:
    """The record of one sequence."""
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked_crc(length)), data, struct.pack("<I", masked_crc(data))))


def read_frame(file, at: int | None = None) -> bytes | None:
    """The data of the record at a place, or of the next one; None at the end. Raises ValueError for a damaged record."""
    if at is not None:
        file.seek(at)
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("the length of a record is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    data = file.read(size + 4)
    if len(data) < size + 4 or struct.unpack("<I", data[size:])[0] != masked_crc(data[:size]):
        raise ValueError("the data of a record are damaged")
    return data[:size]


def framed(ids: np.ndarray, offsets: np.ndarray, end: bytes) -> tuple[list[bytes], np.ndarray]:
    """The records of some sequences, each followed by the end id, as parts in a row; and the bytes of each record."""
    raw, step, parts = memoryview(ids.tobytes()), ids.itemsize, []
    bounds = (offsets * step).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        length = struct.pack("<Q", b - a + len(end))
        crc = zlib.crc32(end, zlib.crc32(raw[a:b]))
        parts += (length, _masked(zlib.crc32(length)), raw[a:b], end, _masked(crc))
    return parts, np.diff(offsets) * step + len(end) + 16


def write_records(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 2, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files of a table and returns one row for each: part, number, file, documents, ids, base (ids of all files before it).

    Sorted by ranges of doc_id, so a file holds a range, and the files of a range follow each other by number; the ids are made after the shuffle, which moves the texts once.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, end = library_ids(path), np.array([end_id], kind).tobytes()
        left = steps(batches, step_bytes=STEP_BYTES)
        for number in range(1 << 30):
            first = next(left, None)
            if first is None:
                return

            def both(out, index, first=first) -> tuple[int, int]:
                at = start = count = 0
                for batch in chain([first], left):
                    ids, offsets = encoder.encode(batch.column("text"))
                    if len(ids) and int(ids.max()) >= 1 << 8 * width:
                        raise ValueError(f"an id takes more than {width} bytes")
                    parts, sizes = framed(ids.astype(kind), offsets, end)
                    out.write(b"".join(parts))
                    entries = np.empty(batch.num_rows, INDEX)
                    entries["doc_id"] = pc.fill_null(batch.column("doc_id"), NULL_ID).to_numpy(zero_copy_only=False)
                    entries["n"] = np.diff(offsets) + 1
                    entries["at"] = at + np.cumsum(sizes) - sizes
                    entries["start"] = start + offsets[:-1] + np.arange(batch.num_rows)
                    index.write(entries.tobytes())
                    at, start, count = at + int(sizes.sum()), start + len(ids) + batch.num_rows, count + batch.num_rows
                    if at >= file_bytes:
                        break
                return count, start

            name = f"{folder}/part-{part:06d}-{number:04d}"
            count, ids = write_both(f"{name}.rec", f"{name}.idx", both)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "file": [name], "documents": pa.array([count], pa.int64()), "ids": pa.array([ids], pa.int64())})

    manifest = write_shared(rows.mapInArrow(run, "part int, number int, file string, documents long, ids long"), "record-manifest")
    found = sorted(manifest.frame.collect())
    manifest.drop()
    base, known = 0, []
    for part, number, file, documents, ids in found:
        known.append((part, number, file, documents, ids, base))
        base += ids
    listed = spark.sparkContext.parallelize(known, max(1, len(known)))
    return spark.createDataFrame(listed, "part int, number int, file string, documents long, ids long, base long")


def read_records(manifest: DataFrame, summary=None, schema: str = "doc_id long, start long, n_tokens long, ids array<int>", width: int = 2) -> DataFrame:
    """Reads the records through their index, checks lengths and checksums, and gives (doc_id, start, n_tokens, ids).

    `summary(ids)` replaces the last column by what it makes of the ids as unsigned 32-bit integers.
    """
    kind = np.dtype(f"<u{width}")
    names = [x.split()[0] for x in schema.split(", ")]
    last = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}[schema.rsplit(" ", 1)[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, base in ((f, b) for batch in batches for f, b in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True)):
            store, at = opened(f"{file}.idx")
            with store.open_input_stream(at) as index, store.open_input_file(opened(f"{file}.rec")[1]) as records:
                while block := index.read(1000 * INDEX.itemsize):
                    some, made = np.frombuffer(block, INDEX), []
                    for entry in some:
                        ids = np.frombuffer(read_frame(records, int(entry["at"])), kind)
                        if len(ids) != entry["n"]:
                            raise ValueError("the index and a record differ in length")
                        made.append(summary(ids.astype("<u4")) if summary else ids.astype(np.int32))
                    ids_of = pa.array(some["doc_id"], pa.int64())
                    ids_of = pc.if_else(pc.equal(ids_of, NULL_ID), None, ids_of)
                    yield pa.RecordBatch.from_arrays([ids_of, pa.array(some["start"] + base), pa.array(some["n"].copy()), pa.array(made, last)], names)

    return manifest.select("file", "base").mapInArrow(run, schema)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())
