"""WARC archives written from, and read into, a table of chunks.

A record is a run of rows ``record_id, chunk_no, data``: payloads are cut into chunks of bounded size, and each row carries the
digest of its record's payload up to its end. Writer and reader take one chunk after the other, so neither ever holds a whole
record, whatever its size. Equal payloads are stored once; the other records revisit it. Archives are files of gzip members,
one per record, in any store that Arrow reaches.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.token_files import opened
from webcorpus.operators.joins import broadcast_if_small
from webcorpus.session import written

CHUNK = 1 << 16  # bytes
LEAST_SHARED = 100  # bytes; smaller payloads are never revisits
READ = 1 << 20  # compressed bytes read at once
OUT_BYTES, OUT_ROWS = 1 << 22, 512  # of an Arrow batch of chunks
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # captures carry no time
CHUNKS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint,"
    " payload_digest string, chunk_no int, data binary, running_digest string"
)
SCHEMA = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()),
    ("running_digest", pa.string()),
])
LIST = "file string, records bigint, bytes bigint"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class _Rows:
    """Collects chunk rows into batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += len(row[8])
        if self.bytes >= OUT_BYTES or len(self.rows) >= OUT_ROWS:
            yield from self.done()

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(zip(*self.rows, strict=True), SCHEMA, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=SCHEMA)
            self.rows, self.bytes = [], 0


def chunk_table(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Chunk rows of every row of ``pages``; a revisit is one row without data.

    A null payload is empty. Of rows with equal payloads of at least 100 bytes those with the smallest key are responses and
    the others refer to it; rows with that key and payload again are responses too. Null keys revisit like others, and are
    responses if no equal row has a key. Rows of a record follow each other in their partition.
    """
    rows = pages.select(
        pages[key].cast("bigint").alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"),
        F.coalesce(pages[payload], F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload"))
    kinds = rows.where(F.col("size") >= LEAST_SHARED).groupBy(F.col("digest").alias("_digest")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("held")
    )
    shared = written(kinds.where("held > 1 AND first IS NOT NULL").select("_digest", "first"), "warc-shared")
    rows = rows.join(broadcast_if_small(shared), F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_cut, CHUNKS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    out = _Rows()
    for batch in batches:
        text = batch.column(2)
        wide = pa.types.is_large_string(text.type)
        offsets = memoryview(text.buffers()[1]).cast("q" if wide else "i")[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        columns = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for i, (page_id, url, digest, refers_to) in enumerate(zip(*columns, strict=True)):
            start, end = offsets[i], offsets[i + 1]
            record = f"{task:06d}-{number:09d}"
            number += 1
            if refers_to is not None:
                yield from out.add((record, page_id, url, "revisit", refers_to, end - start, digest, 0, b"", digest))
                continue
            running = hashlib.sha256()
            for n, at in enumerate(range(start, max(end, start + 1), CHUNK)):
                part = data.slice(at, min(CHUNK, end - at)).to_pybytes() if end > start else b""
                running.update(part)
                so_far = running.copy().hexdigest() if at + CHUNK < end else running.hexdigest()
                yield from out.add((record, page_id, url, "response", None, end - start, digest, n, part, so_far))
    yield from out.done()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """One archive per task in ``folder``; returns ``file, records, bytes`` of those that became part of the result.

    A file is named after the attempt that wrote it and moved to its name when whole, so lost attempts leave nothing in
    the table. Takes chunk rows in the order of ``chunk_table``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        store, path = opened(folder)
        store.create_dir(path)
        records = size = 0
        with store.open_output_stream(f"{path}/_{name}") as out:
            pack = None
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                ready = []
                for row in zip(*columns, strict=True):
                    if row[7] == 0:
                        if pack is not None:
                            ready += [pack.compress(b"\r\n\r\n"), pack.flush()]
                        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                        ready.append(pack.compress(_head(row)))
                        records += 1
                    ready.append(pack.compress(row[8]))
                whole = b"".join(ready)
                size += len(whole)
                out.write(whole)
            if pack is not None:
                last = pack.compress(b"\r\n\r\n") + pack.flush()
                size += len(last)
                out.write(last)
        store.move(f"{path}/_{name}", f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], ["file", "records", "bytes"])

    return written(chunks.mapInArrow(run, LIST), "warc-archives")


def _head(row: tuple) -> bytes:
    record, page_id, url, kind, refers_to, size, digest = row[:7]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Chunk rows of the archives in ``files(file)``; digests are worked out anew while reading.

    ``payload_bytes`` and ``payload_digest`` are what the record says of itself. Every archive is read by a task of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        out = _Rows()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}") as source:
                    for row in _records(_members(source)):
                        yield from out.add(row)
        yield from out.done()

    # An archive of gzip members can't be split, and each was written by one task: one reading task per archive. The explicit
    # count keeps adaptive execution from merging the few rows of the listing into one task.
    n_files = files.count()
    return files.select("file").repartitionByRange(max(1, n_files), "file").mapInArrow(run, CHUNKS)


def _members(source: pa.NativeFile) -> Iterator[bytes]:
    """Bytes of a file of gzip members, at most a chunk at a time."""
    unpack = zlib.decompressobj(31)
    held = b""
    while True:
        if not held:
            held = source.read(READ)
            if not held:
                return
        data = unpack.decompress(held, CHUNK)
        held = unpack.unconsumed_tail
        if data:
            yield data
        if unpack.eof:
            held = unpack.unused_data
            unpack = zlib.decompressobj(31)


def _records(data: Iterator[bytes]) -> Iterator[tuple]:
    """Chunk rows out of a stream of bytes; what is held is a header and at most one chunk."""
    held = b""

    def header() -> bytes | None:
        """Up to the next empty line."""
        nonlocal held
        while (at := held.find(b"\r\n\r\n")) < 0:
            more = next(data, None)
            if more is None:
                return None
            held += more
        found, held = held[:at], held[at + 4 :]
        return found

    while (head := header()) is not None:
        named = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
        http = header() or b""
        sizes = re.search(rb"Content-Length: (\d+)", http)
        left = int(named["Content-Length"]) - len(http) - 4
        page_id, refers = named.get("X-Page-ID"), named.get("X-Refers-To-Page-ID")
        fixed = (
            named["WARC-Record-ID"][12:-1], None if page_id is None else int(page_id), named["WARC-Target-URI"], named["WARC-Type"],
            None if refers is None else int(refers), int(sizes[1]) if sizes else 0,
            named["WARC-Payload-Digest"].removeprefix("sha256:"),
        )
        running, number = hashlib.sha256(), 0
        while left > 0 or number == 0:
            while left > 0 and not held:
                held = next(data, b"")
                if not held:
                    return  # cut off
            part = held[: min(left, CHUNK)]
            held = held[len(part) :]
            left -= len(part)
            running.update(part)
            yield (*fixed, number, part, running.copy().hexdigest() if left else running.hexdigest())
            number += 1
        while len(held) < 4:
            more = next(data, None)
            if more is None:
                return
            held += more
        held = held[4:]


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, whole``.

    A response's size and digest are those of its chunks, a revisit's those of its header; ``whole`` tells whether a
    response is what its header says.
    """
    found = chunks.groupBy("record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").agg(
        F.sum(F.octet_length("data")).cast("bigint").alias("_bytes"), F.max_by("running_digest", "chunk_no").alias("_digest")
    )
    own = F.col("record_type") == "response"
    return found.select(
        "page_id", F.when(own, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
        (~own | (F.col("_bytes") == F.col("payload_bytes")) & (F.col("_digest") == F.col("payload_digest"))).alias("whole"),
    )


def archive_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Archives ``pages`` in ``folder`` and returns ``records`` of what is read back. An empty table gives no records."""
    return records(read_archives(write_archives(chunk_table(pages), folder), folder))
