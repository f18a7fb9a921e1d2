"""Flat token files, and document boundaries found in them by a separator scan.

A token file is nothing but ids, two bytes each, documents one after the other with an end identifier behind each: no header,
no index. The scan cuts files into blocks of fixed size without looking at boundaries. Every block is read and searched on its
own; it reports the places of its end identifiers. A prefix sum over the blocks' counts numbers the documents, and the last
end identifier of the blocks before tells where a block's first document began, however many blocks it spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.tokens import tokenizer
from webcorpus.session import written

BLOCK = 1 << 20  # ids in a block: 2 MB
TASK_BYTES = 64 << 20  # bytes of token files one searching task reads
FILES = "file string, doc_id bigint, ordinal bigint"
FILES_NAMES = [column.split()[0] for column in FILES.split(", ")]
LISTED = "file string, bytes bigint"


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder or file, in any store that Arrow reads."""
    return pyarrow.fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def file_name() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}.tokens"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One token file per task in ``folder``; returns which document is where: ``file, doc_id, ordinal``.

    A file's name holds the attempt that wrote it, and it appears under its name only when it is whole; files of attempts that
    were lost aren't in the returned table. A null or empty text is its end identifier alone; a text that spells a special
    token is ordinary text, so no end identifier stands inside a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path)
        name = file_name()
        end = np.uint16(end_id)
        keys: list[int | None] = []
        ordinal = 0

        def texts() -> Iterator[str]:
            for batch in batches:
                keys.extend(batch.column(0).to_pylist())
                for i in range(0, batch.num_rows, 64):
                    yield from (text or "" for text in batch.column(1).slice(i, 64).to_pylist())

        with store.open_output_stream(f"{path}/_{name}") as out:
            for ids in tokenizer(tokenizer_path, plain=True).ids(texts()):
                out.write(np.append(ids, end).astype("<u2").tobytes())
                ordinal += 1
                if ordinal % 10_000 == 0:
                    yield listed(keys[:10_000], ordinal - 10_000)
                    del keys[:10_000]
        store.move(f"{path}/_{name}", f"{path}/{name}")
        if keys:
            yield listed(keys, ordinal - len(keys))

    def listed(keys: list[int | None], first: int) -> pa.RecordBatch:
        name = file_name()
        places = pa.array(range(first, first + len(keys)), pa.int64())
        names = pa.array([name] * len(keys), pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(keys, pa.int64()), places], FILES_NAMES)

    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return written(rows.mapInArrow(run, FILES), "token-file-documents")


def file_sizes(names: DataFrame, folder: str) -> DataFrame:
    """``file, bytes`` of the files named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        for batch in batches:
            files = batch.column(0).to_pylist()
            sizes = [store.get_file_info(f"{path}/{name}").size for name in files]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return names.select("file").mapInArrow(run, LISTED)


def dealt_blocks(files: DataFrame, block: int = BLOCK, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``file, bytes, block``: every block of the non-empty files of ``files(file, bytes)``, dealt by range over the tasks."""
    files = written(files.where("bytes > 1"), "token-file-sizes")
    n_bytes, n_blocks = files.agg(F.sum("bytes"), F.sum(F.expr(f"(bytes DIV 2 - 1) DIV {block} + 1"))).first()
    tasks = max(1, min(n_blocks or 0, max(files.sparkSession.sparkContext.defaultParallelism, -(-(n_bytes or 0) // task_bytes))))
    blocks = files.select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(bytes DIV 2 - 1) DIV {block}"))).alias("block")
    )
    return blocks.repartitionByRange(tasks, "file", "block")


def scan_separators(files: DataFrame, folder: str, end_id: int, block: int = BLOCK, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``file, ordinal, start, length`` of every document in the flat files of ``files(file, bytes)``.

    ``start`` and ``length`` count ids, the length with the end identifier. Ids behind the last end identifier of a file are a
    document without end: a row with a null ordinal. Empty files have no rows. A block reports where its documents end, at
    most one row per document; none holds a document's ids but the ones that read it.

    Blocks are dealt by range of (file, block) over as many tasks as the bytes ask (``task_bytes`` each, at least one task per
    core): an explicit count that adaptive execution does not merge, so the search never runs in one task however few bytes
    the rows of blocks weigh.
    """
    spread = dealt_blocks(files, block, task_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        for batch in batches:
            for name, size, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = number * block
                count = min(block, size // 2 - first)
                with store.open_input_file(f"{path}/{name}") as source:
                    source.seek(2 * first)
                    ids = np.frombuffer(source.read(2 * count), "<u2")
                ends = np.flatnonzero(ids == end_id) + first
                last = ends[-1:] if len(ends) else np.array([-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([number]), pa.array([size // 2]), pa.array([len(ends)]), pa.array(last),
                     pa.array([ends], pa.list_(pa.int64()))],
                    ["file", "block", "ids", "found", "last", "ends"],
                )

    found = written(
        spread.mapInArrow(search, "file string, block bigint, ids bigint, found bigint, last bigint, ends array<bigint>"), "separators"
    )
    # The prefix scan is over one row of counts per block.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "block", "ids", "found", "last",
        F.coalesce(F.sum("found").over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
    )
    placed = found.select("file", "block", "ends").join(carried.drop("ids", "found", "last"), ["file", "block"])
    whole = placed.select("file", "earlier", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    starts = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    whole = whole.select(
        "file", (F.col("earlier") + F.col("k")).alias("ordinal"), starts.alias("start"), (F.col("end") + 1 - starts).alias("length")
    )
    tail = found.groupBy("file").agg(F.max("ids").alias("ids"), F.max("last").alias("last")).where("ids > last + 1")
    tail = tail.select("file", F.lit(None).cast("bigint").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("ids") - F.col("last") - 1).alias("length"))
    return whole.unionAll(tail)


def token_counts(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """``doc_id, file, start, n_tokens`` per row of ``docs``: written to token files, then counted from these alone.

    The counts come from the scan; documents are put to them by their place in the file. Null and empty texts count one, the
    end identifier. Repeated rows and null keys stay rows. Other columns aren't read. An empty table gives an empty result.
    """
    listed = write_token_files(docs, folder, tokenizer_path, end_id)
    files = file_sizes(listed.select("file").distinct(), folder)
    found = scan_separators(files, folder, end_id, block)
    return listed.join(found, ["file", "ordinal"]).select("doc_id", "file", "start", F.col("length").alias("n_tokens"))
