"""Sum-of-squares online packing of tokenized documents into training sequences.

Full windows are cut off a long document; its rest, and every shorter document, goes to the fill level at which the sum
over all levels of squared counts of open windows grows least. The counts live in one level array, so placing a document
is two vector additions and a minimum. Every task packs the rows of its own input split: nothing is shuffled, a lost
executor repeats its split alone, and what is held is the open windows only, whose number is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from webcorpus.llm.tokens import tokenizer
from webcorpus.llm.words import released

PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)
NAMES = [column.split()[0] for column in PIECES.split(", ")]
NEVER = 1 << 40  # cost of taking a window from a level that has none
OUT_ROWS = 256  # pieces in an Arrow batch: at most 2 MB of ids


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


class LevelPacker:
    """Open windows by fill level; ``closed`` collects finished sequences as lists of pieces."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open, self.open = window, max_open, 0
        self.leave = np.full(window, NEVER, np.int64)  # growth of the sum when a window leaves this level
        self.leave[0] = 0  # a new window
        self.reach = np.ones(window + 1, np.int64)  # growth of the sum when a window reaches this level
        self.reach[window] = 0
        self.levels: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.closed: list[list[Piece]] = []

    def _count(self, level: int, change: int) -> None:
        n = len(self.levels[level])
        self.open += change
        self.leave[level] = 1 - 2 * n if n else NEVER
        self.reach[level] = 1 + 2 * n

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        window, total, start = self.window, len(ids), 0
        while total - start >= window:
            self.closed.append([Piece(doc_id, start, total, ids[start : start + window])])
            start += window
        if total == start:
            return
        rest = total - start
        growth = self.leave[: window - rest + 1] + self.reach[rest:]
        level = window - rest - int(growth[::-1].argmin())  # of equal levels the fullest
        held: list[Piece] = []
        if level:
            held = self.levels[level].pop()
            self._count(level, -1)
        held.append(Piece(doc_id, start, total, ids[start:]))
        if level + rest == window:
            self.closed.append(held)
        else:
            self.levels[level + rest].append(held)
            self._count(level + rest, 1)
            if self.open > self.max_open:
                self.close(last=False)

    def close(self, last: bool = True) -> None:
        """Fill the fullest open windows with pieces of the emptiest, cutting where one ends.

        The one that stays partly filled is open again, or at the end is cut into powers of two, which need no padding.
        """
        held = [list(pieces) for level in reversed(self.levels) for pieces in level]
        for level, pieces in enumerate(self.levels):
            if pieces:
                self.levels[level] = []
                self._count(level, 0)
        self.open = 0
        first, end = 0, len(held) - 1
        fill = [sum(len(piece.ids) for piece in pieces) for pieces in held]
        while first < end:
            gap, piece = self.window - fill[first], held[end].pop()
            cut = min(gap, len(piece.ids))
            held[first].append(piece._replace(ids=piece.ids[:cut]))
            if cut < len(piece.ids):
                held[end].append(piece._replace(start=piece.start + cut, ids=piece.ids[cut:]))
            fill[first] += cut
            fill[end] -= cut
            if fill[first] == self.window:
                self.closed.append(held[first])
                first += 1
            if not held[end]:
                end -= 1
        if first != end:
            return
        if not last and fill[first] < self.window:
            self.levels[fill[first]].append(held[first])
            self._count(fill[first], 1)
            return
        rest = held[first]
        while rest:
            left = 1 << (sum(len(piece.ids) for piece in rest).bit_length() - 1)
            sequence: list[Piece] = []
            while left:
                piece = rest.pop(0)
                cut = min(left, len(piece.ids))
                sequence.append(piece._replace(ids=piece.ids[:cut]))
                if cut < len(piece.ids):
                    rest.insert(0, piece._replace(start=piece.start + cut, ids=piece.ids[cut:]))
                left -= cut
            self.closed.append(sequence)


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, max_open: int = 4096,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of all documents, placed in sequences of ``window`` ids.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned 32-bit, little-endian); other
    columns of ``docs`` are not read. A document is its text's ids and ``end_id``: a null or empty text is that one id.
    Every row is a document of its own, also when texts or keys repeat or the key is null. At most ``max_open`` windows are
    open in a task; beyond that, open ones are filled up from each other. ``window`` has to be a power of two for the
    end of a task to need no padding. An empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = tokenizer(tokenizer_path), LevelPacker(window, max_open)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def texts(keys: list[int | None]) -> Iterator[str]:
            for batch in batches:
                keys += batch.column(0).to_pylist()
                for i in range(0, batch.num_rows, 64):  # few texts in Python at a time
                    yield from (text or "" for text in batch.column(1).slice(i, 64).to_pylist())

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal number, rows
            for sequence in packer.closed:
                offset = 0
                for p in sequence:
                    n = len(p.ids)
                    rows.append((p.doc_id, p.start, n, p.doc_tokens, number, offset, p.ids.astype("<u4").tobytes()))
                    offset += n
                number += 1
            packer.closed.clear()
            while len(rows) >= OUT_ROWS:
                yield batch_of(rows[:OUT_ROWS])
                rows = rows[OUT_ROWS:]

        keys: list[int | None] = []
        done = 0
        for ids in tokens.ids(texts(keys)):
            packer.add(keys[done], np.append(ids, np.uint16(end_id)))
            done += 1
            if done >= 4096:
                del keys[:done]
                done = 0
            if len(packer.closed) >= OUT_ROWS:
                yield from finished()
        packer.close()
        yield from finished()
        if rows:
            yield batch_of(rows)

    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text")).mapInArrow(released(run), PIECES)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(column, pa.int64()) for column in columns[:-1]] + [pa.array(columns[-1], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, NAMES)
