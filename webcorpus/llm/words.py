"""Words of whole texts as 64-bit hashes, in numpy: lower-case A-Z, split at ASCII white space."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
GROUP = 1 << 15  # bytes of short texts hashed together
CHUNK = 1 << 18  # bytes hashed at a time, so long texts need little memory
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses

with np.errstate(over="ignore"):
    _lower = np.arange(256)
    _lower[65:91] += 32
    # One random 64-bit value per byte; upper-case letters share that of the lower-case ones.
    BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)[_lower]
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False
# For matching that ignores marks: letters, digits and all that isn't ASCII.
IS_PLAIN = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n, CHUNK + 1)
        tables = []
        for value in (BASE, inverse):
            table = np.full(size, value, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if size > 4 * CHUNK:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chunk_words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = kind[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    if len(edges) % 2:
        edges = np.concatenate([edges, [len(data)]])
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts]), starts, ends


def word_hashes(text: bytes, kind: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of an UTF-8 text. Equal words have equal hashes at any place.

    ``kind`` tells which bytes are part of a word.
    """
    data = np.frombuffer(text, np.uint8)
    if len(data) <= CHUNK:
        return _chunk_words(data, kind)
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data):  # up to the next separator, so that no word is cut
            gaps = np.flatnonzero(~kind[data[end : end + CHUNK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += CHUNK
        end = min(end, len(data))
        h, s, e = _chunk_words(data[at:end], kind)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


Hashed = tuple[bytes, np.ndarray, np.ndarray, np.ndarray]


def hashed_texts(texts: Iterable[bytes], kind: np.ndarray = IS_WORD) -> Iterator[Hashed]:
    """Each text with what ``word_hashes`` gives for it; short texts are hashed together, which costs less."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP:
            yield from _together(held, kind)
            held, size = [], 0
    yield from _together(held, kind)


def _together(texts: list[bytes], kind: np.ndarray) -> Iterator[Hashed]:
    hashes, first, last = word_hashes(b"\n".join(texts), kind)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(first, begins).tolist()
    for text, begin, a, b in zip(texts, begins.tolist(), cuts, cuts[1:], strict=False):
        yield text, hashes[a:b], first[a:b] - begin, last[a:b] - begin


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in order of place."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count].copy()
    for k in range(1, n):
        total = total * BASE + words[k : k + count]
    return mix(total)


def texts_of(batch: pa.RecordBatch, column: int, rows: int = 64) -> Iterator[bytes]:
    """UTF-8 of each row, null as empty; few rows are Python objects at a time."""
    for i in range(0, batch.num_rows, rows):
        for text in batch.column(column).slice(i, rows).to_pylist():
            yield b"" if text is None else text.encode()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task function of ``mapInArrow`` that, when its task ends, frees what the task left behind in the Python worker:
    cycles are collected and Arrow's pool gives unused memory back. Reused workers then don't carry one stage's peak
    into the next."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()

    return task
