"""Benchmark decontamination by edit distance on words: CGK embedding, bit-sampling LSH, exact verification.

The CGK walk reads a sequence of words with a pointer: at each of its steps it writes the word below the pointer and moves on
or stays, as a random function of step and word says. Two sequences with few edits give walks that agree at most steps, so
edit distance becomes Hamming distance. Each repetition has walks of its own and samples a few steps; windows as long as an
item whose samples agree with the item's in some repetition are candidates, and their edit distance is computed exactly.

A window with k edits of an item of n words holds an unchanged run of q >= (n - k) / (k + 1) of its words, and at least
n - q + 1 - k q runs of q words. So only windows around so many runs of an item are embedded; this loses no match. Documents are never moved: items are few,
and are sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.words import BASE, IS_PLAIN, hashed_texts, mix, ngram_hashes, released, texts_of, word_hashes

SAMPLES = 2  # steps compared in a repetition
AGREE = 0.45  # share of steps at which walks of the largest allowed distance agree, measured; sets the repetitions
STEPS_PER_WORD = 2  # a walk reads n words in about 2 n steps
LANES = 1 << 18  # walks carried on together
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 4 << 20  # items sent to the tasks at once, and bytes of their texts
LONG_ITEM = 1 << 16  # bytes from which an item is a block of its own, since walks are as long as the longest item
FIELDS = "doc_id bigint, item_id bigint, edits int, item_words int, start bigint, end bigint"
NAMES = [column.split()[0] for column in FIELDS.split(", ")]
SEED_BITS = 1 << 20


def repetitions(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE**SAMPLES))


@dataclass
class Items:
    """The items of a block, their runs and their sampled walks; built once per task."""

    rows: list[tuple[int, bytes]]
    edit_percent: int
    recall: float
    min_words: int
    words: list[np.ndarray] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        for item_id, text in self.rows:
            words = word_hashes(text, IS_PLAIN)[0]
            if len(words):
                self.ids.append(item_id)
                self.words.append(words)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.where(self.lengths < self.min_words, 0, self.lengths * self.edit_percent // 100)
        runs = -(-(self.lengths - self.edits) // (self.edits + 1))
        self.least = np.maximum(1, self.lengths - runs + 1 - self.edits * runs)  # runs that a match shares
        # By run length: hashes of runs, with the item and the place of each.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in np.unique(runs).tolist():
            grams = [(i, ngram_hashes(self.words[i], q)) for i in np.flatnonzero(runs == q).tolist()]
            values = np.concatenate([g for _, g in grams])
            owner = np.concatenate([np.full(len(g), i) for i, g in grams])
            place = np.concatenate([np.arange(len(g)) for _, g in grams])
            order = np.argsort(values, kind="stable")
            slots = np.zeros(SEED_BITS, bool)
            slots[(values & np.uint64(SEED_BITS - 1)).astype(np.int64)] = True
            self.seeds[q] = values[order], owner[order], place[order], slots
        self.times = repetitions(self.recall)
        if self.words:
            longest = int(self.lengths.max())
            rng = np.random.default_rng(7)
            shape = (longest * STEPS_PER_WORD, self.times)
            self.flip = rng.integers(0, 1 << 63, shape, np.uint64)
            self.turn = rng.integers(0, 1 << 62, shape, np.uint64) * np.uint64(2) + np.uint64(1)
            self.sample: dict[int, np.ndarray] = {}  # by length: steps by repetition
            for n in np.unique(self.lengths).tolist():
                chosen = np.zeros((longest * STEPS_PER_WORD, self.times), bool)
                for r in range(self.times):
                    chosen[rng.choice(n * STEPS_PER_WORD, SAMPLES, replace=False), r] = True
                self.sample[n] = chosen
            starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
            keys = self.signatures(np.concatenate(self.words), starts, self.lengths, starts + self.lengths)
            owner = np.repeat(np.arange(len(self.words)), self.times)
            order = np.argsort(keys.ravel(), kind="stable")
            self.keys, self.owner = keys.ravel()[order], owner[order]

    def signatures(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A key per window and repetition, of its length and the words its walk writes at the sampled steps."""
        out = np.zeros((len(starts), self.times), np.uint64)
        for n in np.unique(lengths).tolist():
            chosen = self.sample[n]
            steps = np.flatnonzero(chosen.any(1))
            mine = np.flatnonzero(lengths == n)
            for part in np.array_split(mine, max(1, len(mine) * self.times // LANES)):
                at = np.repeat(starts[part][:, None], self.times, 1)
                stop = np.minimum(starts[part] + n, ends[part])[:, None]
                key = np.full(at.shape, np.uint64(n), np.uint64)
                for step in range(int(steps[-1]) + 1):
                    inside = at < stop
                    word = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
                    if chosen[step].any():
                        key = np.where(chosen[step], key * BASE + mix(word), key)
                    move = ((word ^ self.flip[step]) * self.turn[step]) >> np.uint64(63)
                    at += (move.astype(bool) & inside).astype(np.int64)
                out[part] = mix(key + np.arange(self.times, dtype=np.uint64) * BASE)
        return out

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows of a document around runs that an item has too."""
        found: set[tuple[int, int]] = set()
        for q, (values, owner, place, slots) in self.seeds.items():
            grams = ngram_hashes(words, q)
            near = np.flatnonzero(slots[(grams & np.uint64(SEED_BITS - 1)).astype(np.int64)])
            if not len(near):
                continue
            low, high = np.searchsorted(values, grams[near], "left"), np.searchsorted(values, grams[near], "right")
            shared: dict[int, list[tuple[int, int]]] = {}
            for p, a, b in zip(near.tolist(), low.tolist(), high.tolist(), strict=True):
                for item, offset in zip(owner[a:b].tolist(), place[a:b].tolist(), strict=True):
                    shared.setdefault(item, []).append((p, p - offset))
            for item, runs in shared.items():
                k, n, least = int(self.edits[item]), int(self.lengths[item]), int(self.least[item])
                if not k:
                    runs = runs[:1]  # a run of all its words is a match, and the first is the one to give
                dense = [later - p <= n + k for (p, _), (later, _) in zip(runs, runs[least - 1 :], strict=False)]
                diagonals = set()
                upto = -1  # runs up to this place belong to a stretch of the length of a match with enough of them
                for i, (p, d) in enumerate(runs):
                    if i < len(dense) and dense[i]:
                        upto = p + n + k
                    if p <= upto:
                        diagonals.add(d)
                found.update((s, n) for d in diagonals for s in range(max(0, d - k), d + k + 1) if s < len(words))
        some = np.array(sorted(found), np.int64).reshape(-1, 2)
        return some[:, 0], some[:, 1]


def edit_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn ``item`` into a stretch of ``words``; first such stretch to end, its start and end."""
    width = len(words) + 1
    cost, origin = np.zeros(width, np.int64), np.arange(width)
    places = np.arange(width)
    for i, word in enumerate(item.tolist(), 1):
        swap = np.concatenate([[i], cost[:-1] + (words != np.uint64(word))])
        drop = cost + 1
        best = np.minimum(swap, drop)
        best[0] = i
        begun = np.where(swap <= drop, np.concatenate([[0], origin[:-1]]), origin)
        # words put in: cost of an earlier place and the distance from it
        level = best - places
        running = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == running, places, 0))
        cost, origin = running + places, begun[source]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def leaks(
    docs: DataFrame, benchmark: DataFrame, edit_percent: int = 25, recall: float = 0.99, min_words: int = 8,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, edits, item_words, start, end``: documents that hold an item with few word edits.

    Words are runs of letters, digits and non-ASCII characters in lower case; at most ``edit_percent`` of an item's words
    may be edited. One row per document row and item, the match with fewest edits, the first of equal ones; ``start`` and
    ``end`` are code points. An item of fewer than ``min_words`` words is matched exactly, by a run of all its words. What is
    written without spaces is one word, which matches as a whole only. Items with a null text or without words match
    nothing; null and empty documents hold nothing. Equal items match each on its own, repeated document rows give repeated
    result rows, null keys stay null. Other columns aren't read. ``recall`` is the target of the candidate search for windows
    with the largest allowed distance; closer ones are found more surely, exact copies always. Without items or documents
    the result is empty. Items are sent to the tasks in blocks of at most
    5,000 and 4 MB, one of 64 KB or more in a block of its own; each block is a pass over the documents.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    items = benchmark.select(benchmark[item_key].cast("bigint").alias("item_id"), benchmark[item_text].alias("text"))
    items = items.where("text IS NOT NULL").orderBy("item_id", "text")
    results = []
    for rows in blocks((r.item_id, r.text.encode()) for r in items.toLocalIterator()):
        sent = spark.sparkContext.broadcast(rows)
        results.append(texts.mapInArrow(released(_search(sent, edit_percent, recall, min_words)), FIELDS))
    return reduce(DataFrame.unionAll, results)


def blocks(rows: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """All items in blocks bounded in number and bytes, long ones each alone; one empty block if there are none."""
    held: list[tuple[int, bytes]] = []
    size = count = 0
    for row in rows:
        if len(row[1]) >= LONG_ITEM:
            count += 1
            yield [row]
            continue
        if held and (len(held) == BLOCK_ITEMS or size + len(row[1]) > BLOCK_BYTES):
            count += 1
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held or not count:
        yield held


def _search(sent, edit_percent: int, recall: float, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, edit_percent, recall, min_words)
        for batch in batches:
            if not items.words:
                continue
            keys = batch.column(0).to_pylist()
            found = [(keys[number], *row) for number, *row in matches(items, texts_of(batch, 1))]
            if found:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    return run


def matches(items: Items, texts: Iterable[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Number of the text, ``item_id, edits, item_words, start, end``; texts with candidates are embedded together."""
    held: list[tuple] = []
    lanes = 0
    for number, (text, words, first, last) in enumerate(hashed_texts(texts, IS_PLAIN)):
        starts, lengths = items.windows(words)
        if len(starts):
            held.append((number, text, words, first, last, starts, lengths))
            lanes += len(starts) * items.times
            if lanes >= LANES:
                yield from _compared(items, held)
                held, lanes = [], 0
    if held:
        yield from _compared(items, held)


def _compared(items: Items, held: list[tuple]) -> Iterator[tuple[int, int, int, int, int, int]]:
    begins = np.cumsum([0] + [len(h[2]) for h in held])
    owner = np.repeat(np.arange(len(held)), [len(h[5]) for h in held])
    starts, lengths = np.concatenate([h[5] for h in held]), np.concatenate([h[6] for h in held])
    keys = items.signatures(
        np.concatenate([h[2] for h in held]), starts + begins[owner], lengths, begins[owner + 1]
    )
    low = np.searchsorted(items.keys, keys, "left")
    hit = low < len(items.keys)
    hit[hit] = items.keys[low[hit]] == keys[hit]
    candidates: dict[tuple[int, int], set[int]] = {}
    for w, at in zip(np.nonzero(hit)[0].tolist(), low[hit].tolist(), strict=True):
        key = items.keys[at]
        while at < len(items.keys) and items.keys[at] == key:
            candidates.setdefault((int(owner[w]), int(items.owner[at])), set()).add(int(starts[w]))
            at += 1
    for (h, item), places in sorted(candidates.items()):
        number, text, words, first, last = held[h][:5]
        n, k = int(items.lengths[item]), int(items.edits[item])
        best = None
        covered = -1
        for s in sorted(places):
            if s < covered:
                continue  # within the stretch already compared
            covered = s + 2 * k + 1
            a, b = max(0, s - k), min(len(words), s + n + 4 * k + 1)
            edits, x, y = edit_match(items.words[item], words[a:b])
            if edits <= k and y > x and (best is None or edits < best[0]):
                best = edits, a + x, a + y
        if best is not None:
            start, end = int(first[best[1]]), int(last[best[2] - 1])
            begin = len(text[:start].decode(errors="ignore"))
            yield number, items.ids[item], best[0], n, begin, begin + len(text[start:end].decode(errors="ignore"))
