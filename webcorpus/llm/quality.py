"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A text gives two streams: its words in lower case, and their shapes (classes of characters with runs joined, whether the word
repeats the one before, whether its three words occur elsewhere in the text). N-grams of both are hashed into one table. A
feature's value is the root of its share of its stream, so a text's length doesn't matter and its vector is normed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.words import GROUP, IS_WORD, hashed_texts, mix, ngram_hashes, released, texts_of, word_hashes

BITS = 18  # of the table of weights: 2^18 doubles are sent to each task
SAMPLE = 4_000  # labelled texts that the classifier is fitted on at most
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
# Classes of bytes in a shape; other bytes stand for themselves. No class is a separator.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 1, 2, 2, 3
SHAPE[~IS_WORD] = 32
SALTS = [np.uint64(k) for k in (0x51ED270B5C9F11A7, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35, 0xD1B54A32D192ED03)]


def shapes(text: bytes) -> np.ndarray:
    """Hash of the shape of each word."""
    classes = SHAPE[np.frombuffer(text, np.uint8)]
    joined = classes[np.concatenate([[True], classes[1:] != classes[:-1]])] if len(classes) else classes
    return word_hashes(joined.tobytes())[0]


def features(words: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and values of the features of a text."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    three = ngram_hashes(words, 3)
    often = np.zeros(len(words), bool)
    if len(three):
        ordered = np.sort(three)
        repeated = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(repeated):
            at = np.searchsorted(repeated, three)
            at[at == len(repeated)] = 0
            often[: len(three)] = repeated[at] == three
    marked = mix(shape + again.astype(np.uint64) * SALTS[0] + often.astype(np.uint64) * SALTS[1])
    slots, weights = [], []
    for stream, salts in ((words, SALTS[:2]), (marked, SALTS[2:])):
        grams = [mix(ngram_hashes(stream, n) ^ salt) for n, salt in ((1, salts[0]), (2, salts[1]))]
        grams = np.concatenate(grams)
        slots.append(grams & np.uint64((1 << BITS) - 1))
        weights.append(np.full(len(grams), 1 / len(grams)))
    used, place = np.unique(np.concatenate(slots), return_inverse=True)
    return used.astype(np.int64), np.sqrt(np.bincount(place, np.concatenate(weights)))


def featured(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of each text; texts are hashed some at a time."""
    held: list[bytes] = []
    size = 0

    def done() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        all_shapes = shapes(b"\n".join(held))
        at = 0
        for _, words, _, _ in hashed_texts(held):
            yield features(words, all_shapes[at : at + len(words)])
            at += len(words)

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP:
            yield from done()
            held, size = [], 0
    yield from done()


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], epochs: int) -> np.ndarray:
    """Weights, the last one the intercept."""
    rows = list(rows)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        some = z[at]
        shrunk = np.sign(some) * L1 - some
        return np.where(np.abs(some) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for slots, values, label in rows:
            at, x = np.append(slots, 1 << BITS), np.append(values, 1.0)
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(np.arange(len(z)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> np.ndarray:
    """Weights fitted on at most ``sample`` labelled texts, chosen by a hash of their key.

    Keys with null or conflicting labels are left out, as are labels without a document; a key that several documents hold
    is one training row, its smallest text (so the bound is one of rows, not only of keys); without any labelled text all
    weights are zero. Updates follow one another, so one task makes them, on a sample whose size is bounded; its features, not
    its texts, are moved, and the weights (at most 2^18 numbers) come to the driver.
    """
    known = labels.groupBy(labels[key].cast("bigint").alias("doc_id")).agg(
        F.min(label).alias("label"), F.max(label).alias("most")
    ).where("label = most AND label IN (0, 1) AND doc_id IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("label").cast("int").alias("label"))
    texts = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    # One row per key: a key held by many documents is learnt once, from its smallest text, so no key outweighs the bound.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "text", "label")
    made = rows.mapInArrow(released(_feature_rows), "doc_id bigint, label int, slots binary, share binary")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        columns = (table[name].to_pylist() for name in ("slots", "share", "label"))
        rows = ((np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), y) for s, v, y in zip(*columns, strict=True))
        found = ftrl(rows, EPOCHS)
        at = np.flatnonzero(found)
        return pa.table({"slot": at.astype(np.int32), "weight": found[at]})

    made = made.withColumn("order", F.xxhash64(F.col("doc_id") + 1))
    trained = made.groupBy().applyInArrow(train, "slot int, weight double").toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[trained["slot"].to_numpy()] = trained["weight"].to_numpy()
    return weights


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = list(featured(texts_of(batch, 1)))
        slots = pa.array([s.astype(np.int32).tobytes() for s, _ in made], pa.binary())
        share = pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), slots, share], ["doc_id", "label", "slots", "share"])


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1. A null or empty text has the score of the intercept alone.

    Repeated rows, null keys and other columns stay as they are; a column ``score`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = sent.value
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        raw = np.array([w[slots] @ values for slots, values in featured(texts_of(batch, 0))]) + w[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))

    return docs.withColumn("score", score(docs[text]))
