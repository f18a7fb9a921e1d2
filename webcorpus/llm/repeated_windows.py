"""Removal of repeated byte windows: every byte covered by a 400-byte string that also starts somewhere else.

A depth-limited radix sort over the suffixes that can matter, which moves runs of neighbouring suffixes instead of single ones.
Texts equal as a whole are one text with a count first: all their windows repeat. Each window has an anchor, a winnowed 32-byte
string: the leftmost smallest fingerprint among the 369 that lie inside it. Equal windows have equal anchors at equal offsets,
so the windows of one anchor's occurrence are a run of offsets, and a window whose anchor occurs once anywhere is unique.

A pass takes runs of offsets in blocks of ``BLOCKS[k]`` offsets (512, which is all, then 64, 8 and 1) and groups them twice:
by the bytes that every window of the block holds (its core), and by all bytes that the run's windows cover. A core that
occurs once holds no repeated window. Runs equal in all bytes repeat as a whole, in one row; one of them stays as their witness,
weighed by their number. What is left, cores shared by different runs of which some is not settled, is cut into the
blocks of the next pass; at one offset a block the core is the 400 bytes themselves, so nothing stays open. Near copies
cost a few rows for each edge between equal and different bytes, not one for each window. A hot passage held by a third of
all texts is a hot group: every pass is a partial aggregate, then a join of rows to one row per kept group.

Strings are compared by 64-bit fingerprints (polynomial hashes with a finalizer): two different windows fall together only if
those collide. Texts lie in a table bucketed by name, so that no pass moves them; they are read in chunks of ``CHUNK`` bytes
with 399 bytes of overlap, so a very long text takes bounded memory in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.session import new_folder, written

# Fixed values of the contract.
WINDOW = 400

ANCHOR = 32  # bytes of an anchor
BLOCKS = (512, 64, 8, 1)  # offsets of a block, pass by pass: the first holds all, the last one
CHUNK = 1 << 20  # window starts handled at once in Python
BASE = 0x100000001B3  # odd, so invertible modulo 2^64
BASE_INV = pow(BASE, -1, 1 << 64)
LOW32 = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, so that all bits of a polynomial hash take part."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    steps = [np.full(n, base, np.uint64) for base in (BASE, BASE_INV)]
    for step in steps:
        step[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``prints`` needs of ``data``: sums of its polynomial up to every place, and inverse powers."""
    n = len(data)
    with np.errstate(over="ignore"):
        powers, inverses = power_tables(1 << max(16, n.bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data * powers[:n], out=sums[1:])
    return sums, inverses


def prints(sums: np.ndarray, inverses: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of ``data[start : end]`` for every pair (uint64, wrapping). Lengths are not part of it."""
    with np.errstate(over="ignore"):
        return mixed((sums[end] - sums[start]) * inverses[start])


def fingerprints(data: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of ``data[i : i + length]`` for every ``i`` from 0 to ``len(data) - length``."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64)
    sums, inverses = prefix_sums(data)
    with np.errstate(over="ignore"):
        return mixed((sums[length:] - sums[: n - length + 1]) * inverses[: n - length + 1])


def named(print_: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A fingerprint together with two small numbers, as int64."""
    with np.errstate(over="ignore"):
        return mixed(print_ ^ mixed(x.astype(np.uint64) * np.uint64(1 << 20) + y.astype(np.uint64) + np.uint64(1))).view(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``x[i : i + w]`` for every ``i``, in linear time (blocks of ``w`` with running minima both ways)."""
    n = len(x)
    pad = (-n) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def chunks(data: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first, anchors, starts, ends)`` per chunk: window starts ``first + starts[j] .. first + ends[j]`` (inclusive) have
    their anchor at ``first + anchors[j]``. Only texts of at least ``WINDOW`` bytes have windows."""
    n = len(data)
    for first in range(0, max(n - WINDOW + 1, 0), chunk):
        part = data[first : min(n, first + chunk + WINDOW - 1)]
        keys = ((fingerprints(part, ANCHOR) >> np.uint64(32)) << np.uint64(32)) | np.arange(len(part) - ANCHOR + 1, dtype=np.uint64)
        anchor = (sliding_min(keys, WINDOW - ANCHOR + 1) & LOW32).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        starts = np.concatenate([[0], cut])
        ends = np.concatenate([cut - 1, [len(anchor) - 1]])
        yield first, anchor[starts], starts, ends


RUNS = pa.schema(
    [("tid", pa.binary()), ("a", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("w", pa.int64()), ("core", pa.int64()), ("bytes", pa.int64())]
)
RUN_COLUMNS = "tid binary, a long, lo long, hi long, w long, core long, bytes long"


def batch_of_runs(tid: bytes, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tid] * len(columns[0]), pa.binary()), *map(pa.array, columns)], schema=RUNS)


def anchors(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The runs of the first pass, one per occurrence of an anchor, of ``texts(tid, data binary)``.

    A run ``tid, a, lo, hi, w, core, bytes`` is the windows that start ``lo`` to ``hi`` bytes before the anchor at ``a``, with a name
    of what they all hold (here the anchor) and one of all they cover. ``w`` counts the runs it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(blob, np.uint8)
                last: tuple | None = None  # the run at the end of the chunk, which may go on in the next
                for first, at, starts, ends in chunks(data, chunk):
                    s, e, at = first + starts, first + ends, first + at
                    if last is not None:
                        if last[0] == at[0]:
                            # An anchor on both sides of a chunk's edge is one occurrence: its intervals meet.
                            s[0] = last[1]
                        else:
                            yield from runs_of(tid, data, *(np.array([x]) for x in last))
                    yield from runs_of(tid, data, at[:-1], s[:-1], e[:-1])
                    last = (at[-1], s[-1], e[-1])
                if last is not None:
                    yield from runs_of(tid, data, *(np.array([x]) for x in last))

    def runs_of(tid: bytes, data: np.ndarray, at: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            begin = int(s[0])
            sums = prefix_sums(data[begin : int(e[-1]) + WINDOW])
            core = prints(*sums, at - begin, at + ANCHOR - begin).view(np.int64)
            covered = named(prints(*sums, s - begin, e + WINDOW - begin), at - e, at - s)
            yield batch_of_runs(tid, at, at - e, at - s, np.ones(len(at), np.int64), core, covered)

    return texts.mapInArrow(run, RUN_COLUMNS)


def cut_runs(texts: DataFrame, kept: DataFrame, block: int, chunk: int = CHUNK) -> DataFrame:
    """The runs of a later pass: those of ``kept(tid, spans array<struct<a, lo, hi, w>>)`` cut at multiples of ``block``.

    The core of a block is what any window of it holds, whether or not the run has all its offsets, so runs of different
    length meet in it. It lies in the text wherever one such window does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tid, data = batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_py(), np.uint8)
                spans = batch.column(2)[i].values.flatten()
                a, lo, hi, w = (x.to_numpy(zero_copy_only=False) for x in spans)
                order = np.argsort(a, kind="stable")
                part = (a[order] - a[order[0]]) // chunk
                for these in np.split(order, np.flatnonzero(np.diff(part)) + 1):
                    yield cut(tid, data, a[these], lo[these], hi[these], w[these])

    def cut(tid: bytes, data: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        count = hi // block - lo // block + 1
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo // block, count)
        a, lo, hi, w = (np.repeat(x, count) for x in (a, lo, hi, w))
        lo, hi = np.maximum(lo, k * block), np.minimum(hi, k * block + block - 1)
        begin = int((a - hi).min())
        sums = prefix_sums(data[begin : int(np.maximum(a - lo + WINDOW, a + ANCHOR).max())])
        at = a - begin
        held = prints(*sums, at - k * block, at - (k + 1) * block + 1 + WINDOW)
        core = named(held ^ mixed(prints(*sums, at, at + ANCHOR)), k, np.zeros_like(k))
        covered = named(prints(*sums, at - hi, at - lo + WINDOW), lo, hi)
        return batch_of_runs(tid, a, lo, hi, w, core, covered)

    return texts.join(kept.hint("shuffle_hash"), "tid").select("tid", "data", "spans").mapInArrow(run, RUN_COLUMNS)


def settle(runs: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """``(repeated, open)`` of a pass: ``tid, s, e`` of window starts found to repeat, and the runs to be cut further.

    A core that occurs once leaves at once. Of runs equal in all bytes one goes on as witness, the others end here; a core goes on
    if different runs share it and one of them is alone of its kind.
    """
    # Counts are written before they are joined: the join then has a shuffle on both sides, and a hot core's rows are split.
    often = written(runs.groupBy("core").agg(F.sum("w").alias("_n")).where("_n > 1").select("core"), "window-cores")
    shared = written(runs.join(often, "core", "left_semi"), "window-shared")
    row = F.xxhash64("tid", "a")
    kinds = written(shared.groupBy("core", "bytes").agg(F.sum("w").alias("all"), F.min(row).alias("one")), "window-kinds")
    judged = shared.join(kinds, ["core", "bytes"]).select("tid", "a", "lo", "hi", "w", "core", "all", (row == F.col("one")).alias("one"))
    # Rows neither found to repeat here nor going on are witnesses found before.
    judged = written(judged.where("one or w < all"), "window-judged")
    repeated = judged.where("w = 1 and all > 1").select("tid", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo")).alias("e"))
    if last:
        return repeated, None
    witnesses = judged.where("one").select("tid", "a", "lo", "hi", F.col("all").alias("w"), "core")
    mixed_ = witnesses.groupBy("core").agg(F.count("*").alias("_n"), F.min("w").alias("_least")).where("_n > 1 and _least = 1")
    return repeated, witnesses.join(written(mixed_.select("core"), "window-mixed"), "core", "left_semi").drop("core")


def bucketed_texts(docs: DataFrame) -> DataFrame:
    """``tid, data, copies``: distinct texts, bucketed by name, so that no later join on ``tid`` moves them.

    Copies are dropped in each task before the shuffle. There are ``spark.sql.shuffle.partitions`` buckets, so that the
    writer takes the rows as the aggregate dealt them.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "window-texts")
    name = "window_texts_" + folder.rsplit("-", 1)[-1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.groupBy("tid").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    texts.write.bucketBy(buckets, "tid").sortBy("tid").option("path", folder).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``.

    Bytes are the UTF-8 of the text (null: empty). A byte is removed when a 400-byte window covering it starts elsewhere too,
    in the same text or another one, overlaps included; windows are judged on the input. ``n_spans`` counts maximal removed
    runs, ``kept_sha256`` hashes the remaining bytes. Equal rows are copies of each other, so a text of at least 400 bytes that
    occurs twice loses everything. Texts under 400 bytes keep everything. Null keys stay rows with a null ``doc_id``; other
    columns are not read. An empty table gives an empty result. A text is named by the first 16 bytes of its SHA-256.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = lambda blob: F.unhex(F.substring(F.sha2(blob, 256), 1, 32))
    rows = docs.select(F.col(key).alias("doc_id"), name(data).alias("tid"))
    texts = bucketed_texts(docs.select(name(data).alias("tid"), data.alias("data")))
    runs = written(anchors(texts.where(F.length("data") >= WINDOW).select("tid", "data"), chunk), "window-runs")
    starts, open_ = settle(runs, last=False)
    for block in BLOCKS[1:]:
        kept = open_.groupBy("tid").agg(F.collect_list(F.struct("a", "lo", "hi", "w")).alias("spans"))
        runs = written(cut_runs(texts, kept, block, chunk), "window-runs")
        repeated, open_ = settle(runs, last=block == BLOCKS[-1])
        starts = starts.unionByName(repeated)
    # Gaps and islands over intervals of repeated window starts: a run ends where the next start lies beyond every window so far.
    by_text = Window.partitionBy("tid").orderBy("s", "e")
    reach = F.max("e").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    runs = starts.select("tid", "s", "e", F.coalesce(F.col("s") - reach > WINDOW, F.lit(True)).alias("_new"))
    runs = runs.select("tid", "s", "e", F.sum(F.col("_new").cast("int")).over(by_text.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    spans = runs.groupBy("tid", "_run").agg(F.min("s").alias("s"), (F.max("e") + WINDOW).alias("e"))
    spans = spans.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("s"), F.length("data").cast("bigint").alias("e")))
    judged = texts.join(spans.hint("shuffle_hash"), "tid", "left").select(
        "tid", "data",
        F.when((F.col("copies") > 1) & (F.length("data") >= WINDOW), whole)
        .otherwise(F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>"))).alias("spans"),
    )
    kept_bytes = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(b"").cast("binary").alias("out")),
        lambda acc, r: F.struct(r["e"].alias("at"), F.concat(acc["out"], F.substring("data", acc["at"] + 1, r["s"] - acc["at"])).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring("data", acc["at"] + 1, F.length("data") - acc["at"])),
    )
    judged = judged.select(
        "tid", F.length("data").cast("bigint").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, r: n + r["e"] - r["s"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2(kept_bytes, 256).alias("kept_sha256"),
    )
    # Written, so that a text that many rows hold can be split in the join.
    return rows.join(written(judged, "window-results"), "tid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """``(n_bytes, n_removed, n_spans, kept_sha256)`` per text, straight from the rule: for tests."""
    blobs = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for blob in blobs:
        for i in range(len(blob) - WINDOW + 1):
            window = hashlib.sha256(blob[i : i + WINDOW]).digest()
            seen[window] = seen.get(window, 0) + 1
    out = []
    for blob in blobs:
        removed = bytearray(len(blob))
        for i in range(len(blob) - WINDOW + 1):
            if seen[hashlib.sha256(blob[i : i + WINDOW]).digest()] > 1:
                removed[i : i + WINDOW] = b"\x01" * WINDOW
        spans = sum(1 for i in range(len(blob)) if removed[i] and (i == 0 or not removed[i - 1]))
        kept = bytes(b for b, r in zip(blob, removed, strict=True) if not r)
        out.append((len(blob), sum(removed), spans, hashlib.sha256(kept).hexdigest()))
    return out
