"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, sorted-array intersection.

Candidates. Two sets that link share l members of their prefixes: with ``n`` members and similarity t, the first
``n - ceil(t n) + l`` in any order that all sets follow. The order here puts frequent n-grams last, so passages that many
documents share seldom are in a prefix. A frequency only moves an n-gram in the order; it never decides a link. l grows with
n, so that a few common passages don't make a candidate; sets that share too few members with any others are left out.

Tiles. Each set meets the smallest set of the size band that it shares most prefix members with; what hangs together by such
meetings is a tile, if it isn't too large for a task, else each set's meeting is. A set that meets none and is met by none is in
no tile; all its pairs are left to the rest. A tile compares bitmaps of member parities: bits that differ bound the overlap from above, and only what passes is intersected. Sets
already in one component aren't compared again, so a group of g copies costs g comparisons, not g^2.

The rest. Pairs with a common prefix member that no tile has seen and whose components differ are compared by bitmap, then
exactly. Nothing is capped: every pair of sets that can link is either compared or known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.components import components
from webcorpus.llm.words import hashed_texts, mix, ngram_hashes, released, texts_of
from webcorpus.operators.joins import broadcast_if_small
from webcorpus.session import Scratch, written

FREQUENT_LOCAL = 4  # a task reports n-grams that so many of the sets it has seen hold
FREQUENT_MOST = 200_000  # so many n-grams are put last in the order; a bound of what tasks are sent (1.6 MB)
FREQUENT_FLUSH = 500_000  # n-grams counted together in a task
SHARED_PERCENT = 3  # of a set's members that it has to share within the prefixes
TILE_MEMBERS, TILE_NGRAMS = 8_000, 2_000_000  # a larger tile is dealt over several, each with the smallest set
BITMAP_MOST = 1 << 15  # bits of the largest signature
SURVIVOR_BITS = 1 << 20  # slots of the filter that finds the texts of candidates again


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, one without words has none."""
    if 0 < len(words) < n:
        return mix(ngram_hashes(words, len(words)) + np.uint64(len(words)))
    found = np.sort(ngram_hashes(words, n))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def set_id(members: np.ndarray) -> int:
    """Identifier of a set, the same for equal sets."""
    return int(mix(np.array([mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(members))]))[0].view(np.int64))


def parity_bitmap(members: np.ndarray, bits: int) -> np.ndarray:
    """Bit i tells whether an odd number of members hashes to i."""
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def bitmap_bits(n: int) -> int:
    return min(BITMAP_MOST, max(64, 1 << (2 * n - 1).bit_length()))


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap with which sets of these sizes link: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def least_shared(n: int | Column) -> int | Column:
    """Prefix members that a set of ``n`` shares with any larger or equal one that it links with."""
    return 1 + (n * SHARED_PERCENT // 100 if isinstance(n, int) else F.floor(n * SHARED_PERCENT / 100))


class Tile:
    """Links among the sets of one tile, as a forest."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets, self.percent = [ids[i] for i in order], [sets[i] for i in order], percent
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        bits = bitmap_bits(int(self.sizes.max()))
        self.bitmaps = np.stack([parity_bitmap(s, bits) for s in self.sets])
        self.part = np.arange(len(self.ids))

    def edges(self) -> Iterator[tuple[int, int]]:
        sizes, part, percent = self.sizes, self.part, self.percent
        for i in range(len(self.ids) - 1):
            end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
            others = i + 1 + np.flatnonzero(part[i + 1 : end] != part[i])
            if not len(others):
                continue
            least = needed(sizes[i], sizes[others], percent)
            differ = np.bitwise_count(self.bitmaps[others] ^ self.bitmaps[i]).sum(1, dtype=np.int64)
            possible = (sizes[i] + sizes[others] - differ) // 2 >= least
            others, least = others[possible], least[possible]
            if not len(others):
                continue
            linked = others[overlaps(self.sets[i], [self.sets[j] for j in others]) >= least]
            for p in np.unique(part[linked]):
                part[part == p] = part[i]
        roots: dict[int, int] = {}
        for p, one in zip(part.tolist(), self.ids, strict=True):
            roots[p] = min(roots.get(p, one), one)
        return ((one, roots[p]) for p, one in zip(part.tolist(), self.ids, strict=True) if one != roots[p])


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with other non-empty ones."""
    members = np.concatenate(others)
    at = np.searchsorted(one, members)
    at[at == len(one)] = 0
    return np.add.reduceat(one[at] == members, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _batch(names: list[str], *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _sets(n: int):
    """Rows ``doc_id, n_shingles, set_id``, and ``n_shingles`` as a count with ``ngram`` for locally frequent ones."""
    names = ["doc_id", "n_shingles", "set_id", "ngram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT_LOCAL
            values, counts = values[often].view(np.int64), counts[often].astype(np.int64)
            none = pa.nulls(len(values), pa.int64())
            return _batch(names, none, counts, none, values)

        for batch in batches:
            sizes, ids = [], []
            for _, words, _, _ in hashed_texts(texts_of(batch, 1)):
                members = shingles(words, n)
                sizes.append(len(members))
                ids.append(set_id(members) if len(members) else None)
                held.append(members)
                count += len(members)
                if count >= FREQUENT_FLUSH:
                    yield frequent()
                    held, count = [], 0
            rows = pa.nulls(batch.num_rows, pa.int64())
            yield _batch(names, batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), rows)
        if held:
            yield frequent()

    return run, "doc_id bigint, n_shingles bigint, set_id bigint, ngram bigint"


def _prefixes(n: int, percent: int, last: np.ndarray):
    """Rows ``ngram, n, set_id, first``: prefix members; ``first`` where the set may be the smaller one of a pair."""
    names = ["ngram", "n", "set_id", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task: copies give their prefix once
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, int]] = []
            for _, words, _, _ in hashed_texts(texts_of(batch, 1)):
                members = shingles(words, n)
                size = len(members)
                if not size or (one := set_id(members)) in seen:
                    continue
                seen.add(one)
                if len(last):
                    at = np.searchsorted(last, members)
                    at[at == len(last)] = 0
                    often = last[at] == members
                    members = np.concatenate([members[~often], members[often]])
                prefix = size - -(-percent * size // 100) + least_shared(size)
                out.append((members[:prefix], size, one, size - needed(size, size, percent) + least_shared(size)))
            for i in range(0, len(out), 50):
                some = out[i : i + 50]
                lengths = [len(x[0]) for x in some]
                yield _batch(
                    names,
                    np.concatenate([x[0] for x in some]).view(np.int64),
                    np.repeat(np.array([x[1] for x in some], np.int32), lengths),
                    np.repeat(np.array([x[2] for x in some], np.int64), lengths),
                    np.concatenate([np.arange(k) < x[3] for k, x in zip(lengths, some, strict=True)]),
                )

    return run, "ngram bigint, n int, set_id bigint, first boolean"


def _shared(percent: int):
    """Of rows sorted by n-gram, size and set: those whose n-gram several sets hold, with the smallest set to meet.

    Streams: what is kept between batches is one n-gram's last row and meeting point.
    """
    names = ["ngram", "n", "set_id", "first", "meet"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # last row of the last batch, not yet given out
        meet: tuple[int, int] | None = None  # size and set of the meeting point of its n-gram
        inside = False  # whether an earlier row of its n-gram has been given out
        for batch in batches:
            table = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                table = [np.concatenate([np.array([h], t.dtype), t]) for h, t in zip(held, table, strict=True)]
            gram, size, one, first = table
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (one[1:] != one[:-1])])  # copies from other tasks
            gram, size, one, first = (t[new] for t in table)
            end = len(gram) - 1
            same = np.concatenate([gram[1:] == gram[:-1], [False]])  # as the next row
            keep = same | np.concatenate([[inside], same[:-1]])
            at = np.flatnonzero(keep[:end])
            meets = []
            lead = None if not inside else int(gram[0])
            for g, s, o, f in zip(gram[at].tolist(), size[at].tolist(), one[at].tolist(), first[at].tolist(), strict=True):
                if g != lead:
                    lead, meet = g, None
                if meet is not None and 100 * meet[0] < percent * s:
                    meet = None
                meets.append(meet[1] if meet else None)
                if meet is None and f:
                    meet = (s, o)
            if len(at):
                yield _batch(names, gram[at], size[at], one[at], first[at], pa.array(meets, pa.int64()))
            held = (gram[end], size[end], one[end], first[end])
            inside = bool(same[end - 1]) if end else inside
        if held is not None and inside:
            if meet is not None and 100 * meet[0] < percent * held[1]:
                meet = None
            yield _batch(names, *[np.array([h]) for h in held], pa.array([meet[1] if meet else None], pa.int64()))

    return run, "ngram bigint, n int, set_id bigint, first boolean, meet bigint"


def _members(n: int):
    names = ["doc_id", "set_id", "members", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                sets = [shingles(words, n) for _, words, _, _ in hashed_texts(texts_of(part, 1))]
                ids = [set_id(s) if len(s) else None for s in sets]
                maps = [parity_bitmap(s, bitmap_bits(len(s))).tobytes() if len(s) else b"" for s in sets]
                yield _batch(names, part.column(0), pa.array(ids, pa.int64()), [s.tobytes() for s in sets], maps)

    return run, "doc_id bigint, set_id bigint, members binary, bitmap binary"


def _tile_edges(percent: int):
    def run(table: pa.Table) -> pa.Table:
        found = {i: m for i, m in zip(table["set_id"].to_pylist(), table["members"].to_pylist(), strict=True)}
        tile = Tile(list(found), [np.frombuffer(m, np.uint64) for m in found.values()], percent)
        edges = list(tile.edges())
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run, "a bigint, b bigint"


def _bounded(percent: int):
    """Pairs whose bitmaps leave a link possible; bitmaps of different lengths are folded to the shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: batch.column(k).to_pylist() for k in range(batch.num_columns)}
            keep = []
            for size_a, size_b, map_a, map_b in zip(rows[2], rows[3], rows[4], rows[5], strict=True):
                x, y = sorted((np.frombuffer(map_a, np.uint64), np.frombuffer(map_b, np.uint64)), key=len)
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                differ = int(np.bitwise_count(x ^ y).sum())
                keep.append((size_a + size_b - differ) // 2 >= needed(size_a, size_b, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run, "a bigint, b bigint"


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                keep.append(int(overlaps(x, [y])[0]) >= needed(len(x), len(y), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run, "a bigint, b bigint"


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row per row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their sets of word n-grams; ``component_id`` is the
    smallest key that links reach. A null, empty or blank text has no set and links with nothing (its own key is its
    component), one with fewer than ``n`` words is one n-gram of them all. Equal sets are one class from the start, whatever
    their number. Repeated rows stay rows. A null key takes part; it gets the smallest key of its component, if any.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    rows = written(texts.mapInArrow(*_released(_sets(n))), "ngram-sets")
    sets = rows.where("ngram IS NULL").select("doc_id", "n_shingles", "set_id")
    with Scratch(spark, "ngram-join") as scratch:
        often = rows.where("ngram IS NOT NULL").groupBy("ngram").agg(F.sum("n_shingles").alias("n"))
        last = often.orderBy(F.desc("n"), "ngram").limit(FREQUENT_MOST).select("ngram").toArrow()["ngram"]
        last = np.sort(last.to_numpy().astype(np.int64).view(np.uint64))
        prefixes = texts.mapInArrow(*_released(_prefixes(n, percent, last)))
        dealt = prefixes.repartition("ngram").sortWithinPartitions("ngram", "n", "set_id")
        shared = scratch.write(dealt.mapInArrow(*_released(_shared(percent))))
        # A partner may be smaller by the band, and then asks for less.
        enough = F.count(F.lit(1)) >= least_shared(F.ceil(F.max("n") * percent / 100))
        able = shared.groupBy("set_id").agg(enough.alias("able")).where("able").select("set_id")
        dealt = shared.drop("meet").join(broadcast_if_small(able), "set_id", "left_semi").select("ngram", "n", "set_id", "first")
        dealt = dealt.repartition("ngram").sortWithinPartitions("ngram", "n", "set_id")
        shared = scratch.write(dealt.mapInArrow(*_released(_shared(percent))))

        # Each set meets the smallest set of most of its shared prefix members; sets that meet, directly or not, are a tile.
        met = scratch.write(shared.groupBy("set_id").agg(F.max("n").alias("n"), F.mode("meet", True).alias("meet")))
        meets = met.where("meet IS NOT NULL")
        trees = components(meets.select(F.col("set_id").alias("a"), F.col("meet").alias("b")), scratch)
        trees = trees.union(trees.select("root", "root").distinct()).withColumnRenamed("node", "set_id")
        placed = met.join(trees, "set_id")
        fits = (F.count(F.lit(1)) <= TILE_MEMBERS) & (F.sum("n") <= TILE_NGRAMS)
        fit = placed.groupBy("root").agg(fits.alias("fits"))
        # Larger tiles are split: by the set that is met, then at random, with that set in each part.
        tile = F.when(F.col("fits"), F.col("root")).otherwise(F.coalesce("meet", "set_id"))
        placed = scratch.write(placed.join(fit, "root").select("set_id", "n", tile.alias("tile")))
        sizes = placed.groupBy("tile").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("ngrams"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("held") / TILE_MEMBERS), F.ceil(F.col("ngrams") / TILE_NGRAMS))
        sizes = scratch.write(sizes.select("tile", parts.cast("int").alias("parts")))
        dealt = placed.join(sizes, "tile").select(
            "tile", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int").alias("part"), "set_id"
        )
        centres = sizes.select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                               F.col("tile").alias("set_id"))
        tiles = scratch.write(dealt.union(centres))

        # All sets that share members, also those in no tile: each may be in a pair of the rest.
        candidates = met.select("set_id")
        # Texts of the candidates are found by a filter of fixed size, so that no other text is moved.
        first = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id"))
        chosen = scratch.write(first.join(candidates, "set_id", "left_semi"))
        slot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("bigint"))), F.lit(SURVIVOR_BITS))
        slots = chosen.select(slot.alias("slot")).distinct()
        again = texts.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
        found = again.mapInArrow(*_released(_members(n))).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
        members = scratch.write(found.join(broadcast_if_small(chosen), ["set_id", "doc_id"], "left_semi").drop("doc_id"))

        held = members.select("set_id", "members").join(broadcast_if_small(tiles), "set_id")
        links = scratch.write(held.groupBy("tile", "part").applyInArrow(*_tile_edges(percent)))
        roots = components(links, scratch)

        # Pairs with a common prefix member that met in no tile and are not connected yet.
        placed = met.select("set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").join(
            dealt, "set_id", "left"
        ).select("set_id", "tile", "part", F.coalesce("root", "set_id").alias("root"))
        here = shared.select("ngram", "n", "set_id", "first").join(placed, "set_id")
        counts = here.groupBy("ngram", "root").agg(F.count(F.lit(1)).alias("held"))
        most = counts.groupBy("ngram").agg(F.max_by("root", F.struct("held", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
        mixed = scratch.write(here.join(most.where("roots > 1"), "ngram").drop("roots"))
        x, y = mixed.where("root <> most").alias("x"), mixed.alias("y")
        apart = (F.col("x.root") != F.col("y.root")) & (
            ~(F.col("x.tile").eqNullSafe(F.col("y.tile")) & F.col("x.part").eqNullSafe(F.col("y.part")))
            | F.col("x.tile").isNull()
        ) & ~F.col("x.tile").eqNullSafe(F.col("y.set_id")) & ~F.col("y.tile").eqNullSafe(F.col("x.set_id"))
        once = (F.col("y.root") == F.col("y.most")) | (F.col("x.set_id") < F.col("y.set_id"))
        low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        band = (100 * low >= percent * high) & F.when(F.col("x.n") < F.col("y.n"), F.col("x.first")).when(
            F.col("x.n") > F.col("y.n"), F.col("y.first")).otherwise(F.col("x.first") | F.col("y.first"))
        pairs = x.join(y, F.col("x.ngram") == F.col("y.ngram")).where(apart & band & once).select(
            F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"), low.alias("low")
        )
        pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"))
        pairs = scratch.write(pairs.where(F.col("shared") >= least_shared(F.col("low"))).select("a", "b"))
        maps = members.select("set_id", (F.octet_length("members") / 8).cast("int").alias("n"), "bitmap")
        a, b = (maps.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"map_{k}")) for k in "ab")
        bounded = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(*_released(_bounded(percent)))
        a, b = (members.select(F.col("set_id").alias(k), F.col("members").alias(f"set_{k}")) for k in "ab")
        more = bounded.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(*_released(_linked(percent)))
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
        classes = written(components(links, scratch), "ngram-classes")
    smallest = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    rooted = smallest.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "root", F.coalesce("root", "set_id")
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = rooted.select("set_id", "root").join(least, "root").select("set_id", "component_id")
    return sets.join(ids, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _released(made: tuple) -> tuple:
    """A task function and its schema, the function freeing what its task leaves behind (``words.released``)."""
    run, schema = made
    return released(run), schema
