"""Pairs of names that may be alike enough, found by what their words' trigrams allow.

A name's marks are the distinct trigrams of its words, each with a blank at both ends; they don't depend on the words' order. An edit
changes three of them at most, so names that share few marks are many edits apart, and their likeness is bounded. A task compares the
marks of a block of names asked for with those of a block of names, as sets of bits: all pairs, a few nanoseconds each. What `near`
gives holds every pair of the likeness asked for, and others, which the likeness itself sorts out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import by_block

#: Names asked for and names that meet in one cell; what marks are hashed to, and bits that stand for these (fewer than a byte counts).
ASKED_BLOCK, NAMED_BLOCK, HASHES, BITS = 8192, 32_768, 65_536, 255
#: Blocks of names at least, if they are long enough.
SIDE = 16
#: Pairs that a task gives at once, bounds by length and marks that it keeps, names of the most marks that a cell gives, of so many tried.
GIVEN, KEPT, FIRST, TRIED = 1 << 17, 512, 4, 64


def marks(words: Column) -> Column:
    """The distinct trigrams of each word with a blank at both ends."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def marked(own: Column) -> list[Column]:
    return [F.size(own).alias("n_marks"), F.transform(own, lambda g: F.pmod(F.xxhash64(g), F.lit(HASHES)).cast("int")).alias("marks")]


def least_shared(size: int, n: int, base: int, least: float, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many marks a name of `size` letters and n marks shares at least with one of `sizes` letters and `counts` marks, if their
    weighted likeness is `least` (0 to 1) or more; `base` at least. k edits cost 3 k marks, a stretch cut out of a name has two new ones."""
    edits = lambda most: 3 * np.floor(most + 1e-9).astype(np.int64)
    short, long = np.minimum(size, sizes), np.maximum(size, sizes)
    whole = np.maximum(n, counts) - edits((1 - least) * np.minimum(long, short / least))
    common = np.minimum(n - edits(np.float64(size * (1 - least / 0.95))), counts - edits(sizes * (1 - least / 0.95)))
    stretch = np.where(size <= sizes, n, counts) - 2 - edits(short * (1 - least / 0.9))
    return np.maximum(base, np.minimum(np.minimum(whole, common), stretch))


class Marked:
    """Names of a cell: their numbers, lengths and marks, those as hashes and as sets of bits."""

    def __init__(self, table: pa.Table):
        self.no, self.size, self.n = (table.column(c).to_numpy() for c in ("no", "size", "n_marks"))
        lists = table.column("marks").combine_chunks()
        self.flat, self.start = lists.flatten().to_numpy(), np.cumsum(self.n) - self.n
        sets = np.zeros((len(self.no), 256), bool)
        sets[np.repeat(np.arange(len(self.no)), self.n), self.flat % BITS] = True
        self.bits = np.packbits(sets, axis=1, bitorder="little").view("<u8")

    def marks(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.n[i]]


class Given(Marked):
    """Names compared with, by length and number of marks, and how many marks one asked for must share with them."""

    def __init__(self, table: pa.Table):
        super().__init__(table.sort_by([("size", "ascending"), ("n_marks", "ascending")]))
        starts = np.flatnonzero(np.r_[True, (np.diff(self.size) != 0) | (np.diff(self.n) != 0)])
        self.sizes, self.counts, self.repeats, self.bounds = self.size[starts], self.n[starts], np.diff(np.r_[starts, len(self.n)]), {}
        self.columns, self.asked = np.ascontiguousarray(self.bits.T), np.zeros(HASHES, bool)
        self.both, self.count, self.total = np.empty(len(self.n), np.uint64), np.empty(len(self.n), np.uint8), np.empty(len(self.n), np.uint8)

    def bound(self, size: int, n: int, base: int, least: float) -> tuple[int, int, np.ndarray]:
        """From where to where names can be near enough, and the marks that each of them must share."""
        kind = size, n, base, least
        if kind not in self.bounds:
            if len(self.bounds) >= KEPT:
                self.bounds.clear()
            need = least_shared(size, n, base, least, self.sizes, self.counts)
            within = np.flatnonzero(np.repeat(need <= np.minimum(n, self.counts), self.repeats))
            x, y = (int(within[0]), int(within[-1]) + 1) if len(within) else (0, 0)
            self.bounds[kind] = x, y, np.repeat(np.clip(need, 0, BITS), self.repeats)[x:y].astype(np.uint8)
        return self.bounds[kind]

    def at_most(self, bits: np.ndarray, marks: np.ndarray, alike: int, x: int, y: int) -> np.ndarray:
        """As many marks as a name and those from x to y share by their bits: never too few, up to BITS. `alike` marks have another's bit."""
        both, count, total = self.both[x:y], self.count[x:y], self.total[x:y]
        np.bitwise_count(np.bitwise_and(self.columns[0, x:y], bits[0], out=both), out=total)
        for column, b in zip(self.columns[1:], bits[1:], strict=True):
            np.bitwise_count(np.bitwise_and(column[x:y], b, out=both), out=count)
            np.add(total, count, out=total)
        places, times = np.unique(marks % BITS, return_counts=True) if alike else (marks[:0], marks[:0])
        for place, more in zip(places[times > 1].tolist(), (times[times > 1] - 1).tolist(), strict=True):
            has = np.bitwise_and(self.columns[place >> 6, x:y], np.uint64(1 << (place & 63)), out=both) != 0
            total[:] = np.minimum(total + more * has.astype(np.int64), BITS) if len(marks) > BITS else total + np.uint8(more) * has
        return total

    def shared(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many marks a name shares with those at some places, up to equal hashes."""
        self.asked[marks] = True
        n = self.n[at]
        ends = np.cumsum(n)
        hits = self.asked[self.flat[np.arange(ends[-1] if len(at) else 0) + np.repeat(self.start[at] - ends + n, n)]]
        self.asked[marks] = False
        return np.diff(np.r_[0, np.cumsum(hits)][np.r_[0, ends]])


def compared(batches) -> Iterator[pa.RecordBatch]:
    """(q, no, shared) of a cell's pairs that may be alike enough. Rows: no, size, n_marks, marks; base and least, null for the names
    compared with. Where least is null, the FIRST names that share the most marks are given."""
    for _, table in by_block(batches, ("_p", "_q")):
        asks = table.column("base").is_valid().combine_chunks()
        asked, rest = table.filter(asks), table.filter(pc.invert(asks))
        if not asked.num_rows or not rest.num_rows:
            continue
        base, least = asked.column("base").to_numpy(), asked.column("least").fill_null(0).to_numpy()
        own, given, held, waiting = Marked(asked), Given(rest), [], 0
        alike = own.n - np.bitwise_count(own.bits).sum(1)
        for i in range(asked.num_rows):
            marks = own.marks(i)
            if least[i] > 0:
                x, y, need = given.bound(int(own.size[i]), int(own.n[i]), int(base[i]), float(least[i]))
                if x == y:
                    continue
                at = np.flatnonzero(given.at_most(own.bits[i], marks, int(alike[i]), x, y) >= need)
                if not len(at):
                    continue
                shared = given.shared(marks, x + at)
                keep = shared >= need[at]
                at, shared = x + at[keep], shared[keep]
            else:
                most = given.at_most(own.bits[i], marks, int(alike[i]), 0, len(given.no))
                at = np.flatnonzero(most >= max(int(base[i]), int(most.max()) - 1))[:TRIED]
                shared = given.shared(marks, at)
                best = np.argsort(-shared, kind="stable")[:FIRST]
                at, shared = at[best], shared[best]
            if len(at):
                held.append((np.full(len(at), own.no[i]), given.no[at], shared.astype(np.int32)))
                waiting += len(at)
            if waiting >= GIVEN:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["q", "no", "shared"])
                held, waiting = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["q", "no", "shared"])


def near(asked: DataFrame, named: DataFrame) -> DataFrame:
    """(q, no, shared): every pair of weighted likeness `least` or more that shares `base` marks, and others. Where `least` is null: a few
    names that share the most marks.

    asked: q, size (letters), n_marks, marks (hashes), base (1 or more), least (0 to 100); named: no, size, n_marks, marks."""
    columns = ["no", "size", "n_marks", "marks"]
    p, n = max(1, math.ceil(asked.count() / ASKED_BLOCK)), named.count()
    q = max(1, math.ceil(n / NAMED_BLOCK), min(SIDE, n // 2048))
    block = lambda blocks: F.pmod(F.xxhash64("no", F.lit(5)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # scores are rounded, so one a little below may count
    left = asked.withColumnRenamed("q", "no").select(*columns, F.col("base").cast("int").alias("base"), F.when(F.col("least").isNotNull(), F.greatest(F.col("least") / 100 - 1e-6, F.lit(1e-9))).alias("least"), block(p).alias("_p"), every(q).alias("_q"))
    right = named.select(*columns, F.lit(None).cast("int").alias("base"), F.lit(None).cast("double").alias("least"), every(p).alias("_p"), block(q).alias("_q"))
    cells = left.unionByName(right).repartition(min(4096, 2 * p * q), "_p", "_q").sortWithinPartitions("_p", "_q")
    return cells.mapInArrow(compared, "q long, no long, shared int")
