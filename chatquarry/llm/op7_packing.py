"""Best-fit packing by bin completion: the ids of all documents go into as few sequences of at most `capacity` ids as the search finds.

Documents longer than a sequence are cut into pieces of `capacity` ids, the first of which is the shorter rest. Pieces are dealt
into groups of about GROUP pieces, so any number of equal documents spreads over the groups; each group is packed by branch and bound on its multiset of lengths. A group wastes less than a sequence more than the whole would.

Pieces are dealt by a hash of their whole row, so neither null ids nor rows that repeat an id gather in one group.

Defined cases: a null text counts as empty and still has its end id; rows that repeat a doc_id are packed each; an empty table
gives no rows; columns other than the id and the text are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .bpe_cache import encoder, vocabulary_path

GROUP = 2048
#: Bytes of text encoded at a time.
BLOCK = 1 << 20
#: Fillings tried for one sequence, and sequences completed beyond a first descent without a better result before the incumbent stands.
FILLINGS, STEPS = 8, 600


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing on a multiset of lengths (counts[l] pieces of length l): each piece goes where least room is left."""
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    present = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            at = length + int(present[length:].argmax())
            if present[at]:
                content = rooms[at].pop()
                present[at] = bool(rooms[at])
            else:
                at, content = capacity, []
            content.append(length)
            rooms[at - length].append(content)
            present[at - length] = True
    return [x for r in rooms for x in r if x]


def fillings(counts: list[int], lengths: list[int], room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` with any number of the pieces left (lengths descending), least waste first.

    Bit s of a reach says that pieces make the sum s. A filling that leaves more room than the largest single piece would is
    dominated by that piece. Of fillings of an equal sum, the one with the largest pieces comes first: smaller ones fit elsewhere."""
    fit = [x for x in lengths if x <= room and counts[x]]
    if not fit:
        return [()]
    mask, reaches = (1 << (room + 1)) - 1, [1]
    for x in fit:
        reach, c, step = reaches[-1], min(counts[x], room // x), 1
        while c > 0:
            step = min(step, c)
            reach |= (reach << (x * step)) & mask
            c -= step
            step *= 2
        reaches.append(reach)
        if reach >> room & 1:  # nothing wastes less, and smaller pieces stay for later
            break

    def filled(total: int, skip: int) -> tuple[int, ...] | None:
        """Pieces of the sum, as few small ones as can be; skip: how many choices take more of a piece than they must."""
        out: list[int] = []
        for k in range(len(reaches) - 2, -1, -1):
            x = fit[k]
            for t in range(min(counts[x], total // x) + 1):
                if reaches[k] >> (total - t * x) & 1:
                    if skip and t < min(counts[x], total // x):
                        skip -= 1
                        continue
                    out += [x] * t
                    total -= t * x
                    break
            else:
                return None
            if not total:
                return tuple(out)
        return None

    out, total = [], reaches[-1].bit_length() - 1
    while total >= fit[0] and len(out) < FILLINGS:
        if reaches[-1] >> total & 1:
            out += [f for f in (filled(total, 0), filled(total, 1)) if f is not None]
        total -= 1
    return list(dict.fromkeys(out))


def bin_completion(counts: np.ndarray, capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Sequences (lists of lengths) that hold the multiset. Depth first: the largest piece left opens a sequence, its fillings are
    tried by waste, and a branch ends once its waste leaves no better result than the incumbent, at first best fit's. The search ends
    at the bound, when all branches are done, or after `steps` sequences without a better result."""
    if counts[capacity]:  # a full piece is a sequence
        rest = counts.copy()
        rest[capacity] = 0
        return [[capacity]] * int(counts[capacity]) + (bin_completion(rest, capacity, steps) if rest.any() else [])
    total, incumbent = int((counts * np.arange(len(counts))).sum()), best_fit(counts, capacity)
    bound = -(-total // capacity)
    left, wasted, used = counts.tolist(), 0, 0
    lengths = [x for x in range(capacity, 0, -1) if left[x]]
    trail: list[tuple[list[int], list[tuple[int, ...]]]] = []
    remaining = int(counts.sum())
    while len(incumbent) > bound and used < steps + len(incumbent):
        used += 1
        allowed = (len(incumbent) - 1) * capacity - total
        if not remaining and wasted <= allowed:
            incumbent, used = [list(x) for x, _ in trail], 0
            continue
        if remaining and wasted <= allowed:
            largest = next(x for x in lengths if left[x])
            left[largest] -= 1
            options = [(largest, *f) for f in fillings(left, [x for x in lengths if left[x]], capacity - largest)]
            left[largest] += 1
            trail.append(([], options[::-1]))
        while trail:
            content, options = trail[-1]
            if content:  # takes back what was tried here
                for x in content:
                    left[x] += 1
                remaining += len(content)
                wasted -= capacity - sum(content)
                content.clear()
            if options:
                content.extend(options.pop())
                for x in content:
                    left[x] -= 1
                remaining -= len(content)
                wasted += capacity - sum(content)
                break
            trail.pop()
        if not trail:
            break
    return incumbent


def cutter(path: str, end_id: int, capacity: int, ids_out: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in common.blocks(batches, BLOCK):
            ids, at = coder.encode(batch.column("text"), end_id)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            n = np.diff(at)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            # the first piece is the shorter rest
            rest = n - (count - 1) * capacity
            start = np.where(piece > 0, rest[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, rest[row])
            bounds = zip((4 * (at[row] + start)).tolist(), (4 * (at[row] + start + length)).tolist(), strict=True)
            parts = [raw[a:b] for a, b in bounds]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids_out:
                columns, names = [*columns, pa.array([bytes(x) for x in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian 32-bit integers."""
    return common.id_and_text(docs, id_col, text_col).mapInArrow(cutter(vocabulary_path(vocabulary), end_id, capacity, ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def pack(table: DataFrame, capacity: int = 1024, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. Their ids, if any, go along to the group's task: at most group x capacity of them."""
    table = common.staged(table)
    groups = max(1, round(table.count() / group))
    names = table.columns

    def solve(batches) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group is packed once its last row is there."""
        for key, rows in by_group(batches):
            lengths = rows.column("length").to_numpy()
            slots: dict[int, list[tuple[int, int]]] = {}
            for number, content in enumerate(bin_completion(np.bincount(lengths, minlength=capacity + 1), capacity)):
                at = 0
                for x in content:
                    slots.setdefault(x, []).append((number, at))
                    at += x
            where = [slots[x].pop() for x in lengths.tolist()]
            rows = rows.select(names).append_column("sequence_id", pa.array([(key << 32) + n for n, _ in where], pa.int64())).append_column("offset", pa.array([o for _, o in where], pa.int64()))
            yield from rows.combine_chunks().to_batches()

    # a row's place in its file tells rows apart that are alike in all columns; the staged files don't change
    dealt = table.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return dealt.repartition("g").sortWithinPartitions("g", "doc_id", "piece").mapInArrow(solve, f"{kinds}, sequence_id long, offset long")


def by_group(batches) -> Iterator[tuple[int, pa.Table]]:
    held, key = [], None
    for batch in batches:
        g = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if held and g[a] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = int(g[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(common.documents(spark, sf_dir), ids=False))
