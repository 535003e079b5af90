"""Computations in which each step depends on the one before, in parallel over one group's rows.

Rows are numbered in their group and dealt into blocks of equal size. A first pass reduces each block to what it makes of any state
that may enter it; a pass over these few rows tells which state does; a last pass computes the block's rows from there. The states'
function is a short table: for `segments` one entry for each place a segment may begin at, for `stitched` the stretches on which the
result is constant."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import staged
from .order import numbered

SIZE = 1 << 16


def dealt(rows: DataFrame, group: str, order: list[str], size: int, ahead: int = 0) -> DataFrame:
    """The rows with _block and _at (place in the block), written once; the first `ahead` rows of a block also follow the block before."""
    out = numbered(rows, group, *order, name="_n").withColumn("_n", F.col("_n") - 1)
    out = out.withColumn("_block", F.floor(F.col("_n") / size).cast("int")).withColumn("_at", (F.col("_n") % size).cast("int")).drop("_n")
    if ahead:
        place = F.struct("_block", "_at")
        before = F.struct((F.col("_block") - 1).alias("_block"), (F.col("_at") + size).alias("_at"))
        both = F.when((F.col("_at") < ahead) & (F.col("_block") > 0), F.array(place, before)).otherwise(F.array(place))
        out = out.withColumn("_x", F.explode(both)).withColumns({"_block": F.col("_x")["_block"], "_at": F.col("_x")["_at"]}).drop("_x")
    return staged(out)


def by_block(batches, keys: tuple[str, ...]) -> Iterator[tuple[dict, pa.Table]]:
    """Tables of the rows that follow each other with equal keys, and their keys."""
    held, at = [], None
    for batch in batches:
        codes = [batch.column(k).dictionary_encode("encode").indices.to_numpy() for k in keys]
        changed = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
        bounds = [0, *changed.tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:], strict=False):
            if start == end:
                continue
            own = tuple(batch.column(k)[start].as_py() for k in keys)
            if held and own != at:
                yield dict(zip(keys, at, strict=True)), pa.Table.from_batches(held)
                held = []
            at = own
            held.append(batch.slice(start, end - start))
    if held:
        yield dict(zip(keys, at, strict=True)), pa.Table.from_batches(held)


def kind_of(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def sorted_blocks(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "_block").sortWithinPartitions(F.asc_nulls_first(group), "_block", "_at")


def walked(rows: DataFrame, group: str, summary: tuple[str, Callable[[pa.Table], dict]], chain: tuple[str, Callable], result: tuple[str, Callable[[pa.Table, dict], dict]], columns: list[str]) -> DataFrame:
    """rows: as `dealt` gives them. summary: fields, and a function from a block's rows to one row of them. chain: the fields of a state,
    and a function from (state or None, a block's summary) to (the state that enters it, the state that leaves it). result: fields, and a
    function from a block's rows (with the columns named) and the state that enters it to rows of them."""
    key = kind_of(rows, group)
    slim = rows.select(group, "_block", "_at", *columns)

    def summarise(batches) -> Iterator[pa.RecordBatch]:
        for at, table in by_block(batches, (group, "_block")):
            made = summary[1](table)
            yield pa.RecordBatch.from_arrays([table.column(group)[:1].combine_chunks(), pa.array([at["_block"]], pa.int32()), *[pa.array([made[n]], k) for n, k in fields.items()]], names=[group, "_block", *fields])

    def enter(batches) -> Iterator[pa.RecordBatch]:
        state, own = None, object()
        for batch in batches:
            rows_, entered = batch.to_pylist(), []
            for r in rows_:
                if r[group] != own:
                    state, own = None, r[group]
                into, state = chain[1](state, r)
                entered.append(into)
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("_block"), *[pa.array([e[k] for e in entered], pa.int64()) for k in entered[0]]], names=[group, "_block", *entered[0]])

    def apply(batches) -> Iterator[pa.RecordBatch]:
        for _, table in by_block(batches, (group, "_block")):
            state = {k: table.column(k)[0].as_py() for k in state_names}
            made = result[1](table, state)
            n = len(next(iter(made.values())))
            one = table.column(group)[:1].combine_chunks()
            yield pa.RecordBatch.from_arrays([one.take(pa.array(np.zeros(n, np.int64))), *[pa.array(v) if not isinstance(v, pa.Array) else v for v in made.values()]], names=[group, *made])

    fields = {f.split()[0]: pa.list_(pa.int64()) if "array" in f else pa.int64() for f in summary[0].split(", ")}
    state_names = [f.split()[0] for f in chain[0].split(", ")]
    summaries = sorted_blocks(slim, group).mapInArrow(summarise, f"`{group}` {key}, _block int, {summary[0]}")
    entries = staged(summaries.repartition(group).sortWithinPartitions(F.asc_nulls_first(group), "_block").mapInArrow(enter, f"`{group}` {key}, _block int, {chain[0]}"))
    named = entries.withColumnsRenamed({group: "_g", "_block": "_b"})
    met = slim.join(named, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b"))).drop("_g", "_b")
    return sorted_blocks(met, group).mapInArrow(apply, f"`{group}` {key}, {result[0]}")


# ---------------------------------------------------------------- segments


def cuts(ts: np.ndarray, length: np.ndarray, gap: int, budget: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the row at which a segment that begins with it is cut, len(ts) where the rows given don't cut it, and why (0 a long
    silence, 1 the budget of tokens, 2 the number of messages).

    The budget is used at the first row by which the joined length grows beyond it: a search in running sums. A silence counts from the
    `least`th message on."""
    n, row = len(ts), np.arange(len(ts))
    before = np.concatenate([[0], np.cumsum(length)])
    grown = before[1:] + row  # grown[j] - (before[i] + i): the joined length of rows i to j
    full = np.maximum(np.searchsorted(grown, before[:-1] + row + -(-5 * (budget + 1) // 2), "left"), row + least)
    silent = np.append(np.flatnonzero(np.diff(ts) > gap) + 1, n)
    quiet = silent[np.minimum(np.searchsorted(silent, row + least, "left"), len(silent) - 1)]
    at = np.minimum(np.minimum(quiet, full), row + most)
    why = np.where(at == quiet, 0, np.where(at == full, 1, 2))
    return np.minimum(at, n), why


REASONS = ("time_gap", "token_budget", "max_msgs")


def segments(messages: DataFrame, chat: str = "chat", gap_s: int = 64_800, budget: int = 2200, most: int = 40, least: int = 8, size: int = SIZE) -> DataFrame:
    """Cuts each chat: after a long silence, when the token budget is used (both from `least` messages on), or at `most` messages.

    messages: chat, doc_id, ts (seconds), length (characters). Returns chat, segment_no, start_doc, end_doc, n, strategy. A segment has at
    most `most` messages, so the one open at a block's end began in the last `most` rows: that many entries are a block's table."""
    size = max(size, most)

    def own_cuts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        ts, length = (table.column(c).to_numpy() for c in ("ts", "length"))
        at, why = cuts(ts, length, gap_s, budget, most, least)
        return at, why, int((table.column("_at").to_numpy() < size).sum())

    def summarise(table: pa.Table) -> dict:
        at, _, own = own_cuts(table)
        following, total = at.tolist(), len(at)
        left: dict[int, tuple[int, int]] = {}  # from a row: where the walk enters the next block (-1: nowhere), and the segments begun before
        for entry in range(min(most, own)):
            path, i = [], entry
            while i < own and i not in left:
                path.append(i)
                i = following[i]
            out, n = left[i] if i < own else ((i - size if i < total else -1), 0)
            for i in reversed(path):
                n += 1
                left[i] = out, n
        return {"leaves": [left[e][0] for e in range(min(most, own))], "begun": [left[e][1] for e in range(min(most, own))]}

    def chain(state: dict | None, block: dict) -> tuple[dict, dict]:
        state = state or {"entry": 0, "number": 0}
        if state["entry"] < 0 or state["entry"] >= len(block["leaves"]):
            return state, {"entry": -1, "number": state["number"]}
        return state, {"entry": block["leaves"][state["entry"]], "number": state["number"] + block["begun"][state["entry"]]}

    def result(table: pa.Table, state: dict) -> dict:
        at, why, own = own_cuts(table)
        following, starts, i = at.tolist(), [], state["entry"]
        while 0 <= i < own:
            starts.append(i)
            i = following[i]
        starts = np.array(starts, np.int64)
        ends = at[starts]
        doc = table.column("doc_id").combine_chunks()
        reasons = np.where(ends < len(at), np.array(REASONS, object)[why[starts]], "final")
        return {"segment_no": (state["number"] + np.arange(len(starts))).astype(np.int32), "start_doc": doc.take(pa.array(starts)).cast(pa.int64()), "end_doc": doc.take(pa.array(ends - 1)).cast(pa.int64()), "n": (ends - starts).astype(np.int32), "strategy": pa.array(reasons, pa.string())}

    rows = dealt(messages.select(chat, "doc_id", F.coalesce(F.col("ts").cast("long"), F.lit(0)).alias("ts"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length")), chat, ["ts", "doc_id"], size, ahead=most)
    return walked(rows, chat, ("leaves array<long>, begun array<long>", summarise), ("entry long, number long", chain), ("segment_no int, start_doc long, end_doc long, n int, strategy string", result), ["doc_id", "ts", "length"])


# ---------------------------------------------------------------- stitched timelines

#: What a segment that would end before it begins gets, in seconds.
EXTRA = 10


def next_resets(s: np.ndarray, e: np.ndarray) -> tuple[list[int], list[int], list[int], dict[int, int], list[tuple[int, int]]]:
    """Row k maps an end p to e[k] where p < e[k] or p = s[k] (a reset), and to p + EXTRA elsewhere.

    Returns for each row the next row that resets the end it sets (len(s): none) and the end of the block that follows from a reset
    there; and for ends that enter the block, the rows that reset exactly one of them, and (least end that isn't reset up to and
    including a row, that row) for the rows that raise it, both rising."""
    n = len(s)
    u, v = (e - EXTRA * np.arange(n)).tolist(), (s - EXTRA * np.arange(n)).tolist()
    after, leaves = [n] * n, [0] * n
    rising: list[int] = []  # from the row on, those whose u exceeds all u between; nearest last
    exact: dict[int, int] = {}
    for k in range(n - 1, -1, -1):
        x = u[k] - EXTRA
        lo, hi = 0, len(rising)
        while lo < hi:  # the nearest of them with u > x
            mid = (lo + hi) // 2
            if u[rising[mid]] > x:
                lo = mid + 1
            else:
                hi = mid
        j = min(rising[lo - 1] if lo else n, exact.get(x, n))
        after[k] = j
        leaves[k] = leaves[j] if j < n else int(e[k]) + EXTRA * (n - 1 - k)
        while rising and u[rising[-1]] <= u[k]:
            rising.pop()
        rising.append(k)
        exact[v[k]] = k
    return after, leaves, rising, exact, [(u[k], k) for k in reversed(rising)]


def stitched(segments_: DataFrame, group: str, order: list[str], start: str = "s", end: str = "e", size: int = SIZE) -> DataFrame:
    """Timelines without gaps: of each group the first segment starts at 0, each other where the one before ends; one that would end by
    then gets EXTRA seconds, unless it starts there as given. Returns the group, the order's columns, start_s and end_s (long).

    A block maps the end that enters it: to a constant between two rows that raise the least end that no row resets, but for single ends
    that a row's start equals; beyond all of them to itself and EXTRA seconds a row. Stretches with equal constants are one."""
    rows = segments_.select(group, *order, *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(n) for c, n in ((start, "s"), (end, "e"))))

    def ends(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("s").to_numpy(), table.column("e").to_numpy()

    def summarise(table: pa.Table) -> dict:
        s, e = ends(table)
        _, leaves, _, exact, records = next_resets(s, e)
        bounds, values = [], []  # p < bounds[i]: values[i]
        for u, k in records:
            if values and values[-1] == leaves[k]:
                bounds[-1] = u
            else:
                bounds.append(u)
                values.append(leaves[k])
        limits = [u for u, _ in records]
        points = []
        for p, k in exact.items():
            at = bisect_right(limits, p)
            first = records[at][1] if at < len(records) else len(s)
            if k < first and (at == len(records) or leaves[k] != leaves[first]):
                points.append((p, leaves[k]))
        points.sort()
        return {"bounds": bounds, "constants": values, "points": [p for p, _ in points], "at_points": [x for _, x in points], "beyond": EXTRA * len(s)}

    def chain(state: dict | None, block: dict) -> tuple[dict, dict]:
        # the first segment of all starts at 0 and keeps its end: as if one before it had ended below any
        state = state or {"before": None}
        p = state["before"] if state["before"] is not None else min([block["bounds"][0] - 1, *block["points"][:1]]) - 1
        i = bisect_right(block["points"], p) - 1
        if i >= 0 and block["points"][i] == p:
            return state, {"before": block["at_points"][i]}
        i = bisect_right(block["bounds"], p)
        return state, {"before": block["constants"][i] if i < len(block["bounds"]) else p + block["beyond"]}

    def result(table: pa.Table, state: dict) -> dict:
        s, e = ends(table)
        after, _, _, exact, records = next_resets(s, e)
        p = state["before"]
        out, n = np.empty(len(s), np.int64), len(s)
        if p is None:
            k = 0
        else:
            at = bisect_right([u for u, _ in records], p)
            k = min(records[at][1] if at < len(records) else n, exact.get(p, n))
            out[:k] = p + EXTRA * np.arange(1, k + 1)
        while k < n:
            out[k : after[k]] = e[k] + EXTRA * np.arange(after[k] - k)
            k = after[k]
        begin = np.concatenate([[0 if p is None else p], out[:-1]])
        return {**{c: table.column(c).combine_chunks() for c in order}, "start_s": begin, "end_s": out}

    kinds = ", ".join(f"`{c}` {kind_of(rows, c)}" for c in order)
    return walked(dealt(rows, group, order, size), group, ("bounds array<long>, constants array<long>, points array<long>, at_points array<long>, beyond long", summarise), ("before long", chain), (f"{kinds}, start_s long, end_s long", result), [*order, "s", "e"])
