"""Segmentation of a stream of messages, chat by chat, with state that survives restarts.

Messages may come in any order within the watermark's delay. A chat holds back what the watermark hasn't passed; an event-time timer
brings it into order once it has. What is in order walks on the open segment, of which only figures are kept. A segment is given out
once it is cut: by the message after it, or, if that doesn't come, by a timer when the silence is long enough to cut there whatever
comes next. The segments still open at a stream's end are not given out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that one value of the state holds, and segments given out at a time.
CHUNK = 1 << 14
COLUMNS = "chat string, segment_no int, start_doc long, end_doc long, n int, strategy string"


def packed(rows: np.ndarray) -> list[tuple[bytes]]:
    """Rows as values of the state."""
    return [(rows[at : at + CHUNK].tobytes(),) for at in range(0, len(rows), CHUNK)]


class Segmenter(StatefulProcessor):
    """Waiting messages (ts in seconds, doc_id, length), many to a value of the state since each value is a call of its own, and the open
    segment: its number, messages, characters, first and last message and the last one's time."""

    def __init__(self, gap_s: int, budget: int, most: int, least: int):
        self.gap_s, self.budget, self.most, self.least = gap_s, budget, most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.open = handle.getValueState("open", "no int, n int, size long, first long, last long, ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (the names that Spark calls)
        passed = timerValues.getCurrentWatermarkInMs()
        given = [batch[["ts", "doc_id", "length"]].to_numpy(np.int64) for batch in rows]
        if given:
            came = np.concatenate(given)
            self.waiting.appendList(packed(came))
            self.handle.registerTimer(max(passed, int(came[:, 0].min()) * 1000) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (the names that Spark calls)
        passed = timerValues.getCurrentWatermarkInMs()
        rows = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(r[0], np.int64).reshape(-1, 3) for r in self.waiting.get())])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        count = int(np.searchsorted(rows[:, 0] * 1000, passed, "left"))
        due, later = rows[:count], rows[count:]
        if len(due):
            self.waiting.clear()
            if len(later):
                self.waiting.put(packed(later))
        out = []
        no, n, size, first, last, before = self.open.get() if self.open.exists() else (0, 0, 0, 0, 0, 0)
        for ts, doc, length in (r for at in range(0, len(due), CHUNK) for r in due[at : at + CHUNK].tolist()):
            why = self.reason(n, size, length, ts - before)
            if why:
                out.append((*key, no, first, last, n, why))
                no, n, size = no + 1, 0, 0
            first = doc if n == 0 else first
            size += length + (n > 0)
            n, last, before = n + 1, doc, ts
        # nothing that comes now, or waits, can be earlier than the watermark
        if n >= self.least and passed > (before + self.gap_s) * 1000:
            out.append((*key, no, first, last, n, "time_gap"))
            no, n, size = no + 1, 0, 0
        self.open.update((no, n, size, first, last, before))
        if len(later):
            self.handle.registerTimer(max(passed, int(later[0, 0]) * 1000) + 1)
        if n >= self.least:
            self.handle.registerTimer((before + self.gap_s) * 1000 + 1)
        for at in range(0, len(out), CHUNK):
            yield pd.DataFrame(out[at : at + CHUNK], columns=["chat", "segment_no", "start_doc", "end_doc", "n", "strategy"])

    def reason(self, n: int, size: int, length: int, silence: int) -> str | None:
        if n >= self.least and silence > self.gap_s:
            return "time_gap"
        if n >= self.least and (size + length + 1) * 2 // 5 > self.budget:
            return "token_budget"
        return "max_msgs" if n >= self.most > 0 and n else None

    def close(self) -> None:
        pass


def closed_segments(messages: DataFrame, late: str, gap_s: int = 64_800, budget: int = 2200, most: int = 40, least: int = 8) -> DataFrame:
    """chat, segment_no, start_doc, end_doc, n, strategy of the segments that are cut. messages: a stream of chat (string), doc_id, at
    (timestamp), length. Messages later than `late` are dropped by the watermark."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = messages.withWatermark("at", late).select("chat", F.col("doc_id").cast("long").alias("doc_id"), F.unix_seconds("at").alias("ts"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), "at")
    return rows.groupBy("chat").transformWithStateInPandas(Segmenter(gap_s, budget, most, least), COLUMNS, "append", "eventTime")
