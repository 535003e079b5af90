"""Choosing rows: even samples, spans that don't overlap, priorities, aggregates of chats."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .blocks import by_block
from .order import Ordered, plain


def even_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """At most n rows of each group at even strides: those at floor(j * count / n), j from 0. The order tells rows apart."""
    placed = Ordered(rows, group, order).prefix(number="_i", totals={"_c": F.lit(1)}).withColumn("_i", F.col("_i") - 1)
    j = f"((_i * {n} + _c - 1) div _c)"
    return plain(placed.filter(F.expr(f"_c <= {n} or {j} * _c < (_i + 1) * {n}")).drop("_i", "_c"))


def surest(s: np.ndarray, e: np.ndarray, confidence: np.ndarray) -> list[int]:
    """The spans that stay of some that overlap: the surest first, of equal ones the earlier. Those that stay lie apart, so the only one a
    further span can meet is the first that ends after its start."""
    kept: list[tuple[int, int, int]] = []
    ends: list[int] = []
    for i in np.lexsort((e, s, -confidence)).tolist():
        a, b = int(s[i]), int(e[i])
        at = bisect_right(ends, a)
        if at == len(kept) or kept[at][0] >= b:
            at = bisect_right(kept, (a, b, i))
            kept.insert(at, (a, b, i))
            ends.insert(at, b)
    return [i for _, _, i in kept]


def without_overlaps(spans: DataFrame, group: str, s: str = "s", e: str = "e", confidence: str = "confidence") -> DataFrame:
    """Of each group's spans the surest of each overlap; of equal ones the earlier, then the shorter. All columns stay.

    A sweep by starts cuts a group where no span before reaches: what is chosen on one side doesn't depend on the other. Only such a
    stretch of spans, each of which overlaps an earlier one, is held by a task; its choice takes time n log n."""
    ordered = Ordered(spans, group, s, e, confidence)
    reached = ordered.prefix(maxima={"_reach": F.col(e)})
    apart = F.coalesce((F.col(s) >= F.col("_reach")).cast("int"), F.lit(1))
    rows = plain(ordered.prefix(sums={"_part": apart}, rows=reached).withColumn("_part", F.col("_part") + apart).drop("_reach"))

    names = spans.columns

    def choose(batches) -> Iterator[pa.RecordBatch]:
        for _, table in by_block(batches, (group, "_part")):
            keep = surest(*(table.column(c).to_numpy() for c in (s, e, confidence)))
            yield from table.take(pa.array(keep, pa.int64())).select(names).combine_chunks().to_batches()

    return rows.repartition(group, "_part").sortWithinPartitions(F.asc_nulls_first(group), "_part", s, e).mapInArrow(choose, spans.schema)


def next_by_priority(queued: DataFrame, kind: str, priority: list[str]) -> DataFrame:
    """Sizes of the queues, and which of them is served next: the first of the priorities that holds anything."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)), F.lit(0))
    sizes = queued.groupBy(kind).agg(F.count("*").alias("size")).withColumn("_rank", rank)
    first = sizes.filter("_rank > 0").agg(F.min("_rank").alias("_first"))
    return sizes.join(F.broadcast(first), F.lit(True)).select(kind, "size", F.coalesce(F.col("_rank") == F.col("_first"), F.lit(False)).alias("is_next"))


def last_with_word_first(rows: DataFrame, word: str, text: str, order: str, n: int = 5) -> DataFrame:
    """The last n rows when those that hold the word come first and the others after them."""
    held = F.coalesce(F.contains(F.lower(text), F.lit(word)), F.lit(False))
    return rows.withColumn("_held", held).orderBy("_held", F.desc(order)).limit(n).drop("_held")


def chat_aggregates(segments: DataFrame) -> DataFrame:
    """Per chat, from segments (chat, seq, topic, summary, events, importance): the 8 most frequent topics (ties: the earlier seen),
    the first 5 of them as tags, the first 3 summaries, all events, the greatest importance. No chat is held whole."""
    topics = segments.filter("topic is not null").groupBy("chat", "topic").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    top = topics.withColumn("rn", F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("n"), "seen"))).filter("rn <= 8")
    dominant = top.groupBy("chat").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "topic"))), lambda x: x.topic).alias("topics"))
    first = segments.withColumn("rn", F.row_number().over(Window.partitionBy("chat").orderBy("seq"))).filter("rn <= 3")
    words = first.groupBy("chat").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "summary"))), lambda x: x.summary), " ").alias("description"))
    totals = segments.groupBy("chat").agg(F.sum("events").cast("long").alias("events"), F.max("importance").alias("importance"))
    joined = totals.join(dominant, "chat", "left").join(words, "chat")
    return joined.select("chat", F.array_join("topics", ",").alias("topics"), F.array_join(F.slice("topics", 1, 5), ",").alias("tags"), "description", "events", "importance")
