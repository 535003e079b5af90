"""Ordered computations per chat: context windows, sessions, prefixes under a budget. No chat is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from .blocks import segments, stitched  # noqa: F401  (ordered computations of their own kind)
from .order import Ordered, plain


def context_windows(messages: DataFrame, chat: str, order: list[str], k: int = 3) -> DataFrame:
    """Each message with its k predecessors' masked texts before it, one a line."""
    rows = messages.withColumn("_masked", text.mask_pii("content"))
    before = Ordered(rows, chat, *order).preceding("_before", F.col("_masked"), k)
    out = before.withColumn("context", F.array_join("_before", "\n"))
    return plain(out.withColumn("node_text", F.concat_ws("\n", F.when(F.length("context") > 0, F.col("context")), F.col("_masked"))).drop("_masked", "_before"))


def silence_sessions(messages: DataFrame, chat: str, gap_s: int) -> DataFrame:
    """Session numbers by silence alone: a running count of long gaps. ts in seconds."""
    ordered = Ordered(messages, chat, "ts", "doc_id")
    last = ordered.prefix(maxima={"_last": F.col("ts")})
    opened = F.when(F.col("ts") - F.col("_last") > gap_s, 1).otherwise(0)
    counted = ordered.prefix(sums={"_opened": opened}, rows=last)
    return plain(counted.withColumn("session_no", (F.col("_opened") + opened).cast("long")).drop("_last", "_opened"))


def budget_prefix(items: DataFrame, group: str, order: list[str], tokens: str, budget: int, kept_anyway: int = 4) -> DataFrame:
    """Items up to the first that goes beyond the budget and isn't among the first `kept_anyway`, with their position and the tokens so
    far. Negative tokens count as none, so whatever follows an item beyond the budget is beyond it as well."""
    own = F.greatest(F.col(tokens), F.lit(0))
    counted = Ordered(items, group, *order).prefix(number="pos", sums={"cum": own}).withColumn("cum", F.col("cum") + own)
    return plain(counted.filter((F.col("cum") <= budget) | (F.col("pos") <= kept_anyway)))


def proportional_truncation(rows: DataFrame, section: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Shortens every section by the same ratio, so that all fit the budget; at least a row of each stays."""
    total = rows.agg(F.sum(tokens).alias("_all"))  # one row
    counted = Ordered(rows, section, *order).prefix(number="pos", totals={"_n": F.lit(1)})
    ratio = F.least(F.lit(1.0), F.lit(float(budget)) / F.col("_all"))
    return plain(counted.join(F.broadcast(total)).filter(F.col("pos") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_n", "_all"))
