"""Joins over messages: replies, neighbours, upserts, interval gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from .order import Ordered, numbered, plain


def reply_pairs(messages: DataFrame) -> DataFrame:
    """How often two senders answer each other. messages: chat, doc_id, reply_to, sender."""
    a = messages.select("chat", F.col("reply_to").alias("at"), F.col("sender").alias("a"))
    b = messages.select("chat", F.col("doc_id").alias("at"), F.col("sender").alias("b"))
    pairs = a.join(b, ["chat", "at"]).filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("user_a"), F.greatest("a", "b").alias("user_b")).agg(F.count("*").alias("interactions"))


def with_reply_to(messages: DataFrame, chat: str = "chat") -> DataFrame:
    """Takes each message for an answer to the one before it in its chat."""
    before = Ordered(messages, chat, "ts", "doc_id").prefix(maxima={"_before": F.struct("ts", "doc_id")})
    return plain(before.withColumn("reply_to", F.col("_before")["doc_id"]).drop("_before"))


def neighbours(messages: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The targets (column doc_id) with the n messages before and after each in its chat: one numbering, one join."""
    rows = numbered(messages, "chat", "ts", "doc_id")
    hits = rows.join(targets.select("doc_id"), "doc_id", "left_semi").select("chat", F.explode(F.sequence(F.col("rn") - n, F.col("rn") + n)).alias("rn"), F.col("doc_id").alias("target"), F.col("rn").alias("at"))
    return hits.join(rows, ["chat", "rn"]).select("target", "chat", "doc_id", (F.col("rn") - F.col("at")).alias("distance"))


def bundle(messages: DataFrame, hits: DataFrame, window: int, top: int) -> DataFrame:
    """Hits (doc_id, rank) and the neighbours of the first `top`: each message once, as a hit if it is one, with `primary`."""
    near = neighbours(messages, hits.filter(F.col("rank") <= top), window).select("doc_id", F.lit(False).alias("primary"))
    both = hits.select("doc_id", F.lit(True).alias("primary")).unionByName(near)
    return messages.join(both.groupBy("doc_id").agg(F.max("primary").alias("primary")), "doc_id")


def update(base: DataFrame, changes: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Rows of the base with what their last change supplies (not null); changes of keys that the base lacks are dropped."""
    given = F.max_by(F.struct(*columns), F.col(order)).alias("_new")
    last = changes.groupBy(F.col(key).alias("_key")).agg(given)
    both = base.join(last, F.col(key) == F.col("_key"), "left")
    return both.select(*[F.coalesce(f"_new.{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Rows of both; columns that a change supplies (not null) replace the old ones. Of several changes of a key each column takes
    the last one by `order`, if that is given; otherwise keys must not repeat."""
    if order is not None:
        changes = changes.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_given"))
    both = base.select(key, *columns).join(new, key, "full_outer")
    return both.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The base and those rows whose key it lacks, one of each key."""
    return base.unionByName(rows.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))


def gaps(ranges: DataFrame, group: str, start: int, end: int) -> DataFrame:
    """Parts of [start, end) that no range (columns s, e) covers, per group; touching ranges don't overlap."""
    cut = ranges.select(group, "s", "e").filter((F.col("s") < end) & (F.col("e") > start) & (F.col("s") < F.col("e")))
    front = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(start)), F.lit(start))
    inner = Ordered(cut, group, "s", "e").prefix(maxima={"_reached": F.col("e")}).select(group, front("_reached").alias("gap_start"), F.col("s").alias("gap_end"))
    covered = F.when((F.col("s") < end) & (F.col("e") > start) & (F.col("s") < F.col("e")), F.col("e"))
    tail = ranges.groupBy(group).agg(F.max(covered).alias("_reached")).select(group, front("_reached").alias("gap_start"), F.lit(end).alias("gap_end"))
    return inner.unionByName(tail).filter("gap_start < gap_end")
