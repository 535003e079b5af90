"""Retrieval: lexical and vector search, rank fusion, context packs, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators import history, sequences
from .vectors import nearest  # noqa: F401  (a way to search like the others)


def lexical(rows: DataFrame, needle: str, column: str, by: str, tie: str, limit: int) -> DataFrame:
    """The newest rows that contain the needle, with their rank."""
    hits = history.page(rows.filter(history.contains_folded(column, needle)), by, tie, limit)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), F.desc(tie))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def fused(lists: list[DataFrame], key: str, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, rank from 1): sum of 1 / (k + rank)."""
    every = None
    for i, x in enumerate(lists):
        part = x.select(key, (1 / (F.lit(k) + F.col("rank"))).alias("s"), (F.lit(i * 1_000_000) + F.col("rank")).alias("seen"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.sum("s").alias("score"), F.min("seen").alias("first_seen")).orderBy(F.desc("score"), "first_seen").limit(limit)


def context_pack(ranked: DataFrame, group: str, key: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """One row of each key, the best-ranked, then the prefix that fits the budget."""
    w = Window.partitionBy(group, key).orderBy(rank)
    best = ranked.withColumn("_d", F.row_number().over(w)).filter("_d = 1").drop("_d")
    return sequences.budget_prefix(best, group, [rank], tokens, budget)
