"""Reading a message history: pages, lookups, predicates, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def page(messages: DataFrame, by: str = "ts", tie: str = "doc_id", limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest rows, or a later page of them. Order them for display as needed."""
    return messages.orderBy(F.desc_nulls_last(by), F.desc(tie)).offset(offset).limit(limit)


def last_of_each(messages: DataFrame, group: str, n: int, by: str = "ts", tie: str = "doc_id") -> DataFrame:
    """The newest n rows of every group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), F.desc(tie))
    return messages.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def contains_folded(column: str, needle: str) -> Column:
    """Case-insensitive substring test; the needle's LIKE signs stand for themselves."""
    return F.lower(F.col(column)).contains(needle.lower())


def not_mine(flag: Column) -> Column:
    """True where a flag that may be text, number or null says that a message isn't the user's own."""
    return F.lower(F.coalesce(flag.cast("string"), F.lit("false"))).isin("0", "false")


def json_text(column: str, key: str, default: str | None = None) -> Column:
    """Text of a JSON key; broken JSON, null and JSON null give the default."""
    found = F.get_json_object(column, f"$.{key}")
    return found if default is None else F.coalesce(found, F.lit(default))


def numeric_id(column: Column) -> Column:
    """A long where the text is an integer, null elsewhere."""
    return F.when(column.rlike(r"^-?[0-9]+$"), column.try_cast("long"))


def lookup(messages: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows with one of the keys, in no order. The optimizer picks the join by the sizes."""
    return messages.join(keys.select(*on).distinct(), on, "left_semi")


def not_indexed(messages: DataFrame, indexed: DataFrame, on: list[str]) -> DataFrame:
    return messages.join(indexed.select(*on), on, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def holding(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows of which one of the columns contains the needle, whatever the case; nulls count as empty, and an empty needle is everywhere."""
    held = F.lit(False)
    for c in columns:
        held = held | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle.lower())
    return rows.filter(held)


def dialog_lists(dialogs: DataFrame, needle: str, name: str = "name", kind: str = "type", archived: str = "archived") -> DataFrame:
    """The dialogs whose name contains the needle, with the list each is shown in: `archived`, else its kind (`personal`, `group`,
    `channel`); dialogs of other kinds are shown in none."""
    shown = F.when(F.coalesce(F.col(archived), F.lit(False)), "archived").when(F.col(kind).isin("personal", "group", "channel"), F.col(kind))
    return holding(dialogs, needle, [name]).withColumn("list", shown).filter("list is not null")


def high_signal(messages: DataFrame, score: Column, by: str, tie: str, limit: int = 60) -> DataFrame:
    """Of the messages with a score above 0 the best, of equal ones the earlier, in the order of time."""
    best = messages.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), by, tie).limit(limit)
    return best.orderBy(by, tie)
