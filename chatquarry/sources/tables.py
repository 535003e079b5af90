"""Message tables derived from the given tables, with explicit columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: chat, doc_id, sender, ts, content, metadata (raw JSON)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("chat"), F.col("event_id").alias("doc_id"), F.col("user_id").alias("sender"), "ts", "value", F.col("props").alias("metadata"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations: chat_id, doc_id, sender, mine, content."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("doc_id"), F.col("role").alias("sender"), (F.col("role") == "user").alias("mine"), F.col("text").alias("content"))


# Tables of a chat archive derived from the given ones; each expression means the same in Spark and in DuckDB.
SENDER = "CASE WHEN role = 'assistant' THEN 'assistant' WHEN role = 'system' THEN 'me' ELSE CAST(conv_id % 40 + turn % 3 + 1 AS STRING) END"
MEDIA = """CASE turn % 5
 WHEN 0 THEN ',"media":{"type":"photo","path":"/app/storage/media/tg_' || CAST(conv_id AS STRING) || '.jpg","description":"a Meme of ' || role || '","tags":"fun"}'
 WHEN 1 THEN ',"media":{"type":"voice","path":"/app/storage/media/v_' || CAST(turn AS STRING) || '.ogg"}'
 WHEN 2 THEN ',"media":{"type":"document","extension":"PDF","path":""}'
 WHEN 3 THEN ',"media":null' ELSE '' END"""
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "chats": ("nation", {
        "chat_id": "CAST(n_nationkey AS BIGINT)",
        "title": "CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_name END",
        "is_private": "CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE n_nationkey % 2 = 0 END",
    }),
    "contacts": ("customer", {
        "user_id": "c_custkey",
        "name": "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'Лев' WHEN c_custkey % 13 = 0 THEN 'Аліса' WHEN c_custkey % 17 = 0 THEN 'Lev' ELSE c_name END",
        "username": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) END",
    }),
    "members": ("customer", {"chat_id": "CAST(c_nationkey AS BIGINT)", "user_id": "c_custkey"}),
    "raw": ("conversations", {
        "source_id": "'chat_' || CAST(conv_id AS STRING)",
        "chat_id": "conv_id",
        "doc_id": "turn",
        "ts": "conv_id * 100000 + turn * 60",
        "content": "text",
        "metadata": f"""'{{"chat_id":' || CAST(conv_id AS STRING) || ',"sender_id":"' || {SENDER} || '","sender_name":' || CASE WHEN conv_id % 9 = 0 THEN 'null' ELSE '"n' || CAST(conv_id % 40 AS STRING) || '"' END
 || ',"is_from_me":' || CASE WHEN role = 'system' THEN 'true' ELSE 'false' END || CASE WHEN conv_id % 8 = 0 THEN ',"source":"session_ui"' ELSE '' END
 || CASE WHEN turn > 1 AND turn % 2 = 0 THEN ',"reply_to_msg_id":"' || CAST(turn - 2 AS STRING) || '"' ELSE '' END || {MEDIA} || CASE WHEN turn % 11 = 7 THEN '' ELSE '}}' END""",
    }),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`chats`, `contacts`, `members` or `raw` (messages with JSON metadata, some of it broken)."""
    base, columns = DERIVED[name]
    return table(spark, sf_dir, base).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def derived_sql(name: str) -> str:
    base, columns = DERIVED[name]
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {base})"
