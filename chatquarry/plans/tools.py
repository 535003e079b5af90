"""Search tools over a chat archive: by person, newest messages, history, media, unread.

messages: chat, doc_id, ts, content, meta (see functions.messages.metadata) and, where vectors are searched, embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import messages as m, text as text_functions
from ..operators import history, joins, people, sequences
from . import questions, retrieval


def others(messages: DataFrame) -> DataFrame:
    """Without the user's own messages and those of the session window."""
    return messages.filter(history.not_mine(F.col("meta.is_from_me")) & m.not_ui(F.col("meta")))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rank of the few rows of a result."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def lexical(messages: DataFrame, needle: str, limit: int) -> DataFrame:
    hits = others(messages).filter(history.contains_folded("content", needle)).select("chat", "doc_id", "ts")
    return ranked(history.page(hits, limit=limit), F.desc("ts"), F.desc("doc_id"))


def by_vector(messages: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """The most similar messages to one vector: a scan that keeps `limit` rows a task."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    sim = retrieval.dot(F.col("embedding"), q) / (retrieval.norm(F.col("embedding")) * F.lit(sum(x * x for x in vector) ** 0.5))
    hits = messages.filter("embedding is not null").select("chat", "doc_id", "ts", sim.alias("sim")).orderBy(F.desc("sim"), "doc_id").limit(limit)
    return ranked(hits, F.desc("sim"), "doc_id")


def search(messages: DataFrame, needle: str, vector: list[float] | None, mode: str, limit: int) -> DataFrame:
    """doc_id, rank: `lexical`, `vector` or `hybrid`, fused by ranks; where one way finds nothing, the other's order stands."""
    lists = []
    if mode in ("lexical", "hybrid"):
        lists.append(lexical(messages, needle, limit).select("doc_id", "rank"))
    if mode in ("vector", "hybrid") and vector is not None:
        lists.append(by_vector(messages, vector, limit).select("doc_id", "rank"))
    if len(lists) == 1:
        return lists[0]
    return ranked(retrieval.fused(lists, "doc_id", limit), F.desc("score"), "first_seen").select("doc_id", "rank")


def packed(rows: DataFrame, budget: int = 4000, least: int = 3) -> DataFrame:
    """Rows (doc_id, rank, text) once each, in order, until one after the `least` first would exceed the budget of tokens."""
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("rank", "text"), "rank").alias("x")).select("doc_id", "x.*")
    counted = first.withColumns({"tokens": (F.floor(F.length("text") / 3) + 10).cast("int"), "_all": F.lit(0)})
    return sequences.budget_prefix(counted, "_all", ["rank"], "tokens", budget, least + 1).select("doc_id", "rank", "text", "tokens")


def from_person(messages: DataFrame, chats: DataFrame, members: DataFrame, contacts: DataFrame, name: str, needle: str, vector: list[float] | None, mode: str, limit: int, window: int = 1, top: int = 8) -> DataFrame:
    """What a person's chat says about something: hits and their neighbours, in the order of time. No chat of that name: no rows."""
    spark = messages.sparkSession
    chat = people.find_chats(chats, members, contacts, spark.createDataFrame([(name,)], "asked string"), 1).select(F.col("chat_id").alias("chat"))
    own = messages.join(F.broadcast(chat), "chat", "left_semi")  # one row
    return joins.bundle(own, search(own, needle, vector, mode, limit), window, top)


def planned(spark: SparkSession, question: str, limit: int) -> tuple[list[str], str, int, int, int]:
    """What is searched for (any of the terms), how (mode, limit), and how much around the hits (window, top)."""
    q = F.col("q")
    row = spark.createDataFrame([(question,)], "q string").select(questions.policy(q, F.lit(limit)).alias("p"), questions.terms(q).alias("terms")).first()
    return list(row.terms), row.p["mode"], row.p["limit"], row.p["window"], row.p["top_k"]


def any_words(messages: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The newest messages of others that contain one of the terms, ranked."""
    held = text_functions.any_of(F.lower("content"), [t.lower() for t in terms])
    hits = others(messages).filter(held).select("chat", "doc_id", "ts")
    return ranked(history.page(hits, limit=limit), F.desc("ts"), F.desc("doc_id"))


def asked(messages: DataFrame, question: str, vector: list[float] | None = None, limit: int = 20) -> DataFrame:
    """doc_id, rank of what answers a question, by its kind's or its own words, by vectors, or both, as the question's policy says. Without
    a vector only words count."""
    terms, mode, n, _, _ = planned(messages.sparkSession, question, limit)
    return answered(messages, terms, vector, mode, n)


def answered(messages: DataFrame, terms: list[str], vector: list[float] | None, mode: str, limit: int) -> DataFrame:
    lists = []
    if mode == "hybrid" or vector is None:
        lists.append(any_words(messages, terms, limit).select("doc_id", "rank"))
    if vector is not None:
        lists.append(by_vector(messages, vector, limit).select("doc_id", "rank"))
    return lists[0] if len(lists) == 1 else ranked(retrieval.fused(lists, "doc_id", limit), F.desc("score"), "first_seen").select("doc_id", "rank")


def asked_of_person(messages: DataFrame, chats: DataFrame, members: DataFrame, contacts: DataFrame, name: str, question: str, vector: list[float] | None = None, limit: int = 20) -> DataFrame:
    """A question about what was said in a person's chat: the question's kind and policy choose terms, mode, limit and neighbours; the
    hits and their neighbours come in the order of time, hits marked `primary`. No chat of that name: no rows."""
    spark = messages.sparkSession
    terms, mode, n, window, top = planned(spark, question, limit)
    chat = people.find_chats(chats, members, contacts, spark.createDataFrame([(name,)], "asked string"), 1).select(F.col("chat_id").alias("chat"))
    own = messages.join(F.broadcast(chat), "chat", "left_semi")  # one row
    return joins.bundle(own, answered(own, terms, vector, mode, n), window, top)


def newest(messages: DataFrame, since: int | None = None, limit: int = 50) -> DataFrame:
    """The newest messages, since a time."""
    return history.page(messages if since is None else messages.filter(F.col("ts") >= since), limit=limit)


def unread(messages: DataFrame, now: int, days: int = 7, limit: int = 50) -> DataFrame:
    """The newest messages of others in the last days."""
    return newest(others(messages), now - days * 86400, limit)


def with_media(messages: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """The newest messages whose medium's description or kind contains the needle."""
    media = F.col("meta.media")
    text = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower())
    return history.page(messages.filter(media.isNotNull() & (text(media["description"]) | text(media["type"]))), limit=limit)
