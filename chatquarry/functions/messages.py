"""Messages as rows: metadata, senders, rendered lines, links, predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators.history import numeric_id
from .text import any_of

#: The keys of a message's metadata that the library reads.
METADATA = "chat_id bigint, chat_title string, sender_id string, sender_name string, is_from_me string, reply_to_msg_id string, source string, media struct<type: string, path: string, extension: string, description: string, tags: string, is_meme: boolean, duration: double>"


def metadata(column: str = "metadata") -> Column:
    """The metadata struct; null, empty and broken JSON give a struct of nulls."""
    text = F.when(F.try_parse_json(F.col(column)).isNotNull(), F.col(column))
    return F.from_json(F.coalesce(text, F.lit("{}")), METADATA)


def sender(meta: Column) -> Column:
    """A long, or null for `me`, `assistant` and whatever isn't a number."""
    return numeric_id(meta["sender_id"])


def sender_name(meta: Column) -> Column:
    return F.coalesce(F.nullif(meta["sender_name"], F.lit("")), F.lit("Unknown"))


def message_time(text: Column, now: Column) -> Column:
    """The instant that an ISO text tells, in UTC where it names no zone; `now` where it tells none."""
    return F.coalesce(F.try_to_timestamp(F.trim(text)), now)


#: Fixed value: links to pictures in an answer.
INLINE_MEDIA = r"(?i)(/media/[a-zA-Z0-9_.-]+\.(?:jpg|jpeg|png|gif|webp))"


def inline_media(role: Column, content: Column) -> Column:
    """The pictures that an assistant's message links to, in its order; other roles have none."""
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(INLINE_MEDIA), F.lit(1))
    return F.when(role == "assistant", found).otherwise(F.array().cast("array<string>"))


def not_ui(meta: Column) -> Column:
    """Not written in the session window; an absent source counts as another one."""
    return meta["source"].isNull() | (meta["source"] != "session_ui")


def has_media_kind(meta: Column, kind: str | None) -> Column:
    """`text`, `photo`, `audio` (voice too), `video`, `document`; other kinds filter nothing."""
    media = meta["media"]
    named = {"text": media.isNull(), "audio": media["type"].isin("audio", "voice")} | {k: media["type"] == k for k in ("photo", "video", "document")}
    return F.coalesce(named[kind], F.lit(False)) if kind in named else F.lit(True)


def analysis_task(media: Column) -> Column:
    """struct(task, model) by which a medium is analysed, null for others."""
    office = ("pdf", "docx", "pptx", "xlsx", "doc", "ppt", "xls")
    kinds = [(media["type"] == "photo", "analyze_image", "vision"), (media["type"].isin("audio", "voice"), "transcribe_audio", "audio"), ((media["type"] == "document") & F.lower(media["extension"]).isin(*office), "analyze_pdf", "document")]
    out = F.lit(None).cast("struct<task: string, model: string>")
    for test, task, model in reversed(kinds):
        out = F.when(test, F.struct(F.lit(task).alias("task"), F.lit(model).alias("model"))).otherwise(out)
    return out


def meme_reason(media: Column) -> Column:
    """`is_meme flag`, `keywords` or null."""
    words = F.lower(F.concat_ws(" ", media["description"], media["tags"]))
    return F.when(F.coalesce(media["is_meme"], F.lit(False)), "is_meme flag").when(media.isNotNull() & any_of(words, ("meme", "funny")), "keywords")


def deep_link(chat: Column, message: Column) -> Column:
    """A link to a message; ids of channels and groups lose their prefix."""
    c, m = chat.cast("string"), message.cast("string")
    cut = F.when(c.startswith("-100"), F.substring(c, 5, 64)).when(c.startswith("-"), F.substring(c, 2, 64))
    return F.when(cut.isNotNull(), F.concat(F.lit("https://t.me/c/"), cut, F.lit("/"), m)).otherwise(F.concat(F.lit("tg://openmessage?user_id="), c, F.lit("&message_id="), m))


def backlink(text: Column, chat: Column, message: Column, base: str) -> Column:
    return F.concat(text, F.lit(f" [#cite]({base}/#/chat/"), chat.cast("string"), F.lit("?msg="), message.cast("string"), F.lit(")"))


def media_file(media: Column) -> Column:
    """/media/ and the file name of a medium's path; null without one."""
    name = F.element_at(F.split(media["path"], "/"), -1)
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("/media/"), name))


def media_prefix(media: Column) -> Column:
    """The mark of a medium before a message's text."""
    kind, said = F.upper(F.coalesce(F.nullif(media["type"], F.lit("")), F.lit("MEDIA"))), F.coalesce(media["description"], F.lit(""))
    voiced = F.when(kind.isin("AUDIO", "VOICE") & (said != ""), F.concat(F.lit("["), kind, F.lit(" TRANSCRIPT] "), said))
    shown = F.coalesce(voiced, F.when(said != "", F.concat(F.lit("["), kind, F.lit("] "), said)).otherwise(F.concat(F.lit("["), kind, F.lit("]"))))
    return F.when(media.isNull(), "").otherwise(F.concat(shown, F.lit("\n")))


def document_line(time: Column, name: Column, mine: Column, chat: Column, forwarded: Column, media: Column, text: Column) -> Column:
    """What a message is stored as."""
    who = F.when(mine, "Me").otherwise(name)
    by = F.when(F.coalesce(forwarded, F.lit("")) != "", F.concat(F.lit(" (Forwarded from "), forwarded, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), time, F.lit("] "), who, F.lit(" (in "), chat, F.lit(")"), by, F.lit(": "), media_prefix(media), F.coalesce(text, F.lit("")))


def model_line(time: Column, name: Column, content: Column) -> Column:
    """A message as a model reads it."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    return F.concat(F.lit("["), time, F.lit("] "), name, F.lit(": "), F.when(text == "", "[EMPTY MESSAGE]").otherwise(text))


def history_line(meta: Column, content: Column, cut: int = 200) -> Column:
    """A message of a history as a person reads it, with its medium."""
    mine = F.lower(F.coalesce(meta["is_from_me"], F.lit("false"))) == "true"
    head = F.when(mine, "[Me]").otherwise(F.concat(F.lit("["), sender_name(meta), F.lit("]")))
    media = meta["media"]
    said = F.coalesce(media["description"], F.lit(""))
    tail = F.concat(F.lit(" | Media type: "), F.coalesce(media["type"], F.lit("media")), F.lit(" | Download: "), media_file(media), F.when(said != "", F.concat(F.lit(" | Description: "), F.substring(said, 1, cut), F.when(F.length(said) > cut, "...").otherwise(""))).otherwise(""))
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    return F.concat(head, F.lit(": "), text, F.coalesce(tail, F.lit("")))


# Words that send a text to an event extractor.
EVENT_WORDS = (
    ("debt", ("owe", "debt", "borrow", "lent")),
    ("interview", ("interview", "call", "meeting", "hiring")),
    ("top_up_reminder", ("pay", "bill", "top up", "internet", "subscription")),
)


def event_types(column: str) -> Column:
    """All kinds of events that a text may tell of."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return F.filter(F.array(*[F.when(any_of(low, words), F.lit(kind)) for kind, words in EVENT_WORDS]), lambda k: k.isNotNull())


def payload_kind(messages: Column) -> Column:
    """`vision`, `audio` or `text`, by the first part of a request's messages that is an image or a sound.

    messages: array of struct(role, parts: array of struct(type)); a plain text has no parts."""
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["parts"], F.array().cast("array<struct<type: string>>"))))
    kinds = F.filter(F.transform(parts, lambda p: F.when(p["type"].isin("image_url", "input_image"), "vision").when(p["type"] == "input_audio", "audio")), lambda k: k.isNotNull())
    return F.coalesce(F.get(kinds, F.lit(0)), F.lit("text"))


# Words for units of time.
UNITS = {
    "минут": "minutes", "минуту": "minutes", "минуты": "minutes", "час": "hours", "часа": "hours", "часов": "hours", "часы": "hours", "день": "days", "дня": "days",
    "дней": "days", "неделю": "weeks", "недели": "weeks", "неделей": "weeks", "месяц": "months", "месяца": "months", "месяцев": "months", "хвилин": "minutes",
    "хвилину": "minutes", "годину": "hours", "годин": "hours", "години": "hours", "днів": "days", "дні": "days", "тиждень": "weeks", "тижні": "weeks", "тижнів": "weeks",
    "місяць": "months", "місяці": "months", "minute": "minutes", "minutes": "minutes", "hour": "hours", "hours": "hours", "day": "days", "days": "days", "week": "weeks",
    "weeks": "weeks", "month": "months", "months": "months",
}
SECONDS = {"minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800, "months": 2592000}


def time_expression(column: str, now: Column) -> Column:
    """struct(raw, amount, unit, since) of the first number with a unit of time in a text, null without one; now: epoch seconds.

    Free-form dates are not read."""
    words = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    pattern = rf"(?iU)\b([0-9]{{1,6}})\s+({words})\b"
    amount, word, raw = (F.regexp_extract(F.col(column), pattern, g) for g in (1, 2, 0))
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[F.lower(word)]
    seconds = F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair])[unit]
    n = amount.try_cast("long")
    return F.when(raw != "", F.struct(raw.alias("raw"), n.alias("amount"), unit.alias("unit"), (now - n * seconds).alias("since")))
