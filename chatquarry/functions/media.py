"""Media metadata and prompts on columns: kinds, sizes, titles, tags in contents, chat markup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bytes of a unit (fixed values).
UNITS = {
    "B": 1, "K": 1000, "M": 1000**2, "G": 1000**3, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "TB": 1000**4,
    "KIB": 1024, "MIB": 1024**2, "GIB": 1024**3, "TIB": 1024**4,
}
#: MIME types whose text can be extracted (fixed values).
OFFICE = ["application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
#: Kinds of images (fixed values); a description that names several takes the first by this order, which is ours.
IMAGES = ["selfie", "meme", "generic", "document"]
#: Seconds of a unit of time; a month has 30 days (fixed values).
SECONDS = {"minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800, "months": 2_592_000}


def size_bytes(column: Column) -> Column:
    """Bytes of a size such as `1.5 GiB`; 0 where it can't be read."""
    pattern = r"^\s*([0-9]+(?:[.][0-9]+)?|[.][0-9]+)\s*([A-Za-z]*)\s*$"  # a number, with or without a fraction or its whole part, and a unit
    unit = F.upper(F.regexp_extract(column, pattern, 2))
    table = F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u, float(n))])
    value = F.regexp_extract(column, pattern, 1).try_cast("double") * table[F.when(unit == "", "B").otherwise(unit)]
    return F.coalesce(value, F.lit(0.0)).cast("long")


def size_label(size: Column) -> Column:
    """Bytes in words: B below 1 KB, KB below 1 MB, else MB, with one decimal."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / 1024**2))


def title(doc_id: Column, name: Column, path: Column, extension: Column, mime: Column, size: Column, kind: Column) -> Column:
    """A document's title: the first of file name, last part of its path, extension, MIME type with size, kind, id."""
    given = lambda c: F.nullif(c, F.lit(""))
    label = F.concat(F.upper(F.substring_index(given(mime), "/", -1)), F.lit(" file"), F.when(size > 0, F.concat(F.lit(" ("), size_label(size), F.lit(")"))).otherwise(""))
    return F.coalesce(given(name), given(F.substring_index(path, "/", -1)), F.concat(F.upper(given(extension)), F.lit(" document")), label, F.concat(F.upper(given(kind)), F.lit(" file")), F.concat(F.lit("Doc "), doc_id.cast("string")))


def media_kind(attributes: Column, mime: Column) -> Column:
    """video, voice, audio, document, image or file, from the attributes (array of strings) first and then the MIME type."""
    has = lambda x: F.array_contains(attributes, x)
    return F.when(has("video"), "video").when(has("voice"), "voice").when(has("audio"), "audio").when(mime.isin(OFFICE), "document").when(mime.startswith("image/"), "image").otherwise("file")


def image_type(column: Column) -> Column:
    """The kind of image that a description names: its first word, else the first kind found anywhere, else generic."""
    low = F.trim(F.lower(column))
    first = F.regexp_extract(low, r"^[^ \t\r\n]+", 0)
    return F.coalesce(F.when(first.isin(IMAGES), first), *[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in IMAGES], F.lit("generic"))


def ocr_text(column: Column) -> Column:
    """Recognised text; empty where it says that there is none."""
    text = F.trim(F.coalesce(column, F.lit("")))
    return F.when(F.lower(text).isin("", "[no_text]", "none", "n/a"), "").otherwise(text)


def retagged(content: Column, kind: Column, description: Column) -> Column:
    """The content with its first media tag replaced by the tag and the description; as it is where there is no description."""
    up = F.upper(kind)
    spoken = F.when(up.isin("AUDIO", "VOICE"), " TRANSCRIPT").otherwise("")
    safe = F.regexp_replace(description, r"([\\$])", r"\\$1")
    found = F.regexp_replace(content, F.concat(F.lit(r"(?s)^(.*?)\["), up, F.lit(r"(?:\s+TRANSCRIPT)?\]\s*")), F.concat(F.lit("$1["), up, spoken, F.lit("] "), safe, F.lit("\n")))
    return F.when(F.length(description) > 0, found).otherwise(content)


def without_name(query: Column, name: Column) -> Column:
    """A search without the person's name in it; null where nothing is left."""
    held = F.contains(F.lower(query), F.lower(name)) & (F.length(name) > 0)
    return F.when(held, F.nullif(F.trim(F.replace(query, name, F.lit(""))), F.lit(""))).otherwise(query)


def since(now: Column, amount: int, unit: str) -> Column:
    """The time so many units before now; a day before where the unit is unknown."""
    return now - F.make_dt_interval(secs=F.lit(amount * SECONDS[unit] if unit in SECONDS else 86_400))


def chat_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit("<|im_end|>\n"))


def node_size(n: Column) -> Column:
    """A node's drawn size by its number of messages."""
    return F.least(n / 5, F.lit(30.0)) + 4
