"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What masks stand for and the marks, in the order in which they are applied. Classes and boundaries are Unicode's.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b|\b\d{3}[-. ]\d{4}\b"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
SECRET = r"(?i)\b(password|passwd|pwd|secret|api_key|token)\s*([:=]|\bis\b)\s*([^\s]+)"
MASKS = ((EMAIL, "<EMAIL_MASKED>"), (PHONE, "<PHONE_MASKED>"), (CARD, "<CC_MASKED>"), (SECRET, "$1: <SECRET_MASKED>"))
URL = r"https?://\S+|www\.\S+"

#: Java's classes are ASCII's without this flag.
UNICODE = "(?U)"
#: White space as Unicode has it, and the separators of control characters.
SPACE = r"[\s\x1c-\x1f]"


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def mask_pii(column: str) -> Column:
    """E-mail addresses, phone numbers, cards and secrets by marks, in that order; null counts as empty."""
    c = F.coalesce(F.col(column), F.lit(""))
    for pattern, mark in MASKS:
        c = F.regexp_replace(c, UNICODE + pattern, mark)
    return c


def sanitized(column: str | Column) -> Column:
    """Without control characters but tab and line ends; without white space at both ends; null counts as empty."""
    c = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return stripped(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def wrapped(column: str | Column) -> Column:
    """Untrusted text between tags."""
    return F.concat(F.lit("<user_data>\n"), sanitized(column), F.lit("\n</user_data>"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"{UNICODE}^{SPACE}+|{SPACE}+$", "")


def cleaned(column: str) -> Column:
    """Without control and format characters (but line ends and tabs), runs of blanks collapsed, ends stripped."""
    return F.regexp_replace(stripped(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[^\P{C}\n\t ]", "")), r"\t[ \t]*| [ \t]+", " ")


def may_link(clean: Column) -> Column:
    """Without one of these no text holds a link: a plain search spares most texts the pattern."""
    low = F.lower(clean)
    return low.contains("http") | low.contains("www.")


def without_links(clean: Column) -> Column:
    return F.when(may_link(clean), stripped(F.regexp_replace(clean, f"(?iU){URL}", " "))).otherwise(clean)


def normalized(column: str) -> Column:
    """Cleaned, links by a space, lower case."""
    return F.lower(without_links(cleaned(column)))


def normal_parts(column: str) -> Column:
    """struct(normalized, lowered, tokens, usernames, urls, numbers, language) of a text."""

    def parts(clean: Column, plain: Column, lowered: Column) -> Column:
        every = lambda p, g=0: F.regexp_extract_all(clean, F.lit(p), F.lit(g))
        return F.struct(
            plain.alias("normalized"),
            lowered.alias("lowered"),
            F.filter(F.split(lowered, rf"{UNICODE}{SPACE}+"), lambda t: t != "").alias("tokens"),
            every(r"@([\p{L}\p{N}_]+)", 1).alias("usernames"),
            F.when(may_link(clean), every(f"(?iU){URL}")).otherwise(F.array().cast("array<string>")).alias("urls"),
            every(r"(?=\p{Nd})(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])").alias("numbers"),
            language_of(plain).alias("language"),
        )

    return bound(cleaned(column), lambda clean: bound(without_links(clean), lambda plain: bound(F.lower(plain), lambda lowered: parts(clean, plain, lowered))))


#: Letters that tell languages apart (fixed values), as ranges: a pattern tries letters that are listed one by one.
RUSSIAN, UKRAINIAN = "А-яЁё", "ІЇЄҐіїєґ"


def language_of(c: Column) -> Column:
    """`en`, `mixed` (both scripts), `uk`, `ru` or `unknown`, from counts of ASCII, Russian and Ukrainian letters."""
    has = lambda p: c.rlike(f"[{p}]")
    cyrillic = has(RUSSIAN)
    return F.when(has("A-Za-z"), F.when(cyrillic, "mixed").otherwise("en")).when(has(UKRAINIAN), "uk").when(cyrillic, "ru").otherwise("unknown")


def script_hint(column: str) -> Column:
    return F.coalesce(language_of(F.col(column)), F.lit("unknown"))


def tokens_estimate(column: str) -> Column:
    """Characters by 2.5, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(column) * 2 / 5)).cast("int")


def chat_tokens(contents: Column) -> Column:
    """An estimate for a prompt of several messages (an array): 8 more for each, 3 for the answer."""
    each = lambda t: F.greatest(F.lit(1), F.floor(F.length(t) * 2 / 5)).cast("int") + 8
    return F.aggregate(contents, F.lit(0), lambda n, t: n + each(t)) + 3


def pack_tokens(column: str) -> Column:
    """A third of the characters and 10: what an item of a context pack counts."""
    return (F.floor(F.length(column) / 3) + 10).cast("int")


def line_tokens(column: str) -> Column:
    return F.floor(F.length(column) / 3).cast("int")


def window_tokens(column: str) -> Column:
    return F.floor(F.length(column) / 4).cast("int")


# What makes a message worth a look, and by how much.
SIGNALS = (
    (3, ("http://", "https://")),
    (3, ("zoom", "meet.google", "teams.microsoft")),
    (2, ("вт ", "ср ", "чт ", "пт ", "сб ", "нд ", "понед", "tuesday", "wednesday", "thursday", ":30", ":00", "14:00", "19:00")),
    (2, ("[photo]", "[audio transcript]", "[document]", "[voice]")),
)


def any_of(c: Column, words) -> Column:
    """Whether a text contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def high_signal(column: str) -> Column:
    """Points for links, meeting hosts, weekdays and times, media marks, and 1 for more than 200 characters."""
    c = F.lower(F.coalesce(F.col(column), F.lit("")))
    score = F.when(F.length(c) > 200, 1).otherwise(0)
    for points, words in SIGNALS:
        score = score + F.when(any_of(c, words), points).otherwise(0)
    return score


def json_or_csv(column: str) -> Column:
    """A list from a JSON list or from text with commas."""
    return F.coalesce(F.from_json(F.col(column), "array<string>"), F.transform(F.split(F.col(column), ","), lambda x: F.trim(x)))


def clock(seconds: str) -> Column:
    """mm:ss, or hh:mm:ss from an hour on."""
    s = F.col(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short = F.concat(two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, F.concat(two(F.floor(s / 3600)), F.lit(":"), short)).otherwise(short)


def clock_seconds(column: str) -> Column:
    """Seconds of mm:ss or hh:mm:ss, 0 for other numbers of parts."""
    parts = F.transform(F.split(F.col(column), ":"), lambda p: p.try_cast("int"))
    n = F.size(parts)
    return F.when(n == 2, parts[0] * 60 + parts[1]).when(n == 3, F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))).otherwise(0)


def first_json(column: str) -> Column:
    """The JSON object of a model's answer: the one in a code fence, else from the first brace to the last; null without any."""
    fenced = F.regexp_extract(column, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(bare, F.lit("")))


def described(column: str) -> Column:
    """The `description` of the JSON object in a model's answer; the whole answer where there is no valid one."""
    objects = [F.regexp_extract(column, p, 1) for p in (r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)(\{.*\})")]
    valid = [F.when(F.try_parse_json(o).isNotNull() & (o != ""), o) for o in objects]
    chosen = F.coalesce(*valid)
    return F.when(chosen.isNull(), F.col(column)).otherwise(F.coalesce(F.get_json_object(chosen, "$.description"), F.col(column)))
