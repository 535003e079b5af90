"""Dates in free text, in English, Russian and Ukrainian: all of a text's, against a given day."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .messages import SECONDS, UNITS
from .text import bound

# Names of months (as dates write them), days told from today, spans told from today, and words that look back.
MONTHS = (
    ("january", "jan", "января", "январь", "січня", "січень"), ("february", "feb", "февраля", "февраль", "лютого", "лютий"), ("march", "mar", "марта", "март", "березня", "березень"),
    ("april", "apr", "апреля", "апрель", "квітня", "квітень"), ("may", "мая", "май", "травня", "травень"), ("june", "jun", "июня", "июнь", "червня", "червень"),
    ("july", "jul", "июля", "июль", "липня", "липень"), ("august", "aug", "августа", "август", "серпня", "серпень"), ("september", "sep", "сентября", "сентябрь", "вересня", "вересень"),
    ("october", "oct", "октября", "октябрь", "жовтня", "жовтень"), ("november", "nov", "ноября", "ноябрь", "листопада", "листопад"), ("december", "dec", "декабря", "декабрь", "грудня", "грудень"),
)
DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1, "сегодня": 0, "вчера": -1, "позавчера": -2, "завтра": 1, "сьогодні": 0, "вчора": -1, "позавчора": -2}
SPANS = {"week": ("last week", "прошлую неделю", "прошлой неделе", "минулого тижня"), "month": ("last month", "прошлый месяц", "прошлом месяце", "минулого місяця"), "year": ("last year", "прошлый год", "прошлом году", "минулого року")}
AGO = ("ago", "назад", "тому")

NAMED = {name: i for i, names in enumerate(MONTHS, 1) for name in names}
one_of = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
ISO = r"(?iU)\b(\d{4})-(\d{2})-(\d{2})\b"
NUMERIC = r"(?iU)\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b"
DAY_MONTH = rf"(?iU)\b(\d{{1,2}})\s+({one_of(NAMED)})\b(?:\s+(\d{{4}})\b)?"
MONTH_DAY = rf"(?iU)\b({one_of(NAMED)})\s+(\d{{1,2}})\b(?:,?\s+(\d{{4}})\b)?"
DAY = rf"(?iU)\b({one_of(DAYS)})\b"
SPAN = rf"(?iU)\b({one_of([w for words in SPANS.values() for w in words])})\b"
BACK = rf"(?iU)\b(\d{{1,5}})\s+({one_of(UNITS)})\s+(?:{one_of(AGO)})\b"


def table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date, null where there is none."""
    text = F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string"))
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def found(raw: Column, start: Column, end: Column | None = None, relative: bool = False) -> Column:
    return F.struct(raw.alias("raw"), start.alias("start"), (F.date_add(start, 1) if end is None else end).alias("end"), F.lit(relative).alias("relative"))


def dates(text: Column, today: Column) -> Column:
    """array<struct(raw, start, end, relative)> of a text's dates: days written in numbers or with a month's name, days and spans told from
    `today` (a date), and times ago. The end is the day after the last. Days without a year are the latest such up to today; days that
    no calendar has are left out. Form by form, each in the text's order."""
    every = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))
    part = lambda raw, p, g: F.regexp_extract(raw, p, g)
    number = lambda raw, p, g: part(raw, p, g).try_cast("int")
    months = table(NAMED)

    def with_name(p: str, day: int, month: int):
        def read(raw: Column) -> Column:
            year, m, d = number(raw, p, 3), months[F.lower(part(raw, p, month))], number(raw, p, day)
            own = day_of(F.year(today), m, d)
            past = F.when(own <= today, own).otherwise(day_of(F.year(today) - 1, m, d))
            return found(raw, F.when(year.isNotNull(), day_of(year, m, d)).otherwise(past))

        return F.transform(every(p), read)

    def span(raw: Column) -> Column:
        low = F.lower(raw)
        unit = F.coalesce(*[F.when(low.isin(*words), F.lit(u)) for u, words in SPANS.items()])
        first = {u: F.trunc(today, u) for u in SPANS}
        back = {"week": F.date_sub(first["week"], 7), "month": F.add_months(first["month"], -1), "year": F.add_months(first["year"], -12)}
        pick = lambda by: F.coalesce(*[F.when(unit == u, by[u]) for u in SPANS])
        return found(raw, pick(back), pick(first), True)

    def back(raw: Column) -> Column:
        seconds = table(SECONDS)[table(UNITS)[F.lower(part(raw, BACK, 2))]]
        at = F.timestamp_seconds(F.unix_seconds(today.cast("timestamp")) - number(raw, BACK, 1) * seconds).cast("date")
        return found(raw, at, F.date_add(today, 1), True)

    lists = [
        F.transform(every(ISO), lambda r: found(r, day_of(number(r, ISO, 1), number(r, ISO, 2), number(r, ISO, 3)))),
        F.transform(every(NUMERIC), lambda r: found(r, day_of(number(r, NUMERIC, 3), number(r, NUMERIC, 2), number(r, NUMERIC, 1)))),
        with_name(DAY_MONTH, 1, 2),
        with_name(MONTH_DAY, 2, 1),
        F.transform(every(DAY), lambda r: found(r, F.date_add(today, table(DAYS)[F.lower(r)]), None, True)),
        F.transform(every(SPAN), span),
        F.transform(every(BACK), back),
    ]
    return F.filter(F.concat(*lists), lambda x: x["start"].isNotNull())


# ---------------------------------------------------------------- events told of in a text

#: A point before a digit ends no sentence. Nothing is given back, so a long sentence takes no stack.
SENTENCE = r"[^.!?\n]++(?:[.][0-9][^.!?\n]*+)*+[.!?]*+"
AMOUNT = r"\d+(?:[.,]\d+)?"


def events(text: Column, kinds: tuple[tuple[str, tuple[str, ...]], ...], today: Column, title: int = 120) -> Column:
    """array<struct(event_type, title, start_time, amount, keyword)>: one for each kind of which a word stands in the text. The title is the
    first sentence that has one, cut at `title` characters; its first date is the start; the amount is the number next after the word, or
    the last one before it."""
    sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))

    def event(kind: str, words: tuple[str, ...]):
        pattern = "|".join(words)

        def of(sentence: Column) -> Column:
            low = F.lower(sentence)
            after = F.regexp_extract(low, rf"(?s)(?:{pattern}).*?({AMOUNT})", 1)
            before = F.regexp_extract(F.regexp_extract(low, rf"(?s)^(.*?)(?:{pattern})", 1), rf"(?s)({AMOUNT})[^\d]*$", 1)
            amount = F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")))
            return F.struct(F.lit(kind).alias("event_type"), F.substring(F.trim(sentence), 1, title).alias("title"), F.get(dates(sentence, today), F.lit(0))["start"].alias("start_time"), amount.alias("amount"), F.regexp_extract(low, f"({pattern})", 1).alias("keyword"))

        first = F.get(F.filter(sentences, lambda s: F.lower(s).rlike(pattern)), F.lit(0))
        return bound(first, lambda s: F.when(s.isNotNull(), of(s)))

    return F.filter(F.array(*[event(k, w) for k, w in kinds]), lambda e: e.isNotNull())
