"""Names across scripts: transliteration, spelling variants, prefixes, fuzzy likeness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bound

# Cyrillic letters and their Latin spelling.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j", "і": "i", "ї": "yi", "є": "ye",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Latin letters and groups of letters and their Cyrillic spelling.
CYRILLIC = {
    "a": "а", "b": "б", "v": "в", "g": "г", "d": "д", "e": "е", "zh": "ж", "z": "з", "i": "и", "j": "й", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о",
    "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "f": "ф", "h": "х", "ts": "ц", "ch": "ч", "sh": "ш", "sch": "щ", "y": "ы", "yu": "ю", "ya": "я",
}
# The Latin spelling by which names are looked up.
LOOKUP = {
    "а": "a", "б": "b", "в": "v", "г": "h", "д": "d", "е": "ye", "є": "ye", "ж": "zh", "з": "z", "и": "y", "і": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "э": "e",
    "ю": "yu", "я": "ya", "ї": "yi", "ґ": "g",
}
PREFIX = 4


def spelled(column: Column, table: dict[str, str]) -> Column:
    """Lower case, letter by letter through a table; other characters stay."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(F.split(F.lower(column), ""), lambda c: F.coalesce(lookup[c], c)), "")


def to_latin(column: Column) -> Column:
    return spelled(column, LATIN)


def lookup_spelling(column: Column) -> Column:
    """The Latin spelling for lookups, with a capital; unchanged names give null."""
    low = F.lower(column)
    latin = spelled(column, LOOKUP)
    return F.when(latin != low, F.concat(F.upper(F.substring(latin, 1, 1)), F.substring(latin, 2, 1 << 20)))


def to_cyrillic(column: Column) -> Column:
    """Lower case; at each place the longest group of Latin letters that the table has.

    Groups are marked off by a control character first: where no group overlaps a longer one, the first alternative of a pattern
    that lists longer groups first is the longest, as in a walk from left to right."""
    groups = "|".join(sorted(CYRILLIC, key=lambda g: (-len(g), g)))
    lookup = F.create_map(*[F.lit(x) for pair in CYRILLIC.items() for x in pair])
    parts = F.split(F.regexp_replace(F.lower(column), f"({groups})", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(lookup[p], p)), "")


def as_russian(column: Column) -> Column:
    return F.translate(F.lower(column), "іїє", "ийе")


def as_ukrainian(column: Column) -> Column:
    return F.translate(F.lower(column), "ией", "ієї")


def prefixes(query: Column) -> Column:
    """The first PREFIX letters of a name in all its spellings: an array without order or repeats, empty for a blank name."""
    q = F.lower(F.trim(query))
    cyrillic = q.rlike("[Ѐ-ӿ]")
    other = F.when(cyrillic, to_latin(q)).otherwise(to_cyrillic(q))
    base = F.when(cyrillic, q).otherwise(other)
    every = F.array_distinct(F.array(q, other, as_russian(base), as_ukrainian(base)))
    cut = F.array_distinct(F.transform(F.filter(every, lambda v: v != ""), lambda v: F.substring(F.trim(v), 1, PREFIX)))
    return F.when(F.coalesce(q, F.lit("")) != "", cut).otherwise(F.array().cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 100: the share of letters that stay when one name is edited into the other, whatever the case."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (1 - F.levenshtein(F.lower(a), F.lower(b)) / longest) * 100).otherwise(F.lit(100.0))


def word_list(c: Column) -> Column:
    return F.array_sort(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def partial_likeness(a: Column, b: Column) -> Column:
    """The likeness of the shorter text and that stretch of the other, as long, that is likest to it."""

    def of(short: Column, long: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(long) - F.length(short) + 1)
        best = F.array_min(F.transform(starts, lambda i: F.levenshtein(short, F.substr(long, i, F.length(short)))))
        return F.when(F.length(short) > 0, (1 - best / F.length(short)) * 100).otherwise(F.lit(0.0))

    return F.when(F.length(a) <= F.length(b), of(F.lower(a), F.lower(b))).otherwise(of(F.lower(b), F.lower(a)))


def parts(c: Column) -> Column:
    """What likeness needs of a name: struct(low: in lower case, words: its words in order, joined: these by blanks)."""
    words = word_list(c)
    return F.struct(F.lower(c).alias("low"), words.alias("words"), F.array_join(words, " ").alias("joined"))


def likeness_of_parts(a: Column, b: Column) -> Column:
    """0 to 100, of two names' parts: the greatest of the likeness as written, 0.95 of that of the sorted words, 0.95 of that of the
    common words with and without the others (if there are any), and 0.9 of that of the best stretch."""

    def of_words(common: Column) -> Column:
        more = lambda p, q: F.trim(F.concat_ws(" ", common, F.array_join(F.array_sort(F.array_except(p["words"], q["words"])), " ")))
        with_common = lambda x, y: F.greatest(likeness(common, x), likeness(common, y), likeness(x, y))
        return F.when(common != "", 0.95 * bound(more(a, b), lambda x: bound(more(b, a), lambda y: with_common(x, y)))).otherwise(F.lit(0.0))

    common = F.array_join(F.array_sort(F.array_intersect(a["words"], b["words"])), " ")
    return F.greatest(likeness(a["low"], b["low"]), 0.95 * likeness(a["joined"], b["joined"]), bound(common, of_words), 0.9 * partial_likeness(a["low"], b["low"]))


def weighted_likeness(a: Column, b: Column) -> Column:
    """The likeness of two names by their parts."""
    return bound(parts(a), lambda x: bound(parts(b), lambda y: likeness_of_parts(x, y)))


def trigrams(c: Column) -> Column:
    """The distinct stretches of three characters of a name with a blank at both ends."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))
