"""Mentions of people in texts, by rules, with their places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: What comes before a name, the group that is the mention, and how sure it is. Case counts only in the last one.
RULES = (
    ("username", re.compile(r"@([\w\d_]+)"), 0.95),
    ("person", re.compile(r"(?:що|что|чого|кого|кому|якщо|если|яку|яке|який|которую|которое|который)\s+\w+\s+([А-ЯІЇЄҐA-Z][а-яіїєґёa-z]+)", re.IGNORECASE | re.UNICODE), 0.9),
    ("person", re.compile(r"(?:від|если|з\b|с\b|у\b|від|у\s|для|with|from)\s+([А-ЯІЇЄҐA-Z][а-яіїєґёa-z]+)", re.IGNORECASE | re.UNICODE), 0.85),
    ("person", re.compile(r"(?:from|by|sent by)\s+([A-Z][a-z]+)", re.IGNORECASE), 0.85),
    ("person", re.compile(r"(?<!\w)([А-ЯІЇЄҐ][а-яіїєґё]{2,})(?!\w)", re.UNICODE), 0.7),
)
AROUND = 20
SCHEMA = "text_id long, kind string, raw string, start int, end int, confidence double, context string"


def found(text: str) -> Iterator[tuple]:
    """kind, raw, start, end, confidence, context; a username's place has its sign in it. Bare names only where no other rule found them."""
    taken = set()
    for n, (kind, pattern, confidence) in enumerate(RULES):
        for m in pattern.finditer(text):
            start, end = m.span() if kind == "username" else m.span(1)
            if n == len(RULES) - 1 and (start, end) in taken:
                continue
            taken.add((start, end))
            yield kind, m[1], start, end, confidence, text[max(0, start - AROUND) : end + AROUND]


def mentions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each mention in each text, whatever the overlaps; places in code points. Null texts have none."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in found(t or "")]
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    return texts.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
