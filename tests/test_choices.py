"""Greedy and file-writing operators against plain Python."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from chatquarry.functions import media
from chatquarry.operators import choices
from chatquarry.sources import sinks


def greedy(spans):
    kept = []
    for x in sorted(spans, key=lambda x: (-x[2], x[0], x[1])):
        if not any(k[0] < x[1] and x[0] < k[1] for k in kept):
            kept.append(x)
    return sorted(kept)


def test_overlaps_equal_the_greedy_choice(spark):
    draw = random.Random(3)
    texts = [[(s := draw.randrange(40), s + draw.randrange(12), draw.randrange(4) / 4) for _ in range(draw.randrange(9))] for _ in range(50)]
    texts.append([(s := draw.randrange(3000), s + draw.randrange(12), draw.randrange(50) / 4) for _ in range(2000)])
    df = spark.createDataFrame([(i, *x) for i, t in enumerate(texts) for x in t], "id int, s int, e int, confidence double").repartition(7)
    got = {}
    for r in choices.without_overlaps(df, "id").collect():
        got.setdefault(r.id, []).append((r.s, r.e, r.confidence))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == greedy(t)


def test_many_spans_that_overlap_in_one_stretch():
    """A hundred thousand spans, each of which overlaps the next ones: n log n, not n by n."""
    s = np.arange(100_000)
    kept = choices.surest(s, s + 3, np.zeros(len(s)))
    assert kept == list(range(0, 100_000, 3))


def test_even_sample(spark):
    for c in (0, 1, 19, 20, 21, 47, 200):
        df = spark.createDataFrame([("g", i) for i in range(c)], "g string, i long")
        wanted = list(range(c)) if c <= 20 else [j * c // 20 for j in range(20)]
        assert sorted(r.i for r in choices.even_sample(df, "g", "i", 20).collect()) == wanted


def test_titles_sizes_and_times(spark):
    df = spark.createDataFrame([(1, "x.pdf", "", "", "", 0, ""), (2, None, "/a/b.png", "", "", 0, ""), (3, None, None, "doc", "", 0, ""), (4, None, None, None, "image/png", 2048, ""), (5, None, None, None, None, 0, "photo"), (6, None, None, None, None, None, None)], "id long, n string, p string, e string, m string, s long, k string")
    got = [r[0] for r in df.orderBy("id").select(media.title(*[df[c] for c in df.columns])).collect()]
    assert got == ["x.pdf", "b.png", "DOC document", "PNG file (2.0 KB)", "PHOTO file", "Doc 6"]
    sizes = spark.createDataFrame([("1.5 GiB",), ("10kb",), ("7",), ("junk",), ("3 parsecs",), (None,)], "s string")
    assert [r[0] for r in sizes.select(media.size_bytes(sizes.s)).collect()] == [1610612736, 10000, 7, 0, 0, 0]
    now = spark.createDataFrame([(datetime(2024, 3, 31, 12),)], "t timestamp_ntz")
    assert now.select(media.since(now.t, 1, "months")).first()[0] == datetime(2024, 3, 1, 12)


def test_replace_groups(spark, tmp_path):
    path = str(tmp_path / "segments")
    sinks.replace_groups(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chat string, n int"), path, "chat")
    sinks.replace_groups(spark.createDataFrame([("a", 9)], "chat string, n int"), path, "chat")
    assert sorted((r.chat, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]
