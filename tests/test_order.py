"""Ordered computations over ranges and blocks against plain walks, with one group that holds most rows and plans that split it anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatquarry.operators import blocks, graph, joins, sequences
from chatquarry.operators.order import Ordered, numbered, plain

N = 100_000


@pytest.fixture(scope="module", params=["true", "false"])
def dealt(spark, request):
    """Sixteen partitions, with coalescing on and off."""
    for k, v in (("spark.sql.adaptive.coalescePartitions.enabled", request.param), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(k, v)
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def hot(spark, n=N):
    """One group with 9 of 10 rows, a few others, one of them null; wide rows, so that ranges don't coalesce into one."""
    g = F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    return spark.range(n).select(g.alias("g"), (F.col("id") * 7919 % n).alias("o"), (F.col("id") * 31 % 101).alias("v"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("pad"))


def test_prefixes_of_a_hot_group(dealt):
    rows = hot(dealt)
    ordered = Ordered(rows, "g", "o")
    got = plain(ordered.prefix(number="n", sums={"s": F.col("v")}, maxima={"m": F.struct("v", "o"), "last": F.col("o")}, totals={"t": F.col("v")})).select("g", "o", "v", "n", "s", "m.v", "last", "t").toPandas()
    got.columns = ["g", "o", "v", "n", "s", "m", "last", "t"]
    want = rows.select("g", "o", "v").toPandas().sort_values(["g", "o"])
    by = want.groupby("g", dropna=False)
    want["n"], want["s"], want["m"], want["last"], want["t"] = by.cumcount() + 1, by["v"].cumsum() - want["v"], by["v"].cummax(), by["o"].shift(), by["v"].transform("sum")
    want["m"] = want.groupby("g", dropna=False)["m"].shift()
    got, want = (x.sort_values(["g", "o"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == N
    for c in ("o", "n", "s", "t"):
        assert (got[c] == want[c]).all(), c
    for c in ("m", "last"):
        assert np.array_equal(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_rows_before_across_ranges(dealt):
    rows = hot(dealt, 20_000)
    got = {(r.g, r.o): r.b for r in Ordered(rows, "g", "o").preceding("b", F.col("v"), 3).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g or "", r.o)):
        want.setdefault(r.g, []).append((r.o, r.v))
    assert got == {(g, o): [v for _, v in x[max(0, i - 3) : i]] for g, x in want.items() for i, (o, _) in enumerate(x)}


def test_replies_and_neighbours_of_a_hot_chat(dealt):
    m = hot(dealt, 40_000).select(F.col("g").alias("chat"), F.floor(F.col("o") / 3).alias("ts"), F.col("o").alias("doc_id"), F.col("v").alias("sender"), "pad").filter("chat is not null")
    chats = {}
    for r in sorted(m.collect(), key=lambda r: (r.chat, r.ts, r.doc_id)):
        chats.setdefault(r.chat, []).append(r.doc_id)
    got = {(r.chat, r.doc_id): r.reply_to for r in joins.with_reply_to(m).collect()}
    assert got == {(c, d): (x[i - 1] if i else None) for c, x in chats.items() for i, d in enumerate(x)}
    near = joins.neighbours(m, m.filter("doc_id % 997 = 5"), 2).collect()
    want = {(d, x[j], j - i) for x in chats.values() for i, d in enumerate(x) if d % 997 == 5 for j in range(max(0, i - 2), min(len(x), i + 3))}
    assert {(r.target, r.doc_id, r.distance) for r in near} == want and len(near) == len(want)


def test_budget_and_gaps_of_a_hot_group(dealt):
    rows = hot(dealt, 30_000)
    kept = sequences.budget_prefix(rows, "g", ["o"], "v", 100_000).groupBy("g").count().collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g or "", r.o)):
        want.setdefault(r.g, []).append(r.v)
    assert {r.g: r["count"] for r in kept} == {g: sum(c <= 100_000 or i < 4 for i, c in enumerate(np.cumsum(x))) for g, x in want.items()}
    spans = rows.select("g", (F.col("o") * 5).alias("s"), (F.col("o") * 5 + F.col("v") % 9).alias("e")).filter("g is not null")
    covered, found = {}, {}
    for r in spans.collect():
        if r.s < r.e:
            covered.setdefault(r.g, np.zeros(150_100, bool))[r.s : r.e] = True
    for r in joins.gaps(spans, "g", 100, 150_000).collect():
        assert not found.setdefault(r.g, np.zeros(150_100, bool))[r.gap_start : r.gap_end].any()
        found[r.g][r.gap_start : r.gap_end] = True
    for g, x in covered.items():
        assert (found[g][100:150_000] == ~x[100:150_000]).all()


def test_texts_of_a_hot_sender(dealt):
    m = hot(dealt, 30_000).select(F.when(F.col("g") == "hot", 1).otherwise(2).cast("long").alias("sender"), F.lit("n").alias("name"), F.col("o").alias("ts"), F.col("o").alias("doc_id"), F.col("v").cast("string").alias("content"))
    got = {r.sender: (r.n, r.texts) for r in graph.user_texts(m).collect()}
    want = {}
    for r in sorted(m.collect(), key=lambda r: r.ts):
        want.setdefault(r.sender, []).append(r.content)
    assert got == {s: (len(x), "\n".join(x)[:8000]) for s, x in want.items()}


# ---------------------------------------------------------------- walks


def plain_segments(rows, gap, budget, most, least):
    out, n, size, no, before = [], 0, 0, 0, None
    for doc, ts, length in rows:
        why = None
        if n:
            grown = size + length + 1
            why = "time_gap" if ts - before > gap and n >= least else "token_budget" if grown * 2 // 5 > budget and n >= least else "max_msgs" if n >= most else None
        if why:
            out.append((no, first, last, n, why))
            no, n, size = no + 1, 0, 0
        first = doc if n == 0 else first
        size += length + (n > 0)
        n, last, before = n + 1, doc, ts
    return out + ([(no, first, last, n, "final")] if n else [])


@pytest.mark.parametrize("size,most,least,budget", [(16, 5, 2, 26), (8, 8, 3, 40), (64, 40, 8, 120), (7, 3, 1, 2)])
def test_segments_equal_the_walk(spark, size, most, least, budget):
    draw = random.Random(size)
    chats = {c: [] for c in ("a", "b", None, "one")}
    for c, n in zip(chats, (700, 90, 33, 1), strict=True):
        ts = 0
        for i in range(n):
            ts += draw.choice([0, 10, 10, 20, 500])
            chats[c].append((i * 3, ts, draw.randrange(30)))
    df = spark.createDataFrame([(c, *x) for c, rows in chats.items() for x in rows], "chat string, doc_id long, ts long, length int").repartition(5)
    got = {}
    for r in blocks.segments(df, gap_s=100, budget=budget, most=most, least=least, size=size).collect():
        got.setdefault(r.chat, []).append((r.segment_no, r.start_doc, r.end_doc, r.n, r.strategy))
    assert {c: sorted(x) for c, x in got.items()} == {c: plain_segments(rows, 100, budget, most, least) for c, rows in chats.items()}
    if size == 16:
        assert {x[4] for x in got["a"]} == {"time_gap", "token_budget", "max_msgs", "final"}


def test_segments_of_one_chat_on_many_tasks(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("c").alias("chat"), F.col("id").alias("doc_id"), (F.col("id") * 60 + F.floor(F.col("id") / 97) * 3000).alias("ts"), (F.col("id") * 7 % 23).cast("int").alias("length"))
    got = sorted(tuple(r)[1:] for r in blocks.segments(rows, gap_s=2400, budget=60, most=30).collect())
    assert got == plain_segments(((i, i * 60 + i // 97 * 3000, i * 7 % 23) for i in range(n)), 2400, 60, 30, 8)


def plain_stitched(times):
    out, p = [], None
    for s, e in times:
        begin = 0 if p is None else p
        end = e if p is None or s == p or e > p else p + 10
        out.append((begin, end))
        p = end
    return out


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_stitched_equals_the_walk(spark, size):
    draw = random.Random(size)
    lines = {}
    for g in range(40):
        base = 0
        lines[g] = []
        for _ in range(draw.randrange(1, 60)):
            base += draw.choice([0, 5, 10, 10])
            lines[g].append((base if draw.random() < 0.6 else draw.randrange(200), draw.randrange(-20, 300) if draw.random() < 0.5 else base - draw.randrange(30)))
    df = spark.createDataFrame([(g, i, *x) for g, t in lines.items() for i, x in enumerate(t)], "g int, i int, s int, e int").repartition(4)
    got = {}
    for r in blocks.stitched(df, "g", ["i"], size=size).collect():
        got.setdefault(r.g, []).append((r.i, r.start_s, r.end_s))
    assert {g: [(s, e) for _, s, e in sorted(x)] for g, x in got.items()} == {g: plain_stitched(t) for g, t in lines.items()}


def test_stitched_keeps_a_block_table_small():
    e = np.arange(0, 2_000_000, 20)
    after, leaves, _, exact, records = blocks.next_resets(e - 20, e)
    assert len(set(leaves)) == 1 and len(records) == len(e)  # every row raises the bound, and all stretches have one constant


def test_numbers_of_half_a_million_rows(dealt):
    got = numbered(hot(dealt, 500_000), "g", "o").groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("rn").alias("d"), F.max("rn").alias("m")).collect()
    assert sum(r.n for r in got) == 500_000 and all(r.n == r.d == r.m for r in got)
