"""The trigram index against `contains`, and delta tables against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from chatquarry.operators import history
from chatquarry.plans import substrings
from chatquarry.sources import deltas


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abAB é_%日") for _ in range(draw.randrange(40))) for _ in range(600)] + [None, "", "ab", "The LICENSE text", "ÉCOLE fermée", "x" * 5000 + "needle" + "y" * 5000]
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, kind int").repartition(4)
    return rows, substrings.TrigramIndex.build(rows, str(tmp_path_factory.mktemp("t") / "i"), "doc_id", "text", block=100, buckets=8)


@pytest.mark.parametrize("needle", ["License", "aba", "AB é", "éa", "a", "_%", "école", "needle", "zzzz", "xyz", "a_b%", "日a日", "xneedley", "abab"])
def test_trigrams_find_what_contains_finds(index, needle):
    rows, found = index
    want = sorted(tuple(r) for r in rows.filter(history.contains_folded("text", needle)).select("doc_id", "text", "kind").collect())
    assert sorted(tuple(r) for r in found.search(needle, 8).select("doc_id", "text", "kind").collect()) == want


def test_only_hit_blocks_and_own_buckets_are_read(index):
    rows, found = index
    plan = found.search("xneedley", 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan
    blocks = found.candidates([g for g, _ in found.rarest("xneedley", 8)], 8).select("block").distinct().collect()
    files = {str(r.block) for r in blocks}
    assert files == {"6"}
    assert found.rarest("xneedley", 8)[0][1] == 1 and found.rarest("zzqz", 8) is None


def test_trigrams_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = substrings.TrigramIndex.build(none, str(tmp_path / "n"), "doc_id", "text")
    assert found.spark is spark


# ---------------------------------------------------------------- delta tables

SCHEMA = "k long, a string, b long, at long"


def applied(state, batch, version):
    for k, a, b, at in batch:
        row = state.setdefault(k, {})
        for name, x in (("a", a), ("b", b), ("at", at)):
            if x is not None and (name not in row or row[name][0] <= (at, version)):
                row[name] = ((at, version), x)
    return state


def rows_of(df):
    return {r.k: (r.a, r.b) for r in df.collect()}


def wanted(state):
    return {k: tuple(row[n][1] if n in row else None for n in ("a", "b")) for k, row in state.items()}


def table(spark, path, buckets=8):
    return deltas.DeltaTable(spark, str(path), SCHEMA, ("k",), "at", buckets)


def frame(spark, batch):
    return spark.createDataFrame(batch, SCHEMA)


def test_batches_compaction_and_late_changes(spark, tmp_path):
    draw, t, state = random.Random(9), table(spark, tmp_path / "t"), {}
    assert t.read().count() == 0
    for version in range(5):
        keys = draw.sample(range(200), 120 if version == 0 else 25)
        batch = [(k, draw.choice([None, f"a{version}{k}"]), draw.choice([None, k * version]), draw.randrange(3) if version else 0) for k in keys]
        done = t.upsert(frame(spark, batch))
        applied(state, batch, done)
        assert rows_of(t.read()) == wanted(state)
        if version == 2:
            full = t.compact(0.1)
            assert full and {p[1] for p in t.pieces() if p[2] == deltas.BASE} >= set(full)
            assert rows_of(t.read()) == wanted(state)
    some = spark.createDataFrame([(k,) for k in (3, 5, 1000)], "k long")
    assert rows_of(t.read(some)) == {k: x for k, x in wanted(state).items() if k in (3, 5)}


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.upsert(frame(spark, [(k, "x", k, 0) for k in range(100)]))
    before = t.pieces()
    version = t.upsert(frame(spark, [(1, "y", None, 1)]))
    fresh = [p for p in t.pieces() if p not in before]
    assert len(fresh) == 1 and fresh[0][0] == version and fresh[0][3] == 1


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.upsert(frame(spark, [(1, "x", 1, 0)]))
    t.upsert(frame(spark, [(1, "y", 2, 1)]))
    first = rows_of(t.read())
    t.upsert(frame(spark, [(1, "y", 2, 1)]), 1)
    assert rows_of(t.read()) == first == {1: ("y", 2)} and t.version() == 1
    # files without a manifest, as a writer that died leaves them, count for nothing
    (tmp_path / "t/data/v__=2/b__=0").mkdir(parents=True)
    assert rows_of(t.read()) == first
    with pytest.raises(ValueError):
        t.upsert(frame(spark, []), 7)


def test_a_stream_of_changes(spark, tmp_path):
    src = tmp_path / "src"
    state, t = {}, table(spark, tmp_path / "t", 4)
    for n in range(4):
        batch = [(k, f"{n}", None if k % 2 else n, n) for k in range(n, 40, n + 1)]
        frame(spark, batch).coalesce(1).write.parquet(str(src / f"part={n}"))
        applied(state, batch, n)
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=[01]")
    deltas.upsert_stream(stream, t, str(tmp_path / "state"), compact_every=2)
    assert {p[2] for p in t.pieces()} >= {deltas.BASE}
    for n in (2, 3):
        t.upsert(spark.read.schema(frame(spark, []).schema).parquet(f"{src}/part={n}"))
    assert rows_of(t.read()) == wanted(state)
