"""Every query of the catalog against DuckDB on the smallest tables, and a few pinned behaviours."""

from pathlib import Path

import duckdb
import pytest

from chatquarry import catalog
from chatquarry.functions import names, text
from chatquarry.operators import joins, sequences
from chatquarry.plans import retrieval, vectors

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    found = catalog.queries()[name](spark, SF).toPandas()
    assert len(found.columns)
    if name in catalog.SQL:
        wanted = duck.sql(catalog.SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def cut(spark, minutes, **options):
    m = spark.createDataFrame([("c", i, 60 * t, 10) for i, t in enumerate(minutes)], "chat string, doc_id long, ts long, length int")
    return [(r.n, r.strategy) for r in sequences.segments(m, **options).orderBy("segment_no").collect()]


def test_segments(spark):
    assert cut(spark, []) == []
    assert cut(spark, [0, 5, 1440, 1445], least=2) == [(2, "time_gap"), (2, "final")]
    assert cut(spark, range(10), most=4, least=2) == [(4, "max_msgs"), (4, "max_msgs"), (2, "final")]


def test_masking_and_scripts(spark):
    df = spark.createDataFrame([("mail a.b@c.org, card 1234 5678 9012 3456, token: abc",), ("привіт світ",), ("12345",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.mask_pii("t"), text.script_hint("t"), text.tokens_estimate("t")).collect()]
    assert got[0][0] == "mail <EMAIL_MASKED>, card <CC_MASKED>, token: <SECRET_MASKED>"
    assert [g[1] for g in got[1:4]] == ["uk", "unknown", "unknown"] and got[3][2] == 1
    assert df.filter("t like 'при%'").select(names.to_latin(df.t)).first()[0] == "privit svit"


def test_gaps(spark):
    r = spark.createDataFrame([("g", 0, 5), ("g", 4, 8), ("g", 10, 12), ("h", 0, 100)], "g string, s int, e int")
    assert sorted(tuple(x) for x in joins.gaps(r, "g", 2, 20).collect()) == [("g", 8, 10), ("g", 12, 20)]


def test_nearest_deals_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 7)
    vecs = {i: [float(i % 7 + 1), float(i * i % 11), float(i * 5 % 13)] for i in range(60)}
    v = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>")
    found = retrieval.nearest(v, v.filter("vec_id % 3 = 0").select(v.vec_id.alias("q"), v.embedding.alias("qv")), 3)
    # no table is broadcast whole
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    got = found.collect()
    assert len(got) == 60 and {r.q for r in got} == set(range(0, 60, 3))
    for q in range(0, 60, 3):
        want = sorted((cos(vecs[q], x) for i, x in vecs.items() if i != q), reverse=True)[:3]
        assert [r.sim for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == pytest.approx(want)
