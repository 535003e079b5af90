"""The vector index against a scan: exact answers by its bounds, measured recall of few lists, one list with most vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatquarry.operators import graph
from chatquarry.plans import vectors


def scan(ids, v, asked, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in asked:
        sim = np.round(u @ u[ids.index(q)], vectors.DECIMALS)
        order = [i for i in np.lexsort((ids, -sim)) if ids[i] != q][:k]
        out[q] = [ids[i] for i in order]
    return out


def frame(spark, ids, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<float>").repartition(5)


def asked_of(df):
    return df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


def lists_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.q, r.rank)):
        out.setdefault(r.q, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """3000 vectors about 12 centres, a third of them alike, some null or of length 0."""
    r = np.random.RandomState(5)
    v = (r.normal(size=(12, 16))[r.randint(0, 12, 3000)] + 0.15 * r.normal(size=(3000, 16))).astype(np.float32).astype(float)
    v[1000:2000] = v[0]
    df = frame(spark, range(3000), v).unionByName(spark.createDataFrame([(9000, None), (9020, [0.0] * 16)], "vec_id long, embedding array<float>"))
    return list(range(3000)), v, df, str(tmp_path_factory.mktemp("index") / "i")


def test_index_is_exact_and_skips_lists(spark, clustered, monkeypatch):
    ids, v, df, path = clustered
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 300)  # the list of equal vectors falls into parts
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    index = vectors.Index.build(df, path, lists=24)
    assert index.vectors.count() == 3000 and index.lists()[3].max() > 2
    queries = asked_of(df)
    want = scan(ids, v, range(0, 3000, 20), 10)
    assert lists_of(index.exact(queries, 10, probes=1)) == want
    read = index._probed(queries.withColumn("least", F.lit(0.9)), 1, beyond=True).count()
    assert read < 150 * 23 / 3  # most lists are excluded by their bound
    assert lists_of(vectors.nearest(df, queries, 10)) == want
    few = lists_of(index.search(queries, 10, probes=2))
    hit = sum(len(set(few[q]) & set(want[q])) for q in want) / 1500
    assert hit > 0.9


def test_recall_on_the_given_vectors(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    want = scan([r.vec_id for r in rows], np.array([r.embedding for r in rows]), [r.vec_id for r in rows if r.vec_id % 20 == 0], 10)
    index = vectors.Index.build(df, str(tmp_path / "i"), lists=32)
    probes = index.probes_for(10, 0.95)
    got = lists_of(index.search(asked_of(df), 10, probes))
    recall = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    print(f"recall {recall:.3f} from {probes} of 32 lists")
    assert recall >= 0.9
    assert lists_of(index.exact(asked_of(df), 10)) == want


def test_an_index_of_nothing_or_one(spark, tmp_path):
    none = frame(spark, [1], [[1.0, 2.0]]).filter("vec_id > 5")
    index = vectors.Index.build(none, str(tmp_path / "n"))
    assert index.exact(asked_of(frame(spark, [20], [[1.0, 2.0]])), 3).count() == 0
    one = vectors.Index.build(frame(spark, [7], [[1.0, 2.0]]), str(tmp_path / "o"))
    assert lists_of(one.exact(asked_of(frame(spark, [20], [[1.0, 2.0]])), 3)) == {20: [7]}


def test_edges_skip_blocks_that_bounds_exclude(spark, clustered):
    ids, v, df, _ = clustered
    nodes = df.withColumnRenamed("vec_id", "id")
    rows = graph.blocks_by_angle(nodes, 100)
    blocks = rows.select("block").distinct().count()
    assert rows.count() == 3000 and rows.groupBy("block").count().filter("count > 100").count() == 0
    pairs = graph.block_pairs(rows, 0.9).count()
    print(f"{blocks} blocks, {pairs} of {blocks * (blocks + 1) // 2} pairs multiplied")
    assert pairs < blocks * (blocks + 1) / 2 / 3
    got = {(r.a, r.b): r.sim for r in graph.similarity_edges(nodes, 0.9, 100).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    i, j = np.nonzero(np.triu(sim >= 0.9 + 1e-9, 1))
    sure = set(zip(i.tolist(), j.tolist(), strict=True))
    assert sure <= set(got) and all(sim[a, b] >= 0.9 - 1e-9 for a, b in got)
    assert all(abs(sim[a, b] - s) < 1e-9 for (a, b), s in list(got.items())[:1000])


def test_edges_of_nothing_or_one(spark):
    one = frame(spark, [7], [[1.0, 2.0]]).withColumnRenamed("vec_id", "id")
    assert graph.similarity_edges(one, 0.1).count() == 0
    assert graph.similarity_edges(one.filter("id > 7"), 0.1).count() == 0


def test_nodes_meet_a_bounded_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8)
    dealt = []
    own = graph.blocks_by_angle
    monkeypatch.setattr(graph, "blocks_by_angle", lambda *a: dealt.append(own(*a)) or dealt[-1])
    draw = np.random.default_rng(3)
    nodes = frame(spark, range(2000), draw.normal(size=(2000, 6)).tolist()).withColumnRenamed("vec_id", "id")
    replies = spark.createDataFrame([(a, a + 1 + a % 9, a + 1) for a in range(0, 2400, 3)], "user_a long, user_b long, interactions long")
    similar = graph.similarity_edges(nodes, 0.8)
    assert dealt[0].select("block").distinct().count() <= graph.SIDE + graph.PIVOTS
    got = graph.social_edges(nodes, 0.8, replies).collect()
    want = graph.merged_edges(similar, replies).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.edge_type for r in got} == {"both", "similarity", "interaction"}


def test_similar_nodes_of_a_cluster(spark):
    draw = np.random.default_rng(4)
    nodes = frame(spark, range(300), draw.normal(size=(300, 5)).tolist()).withColumnRenamed("vec_id", "id").withColumn("label", F.col("id") % 4)
    want = graph.sub_graph(nodes, graph.similarity_edges(nodes, 0.5), 3).collect()
    got = graph.similar_within(nodes, 0.5, 3).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((r.a, r.b) for r in want) and got


def test_a_query_stays_one_row_however_many_lists_it_probes(spark, clustered, tmp_path):
    ids, v, df, _ = clustered
    index = vectors.Index.build(df, str(tmp_path / "one"), lists=24)
    probed = index._probed(asked_of(df), 20)
    assert probed.count() == probed.select("q").distinct().count() > 100 and {len(r.lists) for r in probed.collect()} == {20}
