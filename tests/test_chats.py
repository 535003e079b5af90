"""Pinned behaviours of the chat operators: names, mentions, events, tools, sinks, streams, connectors."""

import itertools

import pytest
from pyspark.sql import functions as F

from chatquarry.functions import messages as m, names, text
from chatquarry.operators import enrichment, graph, joins, mentions, order, people
from chatquarry.plans import registry, tools
from chatquarry.sources import connector, deltas, sinks

MASKED = [
    ("write to a.b@c.org now", "write to <EMAIL_MASKED> now"),
    ("call +1-555-123-4567 or 555-1234", "call +<PHONE_MASKED> or <PHONE_MASKED>"),
    ("card 1234 5678 9012 3456 end", "card <CC_MASKED> end"),
    ("Password is hunter2, api_key: K1 pwd=x", "Password: <SECRET_MASKED> api_key: <SECRET_MASKED> pwd: <SECRET_MASKED>"),
    ("tokens = many, secretly", "tokens = many, secretly"),
    (None, ""),
]


def test_masking(spark):
    rows = spark.createDataFrame([(t,) for t, _ in MASKED], "t string")
    assert [r[0] for r in rows.select(text.mask_pii("t")).collect()] == [x for _, x in MASKED]


def test_token_rules(spark):
    r = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz", "hi", ["sixsix"])], "a string, b string, c array<string>").select(text.tokens_estimate("a"), text.tokens_estimate("b"), text.chat_tokens(F.col("c"))).first()
    assert tuple(r) == (10, 1, 13)


def walk(word, table):
    """A greedy walk from left to right, the longest group first."""
    out, i = "", 0
    while i < len(word):
        for n in (3, 2, 1):
            if word[i : i + n] in table and i + n <= len(word):
                out, i = out + table[word[i : i + n]], i + n
                break
        else:
            out, i = out + word[i], i + 1
    return out


def test_cyrillic_spelling_is_greedy(spark):
    words = ["".join(w) for w in itertools.product("schyaut", repeat=4)] + ["x-ray", "schyuka", ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(names.to_cyrillic(F.col("w"))).collect()]
    assert got == [walk(w, names.CYRILLIC) for w in words]


@pytest.fixture(scope="module")
def archive(spark):
    chats = spark.createDataFrame([(1, "Lev", True), (2, "Lev Group", False), (3, None, None), (4, "work", False)], "chat_id long, title string, is_private boolean")
    contacts = spark.createDataFrame([(10, "Лев", "lion"), (11, "Аліса", None), (12, None, None), (13, "Aleksandr", "x_%")], "user_id long, name string, username string")
    members = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 13), (4, 12)], "chat_id long, user_id long")
    return chats, members, contacts


def find(spark, archive, *asked):
    rows = people.find_chats(*archive, spark.createDataFrame([(a,) for a in asked], "asked string")).collect()
    return {a: [(r.chat_id, r.contact_name) for r in sorted(rows, key=lambda r: r["rank"]) if r.asked == a] for a in asked}


def test_name_search(spark, archive):
    got = find(spark, archive, "lev", "Аліса", "Алиса", "alisa", "nobody", "", "x_%", "x1")
    assert [c for c, _ in got["lev"]] == [1, 2] and got["lev"][0] == (1, "Лев")
    assert got["Аліса"] == got["Алиса"] == got["alisa"] == [(3, "Аліса"), (2, "Аліса")]
    assert got["nobody"] == got[""] == got["x1"] == [] and got["x_%"] == [(4, "Aleksandr")]


def test_resolution(spark, archive):
    given = spark.createDataFrame([(1, "лев", 0.9), (1, "nobody", 0.95), (2, "Aleksandra", 0.7), (3, "zzz", 0.9)], "text_id long, raw string, confidence double")
    got = {(r.text_id, r.raw): r for r in people.resolved(given, *archive).collect()}
    assert got[1, "лев"].chat_id == 1 and got[1, "лев"].primary_person and not got[1, "nobody"].primary_person
    assert got[2, "Aleksandra"].chat_id == 4 and got[3, "zzz"].chat_id is None and got[3, "zzz"].primary_person


def test_mentions(spark):
    rows = spark.createDataFrame([(1, "find @john_doe"), (2, "що задала Аліса"), (3, "письмо от Ивана"), (4, "nothing"), (5, None)], "id long, t string")
    got = [(r.text_id, r.kind, r.raw, r.start, r.end, r.confidence) for r in mentions.mentions(rows, "id", "t").collect()]
    assert got == [(1, "username", "john_doe", 5, 14, 0.95), (2, "person", "Аліса", 10, 15, 0.9), (3, "person", "Ивана", 10, 15, 0.7)]


def test_memes_and_files(spark):
    kind = "struct<type: string, path: string, description: string, tags: string, is_meme: boolean>"
    rows = spark.createDataFrame([(("photo", "/a/b.jpg", "x", None, True),), (("photo", "/a/", "a Funny cat", None, False),), (("photo", None, None, "meme", None),), (("photo", "c", "plain", None, None),), (None,)], f"m {kind}")
    got = rows.select(m.meme_reason(F.col("m")), m.media_file(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("is_meme flag", "/media/b.jpg"), ("keywords", None), ("keywords", None), (None, "/media/c"), (None, None)]


def test_metadata_takes_anything(spark):
    given = ['{"sender_id": "12", "is_from_me": true}', '{"sender_id": "me", "sender_name": ""}', "", None, "{broken", '{"media": null, "sender_id": -5}', "[1]"]
    rows = spark.createDataFrame([(g,) for g in given], "metadata string").withColumn("meta", m.metadata())
    got = [tuple(r) for r in rows.select(m.sender(F.col("meta")), m.sender_name(F.col("meta")), m.has_media_kind(F.col("meta"), "text")).collect()]
    assert [g[0] for g in got] == [12, None, None, None, None, -5, None] and {g[1] for g in got} == {"Unknown"} and all(g[2] for g in got)


def test_numbering_within_hot_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, F.lit("cold")).alias("g"), (F.col("id") * 7919 % 5003).alias("o"))
    got = order.numbered(rows, "g", "o").collect()
    for g in ("hot", "cold", None):
        own = sorted((r.o, r.rn) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and own


@pytest.mark.parametrize("block", [7, 1024])
def test_similarity_blocks(spark, block):
    vecs = {i: [float(i % 7 - 3), float(i * i % 11 - 5), float(i * 5 % 13 - 6)] for i in range(60)}
    rows = spark.createDataFrame([*vecs.items(), (100, None), (101, []), (102, [0.0, 0.0, 0.0])], "id long, embedding array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    live = [i for i, v in vecs.items() if any(v)]
    want = {(a, b) for a in live for b in live if a < b and cos(vecs[a], vecs[b]) >= 0.3}
    found = graph.similarity_edges(rows, 0.3, block).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_edges_need_nodes_and_clusters_need_two(spark):
    similar = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, sim double")
    replies = spark.createDataFrame([(1, 2, 8), (2, 3, 5), (7, 8, 1)], "user_a long, user_b long, interactions long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {(r.a, r.b, r.weight, r.edge_type) for r in graph.merged_edges(similar, replies, nodes).collect()} == {(1, 2, 0.8, "both"), (2, 3, 0.5, "interaction")}
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    assert [tuple(r) for r in graph.clusters(one).collect()] == [(1, 0)]
    three = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id long, embedding array<double>")
    assert {r.cluster for r in graph.clusters(three).collect()} <= {0, 1, 2}


def test_bundle_prefers_hits(spark):
    rows = spark.createDataFrame([("c", i, i * 10, f"t{i}") for i in range(10)], "chat string, doc_id long, ts long, content string")
    hits = spark.createDataFrame([(3, 1), (4, 2), (9, 3)], "doc_id long, rank int")
    got = sorted((r.doc_id, r.primary) for r in joins.bundle(rows, hits, 1, 2).collect())
    assert got == [(2, False), (3, True), (4, True), (5, False), (9, True)]


def test_context_budget_keeps_at_least_four(spark):
    rows = spark.createDataFrame([(i, i, "x" * n) for i, n in enumerate([30, 30, 30, 30, 6000, 30])], "doc_id long, rank long, text string")
    assert sorted(r.doc_id for r in tools.packed(rows, 100).collect()) == [0, 1, 2, 3]
    assert sorted(r.doc_id for r in tools.packed(rows, 10).collect()) == [0, 1, 2, 3]


def test_events_with_null_keys_are_kept_once(spark):
    base = spark.createDataFrame([("a", None)], "title string, start_time long").withColumn("end_time", F.lit(None).cast("long")).withColumn("event_type", F.lit("x"))
    given = spark.createDataFrame([("a", None), ("a", None), (None, 3)], "title string, start_time long").withColumn("end_time", F.lit(None).cast("long")).withColumn("event_type", F.lit("x"))
    rows = enrichment.stored_events(base, given, F.lit(7).cast("long"), ["title", "event_type"]).collect()
    assert sorted((r.title, r.start_time or 0, r.end_time or 0) for r in rows) == [("Untitled event", 3, 7), ("a", 0, 0)]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1, [0.5]), ("b", 2, [0.1])], "source_id string, doc_id long, embedding array<double>")
    for _ in range(2):
        sinks.append_nodes(nodes, str(tmp_path / "v"), ["source_id", "doc_id"])
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    sinks.save_version(nodes.limit(1), str(tmp_path / "g"), 1)
    sinks.save_version(nodes, str(tmp_path / "g"), 2)
    assert sinks.latest(spark, str(tmp_path / "g")).count() == 2
    sessions = spark.createDataFrame([(1, "old", 5)], "id long, name string, updated long")
    changes = spark.createDataFrame([(1, None, 7, 1), (1, "renamed", None, 2), (2, "new", 1, 1)], "id long, name string, updated long, at int")
    assert sorted(tuple(r) for r in sinks.upserted(sessions, changes, "id", "at").collect()) == [(1, "renamed", 7), (2, "new", 1)]
    sinks.append(sessions, str(tmp_path / "m"))
    sinks.append(sessions, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_stream_upsert(spark, tmp_path):
    state = str(tmp_path / "s")
    t = deltas.DeltaTable(spark, str(tmp_path / "t"), "k long, at long, v string", ("k",), "at", 4)
    for n in range(2):
        spark.createDataFrame([(k, n, f"v{n}") for k in range(n, n + 3)], "k long, at long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        deltas.upsert_stream(spark.readStream.schema("k long, at long, v string").parquet(str(tmp_path / "in")), t, state)
    assert {r.k: r.v for r in t.read().collect()} == {0: "v0", 1: "v1", 2: "v1", 3: "v1"} and t.version() == 1


def test_connector(spark, tmp_path):
    """Ranges of dialogs read once, and a stream that goes on from where it was, past what is held."""
    rows = [(d, i, f"m{i}", i * 60) for d in ("a", "b") for i in range(10)]
    path = str(tmp_path / "files")
    spark.createDataFrame(rows, "dialog string, doc_id long, content string, ts long").coalesce(1).write.parquet(path)
    own = "chatquarry.sources.connector.ParquetConnector"
    got = connector.read_messages(spark, own, [("a", 0, 180), ("b", 60, 61), ("unknown", 0, 600), ("a", 300, 300)], path=path).collect()
    assert sorted((r.source_id, r.ts) for r in got) == [("a", 0), ("a", 60), ("a", 120), ("b", 60)]

    def run():
        m = connector.stream_messages(spark, own, [("a", 60, 1200), ("b", 0, 300)], [("a", 120, 240)], path=path, step="100")
        m.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.source_id, r.ts) for r in spark.read.schema(m.schema).parquet(str(tmp_path / "out")).collect())

    first = [("a", t) for t in (60, *range(240, 600, 60))] + [("b", t) for t in range(0, 300, 60)]
    assert run() == first
    spark.createDataFrame([("a", 10 + i, "later", 600 + i * 60) for i in range(15)], "dialog string, doc_id long, content string, ts long").coalesce(1).write.mode("append").parquet(path)
    assert run() == sorted(first + [("a", t) for t in range(600, 1200, 60)])


def test_tools_check_their_arguments(spark):
    rows = spark.createDataFrame([("c", i, i, "x") for i in range(60)], "chat string, doc_id long, ts long, content string")
    assert registry.call("last_messages", rows).count() == 50 and registry.call("last_messages", rows, since=55, limit=3).count() == 3
    for name, given in (("nothing", {}), ("last_messages", {"limit": 0}), ("last_messages", {"limit": "5"}), ("last_messages", {"needle": "x"}), ("unread", {"limit": True})):
        with pytest.raises(ValueError):
            registry.call(name, rows, **given)


def test_mentions_in_sql(spark):
    registry.register(spark)
    got = spark.sql("SELECT t.id, m.raw, m.start FROM VALUES (1, 'find @ann and @bob'), (2, CAST(NULL AS STRING)) t(id, text), LATERAL mentions(t.text) m ORDER BY m.start").collect()
    assert [tuple(r) for r in got] == [(1, "ann", 5), (1, "bob", 14)]


def test_replaced_groups(spark, tmp_path):
    path = str(tmp_path / "g")
    sinks.replace_groups(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "chat int, v string"), path, "chat")
    sinks.replace_groups(spark.createDataFrame([(1, "z")], "chat int, v string"), path, "chat")
    assert sorted((r.chat, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
