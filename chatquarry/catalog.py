"""All queries of the library by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .functions import media, messages, text
from .operators import choices, graph, history, joins, order, sequences
from .plans import retrieval, substrings, vectors
from .shipping import ship
from .sources import connector, deltas
from .sources.tables import event_messages, table, turns
from .staging import scratch
from .streaming import ingest, segments as stream_cuts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EV = "(SELECT event_type AS chat, event_id AS doc_id, user_id AS sender, ts, value, props AS metadata FROM events)"
TURNS = "(SELECT conv_id AS chat_id, turn AS doc_id, role AS sender, role = 'user' AS mine, text AS content FROM conversations)"
PAIRS = f"""(WITH m AS (SELECT *, lag(doc_id) OVER (PARTITION BY chat ORDER BY ts, doc_id) AS reply_to FROM {EV})
SELECT least(a.sender, b.sender) AS user_a, greatest(a.sender, b.sender) AS user_b, count(*) AS interactions
FROM m a JOIN m b ON a.chat = b.chat AND a.reply_to = b.doc_id WHERE a.sender <> b.sender GROUP BY 1, 2)"""


@query(f"SELECT * FROM {PAIRS}")
def reply_pairs(spark, d):
    return joins.reply_pairs(joins.with_reply_to(event_messages(spark, d)))


@query(f"SELECT chat, doc_id, sender, ts FROM {EV} ORDER BY ts DESC, doc_id DESC LIMIT 50")
def recent_messages(spark, d):
    return history.page(event_messages(spark, d).select("chat", "doc_id", "sender", "ts"))


@query(f"SELECT chat, doc_id, ts FROM {EV} ORDER BY ts DESC, doc_id DESC LIMIT 50 OFFSET 50")
def recent_page2(spark, d):
    return history.page(event_messages(spark, d).select("chat", "doc_id", "ts"), offset=50)


@query(f"SELECT chat, doc_id, ts FROM {EV} WHERE chat = 'click' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def chat_history_since(spark, d):
    m = event_messages(spark, d)
    newest = m.agg(F.max("ts").alias("t"))
    return m.filter("chat = 'click'").join(F.broadcast(newest), F.expr("ts >= t - INTERVAL 3 DAY")).select("chat", "doc_id", "ts")


@query(f"SELECT chat, doc_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts DESC, doc_id DESC) AS rn FROM {EV}) WHERE rn <= 10")
def last_of_each_chat(spark, d):
    return history.last_of_each(event_messages(spark, d), "chat", 10).select("chat", "doc_id", "ts")


@query(f"SELECT chat_id, doc_id, content FROM {TURNS} WHERE lower(coalesce(CASE WHEN mine THEN 'true' ELSE 'false' END, 'false')) IN ('0', 'false') AND sender <> 'system'")
def messages_from_others(spark, d):
    return turns(spark, d).filter(history.not_mine(F.col("mine")) & (F.col("sender") != "system")).select("chat_id", "doc_id", "content")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def lookup_by_ids(spark, d):
    return history.lookup(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 100")
def lexical_search(spark, d):
    return retrieval.lexical(table(spark, d, "documents"), "License", "text", "doc_id", "doc_id", 100).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), '100%') OR contains(lower(text), 'a_b') OR contains(lower(text), '%%%')")
def lexical_search_escaped(spark, d):
    t = table(spark, d, "documents")
    return t.filter(history.contains_folded("text", "100%") | history.contains_folded("text", "a_b") | history.contains_folded("text", "%%%")).select("doc_id")


@query(f"SELECT try_cast(json_extract_string(metadata, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT sender) AS senders FROM {EV} GROUP BY 1")
def json_prop_counts(spark, d):
    return event_messages(spark, d).groupBy(history.numeric_id(history.json_text("metadata", "k")).alias("k")).agg(F.count("*").alias("n"), F.count_distinct("sender").alias("senders"))


@query(f"SELECT count(*) AS total, count(*) FILTER (chat = 'click') AS click, count(*) FILTER (chat = 'view') AS view, count(*) FILTER (chat = 'purchase') AS purchase, count(*) FILTER (chat = 'signup') AS signup, count(*) FILTER (chat NOT IN ('click', 'view', 'purchase', 'signup')) AS other FROM {EV}")
def type_counts(spark, d):
    c = F.col("chat")
    return event_messages(spark, d).agg(F.count("*").alias("total"), *[F.count_if(c == x).alias(x) for x in ("click", "view", "purchase", "signup")], F.count_if(~c.isin("click", "view", "purchase", "signup")).alias("other"))


@query(f"SELECT chat_id, count(*) AS total, count(*) FILTER (mine) AS own FROM {TURNS} GROUP BY 1")
def chat_message_stats(spark, d):
    return turns(spark, d).groupBy("chat_id").agg(F.count("*").alias("total"), F.count_if("mine").alias("own"))


@query(f"SELECT chat_id, round(count(*) FILTER (mine) / (SELECT count(*) FROM {TURNS} WHERE mine), 8) AS importance FROM {TURNS} GROUP BY 1 HAVING count(*) FILTER (mine) > 0")
def chat_importance(spark, d):
    m = turns(spark, d)
    own = m.groupBy("chat_id").agg(F.count_if("mine").alias("own")).filter("own > 0")
    return own.join(F.broadcast(m.agg(F.count_if("mine").alias("every"))), F.lit(True)).select("chat_id", F.round(F.col("own") / F.col("every"), 8).alias("importance"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def source_stats(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT n_nationkey, n_name, count(c_custkey) AS members, max(c_name) AS newest FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE lower(n_name) LIKE 'nation_1%' OR lower(n_name) LIKE 'a%' OR lower(n_name) LIKE 'u%' GROUP BY 1, 2")
def name_search_prefix(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    low = F.lower("n_name")
    hits = n.filter(low.like("nation_1%") | low.like("a%") | low.like("u%"))
    return hits.join(c, c.c_nationkey == hits.n_nationkey, "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("members"), F.max("c_name").alias("newest"))


@query("SELECT n_name, c_custkey, coalesce(c_name, 'Unknown') AS display FROM customer JOIN nation ON c_nationkey = n_nationkey")
def members_display(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("n_name", "c_custkey", F.coalesce("c_name", F.lit("Unknown")).alias("display"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def not_indexed(spark, d):
    return history.not_indexed(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang")


@query(f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts, doc_id) AS rn FROM {EV}) SELECT t.doc_id AS target, m.chat, m.doc_id, m.rn - t.rn AS distance FROM m JOIN (SELECT * FROM m WHERE value > 99) t ON m.chat = t.chat AND m.rn BETWEEN t.rn - 2 AND t.rn + 2")
def neighbors(spark, d):
    m = event_messages(spark, d)
    return joins.neighbours(m, m.filter("value > 99"), 2).withColumn("distance", F.col("distance").cast("long"))


@query("SELECT doc_id, count(*) AS n FROM labels GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT conv_id, count(*) FROM conversations GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return history.duplicate_keys(table(spark, d, "labels"), ["doc_id"]).unionByName(history.duplicate_keys(table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id"), ["doc_id"]))


#: White space of Unicode in DuckDB's patterns.
SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def masked(column: str) -> str:
    """What masking must do, in its order."""
    out = f"coalesce({column}, '')"
    for pattern, mark in (
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "<EMAIL_MASKED>"),
        (r"\b(?:\+?[0-9]{1,3}[-. ]?)?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}\b|\b[0-9]{3}[-. ][0-9]{4}\b", "<PHONE_MASKED>"),
        (r"\b(?:[0-9][ -]*?){13,16}\b", "<CC_MASKED>"),
        (rf"(?i)\b(password|passwd|pwd|secret|api_key|token){SPACE}*([:=]|\bis\b){SPACE}*([^{SPACE[1:-1]}]+)", r"\1: <SECRET_MASKED>"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


@query(f"SELECT doc_id, md5({masked('text')}) AS masked FROM documents")
def mask_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.mask_pii("text")).alias("masked"))


@query("SELECT doc_id, greatest(1, floor(length(text) * 2 / 5))::INT AS tokens, length(text)::INT AS chars FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tokens_estimate("text").alias("tokens"), F.length("text").alias("chars"))


#: A text without control characters, blanks collapsed; and without links.
CLEAN = f"regexp_replace({stripped(r"regexp_replace(coalesce(text, ''), '[^\P{C}\n\t ]', '', 'g')")}, '[ \t]+', ' ', 'g')"
PLAIN = stripped(f"regexp_replace({CLEAN}, '(?i)https?://[^{SPACE[1:-1]}]+|www\\.[^{SPACE[1:-1]}]+', ' ', 'g')")


@query(f"SELECT doc_id, md5(lower({PLAIN})) AS normal FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalized("text")).alias("normal"))


def said(points: int, *words: str) -> str:
    return f"CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN {points} ELSE 0 END"


SCORE = f"""({said(3, "http://", "https://")} + {said(3, "zoom", "meet.google", "teams.microsoft")}
 + {said(2, "вт ", "ср ", "чт ", "пт ", "сб ", "нд ", "понед", "tuesday", "wednesday", "thursday", ":30", ":00", "14:00", "19:00")}
 + {said(2, "[photo]", "[audio transcript]", "[document]", "[voice]")} + CASE WHEN length(text) > 200 THEN 1 ELSE 0 END)"""


@query(f"SELECT doc_id, {SCORE}::INT AS score FROM documents WHERE {SCORE} > 0 ORDER BY score DESC, doc_id LIMIT 60")
def high_signal(spark, d):
    return history.high_signal(table(spark, d, "documents"), text.high_signal("text"), "doc_id", "doc_id").select("doc_id", "score")


@query(f"WITH m AS (SELECT chat_id, doc_id, {masked('content')} AS c FROM {TURNS}), w AS (SELECT *, string_agg(c, chr(10)) OVER (PARTITION BY chat_id ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM m) SELECT chat_id, doc_id, md5(CASE WHEN length(before) > 0 THEN before || chr(10) || c ELSE c END) AS node FROM w")
def context_window_nodes(spark, d):
    return sequences.context_windows(turns(spark, d), "chat_id", ["doc_id"]).select("chat_id", "doc_id", F.md5("node_text").alias("node"))


def segments_sql(messages: str, gap: int, budget: int, most: int, least: int) -> str:
    """The walk over messages (chat, doc_id, ts, l, rn) as a recursion."""
    return f"""WITH RECURSIVE m AS ({messages}),
r AS (SELECT chat, rn, doc_id, ts, 0 AS no, 1 AS n, l AS size, doc_id AS first, NULL::VARCHAR AS why FROM m WHERE rn = 1 UNION ALL
SELECT chat, rn, doc_id, ts, no + (w IS NOT NULL)::INT, CASE WHEN w IS NULL THEN n + 1 ELSE 1 END, CASE WHEN w IS NULL THEN size + l + 1 ELSE l END, CASE WHEN w IS NULL THEN first ELSE doc_id END, w FROM (
SELECT m.*, r.no, r.n, r.size, r.first, CASE WHEN m.ts - r.ts > {gap} AND r.n >= {least} THEN 'time_gap' WHEN (r.size + m.l + 1) * 2 // 5 > {budget} AND r.n >= {least} THEN 'token_budget' WHEN r.n >= {most} THEN 'max_msgs' END AS w FROM r JOIN m ON m.chat = r.chat AND m.rn = r.rn + 1)),
x AS (SELECT *, lead(why) OVER (PARTITION BY chat ORDER BY rn) AS next_why, lead(no) OVER (PARTITION BY chat ORDER BY rn) AS next_no FROM r)
SELECT chat, no::INT AS segment_no, first AS start_doc, doc_id AS end_doc, n::INT AS n, CASE WHEN next_no IS NULL THEN 'final' ELSE next_why END AS strategy, ts AS last_ts FROM x WHERE next_no IS NULL OR next_no <> no"""


@query("SELECT * EXCLUDE (last_ts) FROM (" + segments_sql(f"SELECT chat, doc_id, floor(epoch(ts))::BIGINT AS ts, length(metadata) AS l, row_number() OVER (PARTITION BY chat ORDER BY floor(epoch(ts))::BIGINT, doc_id) AS rn FROM {EV}", 2400, 120, 40, 8) + ")")
def segments(spark, d):
    m = event_messages(spark, d).select("chat", "doc_id", F.floor(F.col("ts").cast("timestamp").cast("double")).alias("ts"), F.length("metadata").alias("length"))
    return sequences.segments(m, gap_s=2400, budget=120)


@query(f"WITH m AS (SELECT sender, doc_id, floor(epoch(ts))::BIGINT AS ts FROM {EV}), o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY sender ORDER BY ts, doc_id) > 21600 THEN 1 ELSE 0 END AS o FROM m) SELECT sender, doc_id, sum(o) OVER (PARTITION BY sender ORDER BY ts, doc_id)::BIGINT AS session_no FROM o")
def gap_sessions(spark, d):
    m = event_messages(spark, d).select("sender", "doc_id", F.floor(F.col("ts").cast("timestamp").cast("double")).alias("ts"))
    return sequences.silence_sessions(m, "sender", 21_600).select("sender", "doc_id", "session_no")


@query(f"WITH t AS (SELECT chat_id, doc_id, greatest(1, floor(length(content) / 4))::INT AS tokens FROM {TURNS}), c AS (SELECT *, row_number() OVER w AS pos, sum(tokens) OVER w AS cum FROM t WINDOW w AS (PARTITION BY chat_id ORDER BY doc_id)), k AS (SELECT *, max(CASE WHEN cum > 60 AND pos > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY doc_id) AS cut FROM c) SELECT chat_id, doc_id, cum::BIGINT AS cum FROM k WHERE cut = 0")
def context_pack(spark, d):
    t = turns(spark, d).select("chat_id", "doc_id", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int").alias("tokens"))
    return sequences.budget_prefix(t, "chat_id", ["doc_id"], "tokens", 60).select("chat_id", "doc_id", "cum")


@query(f"WITH t AS (SELECT sender, chat_id, doc_id, greatest(1, floor(length(content) / 4))::BIGINT AS tokens, row_number() OVER (PARTITION BY sender ORDER BY chat_id, doc_id) AS pos, count(*) OVER (PARTITION BY sender) AS n FROM {TURNS}) SELECT sender, chat_id, doc_id FROM t WHERE pos <= greatest(1, floor(n * least(1.0::DOUBLE, 2000.0::DOUBLE / (SELECT sum(tokens) FROM t)::DOUBLE)))")
def truncate_sections(spark, d):
    t = turns(spark, d).select("sender", "chat_id", "doc_id", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).alias("tokens"))
    return sequences.proportional_truncation(t, "sender", ["chat_id", "doc_id"], "tokens", 2000).select("sender", "chat_id", "doc_id")


@query("""WITH r AS (SELECT user_id AS g, (event_id * 13) % 1000 AS s, (event_id * 13) % 1000 + 5 AS e FROM events), c AS (SELECT * FROM r WHERE s < 900 AND e > 100),
f AS (SELECT g, greatest(coalesce(max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100), 100) AS gap_start, s AS gap_end FROM c
UNION ALL SELECT r.g, greatest(coalesce(max(c.e), 100), 100), 900 FROM (SELECT DISTINCT g FROM r) r LEFT JOIN c ON c.g = r.g GROUP BY r.g) SELECT g, gap_start::BIGINT AS gap_start, gap_end::BIGINT AS gap_end FROM f WHERE gap_start < gap_end""")
def download_gaps(spark, d):
    r = event_messages(spark, d).select(F.col("sender").alias("g"), (F.col("doc_id") * 13 % 1000).alias("s"), (F.col("doc_id") * 13 % 1000 + 5).alias("e"))
    return joins.gaps(r, "g", 100, 900).select("g", F.col("gap_start").cast("long").alias("gap_start"), F.col("gap_end").cast("long").alias("gap_end"))


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({a}, lambda z: z::DOUBLE * z::DOUBLE)))"
COS = f"{DOT.format(a='v.embedding', b='q.embedding')} / ({NORM.format(a='v.embedding')} * {NORM.format(a='q.embedding')})"


EVERY_20TH = f"(WITH s AS (SELECT q.vec_id AS q, v.vec_id, {COS} AS sim FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON v.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT q, vec_id, round(sim, 4) AS sim, rank::INT AS rank FROM r WHERE rank <= 10)"


def every_20th(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


@query(f"SELECT * FROM {EVERY_20TH}")
def vector_topk(spark, d):
    """By the index, which reads what its bounds don't exclude."""
    v = table(spark, d, "embeddings")
    return vectors.Index.build(v, scratch(spark), lists=32).exact(every_20th(v), 10).select("q", "vec_id", F.round("sim", 4).alias("sim"), "rank")


@query()
def vector_topk_probed(spark, d):
    """By the index, from as many of each query's nearest lists as hold 19 of 20 neighbours by a trial."""
    v = table(spark, d, "embeddings")
    index = vectors.Index.build(v, scratch(spark), lists=32)
    return index.search(every_20th(v), 10, index.probes_for(10, 0.95)).select("q", "vec_id", F.round("sim", 4).alias("sim"), "rank")


@query(f"SELECT * FROM {EVERY_20TH}")
def vector_topk_every_20th(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.nearest(v, every_20th(v), 10).select("q", "vec_id", F.round("sim", 4).alias("sim"), "rank")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 40), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents WHERE contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id DESC LIMIT 40), u AS (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS s, rank AS f FROM a UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank), 1000000 + rank FROM b) SELECT doc_id, round(sum(s), 8) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, min(f) LIMIT 50")
def rrf_fusion(spark, d):
    t = table(spark, d, "documents")
    lists = [retrieval.lexical(t, "license", "text", "doc_id", "doc_id", 40), retrieval.lexical(t, "the", "text", "n_chars", "doc_id", 40)]
    return retrieval.fused(lists, "doc_id", 50).select("doc_id", F.round("score", 8).alias("score"))


EDGES = f"(SELECT v.vec_id AS a, q.vec_id AS b, {COS} AS sim FROM embeddings v JOIN embeddings q ON v.vec_id < q.vec_id WHERE {COS} >= 0.25)"


@query(f"SELECT a, b, round(sim, 4) AS sim FROM {EDGES}")
def similarity_edges(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return graph.similarity_edges(v, 0.25).select("a", "b", F.round("sim", 4).alias("sim"))


@query(f"SELECT coalesce(e.a, p.user_a) AS a, coalesce(e.b, p.user_b) AS b, round(greatest(coalesce(sim, 0.0), coalesce(least(interactions / 10.0::DOUBLE, 1.0), 0.0)), 4)::DOUBLE AS weight, CASE WHEN sim IS NULL THEN 'interaction' WHEN interactions IS NULL THEN 'similarity' ELSE 'both' END AS edge_type, coalesce(interactions, 0)::BIGINT AS interactions FROM {EDGES} e FULL JOIN {PAIRS} p ON e.a = p.user_a AND e.b = p.user_b")
def social_graph_edges(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return graph.social_edges(v, 0.25, reply_pairs(spark, d))


@query(f"SELECT sender, count(*) AS n, sum(length(metadata))::BIGINT AS chars, min(ts) AS first_ts, max(ts) AS last_ts FROM {EV} GROUP BY 1")
def user_profiles(spark, d):
    return graph.profiles(event_messages(spark, d))


@query(f"SELECT a, b FROM {EDGES} WHERE a IN (SELECT vec_id FROM embeddings WHERE label = 3) AND b IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def cluster_subgraph(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return graph.similar_within(v, 0.25, 3).select("a", "b")


@query()
def cluster_users(spark, d):
    return graph.clusters(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def job_status(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT lang, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS topic FROM documents), c AS (SELECT lang, topic, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, topic) AS rn FROM c) SELECT lang, topic, n FROM r WHERE rn <= 20")
def topic_top20(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("topic")).filter("topic <> ''")
    c = w.groupBy("lang", "topic").agg(F.count("*").alias("n"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "topic"))).filter("rn <= 20").drop("rn")


@query(f"SELECT chat, sender, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY chat, sender, date_trunc('day', ts) ORDER BY ts, doc_id) AS rn FROM {EV}) WHERE rn = 1")
def event_dedup(spark, d):
    w = Window.partitionBy("chat", "sender", F.date_trunc("day", "ts")).orderBy("ts", "doc_id")
    return event_messages(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("chat", "sender", "doc_id")


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS links, split_part(url, '/', -1) AS file FROM pages")
def media_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).cast("long").alias("links"), F.element_at(F.split("url", "/"), -1).alias("file"))


@query("WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'm' || c_custkey END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey + 1000000, 'new', 0.0 FROM customer WHERE c_acctbal > 9000) SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey")
def upsert_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.filter("c_acctbal < 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("m"), "c_custkey")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = c.filter("c_acctbal > 9000").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return joins.upsert(c, changed.unionByName(new), "c_custkey", ["c_name", "c_acctbal"])


@query("SELECT o_orderkey, o_custkey FROM orders UNION SELECT o_orderkey + 10000000, o_custkey FROM orders WHERE o_totalprice > 300000")
def insert_ignore(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    more = o.filter("o_totalprice > 300000")
    return joins.insert_ignore(o, more.unionByName(more.withColumn("o_orderkey", F.col("o_orderkey") + 10000000)), ["o_orderkey"])


NEEDLES = ("License", "100%", "th", "zzqx", "ation the")


@query(" UNION ALL ".join(f"SELECT '{n}' AS needle, doc_id FROM documents WHERE contains(lower(text), lower('{n}'))" for n in NEEDLES))
def trigram_search(spark, d):
    """Each needle's rows, by the index."""
    index = substrings.TrigramIndex.build(table(spark, d, "documents").select("doc_id", "text"), scratch(spark), "doc_id", "text")
    found = [index.search(n).select(F.lit(n).alias("needle"), "doc_id") for n in NEEDLES]
    return reduce(DataFrame.unionByName, found)


@query("""WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, 0 AS k, 0 AS v FROM orders UNION ALL SELECT o_orderkey, NULL, o_totalprice + 1, NULL, 1, 1 FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, o_custkey + 7, NULL, 'X', 2, 2 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey + 100000000, 1, 1.0, 'N', 2, 2 FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, -1, -1.0, 'late', 1, 3 FROM orders WHERE o_orderkey % 15 = 0)
SELECT o_orderkey, arg_max(o_custkey, k * 10 + v) AS o_custkey, arg_max(o_totalprice, k * 10 + v) AS o_totalprice, arg_max(o_orderstatus, k * 10 + v) AS o_orderstatus FROM c GROUP BY 1""")
def upsert_deltas(spark, d):
    """Orders and three batches of changes, the last one late; compacted after the second."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "cast(o_totalprice as double) as o_totalprice", "o_orderstatus", "0 as at")
    t = deltas.DeltaTable(spark, scratch(spark), "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, at int", ("o_orderkey",), "at", buckets=16)
    none = "cast(null as {}) as {}".format
    t.upsert(o)
    t.upsert(o.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey", none("long", "o_custkey"), "o_totalprice + 1 as o_totalprice", none("string", "o_orderstatus"), "1 as at"))
    changed = o.filter("o_orderkey % 5 = 0").selectExpr("o_orderkey", "o_custkey + 7 as o_custkey", none("double", "o_totalprice"), "'X' as o_orderstatus", "2 as at")
    t.upsert(changed.unionByName(o.filter("o_orderkey % 7 = 0").selectExpr("o_orderkey + 100000000 as o_orderkey", "1L as o_custkey", "1.0d as o_totalprice", "'N' as o_orderstatus", "2 as at")))
    t.compact(0.3)
    t.upsert(o.filter("o_orderkey % 15 = 0").selectExpr("o_orderkey", "-1L as o_custkey", "-1.0d as o_totalprice", "'late' as o_orderstatus", "1 as at"))
    return t.read().drop("at")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, d):
    return ingest.drained(ingest.deduplicated(ingest.stream(spark, f"{d}/[e]vents.parquet").unionByName(ingest.stream(spark, f"{d}/[e]vents.parquet")), ["event_id"])).select("event_id", "user_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_window_counts(spark, d):
    """The windows that the watermark has closed."""
    return ingest.drained(ingest.window_counts(ingest.stream(spark, f"{d}/[e]vents.parquet"), "1 hour")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT event_type AS source_id, event_id::VARCHAR AS doc_id, floor(epoch(ts))::BIGINT AS ts FROM events, (SELECT floor(epoch(min(ts)))::BIGINT AS first FROM events)
WHERE floor(epoch(ts))::BIGINT >= first + 86400 AND NOT (event_type = 'click' AND floor(epoch(ts))::BIGINT >= first + 200000 AND floor(epoch(ts))::BIGINT < first + 900000)""")
def connector_stream(spark, d):
    """Events as five dialogs of a connector, from the second day on; of one dialog some days are held already."""
    e = table(spark, d, "events")
    first = e.agg(F.floor(F.min("ts").cast("timestamp").cast("double"))).first()[0]
    dialogs = [r[0] for r in e.select("event_type").distinct().collect()]  # kinds of events
    m = connector.stream_messages(spark, "chatquarry.sources.connector.ParquetConnector", [(x, first + 86_400, 1 << 40) for x in dialogs], [("click", first + 200_000, first + 900_000)], path=f"{d}/events.parquet", dialog="event_type", doc_id="event_id", content="props", step="432000")
    return ingest.drained(m).select("source_id", "doc_id", "ts")


#: Conversations as messages of 25 chats: one starts each hour, a turn a minute. The watermark is a day behind.
STREAMED = "SELECT 'c' || (conv_id % 25) AS chat, conv_id * 1000 + turn AS doc_id, 1000000000 + conv_id * 3600 + turn * 60 AS ts, length(text) AS l FROM conversations"


@query(f"""SELECT chat, segment_no, start_doc, end_doc, n, CASE WHEN strategy = 'final' THEN 'time_gap' ELSE strategy END AS strategy
FROM ({segments_sql(f"SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts, doc_id) AS rn FROM ({STREAMED}) WHERE ts < (SELECT max(ts) FROM ({STREAMED})) - 86400", 64800, 60, 6, 3)})
WHERE strategy <> 'final' OR (n >= 3 AND last_ts + 64800 < (SELECT max(ts) FROM ({STREAMED})) - 86400)""")
def stream_segments(spark, d):
    """The segments that the stream has cut."""
    c = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/[c]onversations.parquet")
    m = c.select(F.concat(F.lit("c"), F.col("conv_id") % 25).alias("chat"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.timestamp_seconds(F.lit(1_000_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("at"), F.length("text").alias("length"))
    return ingest.drained(stream_cuts.closed_segments(m, "1 day", gap_s=64_800, budget=60, most=6, least=3))


UNIT = "CASE event_id % 6 WHEN 0 THEN ' B' WHEN 1 THEN 'KB' WHEN 2 THEN ' kib' WHEN 3 THEN ' MB' WHEN 4 THEN 'GiB' ELSE ' parsec' END"


@query(f"SELECT event_id, CAST(trunc(CAST(CAST(value AS DECIMAL(20, 6)) AS DOUBLE) * CASE event_id % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1e3 WHEN 2 THEN 1024.0::DOUBLE WHEN 3 THEN 1e6 WHEN 4 THEN 1073741824.0::DOUBLE ELSE 0.0::DOUBLE END) AS BIGINT) AS size FROM events")
def parsed_sizes(spark, d):
    return table(spark, d, "events").select("event_id", media.size_bytes(F.concat(F.col("value").cast("decimal(20,6)").cast("string"), F.expr(UNIT))).alias("size"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '[?].*', '') AS path, strlen(html) AS n FROM pages)
SELECT page_id, CASE WHEN split_part(path, '/', -1) <> '' THEN split_part(path, '/', -1) ELSE 'HTML file (' || CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f}', floor(n / 1024 * 10 + 0.5) / 10) || ' KB' ELSE format('{:.1f}', floor(n / 1048576 * 10 + 0.5) / 10) || ' MB' END || ')' END AS title FROM p""")
def page_titles(spark, d):
    none = F.lit(None).cast("string")
    t = media.title(F.col("page_id"), none, F.regexp_replace("url", "[?].*", ""), none, F.lit("text/html"), F.octet_length("html"), none)
    return table(spark, d, "pages").select("page_id", t.alias("title"))


@query("""WITH m AS (SELECT event_id, event_type AS a, CASE WHEN value < 50 THEN 'application/pdf' WHEN value < 100 THEN 'image/webp' ELSE 'text/plain' END AS mime FROM events)
SELECT event_id, CASE WHEN a = 'click' THEN 'video' WHEN a = 'view' THEN 'audio' WHEN mime = 'application/pdf' THEN 'document' WHEN mime = 'image/webp' THEN 'image' ELSE 'file' END AS kind FROM m""")
def media_kinds(spark, d):
    attribute = F.when(F.col("event_type") == "click", "video").when(F.col("event_type") == "view", "audio").otherwise("other")
    mime = F.when(F.col("value") < 50, "application/pdf").when(F.col("value") < 100, "image/webp").otherwise("text/plain")
    return table(spark, d, "events").select("event_id", media.media_kind(F.array(attribute), mime).alias("kind"))


@query("""WITH i AS (SELECT doc_id, trim(lower(source || ' ' || CASE lang WHEN 'en' THEN 'A Meme of a selfie' WHEN 'de' THEN 'documents' ELSE '' END)) AS r FROM documents)
SELECT doc_id, CASE WHEN regexp_extract(r, '^[^ ]+') IN ('selfie', 'meme', 'generic', 'document') THEN regexp_extract(r, '^[^ ]+') WHEN contains(r, 'selfie') THEN 'selfie' WHEN contains(r, 'meme') THEN 'meme' WHEN contains(r, 'generic') THEN 'generic' WHEN contains(r, 'document') THEN 'document' ELSE 'generic' END AS image_type FROM i""")
def image_types(spark, d):
    said = F.concat("source", F.lit(" "), F.when(F.col("lang") == "en", "A Meme of a selfie").when(F.col("lang") == "de", "documents").otherwise(""))
    return table(spark, d, "documents").select("doc_id", media.image_type(said).alias("image_type"))


@query(f"SELECT chat_id, doc_id, regexp_replace('a ' || CASE WHEN mine THEN '[AUDIO TRANSCRIPT] ' ELSE '[PHOTO]' END || content || '[PHOTO]', CASE WHEN mine THEN '\\[AUDIO(?:\\s+TRANSCRIPT)?\\]\\s*' ELSE '\\[PHOTO\\]\\s*' END, CASE WHEN mine THEN '[AUDIO TRANSCRIPT] said $1' ELSE '[PHOTO] said $1' END || chr(10)) AS content FROM {TURNS}")
def retagged_contents(spark, d):
    tag = F.when(F.col("mine"), "[AUDIO TRANSCRIPT] ").otherwise("[PHOTO]")
    content = F.concat(F.lit("a "), tag, "content", F.lit("[PHOTO]"))
    return turns(spark, d).select("chat_id", "doc_id", media.retagged(content, F.when(F.col("mine"), "audio").otherwise("photo"), F.lit("said $1")).alias("content"))


@query(f"SELECT chat_id, coalesce(arg_min(kind, doc_id) FILTER (kind IS NOT NULL), 'text') AS modality FROM (SELECT *, CASE WHEN length(content) % 7 = 0 THEN 'vision' WHEN length(content) % 5 = 0 THEN 'audio' END AS kind FROM {TURNS}) GROUP BY 1")
def payload_modality(spark, d):
    """A conversation as one request: what its first part that isn't text is."""
    kind = F.when(F.length("content") % 7 == 0, "input_image").when(F.length("content") % 5 == 0, "input_audio").otherwise("text")
    turn = F.struct("doc_id", F.struct(F.col("sender").alias("role"), F.array(F.struct(kind.alias("type"))).alias("parts")).alias("x"))
    payload = F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["x"])
    return turns(spark, d).groupBy("chat_id").agg(messages.payload_kind(payload).alias("modality"))


@query(f"SELECT chat_id, string_agg('<|im_start|>' || sender || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY doc_id) || '<|im_start|>assistant' || chr(10) AS prompt FROM {TURNS} GROUP BY 1")
def chat_prompts(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("doc_id", media.chat_turn(F.col("sender"), F.col("content")).alias("line"))))
    return turns(spark, d).groupBy("chat_id").agg(F.concat(F.array_join(F.transform(lines, lambda x: x.line), ""), F.lit("<|im_start|>assistant\n")).alias("prompt"))


@query(f"SELECT chat_id, doc_id, CASE WHEN contains(lower(content), lower(name)) AND name <> '' THEN nullif(trim(replace(content, name, '')), '') ELSE content END AS search FROM (SELECT *, regexp_extract(content, '[A-Za-z]+') AS name FROM {TURNS})")
def searches_without_names(spark, d):
    return turns(spark, d).select("chat_id", "doc_id", media.without_name(F.col("content"), F.regexp_extract("content", "[A-Za-z]+", 0)).alias("search"))


@query(f"WITH n AS (SELECT max(ts) AS now FROM {EV}), u AS (SELECT * FROM (VALUES ('minutes', INTERVAL 600 MINUTE), ('hours', INTERVAL 5 HOUR), ('days', INTERVAL 3 DAY), ('weeks', INTERVAL 14 DAY), ('months', INTERVAL 30 DAY)) AS t(unit, span)) SELECT unit, count(*) AS n FROM {EV} m, n, u WHERE m.ts >= n.now - u.span GROUP BY 1")
def recent_by_unit(spark, d):
    m = event_messages(spark, d)
    now = m.agg(F.max("ts").alias("now"))
    asked = {"minutes": 600, "hours": 5, "days": 3, "weeks": 2, "months": 1}
    counts = [F.count_if(F.col("ts") >= media.since(F.col("now"), n, u)).alias(u) for u, n in asked.items()]
    return m.select("ts").join(F.broadcast(now), F.lit(True)).agg(*counts).unpivot([], list(asked), "unit", "n")


@query(f"SELECT sender, 4 + least(count(*) / 5, 30) AS size FROM {EV} GROUP BY 1")
def node_sizes(spark, d):
    return graph.profiles(event_messages(spark, d)).select("sender", media.node_size(F.col("n")).alias("size"))


@query(f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY chat_id) AS c FROM {TURNS}) SELECT chat_id, doc_id FROM p WHERE c <= 3 OR i IN (0, c // 3, 2 * c // 3)")
def even_samples(spark, d):
    return choices.even_sample(turns(spark, d), "chat_id", "doc_id", 3).select("chat_id", "doc_id")


@query("SELECT event_type, count(*) AS size, event_type = coalesce(CASE WHEN bool_or(event_type = 'view') OVER () THEN 'view' WHEN bool_or(event_type = 'click') OVER () THEN 'click' END, '') AS is_next FROM events GROUP BY event_type")
def queue_sizes(spark, d):
    return choices.next_by_priority(table(spark, d, "events"), "event_type", ["absent", "view", "click"])


@query("SELECT doc_id, lang FROM documents ORDER BY coalesce(contains(lower(text), 'license'), false), doc_id DESC LIMIT 5")
def last_with_word_first(spark, d):
    return choices.last_with_word_first(table(spark, d, "documents"), "license", "text", "doc_id").select("doc_id", "lang")


@query(f"SELECT doc_id, chat, ts FROM {EV} ORDER BY value < 50, CASE chat WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, ts DESC, doc_id DESC LIMIT 50")
def ordered_dialogs(spark, d):
    rank = F.when(F.col("chat") == "click", 0).when(F.col("chat") == "view", 1).otherwise(2)
    return event_messages(spark, d).orderBy(F.col("value") < 50, rank, F.desc("ts"), F.desc("doc_id")).limit(50).select("doc_id", "chat", "ts")


@query("""WITH s AS (SELECT source AS chat, doc_id, lang AS topic, n_chars AS words, n_chars % 1000 / 1000 AS importance FROM documents),
t AS (SELECT chat, topic, row_number() OVER (PARTITION BY chat ORDER BY count(*) DESC, min(doc_id)) AS rn FROM s WHERE topic IS NOT NULL GROUP BY 1, 2),
tt AS (SELECT chat, string_agg(topic, ',' ORDER BY rn) AS topics, string_agg(topic, ',' ORDER BY rn) FILTER (rn <= 5) AS tags FROM t WHERE rn <= 8 GROUP BY 1),
w AS (SELECT chat, string_agg(words::VARCHAR, ' ' ORDER BY doc_id) AS description FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY doc_id) AS rn FROM s) WHERE rn <= 3 GROUP BY 1)
SELECT s.chat, topics, tags, description, count(*) AS events, max(importance) AS importance FROM s LEFT JOIN tt USING (chat) JOIN w USING (chat) GROUP BY ALL""")
def chat_aggregates(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("chat"), F.col("doc_id").alias("seq"), F.col("lang").alias("topic"), F.col("n_chars").cast("string").alias("summary"), F.lit(1).alias("events"), (F.col("n_chars") % 1000 / 1000).alias("importance"))
    return choices.chat_aggregates(s)


STEPS = "SELECT conv_id, turn, length(text) % 60 AS s, length(text) % 97 AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations"


@query(f"""WITH RECURSIVE p AS ({STEPS}), r AS (SELECT conv_id, rn, 0::BIGINT AS s, e::BIGINT AS e FROM p WHERE rn = 1
UNION ALL SELECT p.conv_id, p.rn, r.e, CASE WHEN p.s <> r.e AND p.e <= r.e THEN r.e + 10 ELSE p.e END FROM r JOIN p ON p.conv_id = r.conv_id AND p.rn = r.rn + 1)
SELECT conv_id, rn AS segment_no, s AS start_s, e AS end_s FROM r""")
def stitched_timelines(spark, d):
    given = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 60).alias("s"), (F.length("text") % 97).alias("e"))
    lines = sequences.stitched(order.numbered(given, "conv_id", "turn", name="segment_no"), "conv_id", ["segment_no"])
    return lines.select("conv_id", F.col("segment_no").cast("long").alias("segment_no"), "start_s", "end_s")


@query("""WITH RECURSIVE p AS (SELECT conv_id, {'s': s, 'e': e, 'confidence': confidence} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, s, e) AS rn, count(*) OVER (PARTITION BY conv_id) AS last FROM
 (SELECT conv_id, length(text) % 50 AS s, length(text) % 50 + 10 + turn AS e, length(text) % 7 AS confidence FROM conversations)),
r AS (SELECT conv_id, rn, last, [x] AS kept FROM p WHERE rn = 1 UNION ALL
 SELECT p.conv_id, p.rn, p.last, CASE WHEN len(list_filter(r.kept, lambda k: k.s < p.x.e AND p.x.s < k.e)) = 0 THEN list_append(r.kept, p.x) ELSE r.kept END FROM r JOIN p ON p.conv_id = r.conv_id AND p.rn = r.rn + 1)
SELECT conv_id, unnest(kept).s AS s, unnest(kept).e AS e, unnest(kept).confidence AS confidence FROM r WHERE rn = last""")
def surest_spans(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.length("text") % 50).alias("s"), (F.length("text") % 50 + 10 + F.col("turn")).alias("e"), (F.length("text") % 7).alias("confidence"))
    return choices.without_overlaps(c, "conv_id")


from . import chat_catalog  # noqa: E402, F401  (adds its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
