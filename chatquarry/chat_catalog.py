"""Queries over the derived tables of a chat archive, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import CLEAN, PLAIN, SPACE, query, stripped
from .functions import dates, messages as m, names, text
from .operators import enrichment, graph, history, joins, mentions, order, people
from .plans import questions, registry, tools
from .sources.tables import derived, derived_sql, table
from .streaming import ingest

CHATS, CONTACTS, MEMBERS, RAW = (derived_sql(n) for n in ("chats", "contacts", "members", "raw"))
#: Messages with their metadata as columns; broken JSON counts as empty.
META = f"""(SELECT *, j ->> '$.sender_id' AS sender_id, j ->> '$.sender_name' AS sender_name, coalesce(j ->> '$.is_from_me', 'false') AS mine, j ->> '$.reply_to_msg_id' AS reply_to, j ->> '$.source' AS via,
 CASE WHEN json_type(j, '$.media') = 'OBJECT' THEN true ELSE false END AS has_media, j ->> '$.media.type' AS media_type, j ->> '$.media.path' AS path, j ->> '$.media.description' AS said, j ->> '$.media.tags' AS tags, j ->> '$.media.extension' AS extension
 FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata ELSE '{{}}' END AS j FROM {RAW}))"""


def raw(spark, d):
    return derived(spark, d, "raw").withColumn("meta", m.metadata())


# ---------------------------------------------------------------- names

#: What the spelling rules make of the three names asked for.
ASKED = {"lev": ("lev", "лев", "лєв"), "Алиса": ("алис", "alis", "аліс"), "customer#": ("cust", "цуст", "цуст"), "  ": ()}


def name_hits(columns: tuple[str, ...]) -> str:
    starts = lambda prefixes: " OR ".join(f"coalesce({c}, '') ILIKE '{p}%'" for c in columns for p in prefixes) or "false"
    return " UNION ALL ".join(f"SELECT '{asked}' AS asked, * FROM j WHERE {starts(prefixes)}" for asked, prefixes in ASKED.items())


@query(f"""WITH j AS (SELECT ch.*, c.name, c.username FROM {CHATS} ch LEFT JOIN {MEMBERS} USING (chat_id) LEFT JOIN {CONTACTS} c USING (user_id)), h AS ({name_hits(("name", "username", "title"))}),
g AS (SELECT asked, chat_id, title, is_private, max(coalesce(name, username)) AS n FROM h GROUP BY ALL)
SELECT * FROM (SELECT asked, chat_id, coalesce(n, title, '') AS contact_name, coalesce(title, '') AS chat_title, coalesce(is_private, false) AS is_private,
 row_number() OVER (PARTITION BY asked ORDER BY is_private DESC NULLS FIRST, title ASC NULLS LAST, chat_id) AS rank FROM g) WHERE rank <= 10""")
def name_search(spark, d):
    asked = spark.createDataFrame([(a,) for a in ASKED], "asked string")
    found = people.find_chats(derived(spark, d, "chats"), derived(spark, d, "members"), derived(spark, d, "contacts"), asked)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT user_id, CASE WHEN name IS NULL THEN '' WHEN name = 'Аліса' THEN 'alis,алис,аліс' WHEN name IN ('Лев', 'Lev') THEN 'lev,лев,лєв' ELSE 'cust,cуст' END AS prefixes FROM {CONTACTS}")
def name_prefixes(spark, d):
    return derived(spark, d, "contacts").select("user_id", F.array_join(F.array_sort(names.prefixes(F.col("name"))), ",").alias("prefixes"))


@query(f"SELECT chat_id, user_id, coalesce(name, username, 'Unknown') AS display_name, username, row_number() OVER (PARTITION BY chat_id ORDER BY name ASC NULLS LAST, user_id) AS position FROM {MEMBERS} JOIN {CONTACTS} USING (user_id)")
def chat_members_display(spark, d):
    return people.members_of(derived(spark, d, "members"), derived(spark, d, "contacts")).withColumn("position", F.col("position").cast("long"))


MENTIONS = [(1, "Alice", 0.9), (1, "lev", 0.95), (2, "automobile1", 0.7), (2, "Nobody", 0.9), (3, "олег", 0.85), (3, "Custome", 0.7), (4, "nation_03", 0.9)]


@query()
def resolved_people(spark, d):
    given = spark.createDataFrame(MENTIONS, "text_id long, raw string, confidence double")
    return people.resolved(given, derived(spark, d, "chats"), derived(spark, d, "members"), derived(spark, d, "contacts"))


@query(f"SELECT user_id, CASE name WHEN 'Лев' THEN 'Lyev' WHEN 'Аліса' THEN 'Alisa' END AS spelling FROM {CONTACTS}")
def lookup_spellings(spark, d):
    return derived(spark, d, "contacts").select("user_id", names.lookup_spelling(F.col("name")).alias("spelling"))


FULL = "lower(c_mktsegment) || ' n' || CAST(c_custkey AS STRING)"
TYPED = "'n' || CAST(c_custkey AS STRING) || ' ' || replace(lower(c_mktsegment), 'i', 'y')"
GRAMS = "list_distinct(list_transform(range(1, length(' ' || {0} || ' ') - 1), lambda i: (' ' || {0} || ' ')[i : i + 2]))"
RATIO = "(CASE WHEN greatest(length({0}), length({1})) = 0 THEN 100.0 ELSE (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))) * 100 END)"
WORDS = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@query(f"""WITH a AS (SELECT {TYPED} AS a FROM customer WHERE c_custkey % 50 = 0), b AS (SELECT c_custkey AS id, {FULL} AS b FROM customer),
p AS (SELECT a, id, b, {WORDS.format("a")} AS sa, {WORDS.format("b")} AS sb, array_to_string(list_sort(list_intersect(string_split(a, ' '), string_split(b, ' '))), ' ') AS c, list_sort(list_filter(string_split(a, ' '), lambda x: NOT list_contains(string_split(b, ' '), x))) AS ra, list_sort(list_filter(string_split(b, ' '), lambda x: NOT list_contains(string_split(a, ' '), x))) AS rb
 FROM a, b WHERE len(list_intersect({GRAMS.format("a")}, {GRAMS.format("b")})) >= ceil(len({GRAMS.format("a")}) / 2)),
w AS (SELECT *, trim(c || ' ' || array_to_string(ra, ' ')) AS ca, trim(c || ' ' || array_to_string(rb, ' ')) AS cb, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM p),
r AS (SELECT a AS asked, id, round(greatest({RATIO.format("a", "b")}, 0.95 * {RATIO.format("sa", "sb")}, CASE WHEN c <> '' THEN 0.95 * greatest({RATIO.format("c", "ca")}, {RATIO.format("c", "cb")}, {RATIO.format("ca", "cb")}) ELSE 0 END,
 0.9 * (1 - list_min(list_transform(range(1, length(t) - length(s) + 2), lambda i: levenshtein(s, t[i : i + length(s) - 1]))) / length(s)) * 100), 4) AS score FROM w)
SELECT asked, id, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, id) AS rank FROM r WHERE score >= 75 QUALIFY rank <= 3""")
def fuzzy_names(spark, d):
    c = table(spark, d, "customer")
    asked = c.filter("c_custkey % 50 = 0").selectExpr(f"{TYPED} AS asked")
    return people.likest(asked, c.selectExpr("c_custkey AS id", f"{FULL} AS name"), 75.0, 3).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- messages and predicates


@query(f"SELECT source_id, doc_id, coalesce(CASE WHEN regexp_matches(sender_id, '^-?[0-9]+$') THEN sender_id END, 'none') AS sender, coalesce(nullif(sender_name, ''), 'Unknown') AS name, mine = 'true' AS mine, media_type FROM {META}")
def typed_messages(spark, d):
    meta = F.col("meta")
    return raw(spark, d).select("source_id", "doc_id", F.coalesce(m.sender(meta).cast("string"), F.lit("none")).alias("sender"), m.sender_name(meta).alias("name"), (F.coalesce("meta.is_from_me", F.lit("false")) == "true").alias("mine"), F.col("meta.media.type").alias("media_type"))


@query(f"SELECT source_id, doc_id FROM {META} WHERE via IS NULL OR via <> 'session_ui'")
def not_session_messages(spark, d):
    return raw(spark, d).filter(m.not_ui(F.col("meta"))).select("source_id", "doc_id")


KINDS = {"text": "NOT has_media", "photo": "coalesce(media_type = 'photo', false)", "audio": "coalesce(media_type IN ('audio', 'voice'), false)", "video": "coalesce(media_type = 'video', false)", "document": "coalesce(media_type = 'document', false)", "other": "true"}


@query("SELECT chat_id, " + ", ".join(f"count(*) FILTER ({t}) AS n_{k}" for k, t in KINDS.items()) + f" FROM {META} GROUP BY 1")
def media_kind_filters(spark, d):
    return raw(spark, d).groupBy("chat_id").agg(*[F.count_if(m.has_media_kind(F.col("meta"), k)).alias(f"n_{k}") for k in KINDS])


@query(f"SELECT source_id, doc_id, ts FROM {META} WHERE has_media AND (coalesce(said, '') ILIKE '%meme of u%' OR coalesce(media_type, '') ILIKE '%meme of u%') ORDER BY ts DESC, doc_id DESC LIMIT 50")
def media_search(spark, d):
    return tools.with_media(raw(spark, d), "Meme of U").select("source_id", "doc_id", "ts")


@query(f"""SELECT source_id, doc_id, CASE media_type WHEN 'photo' THEN 'analyze_image' WHEN 'voice' THEN 'transcribe_audio' WHEN 'audio' THEN 'transcribe_audio' ELSE 'analyze_pdf' END AS task, CASE media_type WHEN 'photo' THEN 'vision' WHEN 'document' THEN 'document' ELSE 'audio' END AS model
FROM {META} WHERE media_type IN ('photo', 'voice', 'audio', 'document') AND coalesce(path, '') <> '' AND coalesce(said, '') = ''""")
def reindex_tasks(spark, d):
    media = F.col("meta.media")
    rows = raw(spark, d).withColumn("t", m.analysis_task(media)).filter(F.col("t").isNotNull() & (F.coalesce(media["path"], F.lit("")) != "") & (F.coalesce(media["description"], F.lit("")) == ""))
    return rows.select("source_id", "doc_id", "t.task", "t.model")


@query(f"SELECT source_id, doc_id, 'keywords' AS reason, 'tg://openmessage?user_id=' || chat_id || '&message_id=' || doc_id AS link FROM {META} WHERE has_media AND (lower(coalesce(said, '')) LIKE '%meme%' OR lower(coalesce(said, '')) LIKE '%funny%' OR lower(coalesce(tags, '')) LIKE '%meme%' OR lower(coalesce(tags, '')) LIKE '%funny%')")
def memes(spark, d):
    rows = raw(spark, d).withColumn("reason", m.meme_reason(F.col("meta.media"))).filter("reason is not null")
    return rows.select("source_id", "doc_id", "reason", m.deep_link(F.col("chat_id"), F.col("doc_id")).alias("link"))


LINKED = "CASE doc_id % 3 WHEN 0 THEN '-100' || CAST(chat_id AS STRING) WHEN 1 THEN '-5' || CAST(chat_id AS STRING) ELSE CAST(chat_id AS STRING) END"


@query(f"SELECT source_id, doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://t.me/c/' || chat_id || '/' || doc_id WHEN 1 THEN 'https://t.me/c/5' || chat_id || '/' || doc_id ELSE 'tg://openmessage?user_id=' || chat_id || '&message_id=' || doc_id END AS link FROM {RAW}")
def deep_links(spark, d):
    return raw(spark, d).select("source_id", "doc_id", m.deep_link(F.expr(LINKED), F.col("doc_id")).alias("link"))


@query(f"SELECT source_id, doc_id, '/media/' || split_part(path, '/', -1) AS file FROM {META} WHERE coalesce(path, '') <> ''")
def media_files(spark, d):
    return raw(spark, d).select("source_id", "doc_id", m.media_file(F.col("meta.media")).alias("file")).filter("file is not null")


@query(rf"""SELECT source_id, doc_id, md5(CASE WHEN mine = 'true' THEN '[Me]' ELSE '[' || coalesce(nullif(sender_name, ''), 'Unknown') || ']' END || ': ' || {stripped("coalesce(content, '')")}
 || CASE WHEN coalesce(path, '') <> '' THEN ' | Media type: ' || coalesce(media_type, 'media') || ' | Download: /media/' || split_part(path, '/', -1) || CASE WHEN coalesce(said, '') <> '' THEN ' | Description: ' || said[:200] || CASE WHEN length(said) > 200 THEN '...' ELSE '' END ELSE '' END ELSE '' END) AS line FROM {META}""")
def history_lines(spark, d):
    return raw(spark, d).select("source_id", "doc_id", F.md5(m.history_line(F.col("meta"), F.col("content"))).alias("line"))


PREFIX = "CASE WHEN NOT has_media THEN '' WHEN upper(media_type) IN ('AUDIO', 'VOICE') AND coalesce(said, '') <> '' THEN '[' || upper(media_type) || ' TRANSCRIPT] ' || said || chr(10) WHEN coalesce(said, '') <> '' THEN '[' || upper(media_type) || '] ' || said || chr(10) ELSE '[' || upper(media_type) || ']' || chr(10) END"


@query(rf"""SELECT source_id, doc_id, md5('[' || ts || '] ' || CASE WHEN mine = 'true' THEN 'Me' ELSE coalesce(nullif(sender_name, ''), 'Unknown') END || ' (in ' || source_id || ')' || CASE WHEN doc_id % 3 = 0 THEN ' (Forwarded from f)' ELSE '' END || ': ' || {PREFIX} || coalesce(content, '')) AS stored,
 md5('[' || ts || '] ' || coalesce(nullif(sender_name, ''), 'Unknown') || ': ' || CASE WHEN {stripped("coalesce(content, '')")} = '' THEN '[EMPTY MESSAGE]' ELSE {stripped('content')} END) AS model FROM {META}""")
def message_documents(spark, d):
    meta, ts = F.col("meta"), F.col("ts").cast("string")
    mine = F.coalesce("meta.is_from_me", F.lit("false")) == "true"
    stored = m.document_line(ts, m.sender_name(meta), mine, F.col("source_id"), F.when(F.col("doc_id") % 3 == 0, "f"), meta["media"], F.col("content"))
    return raw(spark, d).select("source_id", "doc_id", F.md5(stored).alias("stored"), F.md5(m.model_line(ts, m.sender_name(meta), F.col("content"))).alias("model"))


@query(f"""WITH x AS (SELECT source_id, doc_id, sender_id::BIGINT AS s, reply_to FROM {META} WHERE regexp_matches(sender_id, '^[0-9]+$')), y AS (SELECT source_id, doc_id, sender_id::BIGINT AS s FROM {META} WHERE regexp_matches(sender_id, '^[0-9]+$'))
SELECT least(x.s, y.s) AS user_a, greatest(x.s, y.s) AS user_b, count(*) AS interactions FROM x JOIN y ON x.source_id = y.source_id AND x.reply_to = y.doc_id::VARCHAR WHERE x.s <> y.s GROUP BY 1, 2""")
def reply_graph(spark, d):
    rows = raw(spark, d).select(F.col("source_id").alias("chat"), "doc_id", m.sender(F.col("meta")).alias("sender"), F.col("meta.reply_to_msg_id").try_cast("long").alias("reply_to"))
    return joins.reply_pairs(rows.filter("sender >= 0"))


@query(f"""WITH r AS (SELECT sender_id::BIGINT AS sender, nullif(sender_name, '') AS name, ts, source_id, doc_id, content FROM {META} WHERE regexp_matches(sender_id, '^-?[0-9]+$'))
SELECT sender, first(coalesce(name, 'Unknown') ORDER BY ts, doc_id) AS name, count(*) AS n, md5(string_agg(content, chr(10) ORDER BY ts, doc_id)[:8000]) AS texts FROM r GROUP BY 1""")
def user_texts(spark, d):
    rows = raw(spark, d).select(m.sender(F.col("meta")).alias("sender"), m.sender_name(F.col("meta")).alias("name"), "ts", "doc_id", "content")
    return graph.user_texts(rows).withColumn("texts", F.md5("texts"))


@query("SELECT doc_id, 'x' AS chat FROM documents WHERE lower(source) LIKE '%rc1%' OR lower(coalesce(lang, '')) LIKE '%rc1%' OR lower(text) LIKE '%rc1%'")
def documents_search(spark, d):
    found = history.holding(table(spark, d, "documents"), "RC1", ["source", "lang", "text"])
    return found.select("doc_id", F.lit("x").alias("chat"))


@query(f"""SELECT m.source_id, m.doc_id FROM {META} m LEFT JOIN {CHATS} c ON c.chat_id = m.chat_id % 25
WHERE contains(lower(coalesce(content, '')), 'n1') OR contains(lower(coalesce(title, '')), 'n1') OR contains(lower(coalesce(split_part(path, '/', -1), '')), 'n1') OR contains(lower(coalesce(sender_name, '')), 'n1')""")
def message_search(spark, d):
    """In contents, titles of chats, names of files and of senders."""
    chats = derived(spark, d, "chats").select(F.col("chat_id").alias("of"), "title")
    rows = raw(spark, d).join(chats, F.col("of") == F.col("chat_id") % 25, "left").select("source_id", "doc_id", "content", "title", m.media_file(F.col("meta.media")).alias("link"), F.col("meta.sender_name").alias("sender_name"))
    rows = rows.withColumn("file", F.element_at(F.split("link", "/"), -1))
    return history.holding(rows, "N1", ["content", "title", "file", "sender_name"]).select("source_id", "doc_id")


DIALOG = "(SELECT chat_id, coalesce(title, '') AS name, CASE chat_id % 4 WHEN 0 THEN 'personal' WHEN 1 THEN 'group' WHEN 2 THEN 'channel' ELSE 'bot' END AS type, is_private IS NULL AS archived FROM {0})"


@query(f"SELECT chat_id, name, CASE WHEN archived THEN 'archived' ELSE type END AS list FROM {DIALOG.format(CHATS)} WHERE contains(lower(name), 'nation_') AND (archived OR type <> 'bot')")
def dialog_groups(spark, d):
    kind = F.expr("CASE chat_id % 4 WHEN 0 THEN 'personal' WHEN 1 THEN 'group' WHEN 2 THEN 'channel' ELSE 'bot' END")
    rows = derived(spark, d, "chats").select("chat_id", F.coalesce("title", F.lit("")).alias("name"), kind.alias("type"), F.col("is_private").isNull().alias("archived"))
    return history.dialog_lists(rows, "Nation_").select("chat_id", "name", "list")


STAMPED = "CASE turn % 4 WHEN 0 THEN '2024-03-05T10:00:00' WHEN 1 THEN '2024-03-05 10:00:00+02:00' WHEN 2 THEN 'yesterday' END"


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN TIMESTAMP '2024-03-05 10:00:00' WHEN 1 THEN TIMESTAMP '2024-03-05 08:00:00' ELSE TIMESTAMP '2024-03-31 12:00:00' END AS at FROM conversations")
def message_times(spark, d):
    """Times that don't parse, and none, become the one given."""
    now = F.lit("2024-03-31 12:00:00").cast("timestamp")
    return table(spark, d, "conversations").select("conv_id", "turn", m.message_time(F.expr(STAMPED), now).cast("timestamp_ntz").alias("at"))


LINKING = "CASE turn % 3 WHEN 0 THEN text || ' see /media/a_' || CAST(conv_id AS STRING) || '.JPG and (/media/b.webp)' WHEN 1 THEN text || ' /media/c.pdf' ELSE text END"


@query(rf"SELECT conv_id, turn, len(found)::BIGINT AS links, array_to_string(found, ',') AS files FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN regexp_extract_all({LINKING}, '(?i)(/media/[a-zA-Z0-9_.-]+\.(?:jpg|jpeg|png|gif|webp))', 1) ELSE [] END AS found FROM conversations)")
def inline_media(spark, d):
    found = m.inline_media(F.col("role"), F.expr(LINKING))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("links"), F.array_join(found, ",").alias("files"))


@query(f"SELECT chat_id, coalesce(title, '') AS title, CASE WHEN is_private IS NULL THEN 'archived' ELSE 'open' END AS part FROM {CHATS} WHERE contains(lower(coalesce(title, '')), 'nation_1')")
def dialogs_filtered(spark, d):
    rows = derived(spark, d, "chats").filter(F.lower(F.coalesce("title", F.lit(""))).contains("nation_1"))
    return rows.select("chat_id", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("is_private").isNull(), "archived").otherwise("open").alias("part"))


@query(f"SELECT chat_id, mine, importance FROM (SELECT chat_id, count(*) FILTER (mine = 'true') AS mine, round(count(*) FILTER (mine = 'true') / sum(count(*) FILTER (mine = 'true')) OVER (), 6) AS importance FROM {META} GROUP BY 1) WHERE importance >= 0.001 ORDER BY importance DESC NULLS LAST, mine DESC, chat_id LIMIT 50")
def chats_by_importance(spark, d):
    per = raw(spark, d).groupBy("chat_id").agg(F.count_if(F.coalesce("meta.is_from_me", F.lit("false")) == "true").alias("mine"))
    total = per.agg(F.sum("mine").alias("total"))
    rows = per.join(F.broadcast(total)).select("chat_id", "mine", F.round(F.col("mine") / F.nullif("total", F.lit(0)), 6).alias("importance"))
    return rows.filter("importance >= 0.001").orderBy(F.desc_nulls_last("importance"), F.desc("mine"), "chat_id").limit(50)


@query(f"SELECT user_id, name FROM {CONTACTS} ORDER BY name ASC NULLS LAST, user_id LIMIT 50")
def contacts_by_name(spark, d):
    return derived(spark, d, "contacts").select("user_id", "name").orderBy(F.asc_nulls_last("name"), "user_id").limit(50)


@query(f"SELECT chat_id, max(ts) AS updated FROM {RAW} GROUP BY 1 ORDER BY updated DESC, chat_id LIMIT 50")
def sessions_by_update(spark, d):
    return raw(spark, d).groupBy("chat_id").agg(F.max("ts").alias("updated")).orderBy(F.desc("updated"), "chat_id").limit(50)


@query(f"SELECT * FROM {CHATS} WHERE chat_id = 7")
def chat_by_id(spark, d):
    return derived(spark, d, "chats").filter("chat_id = 7")


@query(f"SELECT source_id, s, e FROM (SELECT source_id, ts - ts % 300 AS s, ts - ts % 300 + 600 AS e FROM {RAW}) GROUP BY ALL ORDER BY source_id, s, e")
def download_ranges(spark, d):
    return raw(spark, d).select("source_id", (F.col("ts") - F.col("ts") % 300).alias("s"), (F.col("ts") - F.col("ts") % 300 + 600).alias("e")).distinct().orderBy("source_id", "s", "e")


# ---------------------------------------------------------------- enrichment, events, jobs

RESULTS = """(SELECT 'chat_' || CAST(conv_id AS STRING) AS source_id, turn AS doc_id, CASE turn % 5 WHEN 0 THEN 'analyze_image' WHEN 1 THEN 'transcribe_audio' ELSE 'analyze_pdf' END AS task, CASE WHEN conv_id % 4 = 1 THEN 'failed' ELSE 'completed' END AS status,
 CASE turn % 5 WHEN 0 THEN '{"description":"costs $1","is_meme":true,"tags":["a","b"]}' WHEN 1 THEN '{"transcript":"um hello","cleaned_transcript":"hello"}' WHEN 2 THEN '{"text":"page one","page_count":3}' END AS result FROM conversations)"""


@query(f"""SELECT source_id, doc_id, CASE WHEN task = 'analyze_image' THEN 'costs $1' WHEN task = 'transcribe_audio' THEN 'hello' ELSE 'page one | Pages: 3' END AS description, CASE WHEN task = 'analyze_image' THEN 'true' END AS is_meme, CASE WHEN task = 'analyze_image' THEN 'a, b' END AS tags,
 md5('x ' || CASE upper(coalesce(media_type, 'media')) WHEN 'PHOTO' THEN CASE WHEN task = 'analyze_image' THEN '[PHOTO] costs $1' ELSE '[PHOTO] ?' END || chr(10) WHEN 'VOICE' THEN '[VOICE TRANSCRIPT] hello' || chr(10) WHEN 'DOCUMENT' THEN '[DOCUMENT] page one | Pages: 3' || chr(10) ELSE '[' || upper(coalesce(media_type, 'media')) || ']' END || content) AS content
 FROM {META} JOIN {RESULTS} USING (source_id, doc_id) WHERE status = 'completed' AND result IS NOT NULL AND media_type IS NOT NULL""")
def enriched_messages(spark, d):
    tagged = F.concat(F.lit("x ["), F.upper("meta.media.type"), F.lit("]"), "content")
    media = F.struct("meta.media.type", "meta.media.description", "meta.media.is_meme", F.lit(None).cast("string").alias("tags"))
    rows = raw(spark, d).filter("meta.media.type is not null").select("source_id", "doc_id", tagged.alias("content"), media.alias("media"))
    results = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("'chat_' || CAST(conv_id AS STRING) AS source_id", "turn AS doc_id", "CASE turn % 5 WHEN 0 THEN 'analyze_image' WHEN 1 THEN 'transcribe_audio' ELSE 'analyze_pdf' END AS task", "CASE WHEN conv_id % 4 = 1 THEN 'failed' ELSE 'completed' END AS status", """CASE turn % 5 WHEN 0 THEN '{"description":"costs $1","is_meme":true,"tags":["a","b"]}' WHEN 1 THEN '{"transcript":"um hello","cleaned_transcript":"hello"}' WHEN 2 THEN '{"text":"page one","page_count":3}' END AS result""")
    return enrichment.enriched(rows, results).withColumn("content", F.md5("content")).withColumn("is_meme", F.col("is_meme").cast("string"))


def said_any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


EVENTS = {"debt": ("owe", "debt", "borrow", "lent"), "interview": ("interview", "call", "meeting", "hiring"), "top_up_reminder": ("pay", "bill", "top up", "internet", "subscription")}


@query(" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS event_type FROM documents WHERE {said_any(words)} AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)" for kind, words in EVENTS.items()))
def event_candidates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return enrichment.event_candidates(docs, table(spark, d, "labels"), ["doc_id"]).select("doc_id", "event_type")


TELLING = "text || CASE doc_id % 4 WHEN 0 THEN '. I owe Bob 12.50 since 2024-02-01! Bye.' WHEN 1 THEN chr(10) || 'In 3 weeks, on 2024-04-02, the hiring begins. Pay later 7' ELSE '' END"


def told(kind: str, words: tuple[str, ...]) -> str:
    w, amount = "|".join(words), r"\d+(?:[.,]\d+)?"
    return f"""SELECT doc_id, '{kind}' AS event_type, trim(s)[:120] AS title, regexp_extract(lower(s), '({w})', 1) AS keyword, CASE WHEN regexp_extract(s, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b') <> '' THEN try_cast(regexp_extract(s, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b') AS DATE) END AS start_time,
 coalesce(nullif(regexp_extract(lower(s), '(?s)(?:{w}).*?({amount})', 1), ''), nullif(regexp_extract(regexp_extract(lower(s), '(?s)^(.*?)(?:{w})', 1), '(?s)({amount})[^\\d]*$', 1), '')) AS amount
 FROM (SELECT doc_id, list_filter(regexp_extract_all({TELLING}, '[^.!?\\n]+(?:[.][0-9][^.!?\\n]*)*[.!?]*'), lambda x: regexp_matches(lower(x), '{w}'))[1] AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) WHERE s IS NOT NULL"""


@query(f"SELECT doc_id AS evidence_msg_id, event_type, title, coalesce(start_time::VARCHAR, '') AS start_time, keyword, coalesce(amount, '') AS amount FROM ({' UNION ALL '.join(told(k, w) for k, w in EVENTS.items())})")
def event_rows(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{TELLING} AS content")
    rows = enrichment.event_rows(docs, table(spark, d, "labels"), ["doc_id"], F.lit("2024-03-31").cast("date"))
    of = lambda k: F.get_json_object("payload", f"$.{k}")
    return rows.select("evidence_msg_id", "event_type", "title", F.coalesce(F.col("start_time").cast("string"), F.lit("")).alias("start_time"), of("keyword").alias("keyword"), F.coalesce(of("amount"), F.lit("")).alias("amount"))


@query("SELECT title, start_time::VARCHAR AS start_time, doc_id FROM (SELECT lower(trim(source)) AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS start_time, doc_id, row_number() OVER (PARTITION BY lower(trim(source)), CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def event_titles_dedup(spark, d):
    events = table(spark, d, "documents").select(F.concat(F.lit(" "), F.upper("source")).alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7).alias("start_time"), "doc_id")
    return enrichment.first_events(events, ["doc_id"]).withColumn("title", F.lower(F.trim("title"))).withColumn("start_time", F.col("start_time").cast("string"))


@query("""SELECT title, event_type, start_time, coalesce(end_time, -1) AS end_time FROM (SELECT 'old' AS title, 'other' AS event_type, 1::BIGINT AS start_time, NULL::BIGINT AS end_time UNION ALL SELECT 'src1', 'other', 9, 9
UNION ALL SELECT DISTINCT coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, 'Untitled event'), CASE WHEN doc_id % 2 = 0 THEN 'other' ELSE 'odd' END, 9, 9 FROM documents WHERE NOT (doc_id % 5 <> 0 AND source = 'src1' AND doc_id % 2 = 0))""")
def event_upsert(spark, d):
    base = spark.createDataFrame([("old", "other", 1, None), ("src1", "other", 9, 9)], "title string, event_type string, start_time long, end_time long")
    given = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 2 == 1, "odd").alias("event_type"), F.lit(None).cast("long").alias("start_time"), F.lit(None).cast("long").alias("end_time"))
    return enrichment.stored_events(base, given, F.lit(9).cast("long"), ["title", "event_type", "start_time", "end_time"]).withColumn("end_time", F.coalesce("end_time", F.lit(-1).cast("long")))


TASKS = "(SELECT CAST(user_id % 20 AS BIGINT) AS job, CASE WHEN user_id % 20 < 8 THEN 'completed' WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'processing' WHEN event_id % 4 = 2 THEN 'completed' ELSE 'failed' END AS status FROM events)"


@query(f"""SELECT job, total, pending, processing, completed, failed, sealed, sealed AND total > 0 AND pending = 0 AND processing = 0 AS done FROM (SELECT coalesce(t.job, s.job) AS job, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending, coalesce(processing, 0) AS processing, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, s.job IS NOT NULL AS sealed
 FROM (SELECT job, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM {TASKS} GROUP BY 1) t FULL JOIN (SELECT unnest(range(0, 40, 2))::BIGINT AS job) s ON t.job = s.job)""")
def job_states(spark, d):
    tasks = table(spark, d, "events").selectExpr("CAST(user_id % 20 AS BIGINT) AS job", "CASE WHEN user_id % 20 < 8 THEN 'completed' WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'processing' WHEN event_id % 4 = 2 THEN 'completed' ELSE 'failed' END AS status")
    return enrichment.job_states(tasks, spark.range(0, 40, 2).withColumnRenamed("id", "job"))


@query("""SELECT s_name AS name, s_acctbal AS memory, s_suppkey % 5 AS cpu, coalesce(vram, 0)::BIGINT AS vram, coalesce(n, 0) AS processes FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_linenumber)::BIGINT AS vram, count(*) AS n FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1) ON l_suppkey = s_suppkey""")
def containers(spark, d):
    s = table(spark, d, "supplier")
    stats = s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("memory"), (F.col("s_suppkey") % 5).alias("cpu"))
    named = s.filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("container"), F.col("s_name").alias("name"))
    used = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("container"), F.col("l_linenumber").cast("long").alias("used"))
    return enrichment.containers(stats, named, used)


@query("SELECT (SELECT string_agg(label::VARCHAR, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM embeddings)) AS clusters, (SELECT count(*) FROM embeddings) AS nodes, (SELECT count(*) FROM labels) AS edges")
def cluster_counts(spark, d):
    nodes = table(spark, d, "embeddings").select(F.col("label").alias("cluster"))
    return graph.cluster_counts(nodes, table(spark, d, "labels")).withColumn("clusters", F.array_join(F.col("clusters").cast("array<string>"), ","))


# ---------------------------------------------------------------- segment analyses

SEGMENTS = """(SELECT conv_id * 1000 + turn AS segment_id, conv_id AS chat_id, role AS person, 'n' || CAST(conv_id % 7 AS STRING) AS other, 't' || CAST(length(text) % 13 AS STRING) AS topic, 'i' || CAST(length(text) % 5 AS STRING) AS interest, CASE WHEN turn % 2 = 0 THEN 'friend' ELSE 'work' END AS relation, turn % 3 AS weight FROM conversations)"""


def segments(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS segment_id", "conv_id AS chat_id", "role AS person", "'n' || CAST(conv_id % 7 AS STRING) AS other", "'t' || CAST(length(text) % 13 AS STRING) AS topic", "'i' || CAST(length(text) % 5 AS STRING) AS interest", "CASE WHEN turn % 2 = 0 THEN 'friend' ELSE 'work' END AS relation", "turn % 3 AS weight")
    person = lambda name, i: F.struct(i.cast("long").alias("source_id"), name.alias("display_name"))
    return rows.select("segment_id", "chat_id", F.array(person(F.col("person"), F.lit(None)), person(F.col("other"), F.col("chat_id") % 7)).alias("people"), F.array("topic").alias("topics"), F.array("interest").alias("interests"), F.array(F.struct(F.col("person").alias("from_person"), F.col("other").alias("to_person"), F.col("relation").alias("relation_type"), F.col("weight").cast("double").alias("weight"))).alias("relations"))


def top_words(column: str) -> str:
    return f"SELECT contact_id, string_agg(x, ', ' ORDER BY rn) AS w8, string_agg(x, ', ' ORDER BY rn) FILTER (rn <= 5) AS w5 FROM (SELECT contact_id, {column} AS x, row_number() OVER (PARTITION BY contact_id ORDER BY count(*) DESC, {column}) AS rn FROM seen GROUP BY 1, 2) WHERE rn <= 8 GROUP BY 1"


@query(f"""WITH c AS (SELECT x::BIGINT AS contact_id, 'n' || x AS display_name FROM range(0, 9) t(x) UNION ALL SELECT 99, 'user'),
seen AS (SELECT c.contact_id, c.display_name, s.* FROM c JOIN {SEGMENTS} s ON s.person = c.display_name OR s.other = c.display_name OR s.chat_id % 7 = c.contact_id),
t AS ({top_words("topic")}), i AS ({top_words("interest")}), v AS (SELECT contact_id, relation, sum(weight) AS w FROM seen WHERE display_name IN (person, other) GROUP BY 1, 2), r AS (SELECT contact_id, relation FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY w DESC, relation) AS rn FROM v) WHERE rn = 1)
SELECT contact_id, display_name, CASE WHEN t.w5 IS NULL THEN 'Недостатньо даних для профілю.' ELSE 'Теми спілкування: ' || t.w5 || '. Інтереси: ' || i.w5 || '.' END AS description, coalesce(t.w8, '') AS topics, coalesce(i.w8, '') AS interests, coalesce(relation, 'unknown') AS relation, CASE WHEN t.w5 IS NULL THEN 0.2 ELSE 0.6 END::DOUBLE AS confidence FROM c LEFT JOIN t USING (contact_id) LEFT JOIN i USING (contact_id) LEFT JOIN r USING (contact_id)""")
def contact_profiles(spark, d):
    contacts = spark.createDataFrame([(i, f"n{i}") for i in range(9)] + [(99, "user")], "contact_id long, display_name string")
    found = people.contact_profiles(contacts, segments(spark, d))
    return found.withColumn("topics", F.array_join("topics", ", ")).withColumn("interests", F.array_join("interests", ", "))


@query(f"SELECT chat_id, kind, label, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, kind ORDER BY n DESC, label) AS rank FROM (SELECT chat_id, kind, label, count(*) AS n FROM (SELECT chat_id, 'topic' AS kind, topic AS label FROM {SEGMENTS} UNION ALL SELECT chat_id, 'interest', interest FROM {SEGMENTS} UNION ALL SELECT chat_id, 'person', person FROM {SEGMENTS} UNION ALL SELECT chat_id, 'person', other FROM {SEGMENTS}) GROUP BY 1, 2, 3)) WHERE rank <= 20")
def analysis_frequencies(spark, d):
    s = segments(spark, d)
    labels = lambda kind, column: s.select("chat_id", F.lit(kind).alias("kind"), F.explode(column).alias("label"))
    rows = labels("topic", "topics").unionByName(labels("interest", "interests")).unionByName(labels("person", F.col("people.display_name")))
    return people.most_common(rows, ["chat_id", "kind"], "label", 20).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- questions and tools

#: The kinds of questions in English.
KIND = r"CASE WHEN regexp_matches(q, '\bhomework\b|\bassign(?:ed)?\b') THEN 'assignment' WHEN regexp_matches(q, '\blink\b|\bhttps?://\S+|\bwww\.') THEN 'link' WHEN regexp_matches(q, '\bpdf\b|\bdocx?\b') THEN 'file' ELSE 'generic' END"
ASKED_FOR = {w: f"contains(lower(text), '{w}')" for w in ("last", "recent", "first", "beginning", "?", "homework", "task", "assignment", "exercise", "please", "write", "read", "send", "check")}
NEWEST, OLDEST, TASK = (" OR ".join(list(ASKED_FOR.values())[a:b]) for a, b in ((0, 2), (2, 4), (4, None)))


@query(rf"""WITH a AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(text), '{SPACE}+', ' ', 'g')) AS q FROM conversations), b AS (SELECT *, {KIND} AS kind, len(list_filter(string_split(q, ' '), lambda w: w <> '')) <= 3 AS short, {NEWEST} AS newest, {OLDEST} AS oldest FROM a), c AS (SELECT *, {TASK} OR short AS wide FROM b)
SELECT conv_id, turn, kind, CASE WHEN kind <> 'generic' OR short THEN 'hybrid' ELSE 'vector' END AS mode, CASE WHEN kind <> 'generic' THEN 120 WHEN short THEN 80 ELSE 20 END AS max_rows,
 array_to_string(list_filter([CASE WHEN newest THEN 'select_tail' END, CASE WHEN oldest THEN 'select_head' END, CASE WHEN wide THEN 'hybrid' END, CASE WHEN NOT wide AND NOT newest AND NOT oldest THEN 'vector' END], lambda x: x IS NOT NULL), ',') AS modes,
 md5(CASE kind WHEN 'assignment' THEN 'задание домашка упражнение прочитай напиши решите выполни параграф задача ' WHEN 'link' THEN 'ссылка http https link www ' WHEN 'file' THEN 'файл документ pdf doc прикрепила отправила ' ELSE '' END || q) AS expanded FROM c""")
def question_plans(spark, d):
    q = F.col("text")
    p = questions.policy(q, F.lit(20))
    return table(spark, d, "conversations").select("conv_id", "turn", questions.kind(q).alias("kind"), p["mode"].alias("mode"), p["limit"].alias("max_rows"), F.array_join(questions.modes(q), ",").alias("modes"), F.md5(questions.expanded(q)).alias("expanded"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\bhomework\\b|\\bassign(?:ed)?\\b') THEN 'assignment' WHEN regexp_matches(lower(text), '\\blink\\b|\\bhttps?://\\S+|\\bwww\\.') THEN 'link' WHEN regexp_matches(lower(text), '\\bpdf\\b|\\bdocx?\\b') THEN 'file' ELSE 'generic' END AS kind FROM conversations")
def turn_kinds(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", questions.kind(F.col("text")).alias("kind"))


def searched(spark, d):
    """Messages of three chats' worth of people, each with one of the given vectors."""
    v = table(spark, d, "embeddings")
    rows = raw(spark, d).select(F.col("chat_id").alias("_c"), F.col("doc_id").alias("_t"), "ts", "content", "meta")
    rows = rows.select((F.col("_c") % 25).alias("chat"), (F.col("_c") * 1000 + F.col("_t")).alias("doc_id"), "ts", "content", "meta", (F.col("_c") * 7 + F.col("_t")).alias("k"))
    return rows.join(v.select(F.col("vec_id").alias("k"), "embedding"), "k", "left")


FROM_OTHERS = f"(SELECT chat_id % 25 AS chat, chat_id * 1000 + doc_id AS doc_id, ts, content, chat_id * 7 + doc_id AS k, mine, via FROM {META})"


@query(f"SELECT chat, doc_id, ts FROM {FROM_OTHERS} WHERE lower(mine) IN ('0', 'false') AND (via IS NULL OR via <> 'session_ui') AND ts >= 1000000 - 7 * 86400 ORDER BY ts DESC, doc_id DESC LIMIT 50")
def unread_messages(spark, d):
    return tools.unread(searched(spark, d), 1000000).select("chat", "doc_id", "ts")


SEARCH = f"""WITH v AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3), a AS (SELECT f.*, embedding::DOUBLE[] AS e FROM {FROM_OTHERS} f LEFT JOIN embeddings ON vec_id = k),
lx AS (SELECT doc_id, row_number() OVER (ORDER BY ts DESC, doc_id DESC) AS rank FROM a WHERE lower(mine) IN ('0', 'false') AND (via IS NULL OR via <> 'session_ui') AND contains(lower(content), 'the')<in> QUALIFY rank <= 20),
ve AS (SELECT doc_id, row_number() OVER (ORDER BY list_cosine_similarity(e, q) DESC, doc_id) AS rank FROM a, v WHERE e IS NOT NULL<in> QUALIFY rank <= 20),
fu AS (SELECT doc_id, sum(1 / (60 + rank)) AS score, min(seen) AS seen FROM (SELECT doc_id, rank, rank AS seen FROM lx UNION ALL SELECT doc_id, rank, 1000000 + rank FROM ve) GROUP BY 1),
hits AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 12) DESC, seen) AS rank FROM fu QUALIFY rank <= 20)"""


def vector(spark, d, i: int) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == i).first()["embedding"])  # one row


@query(SEARCH.replace("<in>", "") + " SELECT doc_id, rank FROM hits")
def hybrid_search(spark, d):
    return tools.search(searched(spark, d), "The", vector(spark, d, 3), "hybrid", 20).withColumn("rank", F.col("rank").cast("long"))


@query(SEARCH.replace("<in>", " AND chat = 13") + """, o AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts, doc_id) AS rn FROM a WHERE chat = 13), near AS (SELECT DISTINCT n.doc_id FROM o t JOIN hits USING (doc_id) JOIN o n ON n.rn BETWEEN t.rn - 1 AND t.rn + 1 WHERE hits.rank <= 8)
SELECT chat, doc_id, ts, doc_id IN (SELECT doc_id FROM hits) AS primary FROM o WHERE doc_id IN (SELECT doc_id FROM hits) OR doc_id IN (SELECT doc_id FROM near)""")
def person_search(spark, d):
    chats = derived(spark, d, "chats").withColumn("title", F.when(F.col("chat_id") == 13, "Zoryana").otherwise("other"))
    none = derived(spark, d, "members").limit(0)
    return tools.from_person(searched(spark, d), chats, none, derived(spark, d, "contacts"), "zoryana", "The", vector(spark, d, 3), "hybrid", 20).select("chat", "doc_id", "ts", "primary")


ASKING = SEARCH.replace("<in>", " AND chat = 13").replace("rank <= 20", "rank <= 80")


@query(ASKING + """, o AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts, doc_id) AS rn FROM a WHERE chat = 13), near AS (SELECT DISTINCT n.doc_id FROM o t JOIN hits USING (doc_id) JOIN o n ON n.rn BETWEEN t.rn - 1 AND t.rn + 1 WHERE hits.rank <= 8)
SELECT chat, doc_id, ts, doc_id IN (SELECT doc_id FROM hits) AS primary FROM o WHERE doc_id IN (SELECT doc_id FROM hits) OR doc_id IN (SELECT doc_id FROM near)""")
def person_question(spark, d):
    """A short question, so its policy is to search both ways, widely, by the registered tool."""
    chats = derived(spark, d, "chats").withColumn("title", F.when(F.col("chat_id") == 13, "Zoryana").otherwise("other"))
    found = registry.call("search_from_person", searched(spark, d), chats=chats, members=derived(spark, d, "members").limit(0), contacts=derived(spark, d, "contacts"), name="zoryana", question="The?", vector=vector(spark, d, 3))
    return found.select("chat", "doc_id", "ts", "primary")


@query(f"WITH a AS (SELECT * FROM {FROM_OTHERS} WHERE lower(mine) IN ('0', 'false') AND (via IS NULL OR via <> 'session_ui') AND (contains(lower(content), 'tion') OR contains(lower(content), 'zoom') OR contains(lower(content), 'inen')) ORDER BY ts DESC, doc_id DESC LIMIT 80) SELECT doc_id, row_number() OVER (ORDER BY ts DESC, doc_id DESC) AS rank FROM a")
def history_question(spark, d):
    """Three words, any of which counts; without a vector."""
    return registry.call("search_history", searched(spark, d), question="Tion,  zoom inen?").withColumn("rank", F.col("rank").cast("long"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, (length(text) // 3 + 10)::INT AS tokens, text FROM documents), s AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS so_far FROM r), c AS (SELECT min(rank) AS cut FROM s WHERE so_far > 4000 AND rank > 4)
SELECT doc_id, rank, md5(text) AS text, tokens FROM s, c WHERE cut IS NULL OR rank < cut""")
def packed_context(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("all"))
    rows = order.numbered(docs, "all", "doc_id", name="rank").select("doc_id", "rank", "text")
    again = rows.withColumn("rank", F.col("rank") + 1_000_000_000_000)  # each a second time, behind all others
    return tools.packed(rows.unionByName(again)).withColumn("text", F.md5("text")).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- texts

@query(rf"""WITH c AS (SELECT doc_id, {CLEAN} AS clean, {PLAIN} AS plain FROM documents)
SELECT doc_id, md5(plain) AS normalized, len(list_filter(string_split_regex(lower(plain), '[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) AS tokens, array_to_string(regexp_extract_all(clean, '@([\p{{L}}\p{{N}}_]+)', 1), ',') AS usernames,
 array_to_string(regexp_extract_all(clean, '(?i)https?://[^\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|www\.[^\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+'), ',') AS urls, md5(array_to_string(regexp_extract_all(regexp_replace(clean, '\p{{L}}', 'x', 'g'), '\b[0-9]+\b'), ',')) AS numbers, CASE WHEN regexp_matches(plain, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM c""")
def normal_parts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.normal_parts("text").alias("p"))
    return rows.select("doc_id", F.md5("p.normalized").alias("normalized"), F.size("p.tokens").cast("long").alias("tokens"), F.array_join("p.usernames", ",").alias("usernames"), F.array_join("p.urls", ",").alias("urls"), F.md5(F.array_join("p.numbers", ",")).alias("numbers"), "p.language")


HINTED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'привет ' || CAST(doc_id AS STRING) WHEN 2 THEN CAST(doc_id AS STRING) || ' привіт' ELSE text || ' привет' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'ru' WHEN 2 THEN 'uk' WHEN 0 THEN CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END ELSE CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'mixed' ELSE 'ru' END END AS language FROM documents")
def language_hints(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{HINTED} AS hinted").select("doc_id", text.script_hint("hinted").alias("language"))


@query("SELECT conv_id, sum(greatest(1, floor(length(text) * 2 / 5)) + 8)::INT + 3 AS chat, sum(length(text) // 3 + 10)::BIGINT AS pack, sum(length(text) // 3)::BIGINT AS lines, sum(length(text) // 4)::BIGINT AS windows FROM conversations GROUP BY 1")
def token_rules(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(text.chat_tokens(F.collect_list("text")).alias("chat"), *[F.sum(f("text")).alias(n) for n, f in (("pack", text.pack_tokens), ("lines", text.line_tokens), ("windows", text.window_tokens))])
    return rows


@query(rf"SELECT page_id, md5('<user_data>' || chr(10) || {stripped(r"regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')")} || chr(10) || '</user_data>') AS wrapped FROM pages")
def wrapped_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.wrapped("html")).alias("wrapped"))


ANSWER = """CASE turn % 6 WHEN 0 THEN '```json\n{"description": "a ' || role || '", "n": 1}\n```' WHEN 1 THEN '{"description": "bare"}' WHEN 2 THEN text || ' {"description": "within ' || CAST(conv_id AS STRING) || '"} done'
 WHEN 3 THEN text WHEN 4 THEN 'broken {"description": ' ELSE '{"other": 1}' END"""


@query("""SELECT conv_id, turn, md5(CASE turn % 6 WHEN 0 THEN 'a ' || role WHEN 1 THEN 'bare' WHEN 2 THEN 'within ' || conv_id WHEN 3 THEN text WHEN 4 THEN 'broken {"description": ' ELSE '{"other": 1}' END) AS description FROM conversations""")
def model_answers(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{ANSWER} AS answer")
    return rows.select("conv_id", "turn", F.md5(text.described("answer")).alias("description"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, s AS seconds FROM (SELECT event_id, event_id * 37 % 20000 AS s FROM events)")
def clock_times(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 37 % 20000).alias("s"))
    return rows.select("event_id", text.clock("s").alias("clock")).withColumn("seconds", text.clock_seconds("clock").cast("long"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '|b' ELSE event_type || '|' || user_id END AS items FROM events")
def list_fields(spark, d):
    given = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "b"]'))).otherwise(F.concat("event_type", F.lit(" , "), F.col("user_id").cast("string")))
    return table(spark, d, "events").withColumn("x", given).select("event_id", F.array_join(text.json_or_csv("x"), "|").alias("items"))


DATED = """text || CASE turn % 10 WHEN 0 THEN ' on 2024-02-30 and 2024-03-05' WHEN 1 THEN ' 5.1.2024 or 31/12/2023' WHEN 2 THEN ' 7 March' WHEN 3 THEN ' May 3, 2023' WHEN 4 THEN ' yesterday' WHEN 5 THEN ' last week' WHEN 6 THEN ' 3 days ago'
 WHEN 7 THEN ' 12 січня 2023 і позавчора' WHEN 8 THEN ' 5 апреля, прошлой неделе' ELSE ' 2 недели назад' END"""


@query(f"""WITH t AS (SELECT conv_id, turn, {DATED} AS t FROM conversations),
e AS (SELECT conv_id, turn, CASE turn % 10 WHEN 0 THEN '2024-03-05..2024-03-06' WHEN 1 THEN '2024-01-05..2024-01-06,2023-12-31..2024-01-01' WHEN 2 THEN '2024-03-07..2024-03-08' WHEN 3 THEN '2023-05-03..2023-05-04' WHEN 4 THEN '2024-03-30..2024-03-31' WHEN 5 THEN '2024-03-18..2024-03-25' WHEN 6 THEN '2024-03-28..2024-04-01'
 WHEN 7 THEN '2023-01-12..2023-01-13,2024-03-29..2024-03-30' WHEN 8 THEN '2023-04-05..2023-04-06,2024-03-18..2024-03-25' ELSE '2024-03-17..2024-04-01' END AS found FROM conversations)
SELECT e.*, CASE turn % 10 WHEN 6 THEN '3' WHEN 9 THEN '2' ELSE '' END AS amount, CASE turn % 10 WHEN 6 THEN 'days' WHEN 9 THEN 'weeks' ELSE '' END AS unit FROM e""")
def time_expressions(spark, d):
    """The dates of texts as of 31 March 2024, and their first number with a unit of time."""
    today = F.lit("2024-03-31").cast("date")
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{DATED} AS text").withColumn("x", m.time_expression("text", F.unix_seconds(today.cast("timestamp"))))
    told = F.transform(dates.dates(F.col("text"), today), lambda x: F.concat(x["start"].cast("string"), F.lit(".."), x["end"].cast("string")))
    return rows.select("conv_id", "turn", F.array_join(told, ",").alias("found"), F.coalesce(F.col("x.amount").cast("string"), F.lit("")).alias("amount"), F.coalesce("x.unit", F.lit("")).alias("unit"))


SPOKEN = """text || CASE turn % 5 WHEN 0 THEN ' find @user_' || CAST(conv_id AS STRING) || '!' WHEN 1 THEN ' link from Bob and files by Nat.' WHEN 2 THEN ' що задала Аліса' WHEN 3 THEN '' ELSE ' бачив Лева' END"""


@query(rf"""WITH t AS (SELECT conv_id, turn, {SPOKEN} AS t FROM conversations), f AS (SELECT conv_id, turn, list_transform(regexp_extract_all(t, '@([\p{{L}}\p{{N}}_]+)', 1), lambda x: '95 ' || x) || list_transform(regexp_extract_all(t, '(?i)(?:що|что|чого|кого|кому|якщо|если|яку|яке|який|которую|которое|который)\s+[\p{{L}}\p{{N}}_]+\s+([А-ЯІЇЄҐA-Z][а-яіїєґёa-z]+)', 1), lambda x: '90 ' || x)
 || list_transform(regexp_extract_all(t, '(?i)(?:від|если|для|with|from)\s+([А-ЯІЇЄҐA-Z][а-яіїєґёa-z]+)', 1), lambda x: '85 ' || x) || list_transform(regexp_extract_all(t, '(?i)(?:from|by|sent by)\s+([A-Z][a-z]+)', 1), lambda x: '85 ' || x) || CASE WHEN turn % 5 = 4 THEN ['70 Лева'] ELSE [] END AS found FROM t)
SELECT conv_id, turn, len(found)::BIGINT AS mentions, md5(array_to_string(list_sort(found), '|')) AS names FROM f WHERE len(found) > 0""")
def text_mentions(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS text_id", f"{SPOKEN} AS text")
    named = F.concat((F.col("confidence") * 100).cast("decimal(4,0)").cast("string"), F.lit(" "), "raw")
    found = mentions.mentions(rows, "text_id", "text").groupBy("text_id").agg(F.count("*").alias("mentions"), F.md5(F.array_join(F.array_sort(F.collect_list(named)), "|")).alias("names"))
    return found.select(F.floor(F.col("text_id") / 1000).cast("long").alias("conv_id"), (F.col("text_id") % 1000).alias("turn"), "mentions", "names")


PARTS = "CASE WHEN length(text) % 7 = 0 THEN 'image_url' WHEN length(text) % 5 = 0 THEN 'input_audio' ELSE 'text' END"


@query(f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'text' ELSE CASE {PARTS} WHEN 'image_url' THEN 'vision' WHEN 'input_audio' THEN 'audio' ELSE 'text' END END AS kind FROM conversations")
def payload_kinds(spark, d):
    """A request of one message each; every third has plain text without parts."""
    message = F.struct("role", F.when(F.col("turn") % 3 != 0, F.array(F.struct(F.lit("text").alias("type")), F.struct(F.expr(PARTS).alias("type")))).alias("parts"))
    return table(spark, d, "conversations").select("conv_id", "turn", m.payload_kind(F.array(message)).alias("kind"))


# ---------------------------------------------------------------- changes and streams


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'second' ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 5.0")
def upsert_last_change(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    own = c.filter("c_acctbal < 0")
    changes = own.select("c_custkey", F.lit("first").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("at")).unionByName(own.select("c_custkey", F.lit("second").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(2).alias("at")))
    new = spark.createDataFrame([(-1, "new", 5.0, 1)], "c_custkey long, c_name string, c_acctbal double, at int")
    return joins.upsert(c, changes.unionByName(new), "c_custkey", ["c_name", "c_acctbal"], "at")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'second' ELSE c_name END AS c_name FROM customer")
def update_by_key(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    own = table(spark, d, "customer").filter("c_acctbal < 0")
    changes = own.select("c_custkey", F.lit("first").alias("c_name"), F.lit(1).alias("at")).unionByName(own.select("c_custkey", F.lit("second").alias("c_name"), F.lit(2).alias("at"))).unionByName(spark.createDataFrame([(-5, "unknown", 3)], "c_custkey long, c_name string, at int"))
    return joins.update(c, changes, "c_custkey", ["c_name"], "at")


@query("""WITH e AS (SELECT user_id, ts, event_id FROM events), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e), f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT mark FROM w)""")
def stream_sessions(spark, d):
    found = ingest.drained(ingest.session_counts(ingest.stream(spark, f"{d}/[e]vents.parquet"), "6 hours"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"SELECT chat_id, doc_id, ts FROM (SELECT * FROM (SELECT chat_id, doc_id, ts FROM {RAW} WHERE chat_id = 3 ORDER BY ts DESC, doc_id DESC LIMIT 10 OFFSET 2) ORDER BY ts, doc_id)")
def page_oldest_first(spark, d):
    newest = history.page(raw(spark, d).filter("chat_id = 3").select("chat_id", "doc_id", "ts"), limit=10, offset=2)
    return newest.orderBy("ts", "doc_id")


@query(f"SELECT chat_id, doc_id, role FROM (SELECT chat_id, doc_id, CASE sender_id WHEN 'assistant' THEN 'assistant' WHEN 'me' THEN 'system' ELSE 'user' END AS role, row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, doc_id DESC) AS rn FROM {META}) WHERE rn <= 4")
def last_turns_with_roles(spark, d):
    who = F.col("meta.sender_id")
    rows = raw(spark, d).select("chat_id", "doc_id", "ts", F.when(who == "assistant", "assistant").when(who == "me", "system").otherwise("user").alias("role"))
    return history.last_of_each(rows, "chat_id", 4).select("chat_id", "doc_id", "role")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_of_equal_texts(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(F.md5("text")).agg(F.min_by(F.struct("doc_id", "lang", "source"), "doc_id").alias("x")).select("x.*")


@query(f"SELECT chat_id, doc_id FROM {META} m WHERE (chat_id, doc_id) IN (SELECT conv_id, turn FROM conversations WHERE length(text) % 11 = 0) ORDER BY ts")
def lookup_by_two_keys(spark, d):
    wanted = table(spark, d, "conversations").filter("length(text) % 11 = 0").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("doc_id"))
    return history.lookup(raw(spark, d), wanted, ["chat_id", "doc_id"]).orderBy("ts").select("chat_id", "doc_id")


@query(f"SELECT source_id, coalesce(doc_id, -1) AS doc_id, CASE WHEN n > 1 THEN 'duplicate' ELSE 'null key' END AS fault FROM (SELECT source_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE doc_id // 2 END AS doc_id, count(*) AS n FROM {RAW} GROUP BY 1, 2) WHERE n > 1 OR doc_id IS NULL")
def key_faults(spark, d):
    rows = raw(spark, d).select("source_id", F.when(F.col("doc_id") % 10 != 9, F.floor(F.col("doc_id") / 2)).alias("doc_id"))
    counted = rows.groupBy("source_id", "doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null or source_id is null")
    return counted.select("source_id", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), F.when(F.col("n") > 1, "duplicate").otherwise("null key").alias("fault"))


@query(f"""WITH r AS (SELECT sender_id::BIGINT AS sender, coalesce(nullif(sender_name, ''), 'Unknown') AS name, ts, doc_id FROM {META} WHERE regexp_matches(sender_id, '^-?[0-9]+$'))
SELECT sender AS id, first(name ORDER BY ts, doc_id) AS label, coalesce(any_value(e.label), 0)::INT AS cluster, count(*) AS message_count FROM r LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0) e ON vec_id = sender GROUP BY sender""")
def social_graph_nodes(spark, d):
    rows = raw(spark, d).select(m.sender(F.col("meta")).alias("sender"), m.sender_name(F.col("meta")).alias("name"), "ts", "doc_id", "content")
    clustered = table(spark, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return graph.assembled_nodes(graph.user_texts(rows), clustered).withColumn("cluster", F.col("cluster").cast("int"))


@query(f"SELECT source_id, doc_id FROM {META} WHERE lower(mine) IN ('0', 'false') AND (via IS NULL OR via <> 'session_ui') AND contains(lower(content), 'the') ORDER BY ts DESC, doc_id DESC, source_id LIMIT 50")
def words_from_others(spark, d):
    rows = tools.others(raw(spark, d)).filter(history.contains_folded("content", "THE"))
    return rows.orderBy(F.desc("ts"), F.desc("doc_id"), "source_id").limit(50).select("source_id", "doc_id")
