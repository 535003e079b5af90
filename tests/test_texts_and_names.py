"""White space of Unicode, masks, dates, events, likeness of names, and the tools that a question chooses."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from chatquarry.functions import dates, messages as m, names, text
from chatquarry.operators import enrichment, history, likeness, people
from chatquarry.plans import registry, tools


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_white_space_is_unicode(spark):
    p = one(spark, "　Hi there   all​　", text.normal_parts("t"))
    assert p.tokens == ["hi", "there", "all"] and p.normalized == "Hi there   all"
    p = one(spark, "Call @ann_b re https://x.org/a　now 42 a7 ٣٤ www.y.z", text.normal_parts("t"))
    assert (p.usernames, p.urls, p.numbers) == (["ann_b"], ["https://x.org/a", "www.y.z"], ["42", "٣٤"]) and p.normalized == "Call @ann_b re  　now 42 a7 ٣٤"
    assert one(spark, "token: abc　and", text.mask_pii("t")) == "token: <SECRET_MASKED>　and"
    assert one(spark, "a|b@c.org|, 555-1234", text.mask_pii("t")) == "a|<EMAIL_MASKED>|, <PHONE_MASKED>"
    assert one(spark, None, text.normal_parts("t")).tokens == []


TODAY = date(2024, 3, 31)
TOLD = [
    ("", []),
    (None, []),
    ("on 2024-03-05 or 2024-13-40", [("2024-03-05", date(2024, 3, 5), date(2024, 3, 6))]),
    ("5.1.2024, 31/12/2023 and 30.02.2024", [("5.1.2024", date(2024, 1, 5), date(2024, 1, 6)), ("31/12/2023", date(2023, 12, 31), date(2024, 1, 1))]),
    ("7 March, 7 April", [("7 March", date(2024, 3, 7), date(2024, 3, 8)), ("7 April", date(2023, 4, 7), date(2023, 4, 8))]),
    ("May 3, 2023 and 5 market stalls", [("May 3, 2023", date(2023, 5, 3), date(2023, 5, 4))]),
    ("Позавчера, вчора та сьогодні", [("Позавчера", date(2024, 3, 29), date(2024, 3, 30)), ("вчора", date(2024, 3, 30), date(2024, 3, 31)), ("сьогодні", date(2024, 3, 31), date(2024, 4, 1))]),
    ("12 січня 2023", [("12 січня 2023", date(2023, 1, 12), date(2023, 1, 13))]),
    ("last week, last month, прошлом году", [("last week", date(2024, 3, 18), date(2024, 3, 25)), ("last month", date(2024, 2, 1), date(2024, 3, 1)), ("прошлом году", date(2023, 1, 1), date(2024, 1, 1))]),
    ("3 days ago и 2 недели назад", [("3 days ago", date(2024, 3, 28), date(2024, 4, 1)), ("2 недели назад", date(2024, 3, 17), date(2024, 4, 1))]),
]


@pytest.mark.parametrize("told,want", TOLD)
def test_dates(spark, told, want):
    got = one(spark, told, dates.dates(F.col("t"), F.lit(str(TODAY)).cast("date")))
    assert [(x.raw, x.start, x.end) for x in got] == want


def test_events_have_title_time_amount_and_evidence(spark):
    docs = spark.createDataFrame([("s", 1, "Hello. I owe Bob 12.50 since 2024-02-01! Bye"), ("s", 2, "Nothing here"), ("s", 3, None), ("s", 4, "Paid 7 euros, pay again\nThe call is yesterday"), ("s", 5, "I owe 3")], "source_id string, doc_id long, content string")
    done = spark.createDataFrame([("s", 5)], "source_id string, doc_id long")
    rows = enrichment.event_rows(docs, done, ["source_id", "doc_id"], F.lit(str(TODAY)).cast("date")).collect()
    got = {(r.evidence_msg_id, r.event_type): (r.title, r.start_time, r.payload) for r in rows}
    assert set(got) == {(1, "debt"), (4, "top_up_reminder"), (4, "interview")}
    assert got[1, "debt"] == ("I owe Bob 12.50 since 2024-02-01!", date(2024, 2, 1), '{"amount":"12.50","keyword":"owe","title":"I owe Bob 12.50 since 2024-02-01!"}')
    assert got[4, "top_up_reminder"][0] == "Paid 7 euros, pay again" and '"amount":"7"' in got[4, "top_up_reminder"][2]
    assert got[4, "interview"][1] == date(2024, 3, 30)


def test_events_of_a_very_long_sentence(spark):
    long = "word 1.5 " * 200_000 + "owe 3"
    rows = one(spark, long, dates.events(F.col("t"), m.EVENT_WORDS, F.lit(str(TODAY)).cast("date")))
    assert [(r.event_type, r.amount, len(r.title)) for r in rows] == [("debt", "3", 120)]


PAIRS = [("Anna Smith", "anna smith", 100.0), ("Smith Anna", "Anna Smith", 95.0), ("Anna", "Anna Maria Smith", 95.0), ("annx", "Hello anna there", 67.5), ("abc", "xyz", 0.0), ("", "abc", 0.0)]


@pytest.mark.parametrize("a,b,score", PAIRS)
def test_weighted_likeness(spark, a, b, score):
    df = spark.createDataFrame([(a, b), (b, a)], "a string, b string")
    assert [round(r[0], 4) for r in df.select(names.weighted_likeness(F.col("a"), F.col("b"))).collect()] == [score, score]


def test_likest_names_share_half_of_their_trigrams(spark):
    named = spark.createDataFrame([(i, n) for i, n in enumerate(["Customer Anna", "Customer Bob", "Customer Alice", "Zoe"] + [f"Customer {i}x" for i in range(300)])], "id long, name string")
    asked = spark.createDataFrame([("customer ana",), ("Alice Customer",), ("zzz",), ("",), (None,)], "asked string")
    got = {r.asked: r.id for r in people.likest(asked, named).collect()}
    assert got == {"customer ana": 0, "Alice Customer": 2}


def test_a_name_is_cut_into_words_a_bounded_number_of_times_a_pair(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(names.weighted_likeness(F.col("a"), F.col("b")))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") <= 8


def test_likest_names_of_dealt_trigrams_equal_a_comparison_of_all(spark, monkeypatch):
    monkeypatch.setattr(people, "POSTED", 3)
    every = ["Household n%d" % i for i in range(90, 130)] + ["Ann  Lee", "anne lee", "Lee Ann", "Li", "", "n100 household", None]
    named = spark.createDataFrame(list(enumerate(every)), "id long, name string")
    asked = spark.createDataFrame([("n101 household",), ("household n99",), ("lee ann",), ("li",), ("household n101",)], "asked string")
    own, theirs = names.trigrams(F.col("name")), names.trigrams(F.col("asked"))
    near = asked.crossJoin(named).filter((F.size(F.array_intersect(own, theirs)) >= F.ceil(F.size(theirs) / 2)) & (F.size(theirs) > 0))
    rows = near.select("asked", "id", F.round(names.weighted_likeness(F.col("asked"), F.col("name")), 4).alias("score")).filter("score >= 75").collect()
    wanted = {(a, i, s) for a in {r.asked for r in rows} for i, s in [(r.id, r.score) for r in sorted(rows, key=lambda r: (-r.score, r.id)) if r.asked == a][:3]}
    assert {(r.asked, r.id, r.score) for r in people.likest(asked, named, 75.0, 3).collect()} == wanted and len(wanted) > 10


def test_likest_names_by_marks_equal_a_comparison_of_all(spark, monkeypatch):
    """Many names: those with the most marks set a bound, and few of the others are scored."""
    scored, near = [], likeness.near
    monkeypatch.setattr(people, "FEW", 0)
    monkeypatch.setattr(likeness, "ASKED_BLOCK", 5)
    monkeypatch.setattr(likeness, "NAMED_BLOCK", 150)
    monkeypatch.setattr(likeness, "near", lambda asked, named: scored.append(near(asked, named)) or scored[-1])
    every = ["household n%d" % i for i in range(1000, 1400)] + ["n1133 household n1133", "Ann  Lee", "anne\tlee", "Lee Ann", "Li", "", "a b c", "c b a", "x", None, "мария иванова", "иванова марья", "ann", "a" * 300 + " lee"]
    named = spark.createDataFrame(list(enumerate(every)), "id long, name string").repartition(3)
    given = ["n1133 household", "household n1299", "n1000 hausehold", "lee ann", "ann lee maria", "li", "a  b\tc", "c a b", "x", "", "марья иванова", "a" * 299 + " lea", None]
    asked = spark.createDataFrame([(a,) for a in given], "asked string")
    got = {(r.asked, r.id, r.score, r["rank"]) for r in people.likest(asked, named, 75.0, 3).collect()}
    assert scored[1].filter("q is not null").count() < 400
    monkeypatch.setattr(people, "FEW", 1 << 40)
    assert got == {(r.asked, r.id, r.score, r["rank"]) for r in people.likest(asked, named, 75.0, 3).collect()} and len(got) > 15
    own, theirs = names.trigrams(F.col("name")), names.trigrams(F.col("asked"))
    near_ = asked.crossJoin(named).filter((F.size(F.array_intersect(own, theirs)) >= F.ceil(F.size(theirs) / 2)) & (F.size(theirs) > 0))
    rows = near_.select("asked", "id", F.round(names.weighted_likeness(F.col("asked"), F.col("name")), 4).alias("score")).filter("score >= 75").collect()
    assert {x[:3] for x in got} == {(a, r.id, r.score) for a in {r.asked for r in rows} for r in sorted((r for r in rows if r.asked == a), key=lambda r: (-r.score, r.id))[:3]}


def test_languages_by_ranges_of_letters(spark):
    every = {"ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "uk": "іїєґ"}
    assert max(len(p) for p in (text.RUSSIAN, text.UKRAINIAN)) < 10
    for language, letters in every.items():
        rows = spark.createDataFrame([(c,) for x in letters for c in (x, x.upper())], "t string")
        assert {r[0] for r in rows.select(text.language_of(F.col("t"))).collect()} == {language}
        assert {r[0] for r in rows.select(text.language_of(F.concat("t", F.lit("q")))).collect()} == {"mixed" if language == "ru" else "en"}
    assert [one(spark, t, text.language_of(F.col("t"))) for t in ("ѐ ў 7", "", None, "w")] == ["unknown", "unknown", "unknown", "en"]
    assert one(spark, "a\t \tb  c d\te", text.cleaned("t")) == "a b c d e"


def test_times_pictures_and_lists(spark):
    now = F.lit("2024-03-31 12:00:00").cast("timestamp")
    at = lambda t: one(spark, t, m.message_time(F.col("t"), now))
    assert at("2024-03-05T10:00:00+02:00") == datetime(2024, 3, 5, 8) and at("soon") == at(None) == datetime(2024, 3, 31, 12)
    assert one(spark, "see /media/a-1.JPG, /media/b.pdf", m.inline_media(F.lit("assistant"), F.col("t"))) == ["/media/a-1.JPG"]
    assert one(spark, "see /media/a.jpg", m.inline_media(F.lit("user"), F.col("t"))) == []
    d = spark.createDataFrame([("Ann", "personal", False), ("Anne", "group", True), ("Bob", "group", False), ("Dan N", "bot", None), (None, "channel", False)], "name string, type string, archived boolean")
    assert sorted((r.name, r["list"]) for r in history.dialog_lists(d, "AN").collect()) == [("Ann", "personal"), ("Anne", "archived")]


def test_a_question_chooses_terms_and_mode(spark):
    assert tools.planned(spark, "Where is the link?", 20) == (["ссылка", "http", "https", "link", "www"], "hybrid", 120, 1, 12)
    assert tools.planned(spark, "Summer plans?", 20) == (["summer", "plans"], "hybrid", 80, 1, 8)
    assert tools.planned(spark, "tell me about the summer plans", 20)[1:] == ("vector", 20, 1, 8)
    rows = spark.createDataFrame([("c", i, i, f"text {i} {'plans' if i % 3 == 0 else ''}") for i in range(9)], "chat string, doc_id long, ts long, content string")
    rows = rows.withColumn("meta", F.from_json(F.lit("{}"), m.METADATA))
    assert [(r.doc_id, r["rank"]) for r in registry.call("search_history", rows, question="Plans?").orderBy("rank").collect()] == [(6, 1), (3, 2), (0, 3)]
    assert set(registry.TOOLS) >= {"last_messages", "search_history", "search_from_person", "search_media", "unread"}
