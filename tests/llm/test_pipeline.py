"""The pipeline's stages, each on its own input."""

import corpus_pipeline
from chatquarry.llm import common


def test_stages(spark):
    common.prepared(spark)
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    rows = [(0, prose, "en"), (1, prose.upper(), "en"), (2, prose + " more", "en"), (3, "12 34 !!", "en"), (4, None, "fr"), (5, "une autre page tout à fait " * 9 + "password = hunter2hunter2", "fr")]
    docs = spark.createDataFrame([(*r[:3], "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, ""))
        kept.append(sorted(r.doc_id for r in docs.collect()))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept == [[0, 1, 2, 5], [1, 2, 5], [1, 5], [1, 5]]
    assert all("hunter2" not in r.text and r.n_chars == len(r.text) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {1, 5}


def test_documents_without_labels_go_through_the_pipeline(spark):
    common.prepared(spark)
    prose = [" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) for w in ("stone", "река", "村")]
    given = list(enumerate([*prose, prose[0].upper(), "x", "12 34 !!", "", None]))
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(tuple(r) for r in kept.collect()) == [(i, t, None, "s", len(t)) for i, t in given[:5]] and kept.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, ""))
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 4}


def test_one_row_of_each_group_stays(spark):
    common.prepared(spark)
    words = lambda n, s: " ".join(f"w{s}{i}" for i in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, key string"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k") for i, t in rows], schema).repartition(3)

    given = [(None, "Prose one"), (None, "prose ONE"), (5, "twice"), (5, "twice"), (5, "another"), (9, "Same"), (8, "same"), (None, "same"), (1, None), (2, ""), (-(2**63), "low"), (2**63 - 1, "low")]
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.exact_dedup(spark, make(given), "").collect()), key=str)
    assert got == sorted([(None, "prose one"), (5, "twice"), (5, "another"), (9, "same"), (2, ""), (2**63 - 1, "low")], key=str)

    t, u = words(60, "t"), words(60, "u")
    given = [(3, t), (2, t + " extra"), (None, t + " other"), (4, u), (4, u), (4, words(30, "v")), (None, words(40, "x")), (None, words(40, "x") + " y"), (7, ""), (7, None), (6, "two words"), (5, "two words")]
    out = corpus_pipeline.near_dedup(spark, make(given), "")
    assert out.columns == [f.split()[0] for f in schema.split(", ")]
    got = [(r.doc_id, (r.text or "")[:6]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(2, t[:6]), (4, u[:6]), (4, "wv0 wv"), (None, "wx0 wx"), (7, ""), (7, ""), (5, "two wo")], key=str)


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
