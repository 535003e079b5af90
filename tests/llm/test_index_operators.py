"""op11 to op13 against brute force, on tables with nulls, empty and long texts, copies, repeated ids and clashing column names."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatquarry.llm import bpe_cache, common, op11_fim as fim, op12_decontamination as dec, op13_alignment as ali

HOT = "one text that very many rows hold, naïve 日本 🎉"
TEXTS = [None, "", " ", "a", "é", HOT, "x <P> y", "tail <S", "<", "🎉" * 50, "ab" * 4000, "two  spaces \n and\tmore  ", "▁ joins", "a<|endoftext|>b</s>", "Él niño — 12,5 €", HOT, "a", None]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepared(spark)
    rows = [(i if i != 7 else None, t, i, "n") for i, t in enumerate(TEXTS)] + [(3, "a", 0, "n"), (3, "a", 0, "n")] + [(100 + i, HOT, i, "n") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, k1 long, items string").repartition(5).cache()


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- op11


def brute_fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rows", [fim.COPY_ROWS, 10])
def test_fim_equals_slicing_strings(docs, monkeypatch, rows):
    monkeypatch.setattr(fim, "COPY_ROWS", rows)
    made = fim.transformed(docs).withColumn("back", fim.restored())
    given_rows = docs.select("doc_id", "text").collect()
    assert rows_of(made.drop("back")) == Counter(brute_fim(*r) for r in given_rows)
    assert Counter(r.back for r in made.select("back").collect()) == Counter(r.text or "" for r in given_rows)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_fim_shares_of_forms_and_an_empty_table(spark, docs):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    n = {r.form: r["count"] for r in fim.transformed(many).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2000) < 200 and abs(n["spm"] - 3600) < 250
    assert fim.transformed(docs.filter("false")).count() == 0


def test_texts_of_an_equal_key_stay_apart(spark, monkeypatch):
    """All texts share a key: rows are indexed one by one, and nothing is mixed up."""
    monkeypatch.setattr(fim, "keyed", lambda d, i, t: common.id_and_text(d, i, t).fillna("", ["text"]).withColumns({"k1": F.lit(1).cast("long"), "k2": F.lit(2).cast("long")}))
    d = spark.createDataFrame([(i, "abc"[i % 3] * 9) for i in range(30)], "doc_id long, text string")
    assert rows_of(fim.transformed(d)) == Counter(brute_fim(r.doc_id, r.text) for r in d.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=400), st.booleans())
def test_elias_fano_selects_what_was_put_in(values, dense):
    offsets = np.cumsum(np.minimum(values, 4 if dense else 10**7))
    found = fim.EliasFano.read(*fim.EliasFano.of(offsets).columns())
    assert [found.select(i) for i in range(len(offsets))] == offsets.tolist()


def test_elias_fano_is_small_and_its_directory_long():
    offsets = np.arange(100_000)
    made = fim.EliasFano.of(offsets)
    assert len(made.ranks) > 50 and len(made.high) + len(made.low) <= 25_001
    assert [made.select(i) for i in (0, 2047, 2048, 99_999)] == [0, 2047, 2048, 99_999]


# ---------------------------------------------------------------- op12

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short one"), (3, None), (4, "..."), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (10, "ÉCOLE naïve 日本 a b c d e f g h"), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "null item")]
SAID = [None, "", "..", "x alpha BETA gamma, delta\nepsilon zeta eta theta iota kappa y", "a short-one! and short  ONE", "école", "ÉCOLE naïve 日本 a b c d e f", "École naïve 日本 a b c d e f", " ".join(["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"] * 3), "w " * 3000 + "short one", "alpha beta gamma delta epsilon zeta eta theta iota", "short", "one", "a null item here", "shortone", "short one short one"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        k = min(width, len(x))
        for j in range(len(x) - k + 1) if x else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == x[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(item)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.fixture(scope="module")
def said(spark):
    common.prepared(spark)
    rows = [(i, t, "t") for i, t in enumerate(SAID)] + [(None, SAID[3], "t"), (3, SAID[3], "t"), (3, SAID[3], "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").repartition(2).cache()


@pytest.mark.parametrize("limit", [dec.SET_BYTES, 200])
def test_hits_equal_brute_force(said, items, limit):
    """With a small limit the benchmark is scanned for in several passes."""
    got = rows_of(dec.report(said, items, limit=limit))
    want = Counter()
    for r in said.collect():
        n, hit, found = brute_hits(r.text, ITEMS)
        want[(r.doc_id, n, hit, len(found), sha(",".join(found)), hit > 0)] += 1
    assert got == want and sum(k[5] for k in want) >= 7


def test_several_sets_are_made(items):
    assert len(list(dec.sets(items, limit=200))) > 2 and len(list(dec.sets(items))) == 1


def test_spans_or_documents_go(said, items):
    kept = dec.decontaminated(said, items, "documents")
    assert kept.columns == said.columns
    assert rows_of(kept) == Counter(tuple(r) for r in said.collect() if not brute_hits(r.text, ITEMS)[1])
    clean = {r.doc_id: r.text for r in dec.decontaminated(said, items).collect()}
    assert clean[3] == "x  y" and clean[4] == "a ! and " and clean[6] == SAID[6] and clean[7] == SAID[7] and clean[0] is None
    assert all(brute_hits(t, ITEMS)[1] == 0 or i == 15 for i, t in clean.items())
    with pytest.raises(ValueError):
        dec.decontaminated(said, items, "words")


def test_no_items_and_no_documents(said, items):
    assert dec.report(said, items.filter("false")).filter("contaminated or n_items > 0").count() == 0
    assert rows_of(dec.report(said, items.filter("false")).select("n_words")) == Counter((len(words(r.text)),) for r in said.collect())
    assert dec.report(said.filter("false"), items).count() == 0


def test_a_hash_alone_is_no_hit(said, items, monkeypatch):
    """All words hash alike, so every window is a candidate; only equal words count."""
    plain = dec.words_of
    monkeypatch.setattr(dec, "words_of", lambda raw, at: (np.zeros_like((w := plain(raw, at))[0]), *w[1:]))
    known = next(iter(dec.sets(items)))
    texts = "x alpha BETA gamma, delta epsilon zeta eta theta iota kappa y".encode()
    *_, hit, text, name = dec.batch_hits(np.frombuffer(texts, np.uint8), np.array([0, len(texts)]), known)
    assert hit.sum() == 10 and set(known.items[name[0]]) == {"1"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aB1 .é日\n", max_size=60), min_size=1, max_size=4))
def test_words_of_arrays_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    hashes, starts, ends, word = dec.words_of(np.frombuffer(b"".join(raw), np.uint8), at)
    joined = b"".join(raw).translate(dec.TABLE)
    assert [[joined[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(word[:-1], word[1:], strict=True)] == [words(t) for t in texts]
    same = {}
    assert all(same.setdefault(joined[s:e], h) == h for s, e, h in zip(starts, ends, hashes.tolist(), strict=True))


# ---------------------------------------------------------------- op13


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_cache.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=bpe_cache.vocabulary_path("piece_bpe_32k.model"))
    letters = {c: b for b, c in bpe_cache.byte_letters().items()}
    found, counts, held = [], Counter(), Counter()
    for doc_id, text in rows:
        a, b = (t.encode(f" {text}", add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(s.id_to_piece, b)]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            found.append((doc_id, [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            n, m = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((a[i:n], b[j:m]))
            i, j = n, m
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e == f]
        counts.update(links)
        held.update({(tuple(x), tuple(y)) for x, y in groups})
        found.append((doc_id, (a, b), groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = Counter()
    for doc_id, ids, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[(doc_id, *(map(len, ids) if ids else (0, 0)), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha(text) if text else "")] += 1
    return out, counts, held


@pytest.fixture(scope="module")
def aligned(spark):
    common.prepared(spark)
    sample = [(r.doc_id, r.text) for r in common.documents(spark, "/root/testdata/sf0.001").filter("doc_id < 40").collect()]
    rows = [(1000 + i if i != 7 else None, t) for i, t in enumerate(TEXTS)] + sample + [(1, "The same row"), (1, "The same row")]
    return spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, block string").repartition(4).cache()


@pytest.mark.parametrize("block", [ali.BLOCK, 2000])
def test_alignment_equals_whole_texts(aligned, block):
    made = ali.Alignment(aligned, block=block)
    want, counts, _ = brute_alignment([(r.doc_id, r.text) for r in aligned.collect()])
    assert rows_of(made.documents()) == want
    pairs = made.pairs().collect()
    assert {(r.a, r.b): r["count"] for r in pairs} == dict(counts)
    assert all(r.best == (r["count"] == max(n for (_, b), n in counts.items() if b == r.b)) for r in pairs)
    assert made.groups.count() == made.groups.select("group").distinct().count()


def test_alignment_counts_documents(aligned):
    made = ali.Alignment(aligned, counted="documents")
    held = brute_alignment([(r.doc_id, r.text) for r in aligned.collect()])[2]
    got = {r.group: r.documents for r in made.groups.collect()}
    assert got == {f"{','.join(map(str, a))}|{','.join(map(str, b))}": n for (a, b), n in held.items()}
    assert made.pairs().agg(F.sum("count")).first()[0] == sum(held.values())


def test_alignment_of_nothing(aligned):
    assert ali.Alignment(aligned.filter("false")).documents().count() == 0
    assert [tuple(r) for r in ali.Alignment(aligned.filter("doc_id = 1000")).documents().collect()] == [(1000, 0, 0, 0, 0, 0, 0, "")]


UNITS = st.lists(st.sampled_from(["a", "é", " ", "  ", "\n", "\t", "the", "'s", "12", ".", " ", "　", "<s>", "🎉", "word"]), min_size=1, max_size=25).map("".join)


@pytest.fixture(scope="module")
def aligner():
    return ali.Aligner(bpe_cache.vocabulary_path("byte_bpe_50k.json"), bpe_cache.vocabulary_path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=UNITS)
def test_units_are_encoded_as_in_their_text(aligner, text):
    units = [u for part in aligner.units(text) for u in part]
    assert "".join(units) == f" {text}"
    assert ";".join(aligner.learn(units)) == aligner.whole(text)


def test_long_texts_are_cut_into_parts(aligner, monkeypatch):
    monkeypatch.setattr(ali, "SLICE", 50)
    text = "some words  and\n more of them " * 30
    assert len(list(aligner.units(text))) > 10
    assert ";".join(aligner.learn([u for part in aligner.units(text) for u in part])) == aligner.whole(text)
