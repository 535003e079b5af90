"""Language by compression: a text belongs to the language whose sample, as a raw-content zstandard dictionary, encodes it shortest.

Only letters count: texts are lower-cased, and what lies between words becomes one space. Long texts are encoded in pieces, each with
the dictionary afresh, so that a text can't become its own dictionary.
The dictionaries are a bounded sample of labelled rows: SAMPLE_ROWS distinct texts a language, whole ones, of SAMPLE_BYTES together.
Texts are drawn among distinct ones, so copies, however many, count once. Predictions read whole texts.

Score: the posterior of the best language under code lengths of SHARPNESS bytes a unit, from 1 / languages to 1, 0 for `und`.
Rejected: texts that are null or have no letter (`und`), and texts whose second-best encoding is too little longer. How much is
learned for each band of lengths, from up to MARGIN_ROWS labelled rows a language that the dictionaries don't hold and from beginnings
of them: a SHARE of the median of what their own language gains on the best other one, MARGIN at least, so that ties are rejected at
any length; a band of too few rows takes a neighbour's. What gains less than that share of what is usual for its length is in no learned language, or in several.

Defined cases: a null text, an empty one and one without letters give `und`, score 0, rejected; equal texts get equal results; ties
go to the language first by name; without labelled rows all are `und`; an empty table gives no rows; columns other than the id,
the text and (in training) the label are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

SAMPLE_ROWS, LEVEL, PIECE, SHARPNESS, MARGIN = 24, 9, 2048, 8.0, 0.001
MARGIN_ROWS, SHARE, BAND_ROWS = 128, 0.25, 20
#: Bytes of a language's sample, of its rows for the margins, and labels: what the driver collects is bounded by their product.
SAMPLE_BYTES, MARGIN_BYTES, LANGUAGES = 1 << 18, 1 << 20, 200
#: All that isn't part of a word.
BETWEEN = re.compile(r"[\W\d_]+")


def sampled(labelled: DataFrame, lang_col: str, id_col: str, text_col: str, rows: int, more: int = 0) -> dict[str, tuple[list[str], list[str]]]:
    """Each language's distinct texts with the smallest hashes, in their order: `rows` of at most SAMPLE_BYTES in all, and of those after
    them `more` of at most MARGIN_BYTES. Texts that don't fit are passed over; where none fits the shortest is cut to what does."""
    table = labelled.select(labelled[lang_col].cast("string").alias("lang"), labelled[id_col].cast("long").alias("doc_id"), labelled[text_col].cast("string").alias("text")).filter("lang is not null and text is not null")
    key = F.xxhash64(F.xxhash64("text"), F.lit(3))
    texts = common.staged(table.select("lang", key.alias("key"), F.pmod(key, F.lit(1 << 32)).alias("h"), F.octet_length("text").alias("bytes")).distinct())
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    if not counts:
        return {}
    # twice the texts wanted by their hashes' share, then the smallest of those
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * (rows + more) / n) * (1 << 32)))])
    drawn = texts.filter(F.col("h") < share[F.col("lang")]).collect()
    chosen: dict[str, tuple[list[int], list[int]]] = {}
    for lang in sorted(counts):
        own = sorted((r["h"], r["key"], r["bytes"]) for r in drawn if r["lang"] == lang)
        first = fitting(own, rows, SAMPLE_BYTES) or sorted(own, key=lambda x: (x[2], x))[:1]
        chosen[lang] = [x[1] for x in first], [x[1] for x in fitting([x for x in own if x not in first], more, MARGIN_BYTES)]
    wanted = labelled.sparkSession.createDataFrame([(lang, k) for lang, lists in chosen.items() for x in lists for k in x], "lang string, key long")
    # a bounded list: at most LANGUAGES x (rows + more) keys
    found = table.withColumn("key", key).join(F.broadcast(wanted), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])
    by_key = {(r["lang"], r["key"]): r["text"] for r in found.select("lang", "key", F.substring("text", 1, MARGIN_BYTES).alias("text")).collect()}
    cut = lambda t: t.encode("utf-8", "surrogatepass")[:SAMPLE_BYTES].decode("utf-8", "ignore")
    return {lang: ([cut(by_key[lang, k]) for k in a], [by_key[lang, k] for k in b]) for lang, (a, b) in chosen.items()}


def fitting(texts: list[tuple[int, int, int]], rows: int, limit: int) -> list[tuple[int, int, int]]:
    """The first `rows` of texts (hash, key, bytes) that fit the limit together, passing over those that don't."""
    out, total = [], 0
    for x in texts:
        if len(out) < rows and total + x[2] <= limit:
            out.append(x)
            total += x[2]
    return out


def pressed(texts: list[str]) -> bytes:
    return " ".join(map(folded, texts)).encode("utf-8", "surrogatepass")


def dictionaries(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A sample of each language's rows, those with the smallest hashes."""
    return {lang: pressed(texts) for lang, (texts, _) in sampled(labelled, lang_col, id_col, text_col, rows).items()}


def learned(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[dict[str, bytes], list[float]]:
    """The dictionaries, and the least margin by length band, from the rows next by hash."""
    found = sampled(labelled, lang_col, id_col, text_col, rows, MARGIN_ROWS)
    samples = {lang: pressed(texts) for lang, (texts, _) in found.items()}
    names, sizes = sorted(samples), sizer(samples)
    gains: list[list[float]] = []
    for lang, (_, texts) in found.items():
        for text in texts if len(names) > 1 else []:
            raw = folded(text).encode("utf-8", "surrogatepass")
            if not any(map(str.isalpha, text)):
                continue
            for band in range(len(raw).bit_length()):
                own = dict(zip(names, sizes(raw[: 1 << band]), strict=True))
                mine = own.pop(lang)
                gains.extend([] for _ in range(band + 1 - len(gains)))
                gains[band].append((min(own.values()) - mine) / mine)
    enough = [SHARE * sorted(band)[len(band) // 2] if len(band) >= BAND_ROWS else None for band in gains]
    margins: list[float] = []
    for i in range(len(enough)):  # a band of few rows takes the nearest shorter one's that has enough, or the nearest longer one's
        near = [m for m in (*enough[i::-1], *enough[i + 1 :]) if m is not None]
        margins.append(max(MARGIN, near[0] if near else MARGIN))
    return samples, margins or [MARGIN]


def folded(text: str) -> str:
    return BETWEEN.sub(" ", text.lower())


def sizer(samples: dict[str, bytes], level: int = LEVEL, piece: int = PIECE):
    """A function from folded bytes to the lengths of their encodings, by the languages' order."""
    import zstandard

    presses = []
    for name in sorted(samples):
        d = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        presses.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(raw: bytes) -> list[int]:
        parts = [raw[i : i + piece] for i in range(0, len(raw), piece)]
        return [sum(len(press(p)) for p in parts) for press in presses]

    return sizes


def predictor(samples: dict[str, bytes], level: int = LEVEL, piece: int = PIECE, margin: float | list[float] = MARGIN):
    """A function from a text to (language, score, rejected, relative margin). margin: the least one, by length band or for all."""
    names, measured = sorted(samples), sizer(samples, level, piece)
    least = margin if isinstance(margin, list) else [margin]

    def predict(text: str | None) -> tuple[str, float, bool, float]:
        if not text or not names or not any(map(str.isalpha, text)):
            return "und", 0.0, True, 0.0
        raw = folded(text).encode("utf-8", "surrogatepass")
        sizes = measured(raw)
        order = sorted(range(len(names)), key=sizes.__getitem__)
        best = sizes[order[0]]
        score = 1 / sum(2.0 ** (-min(1000, (s - best) / SHARPNESS)) for s in sizes)
        gap = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        return names[order[0]], score, gap < least[min(len(raw).bit_length() - 1, len(least) - 1)], gap

    return predict


def classify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float | list[float] = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected, margin."""
    held = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches) -> Iterator[pa.RecordBatch]:
        common.release()
        predict = predictor(held.value, margin=margin)
        for batch in common.slices(batches):
            rows = [predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)]], names=["doc_id", "lang_pred", "score", "rejected", "margin"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, margin double")


def accepted(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text", margin: float | list[float] = MARGIN, lang_col: str = "lang") -> DataFrame:
    """The rows of a table whose text isn't rejected, with all their columns; a language column gets the language found.

    Without samples there is no language to reject a text for: all rows with a letter stay as they are, their language column too."""
    held = docs.sparkSession.sparkContext.broadcast(samples)
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        common.release()
        predict = predictor(held.value, margin=margin)
        for batch in common.slices(batches):
            if not held.value:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))
                continue
            found = [predict(t) for t in batch.column(at).to_pylist()]
            if lang_col in batch.schema.names:
                own = batch.schema.get_field_index(lang_col)
                batch = batch.set_column(own, batch.schema.field(own).name, pa.array([f[0] for f in found], pa.string()).cast(batch.schema.field(own).type))
            yield batch.filter(pa.array([not f[2] for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id") -> F.Column:
    """Rows whose crc32 of the id as text leaves 2 by division by 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    samples, margins = learned(docs.filter(~held_out()))
    return classify(docs, samples, margin=margins).withColumn("held_out", held_out())
