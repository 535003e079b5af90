"""A corpus pipeline: language ID, exact dedup, near-duplicate removal, secret redaction, packing into training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatquarry.llm import common, op3_language, op4_jaccard, op6_exact_dedup, op7_packing, op10_secrets

#: Near duplicates: shingles of five words, similarity 0.8 or more.
WORDS, SIMILARITY = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects (null and letterless texts among them); `lang` of the others gets the language found.

    Without labelled rows no language is known, so none is rejected: all documents with a letter stay as they are, for the later stages.
    Ids, nulls and repeated rows don't matter."""
    prepared(spark)
    samples, margins = op3_language.learned(docs)
    return op3_language.accepted(docs, samples, margin=margins)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (but for the case of A-Z) the row with the largest id; null ids lose against others, and of rows equal in
    id too one stays. Null and empty texts are equal."""
    prepared(spark)
    return op6_exact_dedup.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id; null ids lose against others, of rows equal in id and
    text one stays. Empty texts have no near duplicates and stay."""
    prepared(spark)
    found = common.staged(op4_jaccard.grouped(docs, WORDS, SIMILARITY).select("doc_id", "key", "component"))
    return common.one_of_each(docs, found, "component", largest=False)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text. Null texts, ids and repeated rows stay as they are."""
    prepared(spark)
    clean = op10_secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 1024 ids; a null text is one end id, repeated rows are packed each."""
    prepared(spark)
    return op7_packing.pack(op7_packing.pieces(docs, ids=False))


def prepared(spark: SparkSession) -> None:
    common.prepared(spark)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_redaction", secret_redaction),
    ("packing", packing),
]

#: Compression, hashing to shingle groups and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table, each result written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
