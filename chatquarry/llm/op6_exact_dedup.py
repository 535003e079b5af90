"""Exact duplicates: groups by a 128-bit content hash, with the bytes inside groups compared to exclude collisions. DataFrame functions only.

Hashes alone move for all rows. Texts move only for groups of two or more rows (found through a bitmap of bounded size), and there
only each task's least and greatest text of a group: a group whose least and greatest texts are equal has one text. Rows of a
group with several texts, which a collision would make, are grouped by the text itself.

Rows meet their group's figures by broadcast for the largest groups, so no task gets a hot group.

Defined cases: a null text counts as empty, so all of them are equal to each other and to empty texts; of rows that repeat the kept
id all are marked kept (`survivors` keeps one); null ids lose against any other, and a group of null ids keeps a null id, its rows marked not kept; an
empty table gives no rows; columns other than the id and the text are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text") -> F.Column:
    """Lower-cases A-Z only. lower() does just that where no other character changes, and is much faster than translate()."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def content_hash(c: F.Column) -> F.Column:
    return F.unhex(F.md5(c))


def groups(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key (xxhash64 of the text) for each row. keep: "min" or "max", the id that stays."""
    docs = common.id_and_text(docs, id_col, text_col)
    pick = {"min": F.min, "max": F.max}[keep]
    named = docs.select("doc_id", normalised().alias("norm"), F.xxhash64("text").alias("key")).select("doc_id", "key", hash_of(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    named = common.staged(named)
    sums = named.groupBy("h").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    sums = common.staged(sums)
    several = sums.filter("group_size > 1").select("h", F.xxhash64("h").alias("key"))
    texts = common.maybe_in(docs.select("doc_id", normalised().alias("norm")).withColumn("h", hash_of(F.col("norm"))), F.xxhash64("h"), several)
    # each task's least and greatest text of a group; rows of hashes that only look repeated find no partner
    spans = texts.groupBy("h").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).filter("least <> most")
    clashing = common.staged(spans.join(several.select("h"), "h", "left_semi").select("h"))
    if clashing.isEmpty():
        whole = common.met(named, sums, "h", "group_size")
    else:
        apart = docs.select("doc_id", normalised().alias("norm"), F.xxhash64("text").alias("key")).withColumn("h", hash_of(F.col("norm"))).join(clashing, "h", "left_semi")
        own = apart.groupBy("norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        split = apart.join(own, "norm").select("h", "doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
        whole = common.met(named.join(clashing, "h", "left_anti"), sums, "h", "group_size").unionByName(split)
    return whole.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "key")


def survivors(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of each group of equal texts, null ids included: see `common.one_of_each`."""
    return common.one_of_each(docs, common.staged(groups(docs, keep, id_col, text_col)), "text_sha256", keep == "max", id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.documents(spark, sf_dir)).drop("key")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
