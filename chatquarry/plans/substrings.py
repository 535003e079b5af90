"""Substring search by an index of trigrams in Parquet.

Rows are numbered and stored in blocks of ROWS; for each trigram of the lower-cased texts and each block the index holds the places of
the rows that have it. A needle's rarest trigrams are looked up (of the postings only the files of their buckets are read, and of those
what the files' statistics don't exclude), intersected block by block, and the rows at the places left are read and held against the
needle itself. Needles of under three characters have no trigram: for them the texts are scanned."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import history
from ..operators.order import numbered

#: Rows of a block, folders that trigrams are dealt into, and trigrams of a needle that are looked up at most.
ROWS, BUCKETS, LOOKED_UP = 1 << 16, 64, 8


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def postings(batches) -> Iterator[pa.RecordBatch]:
    """gram, block, places (rising, 4 bytes each) of each batch's rows; the places of a block may come in several rows."""
    for batch in batches:
        found: dict[tuple[int, str], list[int]] = {}
        for block, at, text in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "folded")), strict=True):
            for gram in trigrams(text or ""):
                found.setdefault((block, gram), []).append(at)
        yield pa.RecordBatch.from_arrays([pa.array([g for _, g in found], pa.string()), pa.array([b for b, _ in found], pa.int32()), pa.array([len(x) for x in found.values()], pa.int64()), pa.array([np.sort(np.array(x, "<u4")).tobytes() for x in found.values()], pa.binary())], names=["gram", "block", "rows", "places"])


@dataclass(frozen=True)
class TrigramIndex:
    """Under `path`: texts (block, at, the table's columns), grams (bucket, gram, block, places) and sizes (gram, rows)."""

    spark: SparkSession
    path: str
    text: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, text: str, block: int = ROWS, buckets: int = BUCKETS) -> TrigramIndex:
        """Indexes every row's text (null: empty). `key` tells rows apart. A new index takes a new path."""
        spark = rows.sparkSession
        placed = numbered(rows.withColumn("_all", F.lit(0)), "_all", key, name="_n").drop("_all")
        placed = placed.withColumns({"block": F.floor((F.col("_n") - 1) / block).cast("int"), "at": ((F.col("_n") - 1) % block).cast("int")}).drop("_n")
        placed.repartition("block").sortWithinPartitions("block", "at").write.partitionBy("block").parquet(f"{path}/texts")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/texts")
        parts = stored.select("block", "at", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("folded")).mapInArrow(postings, "gram string, block int, rows long, places binary")
        bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
        parts.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/grams")
        grams = spark.read.parquet(f"{path}/grams") if not parts.isEmpty() else None
        if grams is not None:
            sizes = grams.groupBy("bucket", "gram").agg(F.sum("rows").alias("rows"))
            sizes.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/sizes")
        return cls(spark, path, text)

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def _of(self, name: str, grams: list[str], buckets: int) -> DataFrame:
        """The rows of the trigrams, from the files of their buckets."""
        own = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("b")).distinct()
        numbers = [r.b for r in own.collect()]
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("bucket").isin(numbers) & F.col("gram").isin(grams))

    def rarest(self, needle: str, buckets: int = BUCKETS) -> list[tuple[str, int]] | None:
        """The needle's rarest trigrams and their numbers of rows; None if some occurs nowhere."""
        grams = sorted(trigrams(needle.lower()))
        sizes = {r.gram: r["rows"] for r in self._of("sizes", grams, buckets).select("gram", "rows").collect()}  # a row for each trigram of the needle
        if len(sizes) < len(grams):
            return None
        return sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:LOOKED_UP]

    def candidates(self, grams: list[str], buckets: int = BUCKETS) -> DataFrame:
        """block, at of the rows that have all of the trigrams, the shortest list first."""
        held = self._of("grams", grams, buckets).groupBy("block").agg(F.collect_list(F.struct("gram", "places")).alias("lists"))
        wanted = len(grams)

        def intersect(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks, places = [], []
                for block, lists in zip(batch.column("block").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                    own: dict[str, list[np.ndarray]] = {}
                    for x in lists:
                        own.setdefault(x["gram"], []).append(np.frombuffer(x["places"], "<u4"))
                    if len(own) < wanted:
                        continue
                    left, *others = sorted((np.concatenate(x) for x in own.values()), key=len)
                    for x in others:
                        left = np.intersect1d(left, x, assume_unique=True)
                    blocks.append(np.full(len(left), block, np.int32))
                    places.append(left.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int32)) for x in (blocks, places)], names=["block", "at"])

        return held.mapInArrow(intersect, "block int, at int")

    def search(self, needle: str, buckets: int = BUCKETS) -> DataFrame:
        """The rows whose text contains the needle, whatever the case: those that a scan finds."""
        texts, holds = self.texts(), history.contains_folded(self.text, needle)
        if len(needle.lower()) < 3:
            return texts.filter(holds).drop("block", "at")
        rare = self.rarest(needle, buckets)
        if rare is None:
            return texts.filter(F.lit(False)).drop("block", "at")
        found = self.candidates([g for g, _ in rare], buckets)
        blocks = [r.block for r in found.select("block").distinct().collect()]  # numbers of folders, no rows
        return texts.filter(F.col("block").isin(blocks)).join(found, ["block", "at"], "left_semi").filter(holds).drop("block", "at")
