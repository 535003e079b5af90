"""Upserts into a table that grows by deltas: a batch writes what it changes, reading merges, and compaction rewrites only the buckets
whose deltas have grown.

Under `path`: data/v__=N/b__=B holds version N's rows of a bucket of keys; manifest/N.json lists the pieces (version, bucket, kind, rows)
that make up the table after version N. A version's files are written before its manifest, and a manifest appears whole or not at all,
so a writer that dies leaves the table as it was; a batch that is run again writes the same version again. One writer at a time."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import staged
from .sinks import exists

BASE, DELTA = "base", "delta"


@dataclass(frozen=True)
class DeltaTable:
    """keys: columns that name a row. order: a column by which of two changes of a row the later wins (of equal ones, that of the later
    version). A change leaves the columns alone that it holds null for."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    order: str
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]

    @property
    def others(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    @property
    def stored(self) -> str:
        """The files' columns: each that is no key has a stamp, what its value was ordered by and the version that brought it."""
        kind = self.spark.createDataFrame([], self.schema).schema[self.order].dataType.simpleString()
        return f"{self.schema}, " + ", ".join(f"`_s_{c}` struct<o: {kind}, v: int>" for c in self.others)

    # ------------------------------------------------------------ manifests

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version; -1 before any."""
        folder, fs = self._fs()
        if not fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)

    def pieces(self, version: int | None = None) -> list[tuple[int, int, str, int]]:
        """What makes up the table: (version, bucket, kind, rows). A few numbers a bucket, whatever the rows."""
        version = self.version() if version is None else version
        if version < 0:
            return []
        text = self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0]
        return [tuple(p) for p in json.loads(text)]

    def _publish(self, version: int, pieces: list[tuple[int, int, str, int]]) -> None:
        folder, fs = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        part, whole = path(folder, f"{version}.part"), path(folder, f"{version}.json")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(pieces).encode()))
        out.close()
        fs.delete(whole, False)
        if not fs.rename(part, whole):
            raise OSError(f"version {version} wasn't published")

    # ------------------------------------------------------------ reading

    def _rows(self, pieces: list[tuple[int, int, str, int]]) -> DataFrame | None:
        """The pieces' rows."""
        paths = [f"{self.path}/data/v__={v}/b__={b}" for v, b, _, _ in pieces]
        if not paths:
            return None
        return self.spark.read.schema(f"{self.stored}, b__ int").option("basePath", f"{self.path}/data").parquet(*paths)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row of each key: of each column the value with the latest stamp, and that stamp, so that merging can go on later."""
        last = [F.max_by(F.struct(F.col(c).alias("x"), F.col(f"_s_{c}").alias("s")), F.col(f"_s_{c}")).alias(c) for c in self.others]
        out = rows.groupBy("b__", *self.keys).agg(*last)
        return out.select("b__", *self.keys, *[F.col(c)["x"].alias(c) for c in self.others], *[F.col(c)["s"].alias(f"_s_{c}") for c in self.others])

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The table as of the last version; with `keys`, only those rows, from their buckets' files."""
        pieces = self.pieces()
        if keys is not None:
            wanted = {r.b__ for r in keys.select(self._bucket().alias("b__")).distinct().collect()}  # numbers of buckets
            pieces = [p for p in pieces if p[1] in wanted]
        rows = self._rows(pieces)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        rows = rows if keys is None else rows.join(keys.select(*self.keys).distinct(), list(self.keys), "left_semi")
        return self._merged(rows).select(*self.columns)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ writing

    def upsert(self, changes: DataFrame, version: int | None = None) -> int:
        """Adds a batch of changes as the next version (or again as the one named) and returns its number. Of several changes of a row in
        the batch each column takes its last. Only the batch's own rows are written."""
        last = self.version()
        version = last + 1 if version is None else version
        if version > last + 1:
            raise ValueError(f"version {version} after {last}")
        stamp = F.struct(F.col(self.order).alias("o"), F.lit(version).alias("v"))
        rows = changes.select(*self.columns).withColumns({"b__": self._bucket(), **{f"_s_{c}": F.when(F.col(c).isNotNull(), stamp) for c in self.others}})
        self._write(self._merged(rows), version, DELTA, self.pieces(version - 1))
        return version

    def _write(self, rows: DataFrame, version: int, kind: str, kept: list[tuple[int, int, str, int]]) -> None:
        target = f"{self.path}/data/v__={version}"
        rows.repartition("b__").sortWithinPartitions("b__", *self.keys).write.mode("overwrite").partitionBy("b__").parquet(target)
        written = self.spark.read.schema(f"{self.stored}, b__ int").parquet(target).groupBy("b__").count().collect() if exists(self.spark, target) else []  # a row a bucket
        self._publish(version, sorted([*kept, *((version, r.b__, kind, r["count"]) for r in written)]))

    def compact(self, share: float = 0.5) -> list[int]:
        """Rewrites the buckets whose deltas hold more than a share of their base's rows, as one more version. Returns their numbers."""
        pieces, sizes = self.pieces(), {}
        for _, bucket, kind, rows in pieces:
            sizes.setdefault(bucket, {BASE: 0, DELTA: 0})[kind] += rows
        full = sorted(b for b, n in sizes.items() if n[DELTA] > share * n[BASE])
        if full:
            own = [p for p in pieces if p[1] in set(full)]
            self._write(staged(self._merged(self._rows(own))), self.version() + 1, BASE, [p for p in pieces if p[1] not in set(full)])
        return full


def upsert_stream(messages: DataFrame, table: DeltaTable, state: str, compact_every: int = 16) -> None:
    """Keeps the table with the changes of a stream: a micro-batch writes its own rows only, and a batch that is run again after a failure
    adds nothing that it hadn't. Buckets are compacted every few batches. The batch that a version holds is noted beside it."""
    spark = messages.sparkSession
    noted = f"{table.path}/batches"

    def write(batch: DataFrame, n: int) -> None:
        own = f"{noted}/{n}"
        version = spark.read.text(own).first()[0] if exists(spark, own) else None
        if version is None:
            version = table.version() + 1
            spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("overwrite").text(own)
        if int(version) > table.version():
            table.upsert(batch, int(version))
            if n % compact_every == compact_every - 1:
                table.compact()

    messages.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
