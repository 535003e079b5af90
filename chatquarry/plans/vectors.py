"""Vector search: exact in blocks, and by a stored index of lists around centroids, whose bounds also give an exact answer.

Similarity is the cosine. For the index vectors have length 1, and angles between them obey the triangle inequality: a vector of a list
whose centroid is at angle a from the query, in a list of radius r, is at a - r from the query at least."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.arrays import matrix, unit, usable
from ..operators.blocks import by_block
from ..staging import staged

#: Queries and vectors that meet in one cell.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096
#: Rows that centroids are fitted on, lists at most, and decimals by which similarities are ranked (ties go to the smaller id).
SAMPLE, LISTS, DECIMALS = 50_000, 4096, 12
FOUND = "q long, vec_id long, sim double"


def best(ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k most similar, by similarity, then id."""
    ranked = np.round(sim, DECIMALS)
    if len(ranked) > k:
        least = np.partition(ranked, len(ranked) - k)[len(ranked) - k]
        at = np.flatnonzero(ranked >= least)
    else:
        at = np.arange(len(ranked))
    return at[np.lexsort((ids[at], -ranked[at]))][:k]


def cell_answers(k: int):
    """The k best of a cell for each of its queries. Rows: id, v (unit or not), asked (whether a query)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _, table in by_block(batches, ("_qb", "_vb")):
            ids, asked = table.column("id").to_numpy(), table.column("asked").to_numpy(zero_copy_only=False).astype(bool)
            if not asked.any() or asked.all():
                continue
            v = unit(matrix(table.column("v")))
            given, names = v[~asked], ids[~asked]
            out_q, out_v, out_s = [], [], []
            for q, sims in zip(ids[asked].tolist(), v[asked] @ given.T, strict=True):
                other = names != q
                own, s = names[other], sims[other]
                at = best(own, s, k)
                out_q.append(np.full(len(at), q))
                out_v.append(own[at])
                out_s.append(s[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["q", "vec_id", "sim"])

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's rows, at most k from each cell, with their rank."""
    w = Window.partitionBy("q").orderBy(F.desc(F.round("sim", DECIMALS)), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cells(asked: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """Both tables: id, v, _qb, _vb. Rows of a cell meet in one task, which multiplies two matrices of bounded size."""
    both = asked.withColumn("asked", F.lit(True)).unionByName(given.withColumn("asked", F.lit(False)))
    return both.repartition("_qb", "_vb").sortWithinPartitions("_qb", "_vb").select("id", "v", "_qb", "_vb", "asked").mapInArrow(cell_answers(k), FOUND)


def dealt(column: str, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, vec_id, sim, rank: the k most similar vectors (vec_id, embedding) of each query (q, qv), itself left out.

    Queries and vectors are dealt into blocks by their ids' hashes; each two blocks meet in a cell, which keeps k rows a query."""
    blocks = lambda n, size: max(1, -(-n // size))
    nq, nv = blocks(queries.count(), QUERY_BLOCK), blocks(vectors.count(), VECTOR_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.filter(usable("qv")).select(F.col("q").cast("long").alias("id"), F.col("qv").cast("array<double>").alias("v"), dealt("q", nq).alias("_qb"), every(nv).alias("_vb"))
    given = vectors.filter(usable("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), dealt("vec_id", nv).alias("_vb"), every(nq).alias("_qb"))
    return merged(cells(asked, given.select("id", "v", "_qb", "_vb"), k), k)


@dataclass(frozen=True)
class Index:
    """Lists of vectors in Parquet under `path`: vectors (partitioned by list; part splits lists into blocks) and lists (list, centroid,
    rows, parts, radius)."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = 64, seed: int = 42) -> Index:
        """Indexes every vector (vec_id, embedding) that has a length. Centroids are fitted on a sample of about SAMPLE rows, drawn by the
        ids' hashes. A new index takes a new path."""
        spark = vectors.sparkSession
        rows = vectors.filter(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        n = rows.count()
        share = min(1.0, SAMPLE / max(1, n))
        sample = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        fit = sample.select(array_to_vector(F.transform("v", lambda x: x / length)).alias("features"))
        if n:
            centroids = unit(np.array(KMeans(k=max(2, min(lists, LISTS, n)), seed=seed, maxIter=10).fit(fit).clusterCenters()) + 1e-12) if n > 1 else unit(np.array([rows.first()["v"]]))
        else:
            centroids = np.ones((1, 1))
        held = spark.sparkContext.broadcast(centroids)  # at most LISTS vectors

        def assign(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = unit(matrix(batch.column("v")))
                sim = np.clip(v @ held.value.T, -1, 1)
                at = sim.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(np.arccos(sim[np.arange(len(at)), at]))], names=["vec_id", "v", "list", "angle"])

        placed = staged(rows.mapInArrow(assign, "vec_id long, v array<double>, list int, angle double"))
        sizes = placed.groupBy("list").agg(F.count("*").alias("rows"), F.max("angle").alias("radius")).withColumn("parts", F.ceil(F.col("rows") / VECTOR_BLOCK).cast("int"))
        named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        named.join(sizes, "list").write.parquet(f"{path}/lists")
        parts = spark.read.parquet(f"{path}/lists").select("list", "parts")  # at most LISTS rows
        dealt_rows = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        dealt_rows.repartition("list", "part").write.partitionBy("list").parquet(f"{path}/vectors")
        return cls(spark, path)

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, v array<double>, angle double, part int, list int").parquet(f"{self.path}/vectors")

    def lists(self) -> tuple[np.ndarray, ...]:
        """Numbers, centroids, radii and parts of the lists: at most LISTS rows."""
        t = self.spark.read.parquet(f"{self.path}/lists").orderBy("list").toArrow()
        return t.column("list").to_numpy(), matrix(t.column("centroid")), t.column("radius").to_numpy(), t.column("parts").to_numpy()

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """q, vec_id, sim, rank from the `probes` nearest lists of each query (q, qv); the files of other lists aren't read."""
        return merged(self._answers(self._probed(queries, probes), k), k)

    def exact(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """q, vec_id, sim, rank: what a scan gives. The nearest lists tell how near the k-th neighbour is at most; of the other lists only
        those are read that may hold a nearer one."""
        first = staged(self._answers(self._probed(queries, probes), k))
        worst = merged(first, k).groupBy("q").agg(F.count("*").alias("n"), F.min("sim").alias("least")).select("q", F.when(F.col("n") >= k, F.col("least")).alias("least"))
        rest = self._probed(queries.join(worst, "q", "left"), probes, beyond=True)
        return merged(first.unionByName(self._answers(rest, k)), k)

    def probes_for(self, k: int, recall: float = 0.95, asked: int = 128, seed: int = 7) -> int:
        """How many lists hold that share of the k nearest neighbours, measured on about `asked` indexed vectors against the exact way."""
        numbers, centroids, _, _ = self.lists()
        n = self.vectors.count()
        drawn = self.vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 2 * asked / max(1, n)) * (1 << 30)))
        queries = staged(drawn.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(asked).select(F.col("vec_id").alias("q"), F.col("v").alias("qv")))
        found = self.exact(queries, k).select("q", "vec_id").join(self.vectors.select("vec_id", "list"), "vec_id").join(queries, "q").select("list", "qv").toArrow()
        if not found.num_rows:
            return 1
        order = np.argsort(np.argsort(-(unit(matrix(found.column("qv"))) @ centroids.T), axis=1, kind="stable"), axis=1)  # each list's place
        places = np.sort(order[np.arange(len(order)), np.searchsorted(numbers, found.column("list").to_numpy())])
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1

    def _probed(self, queries: DataFrame, probes: int, beyond: bool = False) -> DataFrame:
        """q, qv, lists, parts (arrays): the nearest lists of each query, or of the others those that its `least` similarity doesn't exclude.
        A query stays one row, so its vector isn't repeated in Python."""
        held = self.spark.sparkContext.broadcast(self.lists())

        def run(batches) -> Iterator[pa.RecordBatch]:
            names, centroids, radii, parts = held.value
            for batch in batches:
                angle = np.arccos(np.clip(unit(matrix(batch.column("qv"))) @ centroids.T, -1, 1)) if len(names) else np.zeros((batch.num_rows, 0))
                order = np.argsort(angle, axis=1, kind="stable")
                chosen = np.zeros(angle.shape, bool)
                np.put_along_axis(chosen, order[:, :probes], True, axis=1)
                if beyond:
                    known = np.nan_to_num(batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64), nan=-1.0)
                    chosen = ~chosen & (angle - radii <= np.arccos(np.clip(known, -1, 1))[:, None] + 1e-9)
                ends = np.concatenate([[0], chosen.sum(1).cumsum()]).astype(np.int32)
                cols = np.nonzero(chosen)[1]
                each = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[cols].astype(np.int32))) for x in (names, parts)]
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("qv"), *each], names=["q", "qv", "lists", "parts"])

        rows = queries.filter(usable("qv")).select(F.col("q").cast("long").alias("q"), F.col("qv").cast("array<double>").alias("qv"), *(["least"] if beyond else []))
        return rows.mapInArrow(run, "q long, qv array<double>, lists array<int>, parts array<int>")

    def _answers(self, probed: DataFrame, k: int) -> DataFrame:
        """Queries meet each part of their lists; of a list that very many queries probe, blocks of about QUERY_BLOCK of them do."""
        probed = staged(probed).select("q", "qv", F.explode(F.arrays_zip("lists", "parts")).alias("x")).select("q", "qv", F.col("x.lists").alias("list"), "x.parts")
        asked_by = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))  # at most LISTS rows
        asked = probed.join(F.broadcast(asked_by), "list").select("list", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("b"), F.col("q").alias("id"), F.col("qv").alias("v"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        given = self.vectors.join(F.broadcast(asked_by), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("vec_id").alias("id"), "v", "part")
        cell = lambda df: df.select("id", "v", (F.col("list").cast("long") * (1 << 32) + F.col("b")).alias("_qb"), F.col("part").alias("_vb"))
        return cells(cell(asked), cell(given), k)
