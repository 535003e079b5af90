"""What the operators of this subpackage share: input projection, staging in the cluster's shared folder, components, ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ..staging import scratch, staged  # noqa: F401  (the operators' too)

#: Rows in an Arrow batch sent to Python: texts of over 100 KB must not add up to gigabytes.
ARROW_ROWS, ARROW_BYTES = 256, 1 << 24


def prepared(spark: SparkSession) -> SparkSession:
    ship(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


# ---------------------------------------------------------------- what a Python worker keeps between tasks

_held: dict = {}


def held(key, make):
    """An object that a worker keeps for its next tasks of the same kind; only the last kind's is kept."""
    if key not in _held:
        release()
        _held[key] = make()
        trim()
    return _held[key]


def release() -> None:
    """Lets go of what other operators kept in this worker."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Gives free memory back to the system, which counts it against the executor otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- tables and batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; whatever else the table holds can't clash with its own names."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of the table has."""
    return next(p for p in (f"_w{i}_" for i in range(len(df.columns) + 1)) if not any(c.lower().startswith(p) for c in df.columns))


def broadcast_value(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def slices(batches: Iterable, rows: int = ARROW_ROWS) -> Iterator:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def blocks(batches: Iterable, size: int = 1 << 22) -> Iterator:
    """Batches put together until they hold `size` bytes: enough rows for array work, whatever the length of the texts."""
    waiting, n = [], 0
    for batch in slices(batches):
        waiting.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, n = [], 0
    if n:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
    waiting.clear()
    trim()


def texts_of(batch) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


# ---------------------------------------------------------------- bitmaps of bounded size


def bitmap(hashes: DataFrame, column: str, log2_bits: int):
    """Driver-side numpy bitmap (fixed 2**log2_bits bits) of the low bits of a long column: a filter without false negatives."""
    import numpy as np

    h = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = hashes.select(F.shiftright(h, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    table = words.toArrow()
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out.view(np.uint64)


def split_by(df: DataFrame, key: F.Column, keys: DataFrame, log2_bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """(rows whose key, a long, is not in keys.key; the others and a few more), by a broadcast bitmap of at most 2**(log2_bits - 6) rows,
    whatever the number of keys. Native; an exact join may follow for the second part."""
    low = lambda c: c.bitwiseAND(F.lit((1 << log2_bits) - 1))
    h = F.xxhash64("key")
    words = keys.select(F.shiftright(low(h), 6).alias("_w"), F.expr("shiftleft(1L, cast(xxhash64(key) & 63 as int))").alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_b"))
    p = free_prefix(df)
    marked = df.withColumn(f"{p}h", low(F.xxhash64(key))).join(F.broadcast(words.toDF(f"{p}w", f"{p}b")), F.shiftright(f"{p}h", 6) == F.col(f"{p}w"), "left")
    hit = F.expr(f"coalesce(shiftright({p}b, cast({p}h & 63 as int)) & 1, 0) = 1")
    return marked.filter(~hit).select(*df.columns), marked.filter(hit).select(*df.columns)


def maybe_in(df: DataFrame, key: F.Column, keys: DataFrame, log2_bits: int = 22) -> DataFrame:
    """Rows whose key (a long) is in keys.key, and a few others: a semi-join with a broadcast bitmap."""
    return split_by(df, key, keys, log2_bits)[1]


def in_bitmap(bits, hashes):
    import numpy as np

    h = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) != 0


# ---------------------------------------------------------------- ranks and running totals without a one-task window


def running_total(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = (), order: str = "doc_id") -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `keys` that come earlier by `order`.

    Rows are dealt by ranges of `order`, drawn from what the table holds, so neither wide-ranging nor crowded ids make a range large;
    rows of an equal id are told apart by a hash of the row. Sums within a range add to the totals of the ranges before it.
    Null ids come first; rows of an equal id follow each other in the order of that hash."""
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    rows = df.withColumn("_tie", tie).repartitionByRange(F.col(order).asc_nulls_first(), "_tie").sortWithinPartitions(F.col(order).asc_nulls_first(), "_tie")
    rows = staged(rows.withColumn("_p", F.spark_partition_id()))
    sums = rows.groupBy(*keys, "_p").agg(F.sum(value).alias("_v"))  # a row for each range and key
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_v").over(before(Window.partitionBy(*keys).orderBy("_p"))), F.lit(0))).drop("_v")
    within = before(Window.partitionBy(*keys, "_p").orderBy(F.col(order).asc_nulls_first(), "_tie"))
    inner = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(sums, [*keys, "_p"]).withColumn(out, (F.col("_within") + F.col("_base")).cast("long")).drop("_within", "_base", "_tie", "_p")


def met(rows: DataFrame, groups: DataFrame, key: str, weight: str, heavy: int = 4096) -> DataFrame:
    """Inner join of rows with their group (one row for each non-null key; `weight`: its number of rows).

    The `heavy` largest groups are broadcast, and their rows stay where they are. The group after those holds at most a share of
    1 / heavy of all rows, so no task of the join gets more than that from one key."""
    top = staged(groups.orderBy(F.desc(weight), key).limit(heavy))
    near = rows.join(F.broadcast(top), key)
    rest = rows.join(F.broadcast(top.select(key)), key, "left_anti").join(groups.join(F.broadcast(top.select(key)), key, "left_anti"), key)
    return near.select(*rest.columns).unionByName(rest)


def one_of_each(docs: DataFrame, found: DataFrame, group: str, largest: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those of which their group keeps another: the row with the largest (smallest) id stays, ids before nulls,
    of equal ids one by a hash of the text, of rows equal in id and text any one.

    found: doc_id, key (xxhash64 of the text) and `group` for each document; rows whose group is null stay. Texts move only for the few
    rows that a bitmap of bounded size takes for rows that go."""
    place = F.struct(F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    sums = found.filter(F.col(group).isNotNull()).groupBy(group).agg((F.max if largest else F.min)(place).alias("_stays"), F.count("*").alias("_n")).filter("_n > 1")
    rows = staged(met(found.select("doc_id", "key", group), staged(sums), group, "_n").select("doc_id", "key", (place == F.col("_stays")).alias("stays")))
    goes = rows.filter("not stays").select("doc_id", "key").distinct()
    twice = rows.filter("stays").groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    p = free_prefix(docs)
    named = docs.withColumn(f"{p}id", F.col(id_col).cast("long")).withColumn(f"{p}key", F.xxhash64(F.col(text_col).cast("string")))
    sure, maybe = split_by(named, F.xxhash64(f"{p}id", f"{p}key"), goes.unionByName(twice).select(F.xxhash64("doc_id", "key").alias("key")))
    same = F.col(f"{p}id").eqNullSafe(F.col(f"{p}other")) & (F.col(f"{p}key") == F.col(f"{p}other_key"))
    kept = maybe.join(goes.select(F.col("doc_id").alias(f"{p}other"), F.col("key").alias(f"{p}other_key")), same, "left_anti").dropDuplicates([f"{p}id", f"{p}key"])
    return sure.select(*docs.columns).unionByName(kept.select(*docs.columns))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge to another one.

    Alternating large-star and small-star steps; each round is staged, the links of a round never outnumber the edges."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = staged(e)
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.expr("array(struct(u as u, m as v), struct(v as u, m as v))")).alias("x")).select("x.u", "x.v")
        e = staged(small.filter("u <> v").distinct())
        n, total, deep = e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if (n, total) == seen and n == deep:
            break
        seen = (n, total)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
