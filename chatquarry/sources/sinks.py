"""Writing tables of chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import joins


def replace_groups(rows: DataFrame, path: str, key: str) -> None:
    """Writes the rows partitioned by key: each key they hold is replaced whole, leftovers included, and no other is touched."""
    rows.repartition(key).write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows, as of a session's messages."""
    rows.write.mode("append").parquet(path)


def append_nodes(nodes: DataFrame, path: str, keys: list[str]) -> None:
    """Adds the nodes (keys, text, embedding and more) that the table lacks."""
    spark = nodes.sparkSession
    fresh = nodes.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema(nodes.schema).parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_version(rows: DataFrame, path: str, created: int) -> None:
    """Adds a version of a cached table; `latest` reads the last one."""
    rows.write.mode("overwrite").parquet(f"{path}/created={created}")


def latest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("created") == rows.agg(F.max("created")).first()[0]).drop("created")


def upserted(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Sessions, segment analyses and the like: all columns but the key upserted, last change last; write it to a new place."""
    return joins.upsert(base, changes, key, [c for c in base.columns if c != key], order)
