"""Ordered computations within groups of any size: rows are dealt by ranges of group and order, and what a range needs to know of the
ranges before it is a few values a group.

The dealt rows are written once with their range, so that all that is derived from them speaks of the same ranges, however a later
plan splits or joins partitions. No window spans more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..staging import staged

RANGE = "_range"


class Ordered:
    """Rows dealt by ranges of a group column and of columns that order its rows and together tell them apart. Null groups and places
    come first. The rows keep a column `_range`; results of the methods can be fed to further ones as `rows`."""

    def __init__(self, rows: DataFrame, group: str, *order: str):
        self.group, self.order = group, order
        place = [F.asc_nulls_first(c) for c in (group, *order)]
        self.rows = staged(rows.repartitionByRange(*place).withColumn(RANGE, F.spark_partition_id()))

    def within(self) -> Window:
        return Window.partitionBy(self.group, RANGE).orderBy(*[F.asc_nulls_first(c) for c in self.order])

    def joined(self, rows: DataFrame, figures: DataFrame) -> DataFrame:
        """Rows with the figures (_g, _r and more) of their range."""
        return rows.join(figures, (F.col(RANGE) == F.col("_r")) & F.col(self.group).eqNullSafe(F.col("_g"))).drop("_g", "_r")

    def prefix(self, number: str | None = None, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, totals: dict[str, Column] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Adds columns: the row's number from 1; sums (0 at first) and greatest values (null at first) over the rows of its group that come
        before it; totals over all rows of the group."""
        rows = self.rows if rows is None else rows
        sums, maxima, totals = dict(sums or {}), maxima or {}, totals or {}
        if number:
            sums[number] = F.lit(1).cast("long")
        before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        by_range = Window.partitionBy("_g").orderBy("_r")
        each = [F.sum(c).alias(f"_t_{n}") for n, c in {**sums, **totals}.items()] + [F.max(c).alias(f"_t_{n}") for n, c in maxima.items()]
        parts = rows.groupBy(F.col(self.group).alias("_g"), F.col(RANGE).alias("_r")).agg(*each)
        carried = [F.coalesce(F.sum(f"_t_{n}").over(before(by_range)), F.lit(0)).alias(f"_c_{n}") for n in sums] + [F.max(f"_t_{n}").over(before(by_range)).alias(f"_c_{n}") for n in maxima]
        carried += [F.sum(f"_t_{n}").over(Window.partitionBy("_g")).alias(n) for n in totals]
        w = before(self.within())
        inner = rows.withColumns({**{f"_i_{n}": F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}, **{f"_i_{n}": F.max(c).over(w) for n, c in maxima.items()}})
        out = self.joined(inner, parts.select("_g", "_r", *carried))
        own = {n: F.col(f"_i_{n}") + F.col(f"_c_{n}") + (1 if n == number else 0) for n in sums} | {n: F.greatest(f"_i_{n}", f"_c_{n}") for n in maxima}
        return out.withColumns(own).drop(*(f"{p}{n}" for n in own for p in ("_i_", "_c_")))

    def preceding(self, name: str, value: Column, k: int, rows: DataFrame | None = None) -> DataFrame:
        """Adds an array of the values of the k rows before, oldest first (fewer at a group's beginning)."""
        rows = (self.rows if rows is None else rows).withColumn("_v", F.struct(value.alias("v")))
        last = Window.partitionBy(self.group, RANGE).orderBy(*[F.desc_nulls_last(c) for c in self.order])
        tails = rows.select(F.col(self.group).alias("_g"), F.col(RANGE).alias("_r"), "_v", F.row_number().over(last).alias("_n")).filter(F.col("_n") <= k)
        tails = tails.groupBy("_g", "_r").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "_v"))).alias("_tail"))
        # each range that holds rows of the group holds one at least, so k ranges before are enough
        carried = F.flatten(F.collect_list("_tail").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(-k, -1)))
        own = F.collect_list("_v").over(self.within().rowsBetween(-k, -1))
        out = self.joined(rows.withColumn("_own", own), tails.select("_g", "_r", carried.alias("_carried")))
        both = F.concat(F.transform("_carried", lambda x: x["_v"]), F.col("_own"))
        return out.withColumn(name, F.transform(F.slice(both, F.greatest(F.lit(1), F.size(both) - k + 1), k), lambda x: x["v"])).drop("_v", "_own", "_carried")


def plain(rows: DataFrame) -> DataFrame:
    return rows.drop(RANGE)


def numbered(rows: DataFrame, group: str, *order: str, name: str = "rn") -> DataFrame:
    """Adds the row's number (from 1) in its group by the order's columns, which together must tell rows apart."""
    return plain(Ordered(rows, group, *order).prefix(number=name))
