"""Whole tables: grouped lists, flags from indices, rows found in another table, draws, matrices in long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped(*tables: DataFrame, name: str = "group") -> DataFrame:
    """Rows of all tables with the number, from 1, of the table that a row is from."""
    return reduce(DataFrame.unionByName, [t.withColumn(name, F.lit(i)) for i, t in enumerate(tables, 1)])


def flags(indices: DataFrame, index: str, n: int | None = None) -> DataFrame:
    """(index, flag) for 1..n, by default to the last index: whether each one is among the indices."""
    last = n if n is not None else indices.agg(F.max(index)).first()[0] or 0
    every = indices.sparkSession.range(1, last + 1).withColumnRenamed("id", index)
    held = indices.select(F.col(index).cast("bigint").alias(index)).distinct().withColumn("flag", F.lit(True))
    return every.join(held, index, "left").fillna(False, ["flag"])


def matched_rows(reference: DataFrame, query: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reference rows with ``matched``: whether a row of the query agrees with them in all columns, nulls being equal."""
    key = query.select(F.struct(*[F.col(c) for c in columns]).alias("_key")).distinct().withColumn("_there", F.lit(True))
    both = reference.withColumn("_own", F.struct(*[F.col(c) for c in columns])).join(key, F.col("_own").eqNullSafe(F.col("_key")), "left")
    return both.withColumn("matched", F.coalesce("_there", F.lit(False))).drop("_own", "_key", "_there")


def drawn_bins(histogram: DataFrame, bin: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, bin): ``n`` independent draws of bins with chances in proportion to their weights.

    A histogram has few bins, so its running sums are one window and are
    broadcast as one sorted list, in which a draw's hash finds its bin.
    """
    total = F.sum(weight).over(Window.partitionBy(F.lit(0)))
    upto = F.sum(weight).over(Window.partitionBy(F.lit(0)).orderBy(bin))
    edges = histogram.where(F.col(weight) > 0).select((upto / total).alias("upto"), bin)
    listed = edges.agg(F.array_sort(F.collect_list(F.struct("upto", bin))).alias("edges")).withColumn("_one", F.lit(1))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(2**53)
    draws = histogram.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("_u"), F.lit(1).alias("_one"))
    found = F.get(F.filter("edges", lambda e: e["upto"] > F.col("_u")), F.lit(0))
    return draws.join(F.broadcast(listed), "_one").select("draw", F.coalesce(found[bin], F.element_at("edges", -1)[bin]).alias(bin))


def filled_matrix(cells: DataFrame, value: str, rows: int, columns: int, fill: float | None = None, row: str = "row", column: str = "column") -> DataFrame:
    """A dense matrix in long form of the given size: sums of equal places, ``fill`` where there is none, places beyond it cut off."""
    every = cells.sparkSession.range(1, rows + 1).withColumnRenamed("id", row).withColumn(column, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(columns).cast("bigint"))))
    sums = cells.groupBy(F.col(row).cast("bigint").alias(row), F.col(column).cast("bigint").alias(column)).agg(F.sum(value).alias(value))
    return every.join(sums, [row, column], "left").withColumn(value, F.coalesce(value, F.lit(fill)))
