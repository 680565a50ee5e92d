"""Windows over long series, in parallel.

A window over a series is one task for each series, however long it is. With
a ``cell``, a length of ``t``, a series is cut into cells, and what a row needs
from earlier ones is a few numbers a cell, carried along a table that has one
row a cell: counts give running counts and ranks, ranks give segments of equal
numbers of rows, and a segment with as many rows of its neighbours as an
operator looks at gives the same result as the whole series.

Without a ``cell`` all functions use one window a series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096


def cell_of(t: str, cell: float) -> Column:
    return F.floor(F.col(t) / cell)


def carried(rows: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Join to each row of ``_cell`` what ``value``, an aggregate, sums up to over the earlier cells."""
    sums = rows.groupBy(*by, "_cell").agg(value.alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_cell", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(name))
    return join_cells(rows, base, by)


def join_cells(rows: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on keys and ``_cell``, in which nulls are equal."""
    keys = [*by, "_cell"]
    right = cells.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    on = [rows[c].eqNullSafe(right[f"_right_{c}"]) for c in keys]
    return rows.join(right, on, "left").drop(*[f"_right_{c}" for c in keys])


def running_sum(rows: DataFrame, amount: Column, by: Sequence[str], t: str, cell: float | None, name: str) -> DataFrame:
    """Add the sum of a whole number over the rows up to each one, itself and equal times included."""
    counted = rows.withColumn("_amount", F.coalesce(amount.cast("bigint"), F.lit(0)))
    if not cell:
        return counted.withColumn(name, F.sum("_amount").over(Window.partitionBy(*by).orderBy(t))).drop("_amount")
    local = counted.withColumn("_cell", cell_of(t, cell)).withColumn(name, F.sum("_amount").over(Window.partitionBy(*by, "_cell").orderBy(t)))
    based = carried(local, by, F.sum("_amount"), "_base")
    return based.withColumn(name, F.col(name) + F.col("_base")).drop("_amount", "_cell", "_base")


def running_count(rows: DataFrame, flag: Column, by: Sequence[str], t: str, cell: float | None, name: str) -> DataFrame:
    """Add how many rows up to each one, itself and equal times included, have a true ``flag``."""
    return running_sum(rows, flag.cast("int"), by, t, cell, name)


def ranked(rows: DataFrame, by: Sequence[str], t: str, cell: float | None, name: str = "_rank") -> DataFrame:
    """Add the place of each row in its series, from 0."""
    if not cell:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(t)).cast("bigint") - 1)
    local = rows.withColumn("_cell", cell_of(t, cell)).withColumn(name, F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(t)) - 1)
    return carried(local, by, F.count("*"), "_base").withColumn(name, F.col(name) + F.col("_base")).drop("_cell", "_base")


def windowed(rows: DataFrame, by: Sequence[str], t: str, cell: float | None, reach: int, f: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``f(rows, keys)``, whose windows over ``keys`` look at most ``reach`` rows to either side.

    ``f`` may add columns and drop rows. With a ``cell`` it is given segments
    that carry copies of ``reach`` rows of their neighbours, which go afterwards.
    """
    if not cell:
        return f(rows, list(by))
    numbered = ranked(rows, by, t, cell)
    own = F.floor(F.col("_rank") / SEGMENT)
    copies = F.sequence(F.greatest(F.floor((F.col("_rank") - reach) / SEGMENT), F.lit(0)), F.floor((F.col("_rank") + reach) / SEGMENT))
    made = f(numbered.withColumn("_segment", F.explode(copies)).withColumn("_own", own == F.col("_segment")), [*by, "_segment"])
    return made.where("_own").drop("_rank", "_segment", "_own")
