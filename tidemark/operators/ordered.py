"""Ordered-row operators: differences, restarts, smoothing, extrema, trains.

Windows are partitioned by ``by``, the series, so that series are dealt over
tasks; a series is ordered by ``t``. Where series are few or long give
``cell``, a length of ``t``: then a series is dealt over tasks too, see
``operators.series``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import cell_of, join_cells, running_count, windowed


def _order(by: Sequence[str], t: str):
    return Window.partitionBy(*by).orderBy(t)


def derivative(samples: DataFrame, value: str, by: Sequence[str], t: str = "t", cell: float | None = None) -> DataFrame:
    """Slope to the next sample as ``slope`` at the midpoint ``mid``; the last row goes."""

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = _order(keys, t)
        after_t, after_v = F.lead(t).over(w), F.lead(value).over(w)
        sloped = rows.withColumn("mid", (F.col(t) + after_t) / 2).withColumn("slope", (after_v - F.col(value)) / (after_t - F.col(t)))
        return sloped.where(F.col("mid").isNotNull())

    return windowed(samples, by, t, cell, 1, made)


def cumulative(samples: DataFrame, value: str, stop: str, by: Sequence[str], t: str = "t", cell: float | None = None) -> DataFrame:
    """Running sum ``total`` that restarts after each row whose ``stop`` is true.

    With a ``cell`` the sum that is open at a cell's end is carried on: what
    the cell has after its last stop, and all of the cells without one.
    """
    keys = [*by, "_cell"] if cell else list(by)
    rows = samples.withColumn("_cell", cell_of(t, cell)) if cell else samples
    stops = F.sum(F.col(stop).cast("int")).over(_order(keys, t).rowsBetween(Window.unboundedPreceding, -1))
    run = rows.withColumn("_run", F.coalesce(stops, F.lit(0)))
    local = run.withColumn("total", F.sum(value).over(Window.partitionBy(*keys, "_run").orderBy(t)))
    if not cell:
        return local.drop("_run")
    all_stops = F.coalesce(F.sum(F.col(stop).cast("int")), F.lit(0))
    per_run = local.groupBy(*keys, "_run").agg(F.sum(value).alias("_s"), all_stops.alias("_n"))
    tail = F.coalesce(F.sum(F.when(F.col("_n") == 0, F.col("_s"))), F.lit(0))
    cells = per_run.groupBy(*keys).agg(tail.alias("_tail"), F.sum("_n").alias("_stops"))
    part = cells.withColumn("_part", F.sum((F.col("_stops") > 0).cast("int")).over(Window.partitionBy(*by).orderBy("_cell")))
    open_sum = part.withColumn("_open", F.sum("_tail").over(Window.partitionBy(*by, "_part").orderBy("_cell")))
    base = open_sum.select(*keys, F.lag("_open").over(Window.partitionBy(*by).orderBy("_cell")).alias("_base"))
    total = F.when((F.col("_run") == 0) & F.col("_base").isNotNull(), F.coalesce("total", F.lit(0)) + F.col("_base")).otherwise(F.col("total"))
    return join_cells(local, base, by).withColumn("total", total).drop("_run", "_cell", "_base")


def moving_average(samples: DataFrame, value: str, by: Sequence[str], half: int, t: str = "t", cell: float | None = None) -> DataFrame:
    """Mean ``smoothed`` of up to ``half`` rows on each side; nulls left out."""
    return windowed(samples, by, t, cell, half, lambda rows, keys: rows.withColumn("smoothed", F.avg(value).over(_order(keys, t).rowsBetween(-half, half))))


def running_average(samples: DataFrame, value: str, by: Sequence[str], width: float, step: float, t: str = "t") -> DataFrame:
    """Mean over windows [k step, k step + width) of time: keys, ``window``, ``n``, ``mean``."""
    spread = math.ceil(width / step)
    last = F.floor(F.col(t) / step)
    copied = samples.withColumn("window", F.explode(F.sequence(last - spread + 1, last))).where(F.col(t) < F.col("window") * step + width)
    return copied.groupBy(*by, "window").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def gaussian(samples: DataFrame, value: str, by: Sequence[str], sigma: float, radius: float = 4.0, t: str = "t", cell: float | None = None) -> DataFrame:
    """Gaussian mean of rows within ``radius`` sigmas (in rows), nulls left out, as ``smoothed``.

    The kernel is cut at ``radius`` and divided by the weights present, which
    also serves at both ends.
    """
    half = math.ceil(radius * sigma)

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = _order(keys, t)
        terms = [(math.exp(-0.5 * (k / sigma) ** 2), F.lag(value, -k).over(w) if k else F.col(value)) for k in range(-half, half + 1)]
        total = sum((F.coalesce(x * g, F.lit(0.0)) for g, x in terms), F.lit(0.0))
        mass = sum((F.when(x.isNotNull(), F.lit(g)).otherwise(0.0) for g, x in terms), F.lit(0.0))
        return rows.withColumn("smoothed", total / mass)

    return windowed(samples, by, t, cell, half, made)


def extrema(samples: DataFrame, value: str, by: Sequence[str], t: str = "t", cell: float | None = None) -> DataFrame:
    """Rows that exceed (``kind`` max) or undercut (min) both neighbours."""

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = _order(keys, t)
        x, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        kind = F.when((x > a) & (x > b), "max").when((x < a) & (x < b), "min")
        return rows.withColumn("kind", kind).where(F.col("kind").isNotNull())

    return windowed(samples, by, t, cell, 1, made)


def zero_crossings(samples: DataFrame, value: str, by: Sequence[str], level: float = 0.0, t: str = "t", cell: float | None = None) -> DataFrame:
    """Sign changes between rows: ``up`` and the time ``crossing`` by linear interpolation."""

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = _order(keys, t)
        after = rows.withColumns({"_v": F.col(value) - level, "_v1": F.lead(value).over(w) - level, "_t1": F.lead(t).over(w)})
        crossed = after.where(((F.col("_v") < 0) & (F.col("_v1") >= 0)) | ((F.col("_v") >= 0) & (F.col("_v1") < 0)))
        at = F.col(t) + (F.col("_t1") - F.col(t)) * F.col("_v") / (F.col("_v") - F.col("_v1"))
        return crossed.withColumn("up", F.col("_v") < 0).withColumn("crossing", at).drop("_v", "_v1", "_t1")

    return windowed(samples, by, t, cell, 1, made)


def trains(points: DataFrame, by: Sequence[str], gap: float, unit: str | None = None, t: str = "t", cell: float | None = None) -> DataFrame:
    """Runs without a gap over ``gap``: keys, start, stop, ``n`` and distinct ``units``."""
    opens = windowed(points, by, t, cell, 1, lambda rows, keys: rows.withColumn("_new", F.col(t) - F.lag(t).over(_order(keys, t)) > gap))
    runs = running_count(opens, F.col("_new"), by, t, cell, "_run")
    units = F.countDistinct(unit or t).alias("units")
    return runs.groupBy(*by, "_run").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n"), units).drop("_run")


def burst_flags(points: DataFrame, by: Sequence[str], within: float, t: str = "t", cell: float | None = None) -> DataFrame:
    """Points with ``burst``: whether a neighbour is at most ``within`` away."""
    near = lambda gap: F.coalesce(gap <= within, F.lit(False))

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = _order(keys, t)
        return rows.withColumn("burst", near(F.col(t) - F.lag(t).over(w)) | near(F.lead(t).over(w) - F.col(t)))

    return windowed(points, by, t, cell, 1, made)


def variation(points: DataFrame, by: Sequence[str], order: int = 1, t: str = "t", cell: float | None = None) -> DataFrame:
    """Coefficient of variation ``cv`` of intervals of ``order`` and ``cv2`` of neighbouring ones."""

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = _order(keys, t)
        return rows.withColumn("_d", F.col(t) - F.lag(t, order).over(w)).withColumn("_d1", F.lead("_d", order).over(w))

    both = windowed(points, by, t, cell, order, made)
    local = 2 * F.abs(F.col("_d1") - F.col("_d")) / (F.col("_d1") + F.col("_d"))
    return both.groupBy(*by).agg((F.stddev_samp("_d") / F.avg("_d")).alias("cv"), F.avg(local).alias("cv2"), F.count("_d").alias("n"))


def inverse_rate(points: DataFrame, by: Sequence[str], t: str = "t", cell: float | None = None) -> DataFrame:
    """Instantaneous rate, one over the time since the previous point."""
    rated = windowed(points, by, t, cell, 1, lambda rows, keys: rows.withColumn("rate", 1 / (F.col(t) - F.lag(t).over(_order(keys, t)))))
    return rated.where(F.col("rate").isNotNull())


def without_repetitions(rows: DataFrame, value: str, by: Sequence[str], t: str = "t", immediate: bool = False, cell: float | None = None) -> DataFrame:
    """The first row of each value, or of each run of equal values."""
    if immediate:
        kept = windowed(rows, by, t, cell, 1, lambda x, keys: x.withColumn("_before", F.lag(value).over(_order(keys, t))))
        return kept.where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")
    first = F.row_number().over(Window.partitionBy(*by, value).orderBy(t))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def renumber(rows: DataFrame, value: str, by: Sequence[str], t: str = "t") -> DataFrame:
    """Values numbered 1.. in order of their first appearance, as ``number``."""
    first = F.min(t).over(Window.partitionBy(*by, value))
    return rows.withColumn("_first", first).withColumn("number", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first"))).drop("_first")


def largest(rows: DataFrame, k: int, by: Sequence[str], value: Column, tie: str) -> DataFrame:
    """The ``k`` rows of largest value of each key, with ``rank``."""
    w = Window.partitionBy(*by).orderBy(value.desc_nulls_last(), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def insert_rows(rows: DataFrame, lines: DataFrame, by: Sequence[str], place: str = "place", after: str = "after", number: str = "number") -> DataFrame:
    """Rows and lines together with their new ``place``.

    ``rows`` are numbered 1.. by ``place``; each line comes after the row that
    its ``after`` names, 0 being before the first, and lines of one row by
    ``number``. Other columns must agree.
    """
    kept = rows.withColumn("_line", F.lit(0)).withColumn(number, F.lit(0).cast(dict(lines.dtypes)[number])).withColumn("_at", F.col(place).cast("bigint"))
    new = lines.withColumn("_line", F.lit(1)).withColumn("_at", F.col(after).cast("bigint")).drop(after)
    both = kept.drop(place).unionByName(new)
    w = Window.partitionBy(*by).orderBy("_at", "_line", number)
    return both.withColumn(place, F.row_number().over(w)).drop("_at", "_line", number)


def shrink(cells: DataFrame, value: str, rows: int, columns: int, block: tuple[int, int], row: str = "row", column: str = "column") -> DataFrame:
    """Means of blocks of a matrix (row, column, value) of known size, numbered from 1.

    Where a size is no multiple of the block, the empty lines that complete it
    are spread evenly between the others.
    """

    def moved(n: int, size: int, x: str) -> Column:
        extra = -n % size
        holes = [int(math.floor(1 + (n + extra - 1) * k / (extra + 1) + 0.5)) for k in range(1, extra + 1)]
        if n == 1:
            holes = list(range(2, extra + 2))
        free = [i for i in range(1, n + extra + 1) if i not in holes]
        return F.get(F.array(*[F.lit((i - 1) // size + 1) for i in free]), F.col(x).cast("int") - 1)

    placed = cells.select(moved(rows, block[0], row).alias(row), moved(columns, block[1], column).alias(column), value)
    return placed.groupBy(row, column).agg(F.avg(value).alias(value))


def pair_order(sequences: DataFrame, target: DataFrame, by: Sequence[str], unit: str, t: str = "t") -> DataFrame:
    """(by, score, best): pairs of a sequence in the target's order less those against it.

    ``target`` has (unit, rank). ``best`` is the number of pairs of different
    units. Earlier points are counted by rank, of which there are few.
    """
    ranks = sorted(r[0] for r in target.select("rank").distinct().limit(257).collect())
    if len(ranks) > 256:
        raise ValueError("a target of more than 256 units")
    known = sequences.select(*by, unit, t).join(F.broadcast(target), unit)  # at most 256 rows
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    before = {k: F.coalesce(F.sum(F.when(F.col("rank") == k, 1).otherwise(0)).over(w), F.lit(0)) for k in ranks}
    signed = sum((before[k] * F.signum(F.col("rank") - k) for k in ranks), F.lit(0.0))
    pairs = sum((before[k] * (F.col("rank") != k).cast("int") for k in ranks), F.lit(0))
    return known.select(*by, signed.alias("_s"), pairs.alias("_p")).groupBy(*by).agg(F.sum("_s").cast("bigint").alias("score"), F.sum("_p").alias("best"))
