"""Interval algebra on (keys, start, stop) tables.

Intervals of different keys do not meet. Null bounds and empty intervals
(start after stop) are dropped. Each operator is a window over the intervals
of one key or a cell join; give a key with many values, or see
``consolidate`` for tables without one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import overlap_join, range_join
from .series import running_count, windowed

TOUCH = 1e-10


def valid(intervals: DataFrame) -> DataFrame:
    return intervals.where(F.col("start") <= F.col("stop"))


def consolidate(intervals: DataFrame, by: Sequence[str] = (), epsilon: float = TOUCH, strict: bool = False, cell: float | None = None) -> DataFrame:
    """Merge intervals that overlap, touch, or lie within ``epsilon``.

    ``strict`` keeps touching ones apart. With ``cell``, intervals are merged
    within cells of that length by their start first, in parallel, and only
    what is left meets in one window per key; use it where keys are few.
    """

    def merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("start", "stop")
        reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = F.col("start") >= F.col("_reach") if strict else F.col("start") > F.col("_reach") + epsilon
        marked = df.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | apart, 1).otherwise(0))
        runs = marked.withColumn("_run", F.sum("_new").over(order))
        return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")

    kept = valid(intervals).select(*by, "start", "stop")
    if cell:
        kept = merge(kept.withColumn("_cell", F.floor(F.col("start") / cell)), [*by, "_cell"]).drop("_cell")
    return merge(kept, by)


def intersect(a: DataFrame, b: DataFrame, width: float, by: Sequence[str] = (), *more: DataFrame) -> DataFrame:
    """Intersection of consolidated sets; touching points do not count."""

    def two(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = overlap_join(consolidate(x, by), consolidate(y, by), width, by)
        return pairs.select(*by, F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop"))

    return reduce(two, more, two(a, b))


def subtract(a: DataFrame, b: DataFrame, width: float, by: Sequence[str] = ()) -> DataFrame:
    """What is left of the intervals of ``a`` outside those of ``b``.

    ``a`` needs a column ``iid``; pieces keep it.
    """
    a = valid(a).select(*by, "iid", "start", "stop")
    holes = overlap_join(a, consolidate(b, by), width, by, closed=True).select(*by, "iid", "start", "stop", "b_start", "b_stop")
    order = Window.partitionBy(*by, "iid").orderBy("b_start")
    head = holes.select(*by, "iid", F.coalesce(F.lag("b_stop").over(order), F.col("start")).alias("start"), F.col("b_start").alias("stop"))
    tail = holes.groupBy(*by, "iid").agg(F.max("b_stop").alias("start"), F.first("stop").alias("stop"))
    whole = a.join(holes.select(*by, "iid").distinct(), [*by, "iid"], "left_anti")
    return head.unionByName(tail).where("start < stop").unionByName(whole)


def exclude(a: DataFrame, b: DataFrame, width: float, by: Sequence[str] = (), only_contained: bool = False) -> DataFrame:
    """Intervals of ``a`` (with ``iid``) that meet none of ``b``.

    With ``only_contained`` just those that lie within one of ``b`` go.
    """
    pairs = overlap_join(valid(a), b, width, by, closed=True)
    if only_contained:
        pairs = pairs.where("start >= b_start and stop <= b_stop")
    return valid(a).join(pairs.select(*by, "iid").distinct(), [*by, "iid"], "left_anti")


def intersecting(a: DataFrame, b: DataFrame, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Intervals of ``a`` (with ``iid``) with ``intersects``: whether any of ``b`` meets them."""
    met = overlap_join(valid(a), b, width, by, closed=True).select(*by, "iid").distinct().withColumn("_met", F.lit(True))
    return valid(a).join(met, [*by, "iid"], "left").withColumn("intersects", F.coalesce("_met", F.lit(False))).drop("_met")


def to_intervals(samples: DataFrame, flag: str, by: Sequence[str], t: str = "t", cell: float | None = None) -> DataFrame:
    """Runs of true rows as [first, last] of ``t``; with a ``cell`` long series are dealt over tasks."""
    true = F.coalesce(F.col(flag), F.lit(False))
    before = lambda keys: F.lag(true).over(Window.partitionBy(*keys).orderBy(t))
    opens = windowed(samples, by, t, cell, 1, lambda rows, keys: rows.withColumn("_new", true & ~F.coalesce(before(keys), F.lit(False))))
    runs = running_count(opens, F.col("_new"), by, t, cell, "_run").where(true)
    return runs.groupBy(*by, "_run").agg(F.min(t).alias("start"), F.max(t).alias("stop")).drop("_run")


def threshold(samples: DataFrame, value: str, limit: float, by: Sequence[str], above: bool = True, shortest: float = 0.0, bridge: float = 0.0, t: str = "t", cell: float | None = None) -> DataFrame:
    """Periods in which a value is beyond a limit.

    Interruptions of at most ``bridge`` are filled first, then periods shorter
    than ``shortest`` go.
    """
    x = F.col(value)
    flagged = samples.withColumn("_in", F.coalesce(x > limit if above else x < limit, F.lit(False)))
    merged = consolidate(to_intervals(flagged, "_in", by, t, cell), by, epsilon=bridge, cell=cell)
    return merged.where(F.col("stop") - F.col("start") >= shortest)


def bins(spark, start: float, stop: float, window: float, step: float | None = None) -> DataFrame:
    """(iid, start, stop) of windows of length ``window`` every ``step`` that end by ``stop``."""
    step = step or window
    n = max(int((stop - start - window) / step + 1e-9) + 1, 0) if stop - start >= window else 0
    return spark.range(n).select(F.col("id").alias("iid"), (start + F.col("id") * step).alias("start"), (start + F.col("id") * step + window).alias("stop"))


def random_intervals(spark, n: int, share: float, seed: int = 0, parts: int = 64) -> DataFrame:
    """(iid, start, stop): ``n`` random intervals in [0, 1] that cover ``share`` of it.

    ``n`` random places divide the line; each interval takes ``share`` of the
    stretch after its place, and the first one that of the stretch before it.
    Places come from hashes, so they are the same after a lost executor.
    """
    from .series import ranked

    place = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(2**53)
    drawn = spark.range(n).select(place.alias("start"))
    after = windowed(drawn, [], "start", 1 / parts, 1, lambda rows, keys: rows.withColumn("next", F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))))
    numbered = ranked(after, [], "start", 1 / parts, "iid")
    stop = F.col("start") + share * (F.coalesce("next", F.lit(1.0)) - F.col("start"))
    return numbered.select("iid", F.when(F.col("iid") == 0, F.col("start") * (1 - share)).otherwise(F.col("start")).alias("start"), stop.alias("stop"))


def random_intervals_within(spans: DataFrame, n: int, share: float, by: Sequence[str], seed: int = 0) -> DataFrame:
    """(keys, iid, start, stop): ``n`` random intervals in each span that cover ``share`` of it.

    As ``random_intervals``, with places drawn for each key; a span has ``n``
    rows in a window, whatever its length. Empty spans give empty intervals.
    """
    place = F.shiftrightunsigned(F.xxhash64(*by, "_k", F.lit(seed)), 11) / float(2**53)
    drawn = spans.select(*by, F.col("start").alias("_a"), (F.col("stop") - F.col("start")).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")).withColumn("_p", place)
    order = Window.partitionBy(*by).orderBy("_p", "_k")
    placed = drawn.withColumn("iid", F.row_number().over(order) - 1).withColumn("_next", F.coalesce(F.lead("_p").over(order), F.lit(1.0)))
    begin = F.when(F.col("iid") == 0, F.col("_p") * (1 - share)).otherwise(F.col("_p"))
    end = F.col("_p") + share * (F.col("_next") - F.col("_p"))
    return placed.select(*by, "iid", (F.col("_a") + begin * F.col("_w")).alias("start"), (F.col("_a") + end * F.col("_w")).alias("stop"))


def split(intervals: DataFrame, size: float, step: float | None = None, keep: str = "discard", extend: bool = False) -> DataFrame:
    """Pieces of ``size`` every ``step``, with ``piece`` from 0.

    A rest shorter than a piece is discarded, or with ``keep='keep'`` stays,
    with ``extend`` at full size.
    """
    step = step or size
    n = (F.col("stop") - F.col("start")) / step
    whole = F.floor((F.col("stop") - F.col("start") - size) / step + 1e-9).cast("int") + 1
    count = F.when(F.lit(keep == "keep"), F.ceil(n - 1e-9).cast("int")).otherwise(whole)
    pieces = valid(intervals).withColumn("_n", count).where("_n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    begin = F.col("start") + F.col("piece") * step
    end = begin + size
    return pieces.withColumns({"start": begin, "stop": end if extend else F.least(end, F.col("stop"))}).drop("_n")


def split_evenly(intervals: DataFrame, n: int) -> DataFrame:
    """``n`` equal pieces of each interval, with ``piece`` from 0."""
    length = (F.col("stop") - F.col("start")) / n
    pieces = valid(intervals).withColumn("_d", length).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return pieces.withColumns({"start": F.col("start") + F.col("piece") * F.col("_d"), "stop": F.col("start") + (F.col("piece") + 1) * F.col("_d")}).drop("_d")


def truncate(intervals: DataFrame, duration: float, by: Sequence[str]) -> DataFrame:
    """The first ``duration`` of the total time of each key."""
    order = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("stop") - F.col("start")).over(order), F.lit(0.0))
    cut = valid(intervals).withColumn("_used", used).where(F.col("_used") < duration)
    return cut.withColumn("stop", F.least("stop", F.col("start") + duration - F.col("_used"))).drop("_used")


def in_intervals(points: DataFrame, intervals: DataFrame, width: float, by: Sequence[str], key: str, t: str = "t") -> DataFrame:
    """Points with ``inside``, the last interval (by ``iid``) that holds them and
    their ``place`` (from 1) in it; ``key`` names each point."""
    held = range_join(points.select(*by, key, t), intervals, width, by, t).groupBy(*by, key, t).agg(F.max("iid").alias("iid"))
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy(*by, "iid").orderBy(t, key)))
    joined = points.join(placed.drop(t), [*by, key], "left")
    return joined.withColumn("inside", F.col("iid").isNotNull())


def count_in_intervals(points: DataFrame, intervals: DataFrame, width: float, by: Sequence[str], t: str = "t") -> DataFrame:
    """Intervals (with ``iid``) and ``n``, how many points each holds, 0 included."""
    n = range_join(points, intervals, width, by, t).groupBy(*by, "iid").agg(F.count("*").alias("n"))
    return intervals.join(n, [*by, "iid"], "left").fillna(0, ["n"])


def restrict(points: DataFrame, intervals: DataFrame, width: float, by: Sequence[str], shift: bool = False, t: str = "t") -> DataFrame:
    """Points within the union of intervals; ``shift`` closes the gaps between them.

    Shifted times begin at 0 and keep the unshifted one as ``original``.
    """
    union = consolidate(intervals, by)
    if not shift:
        return range_join(points, union, width, by, t, how="left_semi")
    order = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    based = union.withColumn("_base", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(order), F.lit(0.0)))
    held = range_join(points, based, width, by, t)
    return held.withColumn("original", F.col(t)).withColumn(t, F.col(t) - F.col("start") + F.col("_base")).drop("start", "stop", "_base")


def unshift(points: DataFrame, intervals: DataFrame, width: float, by: Sequence[str], t: str = "t") -> DataFrame:
    """The inverse of a shifted restriction; a time at a seam belongs to the later interval."""
    union = consolidate(intervals, by)
    order = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    based = union.withColumn("_base", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(order), F.lit(0.0)))
    last = F.lead("start").over(Window.partitionBy(*by).orderBy("start")).isNull()
    moved = based.select(*by, F.col("_base").alias("_from"), (F.col("_base") + F.col("stop") - F.col("start")).alias("_to"), (F.col("start") - F.col("_base")).alias("_by"), last.alias("_last"))
    held = range_join(points, moved, width, by, t, "_from", "_to").where((F.col(t) < F.col("_to")) | F.col("_last"))
    return held.withColumn(t, F.col(t) + F.col("_by")).drop("_from", "_to", "_by", "_last")
