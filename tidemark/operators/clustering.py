"""Functional clustering: how near the points of two trains lie to each other, against jittered trains, and a tree of merges.

A unit's train is the times of its points. The distance of two units is the
mean of how far a point of either lies from the nearest point of the other,
both ways, over what independent Poisson trains of their rates would have.

Groups (``by``) and repetitions are cut into segments of equal numbers of
points. Of other segments a task knows only the last and the first point of
each unit, so neither a long series nor one with few keys meets in one task.
Points whose unit or time is null, NaN or infinite take no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .lineage import cut
from .regression import _joined, _left
from .resampling import uniform
from .series import ranked

SEGMENT = 4096  # points of one task


def _units(points: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """(by, _name, _unit): the units of each group, numbered from 1 in their order."""
    names = points.select(*by, F.col(unit).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    return names.withColumn("_unit", F.row_number().over(Window.partitionBy(*by).orderBy("_name")).cast("bigint"))


def moved(points: DataFrame, by: Sequence[str], unit: str, key: str, deviation: float, repetitions: int, seed: int = 0, t: str = "t") -> DataFrame:
    """(by, _name, _repetition, _t): the points themselves as repetition 0, and each moved by normal deviates in 1..``repetitions``.

    The deviation is at most a tenth of the group's span. A move is a hash of
    (``key``, repetition, seed), so it is the same wherever it is computed.
    """
    kept = points.select(*by, F.col(unit).alias("_name"), F.col(key).alias("_key"), C.finite(F.col(t)).alias("_t")).where(F.col("_name").isNotNull() & F.col("_t").isNotNull())
    spans = kept.groupBy(*by).agg((F.max("_t") - F.min("_t")).alias("_span"))
    every = _joined(kept, spans, by).withColumn("_repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions))))
    u, v = uniform("_key", "_repetition", seed=2 * seed), uniform("_key", "_repetition", seed=2 * seed + 1)
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
    move = F.when(F.col("_repetition") > 0, F.least(F.lit(float(deviation)), F.col("_span") / 10) * normal).otherwise(0.0)
    return every.select(*by, "_name", "_repetition", (F.col("_t") + move).alias("_t"))


def _segments(trains: DataFrame, keys: Sequence[str], cell: float | None) -> DataFrame:
    """Rows with ``_segment``; kept, so that ties at a segment's edge stay where they are."""
    return cut(ranked(trains, keys, "_t", cell).withColumn("_segment", F.floor(F.col("_rank") / SEGMENT)).drop("_rank"))


def _edges(trains: DataFrame, units: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _repetition, _segment, _unit, _last, _next): last point of a unit before a segment and first one after it."""
    keys = [*by, "_repetition", "_segment"]
    ends = trains.groupBy(*keys, "_unit").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    every = _joined(ends.select(*keys).distinct(), units.select(*by, "_unit"), by)
    grid = _left(every, ends, [*keys, "_unit"])
    order = Window.partitionBy(*by, "_repetition", "_unit").orderBy("_segment")
    last = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("_low").over(order.rowsBetween(1, Window.unboundedFollowing))
    return grid.select(*keys, "_unit", last.alias("_last"), after.alias("_next"))


def _nearest_sums(trains: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _repetition, _a, _b, _s): summed distances of the points of ``_a`` to the nearest of ``_b``, for each ``_b`` of ``edges``.

    ``trains`` and ``edges`` name clusters in ``_c``. A task holds a segment's points and a few numbers for each cluster asked for.
    """
    keys = [*by, "_repetition", "_segment"]
    held = [*by, "_repetition"]
    schema = T.StructType([*[trains.schema[c] for c in held], T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_s", T.DoubleType())])

    def within(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return pd.DataFrame(columns=schema.names)
        t, own = points["_t"].to_numpy(), points["_c"].to_numpy()
        order = np.argsort(t, kind="stable")
        t, own = t[order], own[order]
        names, codes = np.unique(own, return_inverse=True)
        made = []
        for b, last, after in zip(asked["_c"], asked["_last"], asked["_next"]):
            line = np.concatenate([[-np.inf if pd.isna(last) else last], t[own == b], [np.inf if pd.isna(after) else after]])
            place = np.searchsorted(line, t).clip(1, len(line) - 1)
            gap = np.minimum(t - line[place - 1], line[place] - t)
            other = names != b
            made.append(pd.DataFrame({"_a": names[other], "_b": b, "_s": np.bincount(codes, gap, len(names))[other]}))
        out = pd.concat(made, ignore_index=True)
        for c in held:
            out[c] = points[c].iat[0]
        return out[schema.names]

    parts = trains.select(*keys, "_c", "_t").groupBy(*keys).cogroup(edges.select(*keys, "_c", "_last", "_next").groupBy(*keys)).applyInPandas(within, schema)
    return parts.groupBy(*held, "_a", "_b").agg(F.sum("_s").alias("_s"))


def _quantile(ordered: Column, n: int, p: float) -> Column:
    """Quantile of a sorted array of ``n`` values, each the middle of an n-th of the distribution."""
    place = min(max(n * p - 0.5, 0), n - 1)
    low = math.floor(place)
    a, b = F.get(ordered, F.lit(low)), F.get(ordered, F.lit(min(low + 1, n - 1)))
    return a + (place - low) * (b - a)


def _pairs(sums: DataFrame, spans: DataFrame, by: Sequence[str], repetitions: int) -> DataFrame:
    """(by, _i, _j, distance, significance) for clusters i before j, from the sums of all repetitions."""
    i, j = F.least("_a", "_b").alias("_i"), F.greatest("_a", "_b").alias("_j")
    both = sums.groupBy(*by, "_repetition", i, j).agg(F.sum(F.col("_s") / F.col("_na")).alias("_both"), F.first(F.col("_na") + F.col("_nb")).alias("_plus"), F.first(F.col("_na") * F.col("_nb")).alias("_times"))
    # Independent Poisson trains of rates f and g have a mean of (f + g) / (4 f g).
    expected = F.nullif("_span", F.lit(0.0)) * F.col("_plus") / (4 * F.col("_times"))
    amd = _joined(both, spans, by).withColumn("_d", F.col("_both") / 2 / expected)
    jittered = F.array_sort(F.collect_list(F.when(F.col("_repetition") > 0, F.col("_d"))))
    made = amd.groupBy(*by, "_i", "_j").agg(F.max(F.when(F.col("_repetition") == 0, F.col("_d"))).alias("distance"), jittered.alias("_null"))
    if not repetitions:
        return made.select(*by, "_i", "_j", "distance", F.lit(None).cast("double").alias("significance"))
    middle, edge = _quantile(F.col("_null"), repetitions, 0.5), _quantile(F.col("_null"), repetitions, 0.05)
    return made.select(*by, "_i", "_j", "distance", ((F.col("distance") - middle) / F.nullif(edge - middle, F.lit(0.0))).alias("significance"))


class _Trains:
    """The kept tables of one analysis: trains of all repetitions, edges of segments, units, spans and the units' sums."""

    def __init__(self, points, by, unit, key, deviation, repetitions, cell, seed, t):
        self.by = list(by) or ["_all"]
        points = points if by else points.withColumn("_all", F.lit(0))
        trains = moved(points, self.by, unit, key, deviation, repetitions, seed, t)
        self.spans = cut(trains.where("_repetition = 0").groupBy(*self.by).agg((F.max("_t") - F.min("_t")).alias("_span")))
        first = trains.where("_repetition = 0").groupBy(*self.by, "_name").agg(F.count("*").alias("_n"))
        self.units = cut(_joined(first, _units(first, self.by, "_name"), [*self.by, "_name"]))
        numbered = _joined(trains, self.units.select(*self.by, "_name", "_unit"), [*self.by, "_name"]).drop("_name")
        self.trains = _segments(numbered, [*self.by, "_repetition"], cell)
        self.edges = cut(_edges(self.trains, self.units, self.by))
        alone = _nearest_sums(self.trains.withColumnRenamed("_unit", "_c"), self.edges.withColumnRenamed("_unit", "_c"), self.by)
        self.sums = cut(self.counted(alone, self.units.select(*self.by, F.col("_unit").alias("_c"), "_n")))

    def counted(self, sums: DataFrame, sizes: DataFrame) -> DataFrame:
        """Sums with the numbers of points of both clusters."""
        for c, n in (("_a", "_na"), ("_b", "_nb")):
            sums = _joined(sums, sizes.select(*self.by, F.col("_c").alias(c), F.col("_n").alias(n)), [*self.by, c])
        return sums


def train_distances(points: DataFrame, by: Sequence[str], unit: str, key: str, deviation: float = 5.0, repetitions: int = 100, cell: float | None = None, seed: int = 0, t: str = "t") -> DataFrame:
    """(by, a, b, distance, significance) for each pair of units, a before b.

    ``distance`` is 1 for independent Poisson trains, 0 for equal ones, null if
    all times are equal. ``significance`` centres it by the median of the
    jittered trains' distances and scales it by how far their fifth percentile
    lies from that: 1 is a p of 0.05. It is null without repetitions, or if
    jitters change nothing. ``key`` tells rows apart; rows that share one move
    alike. With ``cell``, a length of ``t`` that holds few points, ranks are
    counted by cells. Points times (repetitions + 1) are shuffled.
    """
    made = _Trains(points, by, unit, key, deviation, repetitions, cell, seed, t)
    pairs = _pairs(made.sums, made.spans, made.by, repetitions)
    for number, name in (("_i", "a"), ("_j", "b")):
        names = made.units.select(*made.by, F.col("_unit").alias(number), F.col("_name").alias(name))
        pairs = _joined(pairs, names, [*made.by, number])
    return pairs.select(*by, "a", "b", "distance", "significance")


def functional_clusters(points: DataFrame, by: Sequence[str], unit: str, key: str, deviation: float = 5.0, repetitions: int = 100, cell: float | None = None, seed: int = 0, t: str = "t") -> DataFrame:
    """(by, step, first, second, significance, distance, members): the tree of merges, a row a merge.

    The pair of greatest significance is merged, ties to the least second, then
    least first; pairs without one come last. Units are numbered from 1 in their
    order and the cluster made in a step is n + step; ``members`` lists its
    units. Distances of a merged train are those of its points: what its parts'
    points sum up to is added, and only distances to it are counted anew, in all
    repetitions. All groups merge at once, so there are as many rounds, of a few
    Spark jobs each, as the greatest group has units, less one. A group of one
    unit has no row. For the other arguments see ``train_distances``.
    """
    made = _Trains(points, by, unit, key, deviation, repetitions, cell, seed, t)
    by_, sums = made.by, made.sums
    totals = made.units.groupBy(*by_).agg(F.count("*").alias("_units"))
    most = made.units.groupBy(*by_).count().agg(F.max("count")).first()[0] or 0
    labels = cut(made.units.withColumn("_c", F.col("_unit")))
    tree = None
    for step in range(1, most):
        rank = F.struct(F.coalesce("significance", F.lit(float("-inf"))), -F.col("_j"), -F.col("_i"))
        best = _pairs(sums, made.spans, by_, repetitions).groupBy(*by_).agg(F.max_by(F.struct("_i", "_j", "significance", "distance"), rank).alias("_best"))
        merge = cut(_joined(best.select(*by_, "_best.*"), totals, by_).withColumn("_new", F.col("_units") + step).drop("_units"))
        pair = merge.select(*by_, "_i", "_j", "_new")
        joined = F.col("_c").isin(F.col("_i"), F.col("_j"))
        labels = cut(_left(labels, pair, by_).withColumn("_c", F.when(joined, F.col("_new")).otherwise(F.col("_c"))).drop("_i", "_j", "_new"))
        in_new = _joined(labels, pair.select(*by_, "_new"), by_).where("_c = _new")
        members = in_new.groupBy(*by_).agg(F.array_sort(F.collect_list("_name")).alias("members"))
        row = _joined(merge, members, by_).select(*by_, F.lit(step).cast("bigint").alias("step"), F.col("_i").alias("first"), F.col("_j").alias("second"), "significance", "distance", "members")
        tree = cut(row if tree is None else tree.unionByName(row))
        if step == most - 1:
            break
        # Groups that are one cluster now have no sums left, and so no more rows.
        at = _joined(sums, pair, by_)
        a_in, b_in = F.col("_a").isin(F.col("_i"), F.col("_j")), F.col("_b").isin(F.col("_i"), F.col("_j"))
        kept = at.where(~a_in & ~b_in).select(*by_, "_repetition", "_a", "_b", "_s")
        from_new = at.where(a_in & ~b_in).groupBy(*by_, "_repetition", F.col("_new").alias("_a"), "_b").agg(F.sum("_s").alias("_s"))
        named = _joined(made.trains, labels.select(*by_, "_unit", "_c"), [*by_, "_unit"])
        edges = _joined(made.edges, in_new.select(*by_, "_unit", "_c"), [*by_, "_unit"])
        edges = cut(edges.groupBy(*by_, "_repetition", "_segment", "_c").agg(F.max("_last").alias("_last"), F.min("_next").alias("_next")))
        to_new = _nearest_sums(named, edges, by_)
        sizes = labels.groupBy(*by_, "_c").agg(F.sum("_n").alias("_n"))
        sums = cut(made.counted(kept.unionByName(from_new).unionByName(to_new), sizes))
    if tree is None:
        none = made.units.where("false")
        tree = none.select(*by_, F.lit(0).cast("bigint").alias("step"), F.col("_unit").alias("first"), F.col("_unit").alias("second"), F.lit(None).cast("double").alias("significance"), F.lit(None).cast("double").alias("distance"), F.array("_name").alias("members"))
    return tree.select(*by, "step", "first", "second", "significance", "distance", "members")
