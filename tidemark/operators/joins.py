"""Range, overlap and as-of joins, planned as equi-joins or ordered windows.

Spark plans an inequality join as a nested loop. Here time is cut into cells
of ``width``; an interval is copied into the cells that it touches and a point
has one cell, so that the join becomes an equality on keys and cell with the
inequality as a residual. Choose ``width`` near the usual interval length:
copies per interval are then two or so, and cells stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import EPS
from .series import cell_of, join_cells


def cell(x: Column, width: float) -> Column:
    return F.floor(x / width)


def in_cells(intervals: DataFrame, width: float, start: str = "start", stop: str = "stop") -> DataFrame:
    """One row for each cell that an interval touches; empty and null ones go."""
    kept = intervals.where(F.col(start) <= F.col(stop))
    return kept.withColumn("_cell", F.explode(F.sequence(cell(F.col(start), width), cell(F.col(stop), width))))


def range_join(points: DataFrame, intervals: DataFrame, width: float, by: Sequence[str] = (), t: str = "t", start: str = "start", stop: str = "stop", how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them, both bounds included.

    ``by`` columns must be equal. A point has a row for each interval that
    holds it; ``how`` may also be ``left``, ``left_semi`` or ``left_anti``.
    Null times are in no interval.
    """
    left = points.withColumn("_cell", cell(F.col(t), width))
    right = in_cells(intervals, width, start, stop)
    on = ["_cell", *by]
    keys = [left[c] == right[c] for c in on]
    inside = (left[t] >= right[start]) & (left[t] <= right[stop])
    joined = left.join(right, [*keys, inside], how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_cell")
    for c in on:
        joined = joined.drop(right[c])
    return joined.drop("_cell")


def overlap_join(a: DataFrame, b: DataFrame, width: float, by: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """Pairs of intervals that overlap: columns of ``a``, then ``b_start``, ``b_stop``, ``b_*``.

    Intervals that only touch overlap if ``closed``. A pair that shares
    several cells is kept in the first one only.
    """
    right = b.select(*by, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in by])
    x, y = in_cells(a, width), in_cells(right, width, "b_start", "b_stop")
    joined = x.join(y, [*by, "_cell"])
    first = F.col("_cell") == cell(F.greatest("start", "b_start"), width)
    meets = (F.col("start") <= F.col("b_stop")) & (F.col("b_start") <= F.col("stop")) if closed else (F.col("start") < F.col("b_stop")) & (F.col("b_start") < F.col("stop"))
    return joined.where(first & meets).drop("_cell")


def asof_join(left: DataFrame, right: DataFrame, values: Sequence[str], by: Sequence[str], direction: str = "down", strict: bool = False, t: str = "t", cell: float | None = None) -> DataFrame:
    """Each left row with the nearest right row of equal ``by`` before or after it.

    ``down`` is the last right row at or before, ``up`` the first at or after;
    ``strict`` leaves out equal times. Adds ``matched_t`` and ``values``, null
    where there is none. Among right rows of equal time the one with the
    largest values counts. Planned as a union and one ordered window per key;
    with a ``cell`` (of time) as windows over the cells of a key, with each
    cell's outermost right row carried on to the cells that follow.
    """
    down = direction == "down"
    # at equal times right rows come first, and so count, unless strict
    left_rank, right_rank = (0, 1) if strict else (1, 0)
    payload = F.struct(F.col(t).cast("double").alias("_t"), *[F.col(v).alias(v) for v in values])
    lefts = left.withColumn("_is_left", F.lit(True)).withColumn("_rank", F.lit(left_rank))
    rights = right.select(*by, t, payload.alias("_r"), F.lit(False).alias("_is_left"), F.lit(right_rank).alias("_rank"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    keys = [*by, "_cell"] if cell else list(by)
    if cell:
        both = both.withColumn("_cell", cell_of(t, cell))
    along = (lambda w, c: w.orderBy(F.col(c).asc() if down else F.col(c).desc()))
    w = Window.partitionBy(*keys).orderBy(F.col(t).asc() if down else F.col(t).desc(), "_rank", "_r").rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("_found", F.last("_r", ignorenulls=True).over(w)).where("_is_left")
    if cell:
        edge = F.max("_r") if down else F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct((-F.col("_r._t")).alias("t"), F.col("_r").alias("r"))))
        earlier = along(Window.partitionBy(*by), "_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = both.groupBy(*keys).agg(edge.alias("_edge")).select(*keys, F.last("_edge", ignorenulls=True).over(earlier).alias("_carried"))
        done = join_cells(done, cells, by).withColumn("_found", F.coalesce("_found", "_carried"))
    return done.select(*left.columns, F.col("_found._t").alias("matched_t"), *[F.col(f"_found.{v}").alias(v) for v in values])


def match(left: DataFrame, right: DataFrame, by: Sequence[str], direction: str = "closest", error: float = float("inf"), t: str = "t", strict_down: bool = True, cell: float | None = None) -> DataFrame:
    """Time of the right row that each left row is matched to, as ``matched_t``.

    ``up`` is the first at or after, ``down`` the last before (strictly, unless
    ``strict_down`` is off), ``closest`` the nearer of both, the later one on a
    tie. Matches farther than ``error`` are null.
    """
    times = right.select(*by, t)
    if direction in ("up", "down"):
        found = asof_join(left, times, [], by, direction, strict=strict_down and direction == "down", t=t, cell=cell)
    else:
        up = asof_join(left, times, [], by, "up", t=t, cell=cell).withColumnRenamed("matched_t", "_up")
        both = asof_join(up, times, [], by, "down", strict=strict_down, t=t, cell=cell)
        nearer = F.when(F.col("_up").isNull() | (F.col(t) - F.col("matched_t") < F.col("_up") - F.col(t)), F.col("matched_t")).otherwise(F.col("_up"))
        found = both.withColumn("matched_t", nearer).drop("_up")
    return found.withColumn("matched_t", F.when(F.abs(F.col("matched_t") - F.col(t)) <= error + EPS, F.col("matched_t")))


def interpolate(samples: DataFrame, targets: DataFrame, value: str, by: Sequence[str], max_gap: float = float("inf"), t: str = "t", cell: float | None = None) -> DataFrame:
    """Linear interpolation of ``value`` at the targets' times.

    Null outside the samples and where the neighbours are more than ``max_gap``
    away from the target.
    """
    s = samples.select(*by, t, F.col(value).alias("_y")).where(F.col("_y").isNotNull())
    before = asof_join(targets, s, ["_y"], by, "down", t=t, cell=cell).withColumnsRenamed({"matched_t": "_t0", "_y": "_y0"})
    both = asof_join(before, s, ["_y"], by, "up", t=t, cell=cell).withColumnsRenamed({"matched_t": "_t1", "_y": "_y1"})
    slope = (F.col("_y1") - F.col("_y0")) / (F.col("_t1") - F.col("_t0"))
    y = F.when(F.col("_t0") == F.col("_t1"), F.col("_y0")).otherwise(F.col("_y0") + slope * (F.col(t) - F.col("_t0")))
    near = (F.col(t) - F.col("_t0") <= max_gap) & (F.col("_t1") - F.col(t) <= max_gap)
    return both.withColumn(value, F.when(near, y)).drop("_t0", "_t1", "_y0", "_y1")


def first_after(reference: DataFrame, tests: DataFrame, by: Sequence[str], strict: bool = False, t: str = "t", cell: float | None = None) -> DataFrame:
    """Reference rows with ``first_after``: whether a row is the first one at or after some test time (after it, if ``strict``)."""
    return _beside(reference, tests, by, "down", strict, "first_after", t, cell)


def last_before(reference: DataFrame, tests: DataFrame, by: Sequence[str], strict: bool = False, t: str = "t", cell: float | None = None) -> DataFrame:
    """Reference rows with ``last_before``: whether a row is the last one at or before some test time (before it, if ``strict``)."""
    return _beside(reference, tests, by, "up", strict, "last_before", t, cell)


def _beside(reference: DataFrame, tests: DataFrame, by: Sequence[str], direction: str, strict: bool, name: str, t: str, cell: float | None) -> DataFrame:
    """Whether the nearest test time in a direction is nearer than the neighbouring reference row."""
    near = asof_join(reference, tests.select(*by, t), [], by, direction, strict, t, cell).withColumnRenamed("matched_t", "_test")
    other = asof_join(near, reference.select(*by, t), [], by, direction, True, t, cell)
    x, y = (F.col("_test"), F.col("matched_t")) if direction == "down" else (F.col("matched_t"), F.col("_test"))
    apart = (x >= y) if strict else (x > y)
    return other.withColumn(name, F.col("_test").isNotNull() & F.coalesce(apart, F.lit(True))).drop("_test", "matched_t")


def match_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], error: float = 0.0, t: str = "t", cell: float | None = None) -> DataFrame:
    """(by, left_t, right_t) of nearest times in two lists, each used once; null where one has no partner.

    Both lists are read in order, and the earliest times within ``error`` of
    each other are paired. Times more than ``error`` apart part the lists into
    groups that do not touch each other, so a group is as long as its chain of
    close times.
    """
    from .series import running_count, windowed

    both = left.select(*by, F.col(t).cast("double").alias("t"), F.lit(0).alias("side")).unionByName(right.select(*by, F.col(t).cast("double").alias("t"), F.lit(1).alias("side")))
    opens = windowed(both, by, "t", cell, 1, lambda rows, keys: rows.withColumn("_new", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t")) > error))
    chained = running_count(opens, F.col("_new"), by, "t", cell, "_chain")
    keys = [*by, "_chain"]
    # a task reads its chains in order, as most have a row or two
    dealt = chained.select(*keys, "t", "side").repartition(*keys).sortWithinPartitions(*keys, "t")

    def pair(batches):
        def done(parts):
            rows = pa.Table.from_batches(parts)
            t = rows["t"].to_numpy(zero_copy_only=False)
            one, two = _pair_places(t, rows["side"].to_numpy(), _starts(rows, keys), error)
            held = rows.select(list(by)).take(pa.array(np.where(one < 0, two, one)))
            times = [pa.array(np.where(at < 0, np.nan, t[at]), pa.float64(), from_pandas=True) for at in (one, two)]
            made = pa.Table.from_arrays([*held.columns, *times], [*by, "left_t", "right_t"])
            return made.combine_chunks().to_batches(10_000)

        open_rows = []
        for batch in batches:
            if not len(batch):
                continue
            last = [open_rows[-1].slice(len(open_rows[-1]) - 1)] if open_rows else []
            starts = _starts(pa.Table.from_batches([*last, batch]), keys)[1 if last else 0 :] - len(last)
            if len(starts) and (open_rows or starts[-1]):
                yield from done([*open_rows, batch.slice(0, int(starts[-1]))])
                open_rows = [batch.slice(int(starts[-1]))]
            else:
                open_rows.append(batch)
        if open_rows:
            yield from done(open_rows)

    schema = T.StructType([*[chained.schema[c] for c in by], T.StructField("left_t", T.DoubleType()), T.StructField("right_t", T.DoubleType())])
    return dealt.mapInArrow(pair, schema)


def _starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places of the rows whose keys differ from those of the row before, the first one among them; nulls are equal."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in keys:
        code = pa.concat_arrays(rows[c].chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _pair_places(t: np.ndarray, side: np.ndarray, starts: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the left and the right row of each pair, -1 where there is none; chains begin at ``starts`` and are in order of time."""
    stops = np.append(starts[1:], len(t))
    alone = starts[stops - starts == 1]
    pairs, times, sides, missing = [], t.tolist(), side.tolist(), np.isnan(t).tolist()
    long = stops - starts > 1
    for begin, end in zip(starts[long].tolist(), stops[long].tolist()):
        y, j = [i for i in range(begin, end) if sides[i] and not missing[i]], 0
        for i in range(begin, end):
            if missing[i]:
                pairs.append((-1, i) if sides[i] else (i, -1))
            elif not sides[i]:
                while j < len(y) and times[i] > times[y[j]] + error:
                    pairs.append((-1, y[j]))
                    j += 1
                if j < len(y) and times[i] >= times[y[j]] - error:
                    pairs.append((i, y[j]))
                    j += 1
                else:
                    pairs.append((i, -1))
        pairs += [(-1, i) for i in y[j:]]
    found = np.array(pairs, np.int64).reshape(-1, 2)
    one, two = np.where(side[alone] == 0, alone, -1), np.where(side[alone] == 1, alone, -1)
    return np.concatenate([one, found[:, 0]]), np.concatenate([two, found[:, 1]])


def sync(samples: DataFrame, events: DataFrame, before: float, after: float, by: Sequence[str] = (), t: str = "t") -> DataFrame:
    """Samples around each event, with time relative to it.

    Columns of ``samples`` with ``t`` relative, then ``event_t`` and the other
    columns of ``events`` as ``event_*``. Both ends of the window are included.
    """
    shifted = events.select(*by, (F.col(t) - before).alias("_from"), (F.col(t) + after).alias("_to"), *[F.col(c).alias(f"event_{c}") for c in events.columns if c not in by])
    joined = range_join(samples, shifted, before + after, by, t, "_from", "_to")
    return joined.withColumn(t, F.col(t) - F.col(f"event_{t}")).drop("_from", "_to")


def relative_times(points: DataFrame, intervals: DataFrame, width: float, by: Sequence[str] = (), t: str = "t") -> DataFrame:
    """Place of each point within its intervals, 0 at start and 1 at stop."""
    inside = range_join(points, intervals, width, by, t)
    return inside.withColumn("relative", (F.col(t) - F.col("start")) / (F.col("stop") - F.col("start")))
