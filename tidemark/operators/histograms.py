"""Binned aggregation: dense grids, event histograms, correlograms, maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import bin_center, bin_index, circular_mean, finite, resultant
from .joins import in_cells, range_join, sync
from .series import windowed
from .unit_pairs import unit_correlations  # noqa: F401

CELL_ROWS = 1 << 16


def grid(df: DataFrame, **sizes: int) -> DataFrame:
    """All combinations of bins 1..n of each named axis, a table of fixed size."""
    out = df.sparkSession.range(1).select()
    for name, n in sizes.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))
    return out


def dense(sums: DataFrame, fill: Sequence[str] = (), **sizes: int) -> DataFrame:
    """Give every cell of a grid a row; ``fill`` columns are 0 where none was."""
    return grid(sums, **sizes).join(sums, list(sizes), "left").fillna(0, list(fill) or None)


def accumulate(rows: DataFrame, value: str, arg: str | None = None, **sizes: int) -> DataFrame:
    """Sum, mean, deviation, least and largest of a value in each cell of a grid.

    Axis columns hold bins from 1. Missing cells have ``n`` and ``total`` 0
    and the rest null. ``arg`` names the column reported for the extreme rows.
    """
    x = F.col(value)
    named = {"n": F.count(x), "total": F.sum(x), "mean": F.avg(x), "deviation": F.stddev_samp(x), "least": F.min(x), "largest": F.max(x)}
    if arg:
        named |= {"arg_least": F.min_by(arg, F.struct(x, F.col(arg))), "arg_largest": F.max_by(arg, F.struct(x, -F.col(arg)))}
    sums = rows.where(x.isNotNull()).groupBy(*sizes).agg(*[v.alias(k) for k, v in named.items()])
    return dense(sums, ["n", "total"], **sizes)


def peth(samples: DataFrame, events: DataFrame, before: float, after: float, n: int, by: Sequence[str] = (), key: str | None = None, value: str | None = None) -> DataFrame:
    """Event-synchronised histogram in ``n`` bins from -before to after.

    Without ``value`` points are counted, and ``rate`` is the mean rate over
    all events, also those without any point; with it ``mean`` is the value's.
    ``key``, a column of the events, gives a histogram for each event; with it
    and ``value``, and without ``by``, sums come from running sums, so that
    samples are not joined to all events around them (NaN and infinite values
    then count as null, and the samples are counted first).
    """
    if key and value and not by:
        return _summed_peth(samples, events, before, after, n, key, value)
    relative = sync(samples, events, before, after, by)
    binned = relative.withColumn("bin", bin_index(F.col("t"), -before, after, n))
    keys = [f"event_{key}"] if key else []
    if value:
        return binned.groupBy(*keys, "bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    if key:
        return counts
    total = events.count()
    full = dense(counts, ["n"], bin=n)
    return full.withColumn("center", bin_center(F.col("bin"), -before, after, n)).withColumn("rate", F.col("n") / (max(total, 1) * (before + after) / n))


def _summed_peth(samples: DataFrame, events: DataFrame, before: float, after: float, n: int, key: str, value: str) -> DataFrame:
    """``peth`` of a value for each event: a bin's sums are differences of running sums of the sorted samples of two cells."""
    seen = samples.select(F.col("t").cast("double").alias("t"), finite(F.col(value)).alias("v")).where(finite(F.col("t")).isNotNull())
    low, high, many = seen.agg(F.min("t"), F.max("t"), F.count("*")).first()
    low, high = low or 0.0, high or 0.0
    step = (before + after) / n
    # by rounding a sample may be a little outside its bin; cells are at least as wide as a bin, and hold some CELL_ROWS samples if they can
    margin = 1e-6 + 1e-15 * max(abs(low), abs(high))
    width = max(step + 4 * margin, (high - low) * CELL_ROWS / max(many, 1))
    own = F.floor(F.col("t") / width)
    held = seen.withColumn("_cell", F.explode(F.array(own - 1, own)))
    edge = F.col("t") - before + (F.col("bin") - 1) * step - margin
    asked = events.where(finite(F.col("t")).isNotNull()).select(F.col(key).alias("key"), F.col("t").cast("double").alias("t")).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n))))
    asked = asked.where(edge.between(low - 2 * width, high + 2 * width)).withColumn("_cell", F.floor(edge / width))

    def sums(rows: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        u, v = rows["t"].to_numpy(), rows["v"].to_numpy(float)
        there = ~np.isnan(v)
        middle = v[there].mean() if there.any() else 0.0
        d = np.where(there, v.astype(np.longdouble) - middle, 0)
        counts, one, two = (np.concatenate([[0], np.cumsum(x)]) for x in (there, d, d * d))
        t, k = bins["t"].to_numpy(), bins["bin"].to_numpy()

        def places(k: np.ndarray) -> np.ndarray:
            """How many samples are before bin k, which rounding puts nearly at its edge."""
            first, last = np.searchsorted(u, t - before), np.searchsorted(u, t + after, "right")
            reached = lambda i: np.floor((u[i] - t + before) / (after + before) * n) + 1 >= k
            found = np.searchsorted(u, t - before + (k - 1) * step)
            while (high := (found > 0) & reached(np.maximum(found - 1, 0))).any():
                found -= high
            while (low := (found < len(u)) & ~reached(np.minimum(found, len(u) - 1))).any():
                found += low
            return np.where(k == 1, first, np.where(k == n + 1, last, np.clip(found, first, last)))

        if not len(u) or not len(t):
            return pd.DataFrame({c: [] for c in schema.names})
        lo, hi = places(k), places(k + 1)
        size, s, q = (x[hi] - x[lo] for x in (counts, one, two))
        squares = q - s * s / np.maximum(size, 1)
        made = pd.DataFrame({f"event_{key}": bins["key"], "bin": k, "n": size, "total": (s + size * np.longdouble(middle)).astype(float), "squares": np.maximum(squares, 0).astype(float)})
        return made[hi > lo]

    schema = T.StructType([T.StructField(f"event_{key}", events.schema[key].dataType), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("squares", T.DoubleType())])
    parts = held.groupBy("_cell").cogroup(asked.groupBy("_cell")).applyInPandas(sums, schema)
    total, size = F.sum("total"), F.sum("n")
    apart = F.sum("squares") + F.when(F.count("*") > 1, F.greatest(F.sum(F.col("total") ** 2 / F.nullif("n", F.lit(0))) - total * total / F.nullif(size, F.lit(0)), F.lit(0.0))).otherwise(0.0)
    mean, deviation = total / F.nullif(size, F.lit(0)), F.sqrt(apart / F.when(size > 1, size - 1))
    return parts.groupBy(f"event_{key}", "bin").agg(size.alias("n"), mean.alias("mean"), deviation.alias("deviation"))


def joint_peth(a: DataFrame, b: DataFrame, key: str, n_events: int, n: int) -> DataFrame:
    """Joint counts of two histograms by event and what independence expects.

    ``a`` and ``b`` have the key, ``bin`` and ``n``: rows of a cell are the
    events' products; ``expected`` is the product of sums over the events.
    """
    y = b.select(key, F.col("bin").alias("bin_b"), F.col("n").alias("n_b"))
    joint = a.withColumnRenamed("bin", "bin_a").join(y, key).groupBy("bin_a", "bin_b").agg(F.sum(F.col("n") * F.col("n_b")).alias("joint"))
    sums_a = a.groupBy(F.col("bin").alias("bin_a")).agg(F.sum("n").alias("_a"))
    sums_b = b.groupBy(F.col("bin").alias("bin_b")).agg(F.sum("n").alias("_b"))
    full = dense(joint, ["joint"], bin_a=n, bin_b=n).join(F.broadcast(sums_a), "bin_a", "left").join(F.broadcast(sums_b), "bin_b", "left").fillna(0, ["_a", "_b"])  # a row a bin
    expected = F.col("_a") * F.col("_b") / n_events
    return full.withColumn("expected", expected).withColumn("difference", F.col("joint") - F.col("expected")).drop("_a", "_b")


def correlogram(points: DataFrame, unit: str, bin_size: float, half_bins: int, by: Sequence[str] = (), t: str = "t") -> DataFrame:
    """Counts of time differences between all units: keys, ``a``, ``b``, ``bin``, ``n``.

    ``bin`` runs from -half to half; a difference of exactly the lower edge of
    a bin belongs to it. A point is not compared with itself, nor with the
    other points of its unit at the same time. Planned as a cell join with one
    side copied to the cells around it.
    """
    reach = (half_bins + 0.5) * bin_size
    a = points.select(*by, F.col(unit).alias("a"), F.col(t).alias("_t"))
    b = points.select(*by, F.col(unit).alias("b"), F.col(t).alias("_u"))
    windows = a.withColumn("start", F.col("_t") - reach).withColumn("stop", F.col("_t") + reach)
    cells = in_cells(windows, 2 * reach)
    pairs = cells.join(b.withColumn("_cell", F.floor(F.col("_u") / (2 * reach))), [*by, "_cell"])
    d = F.col("_u") - F.col("_t")
    found = pairs.where(((F.col("a") != F.col("b")) | (F.col("_u") != F.col("_t")))).withColumn("bin", F.floor(d / bin_size + 0.5).cast("int"))
    return found.where(F.col("bin").between(-half_bins, half_bins)).groupBy(*by, "a", "b", "bin").agg(F.count("*").alias("n"))


def counted_correlogram(points: DataFrame, unit: str, bin_size: float, half_bins: int, by: Sequence[str] = (), t: str = "t") -> DataFrame:
    """As ``correlogram``, for few keys with many points, whose pairs are too many to be joined.

    Null times, NaN and null keys take no part. Equal points are first added up. Time is cut into cells, and
    a task has the points of a cell and those of the next ones, where it counts
    by places in sorted times, without the pairs, unless the pairs are fewer.
    """
    kinds = points.schema
    u = F.col(t).cast("double")
    whole = points.where(u.isNotNull() & ~F.isnan(u)).dropna(subset=list(by)) if by else points.where(u.isNotNull() & ~F.isnan(u))
    weighed = whole.groupBy(*by, F.col(unit).alias("unit"), u.alias("t")).agg(F.count("*").alias("w"))
    # a little wider than the reach, so that no rounding puts a pair outside
    width = (half_bins + 0.5) * bin_size * (1 + 1e-6) + 1e-6
    own = F.floor(F.col("t") / width)
    copied = weighed.withColumn("_own", own).withColumn("_cell", F.explode(F.array(own - 1, own, own + 1)))
    names = [*by, "a", "b", "bin", "n"]
    schema = T.StructType([*[T.StructField(c, kinds[c].dataType) for c in by], T.StructField("a", kinds[unit].dataType), T.StructField("b", kinds[unit].dataType), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        code, names_of = pd.factorize(cell["unit"], use_na_sentinel=False)
        order = np.lexsort((code, cell["t"].to_numpy()))
        u, code, w, own = cell["t"].to_numpy()[order], code[order], cell["w"].to_numpy()[order], (cell["_own"] == cell["_cell"]).to_numpy()[order]
        sums = _lag_counts(u, code, w, own, len(names_of), bin_size, half_bins, pd.isna(np.asarray(names_of, dtype=object)))
        made = pd.DataFrame({"a": names_of[sums["a"]], "b": names_of[sums["b"]], "bin": (sums["k"] - half_bins).astype(np.int32), "n": sums["n"]})
        for c in by:
            made[c] = cell[c].iat[0]
        return made[names]

    found = copied.groupBy(*by, "_cell").applyInPandas(count, schema)
    return found.groupBy(*by, "a", "b", "bin").agg(F.sum("n").alias("n"))


def _lag_counts(t: np.ndarray, code: np.ndarray, w: np.ndarray, own: np.ndarray, units: int, bin_size: float, half: int, nameless: np.ndarray) -> pd.DataFrame:
    """(a, b, k, n): weighted counts, above 0, of the pairs of an own point of a and a point of b by bin, k = bin + half; times are sorted.

    ``nameless`` units (null) are compared with none at the same time.
    """
    lag = lambda at, u: np.floor((u - at) / bin_size + 0.5)
    mine = np.flatnonzero(own)
    edges = np.arange(-half, half + 2)

    def places(u: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """How many of the sorted times u have a lag below k: nearly where its edge is, as rounding goes."""
        found = np.searchsorted(u, at + (k - 0.5) * bin_size)
        while (high := (found > 0) & ~(lag(at, u[np.maximum(found - 1, 0)]) < k)).any():
            found -= high
        while (low := (found < len(u)) & (lag(at, u[np.minimum(found, len(u) - 1)]) < k)).any():
            found += low
        return found

    size = 2 * half + 1
    parts = []

    def add(a, b, k, n) -> None:
        rows = pd.DataFrame({"key": (np.asarray(a, np.int64) * units + b) * size + k, "n": n})
        parts.append(rows.groupby("key", as_index=False)["n"].sum())

    first, last = places(t, t[mine], -half), places(t, t[mine], half + 1)
    many = last - first
    if many.sum() > len(mine) * units * len(edges):
        for b in range(units):
            at = code == b
            u, upto = t[at], np.concatenate([[0], np.cumsum(w[at])])
            below = [upto[places(u, t[mine], k)] for k in edges]
            for k, (lo, hi) in enumerate(zip(below, below[1:])):
                add(code[mine], b, k, (hi - lo) * w[mine])
    else:
        ends = np.cumsum(many)
        for begin in range(0, int(many.sum()), 1 << 20):
            pair = np.arange(begin, min(begin + (1 << 20), ends[-1]))
            i = np.searchsorted(ends, pair, side="right")
            x, y = mine[i], first[i] + pair - (ends[i] - many[i])
            add(code[x], code[y], lag(t[x], t[y]).astype(np.int64) + half, w[x] * w[y])
    # neither the same unit at the same time, nor a null one
    add(code[mine], code[mine], half, -w[mine] * w[mine])
    if nameless.any():
        new = np.concatenate([[True], t[1:] != t[:-1]])
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        stops = np.append(starts[1:], len(t))
        beside = [(x, y) for x in mine for y in range(starts[group[x]], stops[group[x]]) if code[x] != code[y] and (nameless[code[x]] or nameless[code[y]])]
        x, y = np.array(beside, np.int64).reshape(-1, 2).T
        add(code[x], code[y], half, -w[x] * w[y])
    sums = pd.concat(parts).groupby("key", as_index=False)["n"].sum().query("n > 0")
    key = sums["key"].to_numpy()
    return pd.DataFrame({"a": key // (size * units), "b": key // size % units, "k": key % size, "n": sums["n"].to_numpy()})


def correlogram_rate(counts: DataFrame, points: DataFrame, unit: str, bin_size: float) -> DataFrame:
    """Counts as the rate of ``b`` around a point of ``a``."""
    sizes = points.groupBy(F.col(unit).alias("a")).agg(F.count("*").alias("_n"))
    return counts.join(sizes, "a").withColumn("rate", F.col("n") / (F.col("_n") * bin_size)).drop("_n")


def durations(samples: DataFrame, by: Sequence[str], longest: float, t: str = "t", cell: float | None = None) -> DataFrame:
    """Samples with ``dt``, the time to the next one, at most ``longest``; the last one repeats."""

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(t)
        after = F.lead(t).over(w)
        step = rows.withColumn("_dt", F.when(after.isNotNull(), F.least(after - F.col(t), F.lit(longest))))
        return step.withColumn("dt", F.coalesce("_dt", F.lag("_dt").over(w), F.lit(0.0))).drop("_dt")

    return windowed(samples, by, t, cell, 1, made)


def occupancy(samples: DataFrame, axes: dict[str, tuple[float, float, int]], by: Sequence[str], longest: float, t: str = "t", cell: float | None = None) -> DataFrame:
    """Time and visits in each cell of a grid over the named axes."""
    timed = durations(samples, by, longest, t, cell)
    binned = timed.select(*[bin_index(F.col(c), lo, hi, n).alias(c) for c, (lo, hi, n) in axes.items()], "dt")
    sums = binned.groupBy(*axes).agg(F.sum("dt").alias("time"), F.count("*").alias("visits"))
    return dense(sums, ["time", "visits"], **{c: n for c, (_, _, n) in axes.items()})


def phase_map(rows: DataFrame, angle: str, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Mean direction ``phase``, resultant ``r`` and count of angles in each cell of a grid; one axis makes a curve."""
    binned = rows.select(*[bin_index(F.col(c), lo, hi, n).alias(c) for c, (lo, hi, n) in axes.items()], F.col(angle).alias("_a")).where(F.col("_a").isNotNull())
    sums = binned.groupBy(*axes).agg(F.count("*").alias("n"), circular_mean(F.col("_a")).alias("phase"), resultant(F.col("_a")).alias("r"))
    return dense(sums, ["n"], **{c: n for c, (_, _, n) in axes.items()})


def short_time_correlogram(points: DataFrame, unit: str, bin_size: float, half_bins: int, window: float, step: float, least: int = 1, t: str = "t") -> DataFrame:
    """Correlograms of successive windows [k step, k step + window): ``window``, ``a``, ``b``, ``bin``, ``n``.

    Windows with fewer than ``least`` points are left out.
    """
    last = F.floor(F.col(t) / step)
    spread = math.ceil(window / step)
    copied = points.withColumn("window", F.explode(F.sequence(last - spread + 1, last))).where(F.col(t) < F.col("window") * step + window)
    full = copied.groupBy("window").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("window")
    return counted_correlogram(copied.join(full, "window", "left_semi"), unit, bin_size, half_bins, ["window"], t)


def find_field(cells: DataFrame, value: str, axes: Sequence[str], share: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Cells of the field around the highest one: connected by edges, and at least ``share`` of the peak.

    ``cells`` is a dense grid of fixed size for each key; of equal peaks the
    first one counts. Keys, the axes, the value and ``size``, the field's cells.
    """
    kinds = dict(cells.dtypes)
    names = [*by, *axes, value]

    def field(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(axes)).reset_index(drop=True)
        at = {tuple(p): i for i, p in enumerate(group[list(axes)].to_numpy().tolist())}
        x = group[value].to_numpy(float)
        peak = int(np.nanargmax(x)) if np.isfinite(x).any() else -1
        seen, todo = set(), [peak] if peak >= 0 and x[peak] > 0 else []
        while todo:
            i = todo.pop()
            if i in seen or not x[i] >= share * x[peak]:
                continue
            seen.add(i)
            p = group.loc[i, list(axes)].tolist()
            for k in range(len(axes)):
                for d in (-1, 1):
                    q = tuple([*p[:k], p[k] + d, *p[k + 1 :]])
                    if q in at:
                        todo.append(at[q])
        return group.loc[sorted(seen), names].assign(size=len(seen))

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "size long"])
    return cells.select(*names).withColumn("_one", F.lit(0)).groupBy(*by, "_one").applyInPandas(field, schema)


def rate_map(samples: DataFrame, points: DataFrame, axes: dict[str, tuple[float, float, int]], by: Sequence[str], longest: float, width: float, least_time: float = 0.0, t: str = "t", cell: float | None = None) -> DataFrame:
    """Points per unit of time in each cell that the samples pass through.

    A point counts for the sample whose step holds it; cells visited for at
    most ``least_time`` have rate 0.
    """
    timed = durations(samples, by, longest, t, cell)
    steps = timed.select(*by, *[bin_index(F.col(c), lo, hi, n).alias(c) for c, (lo, hi, n) in axes.items()], F.col(t).alias("start"), (F.col(t) + F.col("dt")).alias("stop"))
    held = range_join(points.select(*by, t), steps, width, by, t).where(F.col(t) < F.col("stop"))
    counts = held.groupBy(*axes).agg(F.count("*").alias("count"))
    sizes = {c: n for c, (_, _, n) in axes.items()}
    full = dense(occupancy(samples, axes, by, longest, t, cell).join(counts, list(axes), "left"), ["time", "visits", "count"], **sizes)
    return full.withColumn("rate", F.when(F.col("time") > least_time, F.col("count") / F.col("time")).otherwise(0.0))


def smooth_grid(cells: DataFrame, value: str, axes: dict[str, int], sigma: float, radius: float = 3.0) -> DataFrame:
    """Separable Gaussian over the axes of a dense grid, a table of fixed size.

    The kernel is cut at ``radius`` and divided by the weights inside the grid.
    """
    half = math.ceil(radius * sigma)
    for axis, n in axes.items():
        rest = [a for a in axes if a != axis]
        w = Window.partitionBy(*rest).orderBy(axis) if rest else Window.partitionBy(F.lit(0)).orderBy(axis)
        terms = [(math.exp(-0.5 * (k / sigma) ** 2), F.lag(value, -k).over(w) if k else F.col(value)) for k in range(-half, half + 1)]
        total = sum((F.coalesce(x * g, F.lit(0.0)) for g, x in terms), F.lit(0.0))
        mass = sum((F.when(x.isNotNull(), F.lit(g)).otherwise(0.0) for g, x in terms), F.lit(0.0))
        cells = cells.withColumn(value, total / mass)
    return cells


def spatial_information(cells: DataFrame) -> DataFrame:
    """Bits per point, sparsity and selectivity of a rate map (time, rate)."""
    whole = cells.agg(F.sum("time").alias("t"), F.sum(F.col("time") * F.col("rate")).alias("s"), F.sum(F.col("time") * F.col("rate") ** 2).alias("q"), F.max("rate").alias("peak")).first()
    if not whole.t or not whole.s:
        return cells.limit(0).select(F.lit(0.0).alias("information"), F.lit(0.0).alias("sparsity"), F.lit(0.0).alias("selectivity"))
    mean = whole.s / whole.t
    share, ratio = F.col("time") / whole.t, F.col("rate") / mean
    bits = F.sum(F.when(F.col("rate") > 0, share * ratio * F.log2(ratio)).otherwise(0.0))
    return cells.agg(bits.alias("information")).withColumn("sparsity", F.lit(whole.t and mean * mean * whole.t / whole.q)).withColumn("selectivity", F.lit(whole.peak / mean))


def active_share(points: DataFrame, unit: str, bin_size: float, units: int, t: str = "t") -> DataFrame:
    """Share of units with a point in each time bin that has any."""
    return points.groupBy(F.floor(F.col(t) / bin_size).alias("bin")).agg((F.countDistinct(unit) / units).alias("share"))


def count_matrix(points: DataFrame, unit: str, bin_size: float, t: str = "t") -> DataFrame:
    """(unit, bin, n): points of each unit by time bin."""
    return points.groupBy(F.col(unit).alias("unit"), F.floor(F.col(t) / bin_size).alias("bin")).agg(F.count("*").alias("n"))


def quantile_bins(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below a value."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def transition(histogram: DataFrame, by: Sequence[str] = (), method: str = "ml", bin: str = "bin", count: str = "n") -> DataFrame:
    """(keys, bin, score): the bin after which a histogram's rate changes.

    ``ml`` takes the two rates of greatest likelihood, ``ls`` the two slopes
    nearest to the cumulated counts by least squares; ``score`` is the part of
    the log-likelihood that depends on the bin, or the sum of squares. All
    bins but the last are tried for ``ml`` (with an empty side none), those
    from the second on for ``ls``; of equal ones (to nine digits) the first is
    taken. Bins count from 1 without a gap. Sums over each side come from
    running sums, so a histogram costs its bins and not their square.
    """
    at, f = F.col(bin), F.col(count).cast("double")
    every, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(bin)
    size, total = F.count("*").over(every), F.sum(f).over(every)
    if method == "ml":
        rows = histogram.select(*by, bin, F.sum(f).over(upto).alias("one"), total.alias("total"), size.alias("size"))
        one, two = F.col("one"), F.col("total") - F.col("one")
        score = one * F.log(one / (at + 1)) + two * F.log(two / (F.col("size") - at))
        tried = rows.where((at < F.col("size")) & (one > 0) & (two > 0)).withColumn("score", score)
        order = -F.round("score", 9)
    elif method == "ls":
        before = F.coalesce(F.sum(f).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = histogram.select(*by, bin, size.alias("size"), before.alias("F"))
        for name, x in (("f", F.col("F")), ("tf", at * F.col("F")), ("ff", F.col("F") ** 2)):
            rows = rows.withColumn(f"{name}1", F.sum(x).over(upto)).withColumn(f"{name}2", F.sum(x).over(every) - F.col(f"{name}1"))
        n = F.col("size") - at  # bins of the second side, from 1 on
        u1, u2, t2 = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6, at * (at + 1) * (2 * at + 1) / 6
        q = F.col("tf2") - at * F.col("f2")
        first = (-F.col("tf1") - at * F.col("f2") + at * u1 * q / u2) / (at * at * u1 * u1 / u2 - t2 - at * at * n)
        sided = rows.where((at >= 2) & (at < F.col("size"))).withColumn("a", first).withColumn("b", (q - F.col("a") * at * u1) / u2)
        a, b = F.col("a"), F.col("b")
        one = F.col("ff1") - 2 * a * F.col("tf1") + a * a * t2
        two = F.col("ff2") + n * a * a * at * at + b * b * u2 - 2 * a * at * F.col("f2") - 2 * b * q + 2 * a * at * b * u1
        tried = sided.withColumn("score", one + two)
        order = F.round("score", 9)
    else:
        raise ValueError(f"unknown method: {method}")
    chosen = tried.groupBy(*by).agg(F.min(F.struct(order.alias("order"), at.alias("bin"), F.col("score"))).alias("x"))
    return chosen.select(*by, F.col("x.bin").alias(bin), F.col("x.score").alias("score"))


def deconvolved(signal: DataFrame, events: DataFrame, before: float, after: float, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, center, response): the signal's mean response to one event.

    The histogram of the signal about the events, less its mean, is what the
    events' own correlogram makes of the response; the system that says so (a
    Toeplitz matrix of the correlogram, twice as wide) is solved for each key,
    and the mean per event is added again. Where it has no single solution the
    one of least squares is given. Only ``2 n - 1`` counts a key leave the
    joins; keys without an event give no rows, and a signal without points a
    response of zeros.
    """
    width = 2 * n - 1

    def counts(samples: DataFrame, kind: int) -> DataFrame:
        about = sync(samples, events.select(*by, "t"), 2 * before, 2 * after, by)
        binned = about.withColumn("bin", bin_index(F.col("t"), -2 * before, 2 * after, width))
        return binned.groupBy(*by, "bin").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))

    shown = events.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(0).alias("bin"), "n", F.lit(2).alias("kind"))
    both = counts(signal.select(*by, "t"), 0).unionByName(counts(events.select(*by, "t"), 1)).unionByName(shown)
    packed = both.groupBy(*by).agg(F.collect_list(F.struct("kind", "bin", "n")).alias("counts"))  # 2 width + 1 entries at most
    begin = (n + 1) // 2 - 1

    def solve(batches):
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                sums, total = np.zeros((2, width)), 0
                for x in row.counts:
                    if x["kind"] == 2:
                        total = x["n"]
                    else:
                        sums[x["kind"], x["bin"] - 1] = x["n"]
                if not total:
                    continue
                raw, own = sums
                matrix = own[n - 1 + np.arange(n)[:, None] - np.arange(n)[None, :]]
                mean = raw.mean()
                wanted = (raw - mean)[begin : begin + n]
                try:
                    response = np.linalg.solve(matrix, wanted)
                    if not np.isfinite(response).all() or np.linalg.cond(matrix) > 1e12:
                        raise np.linalg.LinAlgError
                except np.linalg.LinAlgError:
                    response = np.linalg.lstsq(matrix, wanted, rcond=None)[0]
                part = pd.DataFrame({"bin": np.arange(1, n + 1, dtype=np.int32), "response": response + mean / total})
                for c in by:
                    part[c] = getattr(row, c)
                parts.append(part[[*by, "bin", "response"]])
            yield pd.concat(parts) if parts else pd.DataFrame({c: [] for c in [*by, "bin", "response"]})

    schema = T.StructType([*[events.schema[c] for c in by], T.StructField("bin", T.IntegerType()), T.StructField("response", T.DoubleType())])
    made = packed.mapInPandas(solve, schema)
    return made.select(*by, "bin", bin_center(F.col("bin"), -before, after, n).alias("center"), "response")
