"""Cycles, events and waveforms of signals: cycle counts, delta waves, spindles, artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import consolidate, count_in_intervals, threshold
from .joins import interpolate, range_join
from .ordered import zero_crossings
from .regression import _joined
from .series import ranked, windowed


def cycles(samples: DataFrame, value: str, by: Sequence[str], t: str = "t", cell: float | None = None) -> DataFrame:
    """Intervals between upward zero crossings: keys, ``iid`` (from 1), start, stop."""
    up = zero_crossings(samples, value, by, t=t, cell=cell).where("up").select(*by, F.col("crossing").alias("start"))
    numbered = ranked(up, by, "start", cell, "iid").withColumn("iid", F.col("iid") + 1)

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("stop", F.lead("start").over(Window.partitionBy(*keys).orderBy("start")))

    return windowed(numbered, by, "start", cell, 1, made).where("stop is not null").select(*by, "iid", "start", "stop")


def points_per_cycle(points: DataFrame, samples: DataFrame, value: str, by: Sequence[str], width: float, t: str = "t", cell: float | None = None) -> DataFrame:
    """Cycles with ``n``, how many points each holds."""
    return count_in_intervals(points, cycles(samples, value, by, t, cell), width, by, t)


def delta_waves(samples: DataFrame, value: str, by: Sequence[str], shortest: float, longest: float, peak: float, trough: float, t: str = "t", cell: float | None = None) -> DataFrame:
    """Waves of a filtered signal: start, peak, stop from three crossings of its slope.

    A wave rises to a maximum of at least ``peak`` and falls to at most
    ``trough``; its duration is between the given bounds.
    """
    from .ordered import extrema

    def around(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(t)
        return rows.withColumns({"start": F.lag(t).over(w), "stop": F.lead(t).over(w), "_after": F.lead("_v").over(w)})

    turning = extrema(samples, value, by, t, cell).select(*by, t, "kind", F.col(value).alias("_v"))
    named = windowed(turning, by, t, cell, 1, around)
    wave = named.where((F.col("kind") == "max") & F.col("start").isNotNull() & F.col("stop").isNotNull())
    kept = wave.where((F.col("stop") - F.col("start")).between(shortest, longest) & (F.col("_v") >= peak) & (F.col("_after") <= trough))
    return kept.select(*by, "start", F.col(t).alias("peak"), "stop", F.col("_v").alias("height"))


def spindles(envelope: DataFrame, value: str, by: Sequence[str], low: float = 2.5, high: float = 5.0, merge: float = 0.5, shortest: float = 0.4, longest: float = 3.5, t: str = "t", cell: float | None = None) -> DataFrame:
    """Bouts of an envelope above ``low`` deviations that reach ``high``, near ones merged; the first of equal peaks counts."""
    m = envelope.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = _joined(envelope, m, by).select(*by, t, ((F.col(value) - F.col("_m")) / F.col("_s")).alias("z"))
    bouts = threshold(z, "z", low, by, bridge=merge, t=t, cell=cell)
    peaks = range_join(z, bouts, longest, by, t).groupBy(*by, "start", "stop").agg(F.max_by(t, F.struct(F.col("z"), -F.col(t))).alias("peak"), F.max("z").alias("height"))
    return peaks.where((F.col("height") >= high) & (F.col("stop") - F.col("start")).between(shortest, longest)).select(*by, "start", "peak", "stop", "height")


def without_artefacts(samples: DataFrame, artefacts: DataFrame, value: str, by: Sequence[str], before: float, after: float, t: str = "t") -> DataFrame:
    """Samples with those around artefacts replaced by linear interpolation."""
    periods = consolidate(artefacts.select(*by, (F.col(t) - before).alias("start"), (F.col(t) + after).alias("stop")), by)
    bad = range_join(samples, periods, before + after, by, t, how="left_semi")
    good = range_join(samples, periods, before + after, by, t, how="left_anti")
    filled = interpolate(good.select(*by, t, value), bad.drop(value), value, by, t=t)
    return good.unionByName(filled.select(*samples.columns))


def quiet_periods(velocity: DataFrame, by: Sequence[str], slowest: float, shortest: float, brief: float, value: str = "velocity", t: str = "t") -> DataFrame:
    """Periods of velocity below ``slowest``, brief movements ignored."""
    return threshold(velocity, value, slowest, by, above=False, shortest=shortest, bridge=brief, t=t)


def waveform_shape(waveform: Column) -> Column:
    """struct(trough, peak_after, width): indices from 0 of the trough and the next
    peak, and samples below half of the trough, of an array."""
    n = F.size(waveform)
    trough = (F.array_position(waveform, F.array_min(waveform)) - 1).cast("int")
    tail = F.slice(waveform, trough + 1, n)
    peak = (F.array_position(tail, F.array_max(tail)) - 1).cast("int") + trough
    width = F.size(F.filter(waveform, lambda v: v < F.array_min(waveform) / 2))
    return F.struct(trough.alias("trough"), peak.alias("peak_after"), width.alias("width"))


def cross_correlation(pairs: DataFrame, by: Sequence[str], x: str, y: str, lags: int, i: str = "i") -> DataFrame:
    """(by, lag, r): normalised correlation of two rows of equal length at each lag."""
    norm = pairs.groupBy(*by).agg(F.sqrt(F.sum(F.col(x) ** 2) * F.sum(F.col(y) ** 2)).alias("_n"))
    a = pairs.select(*by, F.col(i).alias("_i"), F.col(x).alias("_x")).withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags))))
    b = pairs.select(*by, F.col(i).alias("_j"), F.col(y).alias("_y"))
    joined = a.withColumn("_j", F.col("_i") + F.col("lag")).join(b, [*by, "_j"])
    return joined.groupBy(*by, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_s")).join(norm, list(by)).select(*by, "lag", (F.col("_s") / F.col("_n")).alias("r"))


def replay_score(posterior: DataFrame, by: Sequence[str], slopes: Sequence[float], offsets: Sequence[float], reach: int) -> DataFrame:
    """(by, slope, offset, score): the line through a posterior (window, x, p) with the most mass
    within ``reach`` cells, averaged over windows. The lines are a fixed list."""
    spark = posterior.sparkSession
    lines = spark.createDataFrame([(float(s), float(o)) for s in slopes for o in offsets], "slope double, offset double")
    lines = lines.withColumn("_all", F.lit(1))
    copied = posterior.withColumn("_all", F.lit(1)).join(F.broadcast(lines), "_all")
    near = F.abs(F.col("x") - F.round(F.col("offset") + F.col("slope") * F.col("window"))) <= reach
    sums = copied.where(near).groupBy(*by, "slope", "offset").agg(F.sum("p").alias("_p"))
    windows = posterior.groupBy(*by).agg(F.countDistinct("window").alias("_w"))
    scored = sums.join(windows, list(by)).withColumn("score", F.col("_p") / F.col("_w"))
    best = F.max(F.struct("score", "slope", "offset"))
    return scored.groupBy(*by).agg(best.alias("b")).select(*by, "b.slope", "b.offset", "b.score")


def visit_sequences(points: DataFrame, intervals: DataFrame, width: float, by: Sequence[str], unit: str, t: str = "t") -> DataFrame:
    """(by, iid, sequence): units in order of their first point in each interval."""
    held = range_join(points, intervals, width, by, t)
    first = held.groupBy(*by, "iid", unit).agg(F.min(t).alias("_t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_t"), F.col(unit)))), lambda s: s[unit])
    return first.groupBy(*by, "iid").agg(ordered.alias("sequence"))
