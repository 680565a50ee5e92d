"""Sharp waves with ripples, from a whole session of two joined channels.

The wave is the low-frequency difference of the two channels, the ripple the
smoothed size of the first one's high-frequency part. Each block of time gives
the greatest wave and the ripple near it; the smaller of two clusters of these
are events, thresholds are learned from the clusters, and each event is tested
and delimited against the seconds around it. Only one row a block, and two
centres a series, leave the segments of the signal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .signals import over_segments


def gaussian_taps(cutoff: float, rate: float, reach: float = 6.0) -> np.ndarray:
    """A Gaussian low pass: its deviation is that of a filter of this cutoff, its sum one."""
    deviation = rate / (2 * np.pi * cutoff)
    half = max(1, int(np.ceil(reach * deviation)))
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / deviation) ** 2)
    return taps / taps.sum()


def _filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    half = len(taps) // 2
    return np.convolve(np.pad(x, half, "reflect" if len(x) > half else "edge"), taps, "valid")


def _between(x: np.ndarray, band: tuple[float, float], rate: float) -> np.ndarray:
    low = _filtered(x, gaussian_taps(band[1], rate))
    return low - _filtered(low, gaussian_taps(band[0], rate))


def _ripple(x: np.ndarray, band: tuple[float, float], rate: float) -> np.ndarray:
    return _filtered(np.abs(_between(x, band, rate)), gaussian_taps(np.mean(band) / np.pi, rate))


def reach_of(wave_band: tuple[float, float], ripple_band: tuple[float, float], rate: float) -> int:
    """How many samples to either side the features look at."""
    half = lambda f: len(gaussian_taps(f, rate)) // 2
    return max(half(wave_band[0]) + half(wave_band[1]), half(ripple_band[0]) + half(ripple_band[1]) + half(np.mean(ripple_band) / np.pi))


def features(samples: DataFrame, ripple: str, sharp: str, rate: float, by: Sequence[str] = (), noise: str | None = None, wave_band=(2.0, 50.0), ripple_band=(80.0, 250.0), half: int = 25, segment: int = 65_536, t: str = "t") -> DataFrame:
    """Add the sharp wave (``wave``), the ripple's power (``power``), its greatest within ``half``
    samples (``crest``) and the waves one sample before and after (``left``, ``right``)."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        wave = _between(x[:, 0] - x[:, 1], wave_band, rate)
        power = _ripple(x[:, 0], ripple_band, rate)
        if noise:
            power = power - _ripple(x[:, 2], ripple_band, rate)
        crest = np.lib.stride_tricks.sliding_window_view(np.pad(power, half, constant_values=-np.inf), 2 * half + 1).max(1)
        return {"wave": wave, "power": power, "crest": crest, "left": np.r_[wave[:1], wave[:-1]], "right": np.r_[wave[1:], wave[-1:]]}

    halo = reach_of(wave_band, ripple_band, rate) + half + 1
    columns = [ripple, sharp, *([noise] if noise else [])]
    added = "wave double, power double, crest double, left double, right double"
    return over_segments(samples.select(*by, t, *columns), f, columns, by, added, rate, segment, halo, t)


def block_peaks(rows: DataFrame, by: Sequence[str], rate: float, block: int, t: str = "t") -> DataFrame:
    """(keys, at, wave, crest): the greatest wave of each block of ``block`` samples, the first of equal ones.

    One on a block's edge counts only if it is no smaller than the sample
    before and greater than the one after (as the first of three equal ones
    is taken), and not as the first or last sample of a series.
    """
    at = F.round(F.col(t) * rate).cast("bigint")
    placed = rows.withColumn("at", at).withColumn("_block", F.floor(F.col("at") / block))
    best = placed.groupBy(*by, "_block").agg(F.max(F.struct("wave", (-F.col("at")).alias("place"), "crest", "left", "right")).alias("x"))
    rank = F.col("_at") - F.col("_block") * block
    peaks = best.select(*by, "_block", (-F.col("x.place")).alias("_at"), "x.wave", "x.crest", "x.left", "x.right")
    ends = rows.withColumn("at", at).groupBy(*by).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    joined = peaks.join(ends, list(by)) if by else peaks.crossJoin(F.broadcast(ends))  # one row
    edge = (rank == 0) | (rank == block - 1)
    whole = (F.col("wave") > F.col("left")) & (F.col("wave") >= F.col("right")) & (F.col("_at") > F.col("_first")) & (F.col("_at") < F.col("_last"))
    return joined.where(~edge | whole).select(*by, F.col("_at").alias("at"), "wave", "crest")


def _keyed(rows: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(other, list(by)) if by else rows.crossJoin(F.broadcast(other))  # one row


def two_means(rows: DataFrame, by: Sequence[str], x: str, y: str, rounds: int = 100) -> DataFrame:
    """Add ``event``, whether a row is in the smaller of two clusters of its series.

    Lloyd's rounds from the least and the greatest of each column until no
    centre moves; equal distances go to the low centre, and of clusters of one
    size the high one is the event. Two centres a series reach the driver.
    """
    spark = rows.sparkSession
    ends = rows.groupBy(*by).agg(*[f(c).alias(f"_{c}{i}") for i, f in enumerate((F.min, F.max)) for c in (x, y)])
    names = [f"_{c}{i}" for i in (0, 1) for c in (x, y)]
    centres = [tuple(r) for r in ends.collect()]
    schema = ends.schema
    if not centres or centres[0][-1] is None:
        return rows.withColumn("event", F.lit(False))
    far = lambda i: (F.col(x) - F.col(f"_{x}{i}")) ** 2 + (F.col(y) - F.col(f"_{y}{i}")) ** 2
    high = far(1) < far(0)
    for _ in range(rounds):
        sided = _keyed(rows, spark.createDataFrame(centres, schema), by).withColumn("_high", high)
        mean = lambda c, i: F.coalesce(F.avg(F.when(F.col("_high") == F.lit(bool(i)), F.col(c))), F.first(f"_{c}{i}")).alias(f"_{c}{i}")
        moved = sided.groupBy(*by).agg(*[mean(c, i) for i in (0, 1) for c in (x, y)], F.count_if(F.col("_high")).alias("_n1"), F.count("*").alias("_n")).collect()
        before, centres = centres, [tuple(r[c] for c in (*by, *names)) for r in moved]
        old = {r[: len(by)]: r[len(by) :] for r in before}
        # sums of one cluster come in any order, so equal means may differ in their last bits
        if all(np.allclose(old[c[: len(by)]], c[len(by) :], rtol=1e-12, atol=0) for c in centres):
            break
    fewer = [(*[r[c] for c in by], r["_n1"] * 2 <= r["_n"]) for r in moved]
    small = spark.createDataFrame(fewer, T.StructType([*[f for f in schema.fields if f.name in by], T.StructField("_small", T.BooleanType())]))
    told = _keyed(_keyed(rows, spark.createDataFrame(centres, schema), by), small, by)
    return told.withColumn("event", high == F.col("_small")).drop(*names, "_small")


def order_statistic(rows: DataFrame, by: Sequence[str], value: str, share: float, name: str, bins: int = 1024) -> DataFrame:
    """(keys, name): the smallest value with at least ``share`` of a series' values at or below it.

    Values are counted in bins between the least and the greatest first; only
    those of the one bin that holds it are ranked.
    """
    v = F.col(value)
    ends = rows.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"))
    place = F.least(F.floor((v - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) * bins), F.lit(bins - 1))
    binned = _keyed(rows.where(v.isNotNull()), ends, by).withColumn("_bin", place)
    need = F.greatest(F.ceil(F.col("_n") * share), F.lit(1))
    counts = binned.groupBy(*by, "_bin", "_n").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin"))
    held = counts.withColumn("_upto", upto).where((F.col("_upto") >= need) & (F.col("_upto") - F.col("_c") < need)).select(*by, "_bin", (need - F.col("_upto") + F.col("_c")).alias("_rank"))
    inside = binned.join(held, [*by, "_bin"])
    return inside.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value))).where("_r = _rank").select(*by, v.alias(name))


def detect(
    samples: DataFrame,
    ripple: str,
    sharp: str,
    rate: float,
    by: Sequence[str] = (),
    noise: str | None = None,
    wave_band: tuple[float, float] = (2.0, 50.0),
    ripple_band: tuple[float, float] = (80.0, 250.0),
    block: float = 0.04,
    around: float = 5.0,
    wave_limits: tuple[float, float] = (0.5, 2.5),
    ripple_limits: tuple[float, float] = (0.5, 2.5),
    wave_share: float = 0.1,
    ripple_share: float = 0.5,
    apart: float = 0.05,
    shortest: tuple[float, float] = (0.02, 0.025),
    longest: float = 0.5,
    use_wave: bool = True,
    segment: int = 65_536,
    t: str = "t",
) -> DataFrame:
    """(keys, start, peak, stop, wave_z, wave_rank, ripple_z, ripple_rank) of each event.

    ``samples`` has one row a sample with both channels. A block's peak is a
    candidate in the smaller cluster if its wave exceeds the ``wave_share``
    quantile of that cluster and its ripple the ``ripple_share`` quantile of
    the other. Within ``around`` seconds to either side, which must all be
    there, its wave and ripple must reach the median plus the upper limit in
    deviations; it ends where the wave, or without ``use_wave`` wave and
    ripple, fall below the lower limit. One nearer than ``apart`` to the
    candidate before goes, as do those too short in both or too long.

    Null channels are missing samples; segments do not change results. An
    empty table gives no rows.
    """
    size, bound = int(rate * block + 1e-9), int(around * rate + 1e-9)
    half = size // 2
    clean = samples.where(F.col(ripple).isNotNull() & F.col(sharp).isNotNull() & (F.col(noise).isNotNull() if noise else F.lit(True)))
    rows = features(clean, ripple, sharp, rate, by, noise, wave_band, ripple_band, half, segment, t).persist()
    peaks = block_peaks(rows, by, rate, size, t).persist()
    told = two_means(peaks, by, "wave", "crest")
    limits = order_statistic(told.where("event"), by, "wave", wave_share, "_wave")
    other = order_statistic(told.where("not event"), by, "crest", ripple_share, "_crest")
    limited = _keyed(_keyed(told.where("event"), limits, by), other, by)
    candidates = limited.where((F.col("wave") > F.col("_wave")) & (F.col("crest") > F.col("_crest"))).select(*by, F.col("at").alias("_at"), F.col("crest").alias("_top"))
    at = F.round(F.col(t) * rate).cast("bigint")
    keys = [*by, "_at"]
    marked = rows.select(*by, at.alias("_at"), "wave", "power").join(candidates, keys, "left")
    gap = int(np.ceil(apart * rate - 1e-9))
    halo = bound + max(half, gap) + 1
    own = F.floor(F.col("_at") / segment)
    copied = marked.withColumn("_own", own).withColumn("_segment", F.explode(F.sequence(F.floor((F.col("_at") - halo) / segment), F.floor((F.col("_at") + halo) / segment))))
    names = ["start", "peak", "stop", "wave_z", "wave_rank", "ripple_z", "ripple_rank"]
    schema = T.StructType([*[clean.schema[c] for c in by], *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_at", kind="stable")
        place, top = group["_at"].to_numpy(), group["_top"].to_numpy(float)
        wave, power = group["wave"].to_numpy(), group["power"].to_numpy()
        asked = np.flatnonzero(~np.isnan(top))
        # candidates whose surroundings are all there; only those count as one before
        asked = np.array([i for i in asked if i >= bound and i + bound < len(place) and place[i + bound] - place[i - bound] == 2 * bound], int)
        mine = (group["_own"] == group["_segment"]).to_numpy()
        found = []
        for j, i in enumerate(asked):
            if mine[i] and not (j and place[i] - place[asked[j - 1]] < gap):
                stretch = slice(i - bound, i + bound + 1)
                one = _delimited(wave[stretch], power[stretch], top[i], half, rate, wave_limits, ripple_limits, shortest, longest, use_wave)
                if one:
                    found.append(((place[i] + one[0]) / rate, place[i] / rate, (place[i] + one[1]) / rate, *one[2:]))
        out = pd.DataFrame(found, columns=names, dtype=float)
        for c in by:
            out[c] = group[c].iloc[0]
        return out[schema.names]

    return copied.groupBy(*by, "_segment").applyInPandas(run, schema)


def _delimited(wave, power, top, half, rate, wave_limits, ripple_limits, shortest, longest, use_wave):
    """(start, stop, z, rank, z, rank) of the event in the middle of a stretch, from it; None if it fails a test."""
    bound = len(wave) // 2
    (wm, ws), (pm, ps) = ((np.median(x), x.std(ddof=1)) for x in (wave, power))
    if (use_wave and wave[bound] < wm + wave_limits[1] * ws) or top < pm + ripple_limits[1] * ps:
        return None
    low = np.flatnonzero(wave < wm + wave_limits[0] * ws)
    before, after = low[low <= bound], low[low >= bound]
    quiet = np.flatnonzero(power < pm + ripple_limits[0] * ps)
    peak = bound - half + int(power[bound - half : bound + half + 1].argmax())
    earlier, later = quiet[quiet <= peak], quiet[quiet >= peak]
    # where a level is not reached within the stretch, the stretch's end stands for it
    start, stop = (before[-1] if len(before) else 0), (after[0] if len(after) else 2 * bound)
    begin, end = (earlier[-1] if len(earlier) else 0), (later[0] if len(later) else 2 * bound)
    if end - begin < int(shortest[1] * rate) and stop - start + 1 < int(shortest[0] * rate):
        return None
    if use_wave and stop - start + 1 > int(longest * rate):
        return None
    first, last = (start, stop) if use_wave else (min(start, begin), max(stop, end))
    n = len(wave)
    return first - bound, last - bound, (wave[bound] - wm) / ws, (wave < wave[bound]).sum() / n, (top - pm) / ps, (power < top).sum() / n
