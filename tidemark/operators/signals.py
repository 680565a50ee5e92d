"""Vectorised signal transforms, over segments with a halo.

A series is cut into segments of equal numbers of samples; each one is sent to
a task with as many samples of its neighbours as the transform looks at, so
that a series of any length is dealt over tasks. Results do not depend on
where the cuts are if the transform looks no farther than the halo, as filters
do; the Fourier phase looks at all samples, so near a cut it is approximate.
Samples on both sides of a gap are not neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no_rows(names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in names})


def over_segments(samples: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]], value: str | list[str], by: Sequence[str], added: str, rate: float, segment: int = 65_536, halo: int = 4_096, t: str = "t") -> DataFrame:
    """Apply ``f`` to the values of each segment with its halo, in time order.

    ``f`` gives arrays as long as its input, the columns of ``added`` (a schema
    string); those of the halo are dropped. Several values come as the columns
    of a matrix. Beyond the ends of a series, and of
    each stretch without a missing sample, the values are mirrored.
    """
    at = F.round(F.col(t) * rate).cast("bigint")
    own = F.floor(at / segment)
    numbered = samples.withColumn("_at", at).withColumn("_own", own)
    copied = numbered.withColumn("_segment", F.explode(F.sequence(F.floor((at - halo) / segment), F.floor((at + halo) / segment))))
    schema = T.StructType([*samples.schema.fields, *T.StructType.fromDDL(added).fields])
    names = samples.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_at", kind="stable")
        mine = (group["_own"] == group["_segment"]).to_numpy()
        if not mine.any():
            return _no_rows(schema.names)
        x, place = group[value].to_numpy(float), group["_at"].to_numpy()
        begin = group["_segment"].iloc[0] * segment
        stretches = [s for s in np.split(np.arange(len(x)), np.flatnonzero(np.diff(place) > 1) + 1) if mine[s].any()]
        parts = []
        for s in stretches:
            left = min(halo if place[s[0]] > begin - halo else 0, len(s) - 1)
            right = min(halo if place[s[-1]] < begin + segment - 1 + halo else 0, len(s) - 1)
            made = f(np.pad(x[s], ((left, right), (0, 0))[: x.ndim], "reflect") if len(s) > 1 else x[s])
            parts.append({k: v[left : left + len(s)][mine[s]] for k, v in made.items()})
        own = group.iloc[np.concatenate([s[mine[s]] for s in stretches])][names]
        return own.assign(**{k: np.concatenate([p[k] for p in parts]) for k in parts[0]})[schema.names]

    return copied.groupBy(*by, "_segment").applyInPandas(run, schema)


def low_pass(cutoff: float, rate: float, half: int) -> np.ndarray:
    """A windowed sinc with unit gain at zero; ``2 half + 1`` taps."""
    k = np.arange(-half, half + 1)
    taps = np.sinc(2 * cutoff / rate * k) * np.hamming(2 * half + 1)
    return taps / taps.sum()


def band_pass_taps(low: float, high: float, rate: float, half: int) -> np.ndarray:
    return low_pass(high, rate, half) - low_pass(low, rate, half)


def band_pass(samples: DataFrame, value: str, by: Sequence[str], low: float, high: float, rate: float, half: int = 256, **options) -> DataFrame:
    """Add ``filtered``: a symmetric FIR band pass, which shifts no phase."""
    taps = band_pass_taps(low, high, rate, half)
    return over_segments(samples, lambda x: {"filtered": np.convolve(np.pad(x, half, "reflect") if len(x) > half else np.pad(x, half, "edge"), taps, "valid")}, value, by, "filtered double", rate, halo=half, **options)


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by the discrete Fourier transform."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def phase(samples: DataFrame, value: str, by: Sequence[str], rate: float, **options) -> DataFrame:
    """Add ``phase`` in [0, 2 pi) and ``amplitude`` of a narrow-band signal."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        z = analytic(x)
        return {"phase": np.mod(np.angle(z), 2 * np.pi), "amplitude": np.abs(z)}

    return over_segments(samples, f, value, by, "phase double, amplitude double", rate, **options)


def tapers(n: int, half_bandwidth: float, k: int) -> np.ndarray:
    """The ``k`` most concentrated sequences of length ``n`` (discrete prolate spheroidal)."""
    w = half_bandwidth / n
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return vectors[:, ::-1][:, :k].T


def _windows(samples: DataFrame, values: Sequence[str], by: Sequence[str], rate: float, window: int, step: int, t: str, added: str, f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Keys, ``t`` (window centre) and what ``f`` makes of a window's values (samples by columns).

    Windows of ``window`` samples begin every ``step`` samples; incomplete ones
    are left out. ``added`` is the schema of the arrays that ``f`` returns.
    """
    at = F.round(F.col(t) * rate).cast("bigint")
    last = F.floor(at / step)
    copies = F.explode(F.sequence(F.greatest(last - (window - 1) // step, F.lit(0)), last))
    numbered = samples.select(*by, *values, at.alias("_at"), copies.alias("_w")).where(F.col("_at") < F.col("_w") * step + window)
    schema = T.StructType([*(x for x in samples.schema.fields if x.name in by), T.StructField("t", T.DoubleType()), *T.StructType.fromDDL(added).fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < window:
            return _no_rows(schema.names)
        made = f(group.sort_values("_at")[list(values)].to_numpy(float))
        out = pd.DataFrame({"t": (group["_w"].iloc[0] * step + window / 2) / rate, **made})
        return out.assign(**{c: pd.Series([group[c].iloc[0]] * len(out), dtype=object) for c in by})[schema.names]

    return numbered.groupBy(*by, "_w").applyInPandas(run, schema)


def spectrogram(samples: DataFrame, value: str, by: Sequence[str], rate: float, window: int, step: int, half_bandwidth: float = 3.0, n_tapers: int = 5, t: str = "t") -> DataFrame:
    """Multitaper power of successive windows: keys, ``t`` (window centre), ``f``, ``power``."""
    v = tapers(window, half_bandwidth, n_tapers)
    frequencies = np.fft.rfftfreq(window, 1 / rate)

    def power(x: np.ndarray) -> dict[str, np.ndarray]:
        return {"f": frequencies, "power": (np.abs(np.fft.rfft(v * (x[:, 0] - x.mean()), axis=1)) ** 2).mean(0) / rate}

    return _windows(samples, [value], by, rate, window, step, t, "f double, power double", power)


def spectrum(spectra: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean power over the windows of a spectrogram at each frequency, with its standard error: keys, f, power, error, n."""
    n = F.count("power")
    return spectra.groupBy(*by, "f").agg(F.avg("power").alias("power"), (F.stddev_samp("power") / F.sqrt(n)).alias("error"), n.alias("n"))


def coherogram(samples: DataFrame, a: str, b: str, by: Sequence[str], rate: float, window: int, step: int, half_bandwidth: float = 3.0, n_tapers: int = 5, t: str = "t") -> DataFrame:
    """Multitaper coherence of two signals: keys, ``t``, ``f``, ``coherence``, ``phase`` of b against a, power of both, and the cross spectrum's parts."""
    v = tapers(window, half_bandwidth, n_tapers)
    frequencies = np.fft.rfftfreq(window, 1 / rate)

    def cross(x: np.ndarray) -> dict[str, np.ndarray]:
        ja, jb = (np.fft.rfft(v * (c - c.mean()), axis=1) for c in x.T)
        s, pa, pb = (np.conj(ja) * jb).mean(0) / rate, (np.abs(ja) ** 2).mean(0) / rate, (np.abs(jb) ** 2).mean(0) / rate
        both = np.sqrt(pa * pb)
        coherence = np.divide(np.abs(s), both, out=np.zeros(len(s)), where=both > 0)
        return {"f": frequencies, "coherence": coherence, "phase": np.angle(s), "power_a": pa, "power_b": pb, "real": s.real, "imaginary": s.imag}

    return _windows(samples, [a, b], by, rate, window, step, t, "f double, coherence double, phase double, power_a double, power_b double, real double, imaginary double", cross)


def coherence(spectra: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coherence and phase at each frequency from the spectra of all windows of a coherogram together."""
    re, im = F.avg("real"), F.avg("imaginary")
    both = F.sqrt(F.avg("power_a") * F.avg("power_b"))
    return spectra.groupBy(*by, "f").agg(F.when(both > 0, F.hypot(re, im) / both).otherwise(0.0).alias("coherence"), F.atan2(im, re).alias("phase"), F.count("*").alias("n"))


def point_spectrogram(points: DataFrame, by: Sequence[str], rate: float, window: int, step: int, half_bandwidth: float = 3.0, n_tapers: int = 5, t: str = "t") -> DataFrame:
    """Multitaper power of a point process: keys, ``t`` (window centre), ``f``, ``power``, ``n``.

    Windows and tapers count steps of ``1 / rate``; tapers are interpolated at
    the points, and what the mean rate alone gives is taken out. Windows
    without a point are left out.
    """
    v = tapers(window, half_bandwidth, n_tapers) * np.sqrt(rate)
    frequencies = np.fft.rfftfreq(window, 1 / rate)
    flat = np.fft.rfft(v, axis=1) / rate
    length, hop = window / rate, step / rate
    last = F.floor(F.col(t) / hop)
    copies = F.explode(F.sequence(F.greatest(last - (window - 1) // step, F.lit(0)), last))
    copied = points.select(*by, F.col(t).alias("_t"), copies.alias("_w")).where(F.col("_t") < F.col("_w") * hop + length)
    schema = T.StructType([*(x for x in points.schema.fields if x.name in by), *T.StructType.fromDDL("t double, f double, power double, n long").fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        begin = group["_w"].iloc[0] * hop
        x = group["_t"].to_numpy(float) - begin
        at = np.array([np.interp(x * rate, np.arange(window), row) for row in v])
        j = at @ np.exp(-2j * np.pi * np.outer(x, frequencies)) - flat * len(x) / length
        out = pd.DataFrame({"t": begin + length / 2, "f": frequencies, "power": (np.abs(j) ** 2).mean(0), "n": len(x)})
        return out.assign(**{c: pd.Series([group[c].iloc[0]] * len(out), dtype=object) for c in by})[schema.names]

    return copied.groupBy(*by, "_w").applyInPandas(run, schema)


def wavelet_power(samples: DataFrame, value: str, by: Sequence[str], rate: float, frequencies: Sequence[float], cycles: float = 6.0, **options) -> DataFrame:
    """Add ``power``, an array by frequency: squared size of the convolution with complex Morlet waves of unit gain.

    A wave is cut at four deviations, so a halo of that many samples of the
    lowest frequency makes the cuts into segments exact.
    """
    waves = []
    for f in frequencies:
        sigma = cycles / (2 * np.pi * f) * rate
        k = np.arange(-int(np.ceil(4 * sigma)), int(np.ceil(4 * sigma)) + 1)
        g = np.exp(-0.5 * (k / sigma) ** 2)
        waves.append(2 * g / g.sum() * np.exp(2j * np.pi * f / rate * k))
    halo = max((len(w) // 2 for w in waves), default=0)

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        power = np.stack([np.abs(np.convolve(np.pad(x, len(w) // 2, "edge"), w, "valid")) ** 2 for w in waves], 1)
        out = np.empty(len(x), object)
        out[:] = list(power)
        return {"power": out}

    return over_segments(samples, f, value, by, "power array<double>", rate, halo=halo, **options)


def band_power(spectra: DataFrame, by: Sequence[str], bands: dict[str, tuple[float, float]], value: str = "power") -> DataFrame:
    """Mean power, or another ``value`` as coherence, in named frequency bands at each time."""
    return spectra.groupBy(*by, "t").agg(*[F.avg(F.when(F.col("f").between(a, b), F.col(value))).alias(k) for k, (a, b) in bands.items()])


def ripples(filtered: DataFrame, value: str, by: Sequence[str], rate: float, low: float = 2.0, high: float = 5.0, frame: int = 11, merge: float = 0.03, shortest: float = 0.02, longest: float = 0.1, t: str = "t", cell: float | None = None) -> DataFrame:
    """Periods of a filtered signal whose smoothed power rises above ``low`` deviations
    and peaks above ``high``: keys, start, peak, stop, power."""
    from pyspark.sql import Window

    from .intervals import threshold
    from .joins import range_join
    from .regression import _joined
    from .series import windowed

    half = frame // 2

    def smoothed(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("_p", F.avg(F.col(value) * F.col(value)).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)))

    powered = windowed(filtered.select(*by, t, value), by, t, cell, half, smoothed).select(*by, t, "_p")
    moments = powered.groupBy(*by).agg(F.avg("_p").alias("_m"), F.stddev_samp("_p").alias("_s"))
    z = _joined(powered, moments, by).select(*by, t, ((F.col("_p") - F.col("_m")) / F.col("_s")).alias("power"))
    periods = threshold(z, "power", low, by, shortest=0.0, bridge=merge, t=t, cell=cell)
    held = range_join(z, periods, max(longest, 10 / rate), by, t)
    peaks = held.groupBy(*by, "start", "stop").agg(F.max_by(t, F.struct(F.col("power"), -F.col(t))).alias("peak"), F.max("power").alias("power"))
    return peaks.where((F.col("power") > high) & (F.col("stop") - F.col("start")).between(shortest, longest)).select(*by, "start", "peak", "stop", "power")


def current_source_density(row: Sequence[str]) -> list:
    """Minus the second difference of neighbouring channels, for a select."""
    return [(-(F.col(a) - 2 * F.col(b) + F.col(c))).alias(f"csd_{b}") for a, b, c in zip(row, row[1:], row[2:])]
