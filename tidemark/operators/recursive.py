"""Recursive filters and rational resampling of long series.

A filter's rational function is a sum of first-order parts, so its state is
one complex number a pole that is multiplied by the pole at each sample. A
cell of samples thus turns the state before it into a factor times that state
plus a constant: only those, one row a cell, are carried along a series, and
all cells are filtered side by side, with the same result as in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = 128


@dataclass
class Parts:
    """y = direct * x + the real part of the sum of weights * states, states following their poles."""

    poles: np.ndarray
    weights: np.ndarray
    direct: float

    def gain(self, f: float, rate: float) -> complex:
        z = np.exp(2j * np.pi * f / rate)
        # conjugate pairs are both among the poles, so the sum is the transfer function
        return self.direct + (self.weights / (1 - self.poles / z)).sum()


def chebyshev2(order: int, attenuation: float, rate: float, passband: tuple[float, float] | None = None, stopband: tuple[float, float] | None = None) -> Parts:
    """A Chebyshev filter of the second kind: flat where it passes, ``attenuation`` decibels down where it stops.

    A pass band from zero makes a low pass, one to infinity a high pass.
    """
    if (passband is None) == (stopband is None):
        raise ValueError("give a pass band or a stop band")
    m = np.arange(1 - order, order, 2)
    bend = np.arcsinh(np.sqrt(10 ** (attenuation / 10) - 1)) / order
    angle = np.exp(1j * np.pi * m / (2 * order))
    poles = -1 / (np.sinh(bend) * angle.real + 1j * np.cosh(bend) * angle.imag)
    zeros = 1j / np.sin(np.pi * m[m != 0] / (2 * order))
    gain = (np.prod(-poles) / np.prod(-zeros)).real
    band = passband or stopband
    low, high = (2 * rate * np.tan(np.pi * min(f, rate / 2 * 0.999999) / rate) for f in band)
    rest = len(poles) - len(zeros)
    if passband and band[0] <= 0:
        zeros, poles, gain = zeros * high, poles * high, gain * high**rest
    elif passband and np.isinf(band[1]):
        gain *= (np.prod(-zeros) / np.prod(-poles)).real
        zeros, poles = np.r_[low / zeros, np.zeros(rest)], low / poles
    elif passband:
        width, centre = high - low, low * high
        both = lambda r: np.r_[r * width / 2 + np.sqrt((r * width / 2) ** 2 - centre), r * width / 2 - np.sqrt((r * width / 2) ** 2 - centre)]
        gain *= width**rest
        zeros, poles = np.r_[both(zeros.astype(complex)), np.zeros(rest)], both(poles)
    else:
        width, centre = high - low, low * high
        both = lambda r: np.r_[width / 2 / r + np.sqrt((width / 2 / r) ** 2 - centre), width / 2 / r - np.sqrt((width / 2 / r) ** 2 - centre)]
        gain *= (np.prod(-zeros) / np.prod(-poles)).real
        notch = np.repeat([1j, -1j], rest) * np.sqrt(centre)
        zeros, poles = np.r_[both(zeros.astype(complex)), notch], both(poles)
    # to the digital plane
    twice, missing = 2 * rate, len(poles) - len(zeros)
    gain *= (np.prod(twice - zeros) / np.prod(twice - poles)).real
    zeros, poles = np.r_[(twice + zeros) / (twice - zeros), -np.ones(missing)], (twice + poles) / (twice - poles)
    # to first-order parts: H = direct + sum of weight / (1 - pole / z)
    direct = gain * (np.prod(-zeros) / np.prod(-poles)).real
    weights = np.array([gain * np.prod(1 - zeros / p) / np.prod(1 - np.delete(poles, i) / p) for i, p in enumerate(poles)])
    return Parts(poles, weights, direct)


def _states(x: np.ndarray, parts: Parts, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered values, last state) of values that follow ``state``."""
    n, p = len(x), parts.poles
    powers = p[None, :] ** np.arange(_BLOCK + 1)[:, None]
    reply = (powers[:_BLOCK] @ parts.weights).real
    reply[0] += parts.direct
    j = np.arange(_BLOCK)
    lower = np.where(j[:, None] >= j[None, :], reply[np.maximum(j[:, None] - j[None, :], 0)], 0)
    y = np.empty(n)
    for a in range(0, n, _BLOCK):
        part = x[a : a + _BLOCK]
        k = len(part)
        y[a : a + k] = lower[:k, :k] @ part + ((powers[1 : k + 1] * state) @ parts.weights).real
        state = powers[k] * state + part @ powers[:k][::-1]
    return y, state


def _sweep(samples: DataFrame, parts: Parts, value: str, by: Sequence[str], rate: float, segment: int, back: bool, t: str) -> DataFrame:
    """Filter a column in place, from the first sample on or from the last one back."""
    n, names = len(parts.poles), samples.columns
    at = F.round(F.col(t) * rate).cast("bigint")
    placed = samples.withColumn("_at", -at if back else at).withColumn("_cell", F.floor(F.col("_at") / segment))
    keys = [samples.schema[c] for c in by]
    many = T.ArrayType(T.DoubleType())
    cell = T.StructField("_cell", T.LongType())
    told = T.StructType([*keys, cell, T.StructField("_n", T.LongType()), T.StructField("_first", T.DoubleType()), T.StructField("_re", many), T.StructField("_im", many)])
    begun = T.StructType([*keys, cell, T.StructField("_re", many), T.StructField("_im", many)])

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("_at", kind="stable")[value].to_numpy(float)
        _, state = _states(x, parts, np.zeros(n, complex))
        own = {c: [group[c].iloc[0]] for c in (*by, "_cell")}
        return pd.DataFrame(own | {"_n": [len(x)], "_first": [x[0]], "_re": [state.real], "_im": [state.imag]})[told.names]

    def carried(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_cell", kind="stable")
        # before the first sample the series is taken to have had its value for ever
        state, before = group["_first"].iloc[0] / (1 - parts.poles), []
        for k, re, im in zip(group["_n"], group["_re"], group["_im"], strict=True):
            before.append(state)
            state = parts.poles**k * state + np.asarray(re) + 1j * np.asarray(im)
        return group.assign(_re=[s.real for s in before], _im=[s.imag for s in before])[begun.names]

    def filtered(group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
        group = group.sort_values("_at", kind="stable")
        state = np.asarray(start["_re"].iloc[0]) + 1j * np.asarray(start["_im"].iloc[0])
        return group.assign(**{value: _states(group[value].to_numpy(float), parts, state)[0]})[names]

    ends = placed.select(*by, "_cell", "_at", value).groupBy(*by, "_cell").applyInPandas(summed, told)
    starts = ends.groupBy(*by).applyInPandas(carried, begun)  # a row a cell
    return placed.groupBy(*by, "_cell").cogroup(starts.groupBy(*by, "_cell")).applyInPandas(filtered, samples.schema)


def recursive_filter(samples: DataFrame, parts: Parts, value: str, by: Sequence[str], rate: float, zero_phase: bool = True, segment: int = 65_536, name: str = "filtered", t: str = "t") -> DataFrame:
    """Add the filtered value; with ``zero_phase`` filtered forward and then backward.

    Both passes begin as if the series had always had its first, or last,
    value. Null values are left out. Samples on both sides of a gap follow
    each other. Cells of ``segment`` samples don't change results beyond rounding.
    """
    kept = samples.where(F.col(value).isNotNull()).withColumn(name, F.col(value).cast("double"))
    once = _sweep(kept, parts, name, by, rate, segment, False, t)
    return _sweep(once, parts, name, by, rate, segment, True, t) if zero_phase else once


def resampling_taps(up: int, down: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """A Kaiser-windowed sinc for both the inserted zeros and the new rate, ``half`` samples of the slower side wide."""
    most = max(up, down)
    k = np.arange(-half * most, half * most + 1)
    taps = np.sinc(k / most) * np.kaiser(len(k), beta)
    return taps * up / taps.sum()


def resample(samples: DataFrame, values: Sequence[str], by: Sequence[str], rate: float, up: int, down: int, segment: int = 65_536, t: str = "t") -> DataFrame:
    """(keys, t, values) at ``rate * up / down``.

    Sample m of the new series is at m * down / (up * rate); it is the old
    series, zero where it has no samples, through a low pass evaluated only
    at that time. Segments with a halo don't change results.
    """
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    taps = resampling_taps(up, down)
    half = len(taps) // 2
    halo = half // up + 2
    at = F.round(F.col(t) * rate).cast("bigint")
    ends = F.struct(F.floor((at - halo) / segment).alias("a"), F.floor((at + halo) / segment).alias("b"))
    copied = samples.select(*by, at.alias("_at"), *values, ends.alias("_e")).withColumn("_segment", F.explode(F.sequence("_e.a", "_e.b"))).drop("_e")
    schema = T.StructType([*[samples.schema[c] for c in by], T.StructField(t, T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in values]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        begin = int(group["_segment"].iloc[0]) * segment
        place = group["_at"].to_numpy()
        x = np.zeros((segment + 2 * halo, len(values)))
        x[place - begin + halo] = np.nan_to_num(group[list(values)].to_numpy(float))
        held = place[(place >= begin) & (place < begin + segment)]
        if not len(held):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in schema.names})
        # new samples between the first and the last old one of the segment, its right end left to the next
        m = np.arange(-(-held.min() * up // down), -(-(held.max() + 1) * up // down))
        y = np.zeros((len(m), len(values)))
        centre = m * down
        nearest = centre // up
        for k in range(-(half // up) - 1, half // up + 2):
            lag = centre - (nearest + k) * up
            inside = np.abs(lag) <= half
            y[inside] += taps[lag[inside] + half][:, None] * x[np.clip(nearest[inside] + k - begin + halo, 0, len(x) - 1)]
        out = pd.DataFrame(y, columns=list(values))
        out[t] = m * down / (up * rate)
        for c in by:
            out[c] = group[c].iloc[0]
        return out[schema.names]

    return copied.groupBy(*by, "_segment").applyInPandas(run, schema)


def gained(samples: DataFrame, gains: dict[str, float], precision: str = "int16") -> DataFrame:
    """Channels times their gains, rounded and held within the range of ``precision``."""
    ends = np.iinfo(precision)
    return samples.withColumns({c: F.greatest(F.lit(int(ends.min)), F.least(F.lit(int(ends.max)), F.round(F.col(c) * g))).cast("bigint") for c, g in gains.items()})
