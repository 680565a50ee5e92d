"""Column expressions: clipping, binning, angles, elementary statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def seconds(ts: str) -> Column:
    """A timestamp as double seconds (session zone UTC)."""
    return F.col(ts).cast("timestamp").cast("double")


def finite(x: Column) -> Column:
    """NaN and infinities as null, which is the engine's missing value."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    """Values below ``low`` become ``low``, above ``high`` become ``high``; null stays."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def bin_index(x: Column, low: float, high: float, n: int, trim: bool = False) -> Column:
    """Bin 1..n of a value; the upper limit belongs to the last bin.

    Values outside go to the first or last bin, with ``trim`` to null.
    """
    raw = F.floor((x - low) / (high - low) * n).cast("int") + 1
    inside = F.greatest(F.lit(1), F.least(F.lit(n), raw))
    if trim:
        return F.when((x >= low) & (x <= high), inside)
    return F.when(x.isNotNull(), inside)


def bin_center(b: Column, low: float, high: float, n: int) -> Column:
    return low + (b - 0.5) * ((high - low) / n)


def wrap(x: Column, around_zero: bool = True) -> Column:
    """An angle in [-pi, pi], or in [0, 2 pi)."""
    y = F.pmod(x, F.lit(2 * math.pi))
    return F.when(y > math.pi, y - 2 * math.pi).otherwise(y) if around_zero else y


def circular_shift(i: Column, by: int, n: int) -> Column:
    """New place 1..n of row ``i`` when rows move down by ``by``."""
    return F.pmod(i - 1 + by, F.lit(n)) + 1


def zero_padded(n: Column, digits: int) -> Column:
    return F.lpad(n.cast("string"), digits, "0")


def resultant(angle: Column) -> Column:
    """Length of the mean resultant, an aggregate; nulls do not count."""
    return F.sqrt(F.pow(F.avg(F.cos(angle)), 2) + F.pow(F.avg(F.sin(angle)), 2))


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def circular_variance(angle: Column) -> Column:
    return 1 - resultant(angle)


def circular_deviation(angle: Column) -> Column:
    return F.sqrt(-2 * F.log(resultant(angle)))


def concentration(r: Column, n: Column) -> Column:
    """Concentration of a von Mises law from resultant and count.

    Three ranges of the resultant, then the correction of small samples.
    """
    k = (
        F.when(r < 0.53, 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6)
        .when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r))
        .otherwise(1 / (F.pow(r, 3) - 4 * F.pow(r, 2) + 3 * r))
    )
    small = F.when(k < 2, F.greatest(k - 2 / (n * k), F.lit(0.0))).otherwise(F.pow(n - 1, 3) * k / (F.pow(n, 3) + n))
    return F.when(n <= 15, small).otherwise(k)


def rayleigh_p(r: Column, n: Column) -> Column:
    """Probability of such a resultant under uniformity (second-order form)."""
    z = n * r * r
    return F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n))


def pairwise_phase_consistency(angle: Column) -> Column:
    """Mean cosine of all pairwise differences, in closed form; null below two."""
    n, c, s = F.count(angle), F.sum(F.cos(angle)), F.sum(F.sin(angle))
    return F.when(n > 1, (c * c + s * s - n) / (n * (n - 1)))


def sem(x: Column) -> Column:
    """Standard error of the mean, nulls left out."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def weighted_corr(w: Column, x: Column, y: Column) -> Column:
    """Correlation with weights, an aggregate."""
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov = F.sum(w * x * y) / n - mx * my
    return cov / F.sqrt((F.sum(w * x * x) / n - mx * mx) * (F.sum(w * y * y) / n - my * my))


def binomial_z(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    """z of two proportions with pooled variance."""
    p = (s1 + s0) / (n1 + n0)
    return F.abs(s1 / n1 - s0 / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def proportion_z(s: Column, n: Column, p: float) -> Column:
    """z of one proportion against ``p``."""
    return F.abs(s / n - p) / F.sqrt(F.lit(p * (1 - p)) / n)


def standard_error_of_median(x: Column) -> Column:
    """Root of the squared deviations from the median over n (n - 1), n counting nulls too; an aggregate."""
    m, n = F.percentile(x, F.lit(0.5)), F.count("*")
    return F.sqrt((F.sum(x * x) - 2 * m * F.sum(x) + F.count(x) * m * m) / (n * (n - 1)))


def sem_angle(angle: Column) -> Column:
    """Angle of the standard errors of sine and cosine, an aggregate."""
    return F.atan2(sem(F.sin(angle)), sem(F.cos(angle)))


def weighted_circular_corr(w: Column, x: Column, angle: Column) -> Column:
    """Correlation of a weighted value with an angle, 0 to 1, an aggregate."""
    s, c = F.sin(angle), F.cos(angle)
    xs, xc, sc = weighted_corr(w, x, s), weighted_corr(w, x, c), weighted_corr(w, s, c)
    return F.sqrt((xc * xc + xs * xs - 2 * xc * xs * sc) / (1 - sc * sc))


def explained(x: Column, y: Column, slope: float | Column, intercept: float | Column) -> Column:
    """Share of the variance of y that a line explains, an aggregate."""
    rest = y - (F.lit(slope) * x + F.lit(intercept))
    return 1 - F.sum(rest * rest) / ((F.count(y) - 1) * F.var_samp(y))


def log_factorial(n: Column) -> Column:
    """Logarithm of n! of a whole number from 0; nulls and numbers below 0 are null.

    Stirling's series from 10 on, which is exact to double precision there,
    and for smaller numbers the one of n + 10 less the factors between.
    """
    z = n.cast("double") + 11
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    between = sum((F.log(n + k) for k in range(2, 11)), F.log(n + 1))
    return F.when(n >= 0, series - between)


def portion(flag: Column) -> Column:
    """Share of rows whose flag is true, nulls counting as false; an aggregate."""
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")) / F.count("*")


def circular_steps(n: int, around_zero: bool = True) -> Column:
    """Array of ``n`` evenly spaced angles, from -pi or from 0."""
    start = -math.pi if around_zero else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + k * (2 * math.pi / n))


def gamma_steps(a: float, b: float, gamma: float, n: int) -> Column:
    """Array of ``n`` values from a to b, evenly spaced but for the power of one over ``gamma``."""
    power = gamma if a > b else 1 / gamma
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pow(k / (n - 1), F.lit(power)) * (b - a) + a)


def steps(start: Column, stop: Column, step: Column | float = 1.0) -> Column:
    """Array of start, start + step and so on up to stop; explode it for a row each."""
    n = F.floor((stop - start) / step + 1e-9)
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda k: start + k * step)).otherwise(F.array().cast("array<double>"))
