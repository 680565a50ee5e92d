"""Do fields move between two conditions less than fields of other units would differ?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .regression import _joined, _left
from .resampling import bootstrap_means, interval, repeated, uniform
from .series import ranked

CELL = 1 / 1024  # of the range of the hashes by which units are numbered


def _arrays(fields: DataFrame, keys: Sequence[str], n: int, name: str) -> DataFrame:
    """(keys, name): rates of bins 1..n, those of equal bins added up, 0 where there is none."""
    sums = fields.where(F.col("bin").between(1, n) & F.col("rate").isNotNull()).groupBy(*keys, F.col("bin").cast("int").alias("bin")).agg(F.sum(F.col("rate").cast("double")).alias("rate"))
    held = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "rate"))).alias("_map"))
    every = F.sequence(F.lit(1), F.lit(n))
    return held.select(*keys, F.transform(every, lambda b: F.coalesce(F.try_element_at("_map", b), F.lit(0.0))).alias(name))


def _lags(x: np.ndarray, y: np.ndarray, circular: bool) -> np.ndarray:
    """Lag of the greatest sum of products of each row of ``x`` with the row of ``y`` moved back, the nearest to 0 of equal ones, then the lesser."""
    n = x.shape[1]
    order = sorted(range(1 - n, n), key=lambda lag: (abs(lag), lag))
    sums = np.stack([(x[:, max(0, -lag) : n - max(0, lag)] * y[:, max(0, lag) : n + min(0, lag)]).sum(1) for lag in order], axis=1)
    best = np.array(order)[sums.argmax(1)]
    return best - n * np.sign(best) * (2 * np.abs(best) > n) if circular else best


def _shifts(pairs: DataFrame, x: str, y: str, n: int, circular: bool) -> DataFrame:
    """Rows with ``shift`` in parts of the axis and ``relative`` in parts of the mean field size, null if both are empty."""

    @F.pandas_udf("double")
    def lag(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(_lags(np.stack(a.to_numpy()), np.stack(b.to_numpy()), circular) / n if len(a) else [], dtype=float)

    size = sum((F.size(F.filter(c, lambda v: v > 0)) for c in (x, y)), F.lit(0)) / (2.0 * n)
    found = pairs.withColumn("_size", F.nullif(size, F.lit(0.0))).withColumn("shift", lag(x, y))
    return found.withColumn("shift", F.when(F.col("_size").isNotNull(), F.col("shift"))).withColumn("relative", F.col("shift") / F.col("_size")).drop("_size")


def field_shifts(control: DataFrame, test: DataFrame, by: Sequence[str], n: int, circular: bool = False) -> DataFrame:
    """(by, shift, relative) for fields in both tables, of n bins from 1; as ``fields.field_shift``, with fields kept as arrays."""
    both = _joined(_arrays(control, by, n, "_x"), _arrays(test, by, n, "_y"), by)
    return _shifts(both, "_x", "_y", n, circular).select(*by, "shift", "relative")


def _draws(units: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """Units with ``repetition`` and ``_other``, the number of a unit of the same group, drawn with replacement."""
    u: Column = uniform("_rank", "repetition", seed=seed)
    return repeated(units, repetitions).withColumn("_other", F.least(F.floor(u * F.col("_n")), F.col("_n") - 1))


def remapping_test(control: DataFrame, repeat: DataFrame, test: DataFrame, by: Sequence[str], unit: str, n: int, repetitions: int = 150, level: float = 0.95, circular: bool = False, seed: int = 0) -> DataFrame:
    """(by, n, shift, control_shift, p, relative_low, relative_high, shift_low, shift_high), a row a group of units.

    Fields are (by, unit, bin 1..n, rate); units that are not in all three
    tables take no part. ``shift`` is the mean unsigned relative shift from
    control to test, ``control_shift`` from control to its repetition. ``p`` is
    the share of repetitions in which the control's fields, drawn with
    replacement from all units in place of the test's, lie at most as far away:
    a low p says that fields did not remap at random. The limits are of the
    mean signed shifts under resampled units. Units without any rate in both
    conditions have no shift. On a ``circular`` axis a shift is at most half of it.

    Every pair of fields that is drawn is compared once; fields travel as arrays
    of n rates, and units times repetitions small rows are shuffled.
    """
    keys = list(by) or ["_all"]
    tables = [t if by else t.withColumn("_all", F.lit(0)) for t in (control, repeat, test)]
    arrays = [_arrays(t, [*keys, unit], n, name) for t, name in zip(tables, ("_control", "_repeat", "_test"))]
    fields = _joined(_joined(arrays[0], arrays[1], [*keys, unit]), arrays[2], [*keys, unit]).where(F.col(unit).isNotNull())
    numbered = ranked(fields.withColumn("_at", uniform(unit, seed=seed)), keys, "_at", CELL).drop("_at")
    units = cut(_joined(numbered, numbered.groupBy(*keys).agg(F.count("*").alias("_n")), keys))
    still = _shifts(units.select(*keys, "_control", "_repeat"), "_control", "_repeat", n, circular)
    shifts = cut(_shifts(units.select(*keys, unit, "_control", "_test"), "_control", "_test", n, circular).select(*keys, unit, "shift", "relative"))
    observed = _joined(
        shifts.groupBy(*keys).agg(F.count("relative").alias("n"), F.avg(F.abs("relative")).alias("shift")),
        still.groupBy(*keys).agg(F.avg(F.abs("relative")).alias("control_shift")), keys,
    )
    draws = _draws(units.select(*keys, "_rank", "_n"), repetitions, seed).select(*keys, "repetition", "_rank", "_other")
    left = units.select(*keys, "_rank", F.col("_control").alias("_x"))
    right = units.select(*keys, F.col("_rank").alias("_other"), F.col("_control").alias("_y"))
    pairs = _joined(_joined(draws.groupBy(*keys, "_rank", "_other").agg(F.collect_list("repetition").alias("_in")), left, [*keys, "_rank"]), right, [*keys, "_other"])
    null = _shifts(pairs, "_x", "_y", n, circular).select(*keys, "relative", F.explode("_in").alias("repetition")).groupBy(*keys, "repetition").agg(F.avg(F.abs("relative")).alias("_mean"))
    made = _joined(null, observed, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("shift").alias("shift"), F.first("control_shift").alias("control_shift"), F.avg((F.col("_mean") <= F.col("shift") * (1 + 1e-12)).cast("double")).alias("p"))
    for value, name in (("relative", "relative"), ("shift", "shift")):
        means = bootstrap_means(shifts.where(F.col(value).isNotNull()), value, unit, keys, repetitions, seed)
        limits = interval(means, "mean", keys, level).withColumnsRenamed({"low": f"{name}_low", "high": f"{name}_high"})
        made = _left(made, limits, keys)
    return made.select(*by, "n", "shift", "control_shift", "p", "relative_low", "relative_high", "shift_low", "shift_high")
