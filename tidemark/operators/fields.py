"""Fields, distributions and phases: shapes on small grids, and what is resampled along a phase."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .joins import interpolate, range_join
from .series import running_sum


def distribution(rows: DataFrame, value: str, by: Sequence[str], n: int) -> DataFrame:
    """(by, bin, center, share): share of each group in ``n`` common bins.

    Bins span the values of all groups and a fifth of that range on both sides.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return rows.limit(0).select(*by, F.lit(0).alias("bin"), F.lit(0.0).alias("center"), F.lit(0.0).alias("share"))
    low, high = low - (high - low) / 5, high + (high - low) / 5
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, C.bin_index(F.col(value), low, high, n).alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))  # at most n rows a group
    return counts.select(*by, "bin", C.bin_center(F.col("bin"), low, high, n).alias("center"), share.alias("share"))


def uniform_phases(points: DataFrame, reference: DataFrame, by: Sequence[str], phase: str = "phase", cell: float | None = None) -> DataFrame:
    """Points with ``corrected``: two pi times the share of the reference's phases up to theirs.

    The share is interpolated between the reference's phases, from 0 at the
    least one; phases beyond them are null. With a ``cell`` one key's phases
    are dealt over tasks.
    """
    turned = lambda df: df.withColumn(phase, C.wrap(F.col(phase), False))
    counts = turned(reference).where(F.col(phase).isNotNull()).groupBy(*by, phase).agg(F.count("*").alias("_n"))
    upto = running_sum(counts, F.col("_n"), by, phase, cell, "_upto")
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_all"), F.min(phase).alias("_least"))
    joined = upto.join(whole, list(by)) if by else upto.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")  # one row
    share = F.when(F.col(phase) == F.col("_least"), 0.0).otherwise(F.col("_upto") / F.col("_all"))
    curve = joined.select(*by, phase, (2 * math.pi * share).alias("corrected"))
    return interpolate(curve, turned(points), "corrected", by, t=phase, cell=cell)


def along_phase(samples: DataFrame, value: str, by: Sequence[str], per_cycle: int, phase: str = "phase", cell: float | None = None) -> DataFrame:
    """(by, phase, value): a signal at evenly spaced unwrapped phases, ``per_cycle`` to a cycle.

    Phases must grow with time; a phase that occurs twice counts once.
    """
    once = samples.groupBy(*by, phase).agg(F.min(value).alias(value))
    ends = once.groupBy(*by).agg(F.min(phase).alias("_a"), F.max(phase).alias("_b"))
    n = F.round((F.col("_b") - F.col("_a")) / (2 * math.pi) * per_cycle).cast("bigint")
    steps = ends.withColumn("_n", n).where("_n > 1").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    targets = steps.select(*by, F.when(F.col("_k") == F.col("_n") - 1, F.col("_b")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_k") / (F.col("_n") - 1)).alias(phase))
    return interpolate(once, targets, value, by, t=phase, cell=cell)


def subcycles(samples: DataFrame, by: Sequence[str], n: int, phase: str = "phase", t: str = "t", cell: float | None = None) -> DataFrame:
    """(by, cycle, subcycle, start, stop): each whole cycle of an unwrapped phase in ``n`` equal parts of phase."""
    width = 2 * math.pi / n
    once = samples.groupBy(*by, phase).agg(F.min(t).alias("_t"))
    ends = once.groupBy(*by).agg(F.ceil(F.min(phase) / (2 * math.pi)).alias("_a"), F.floor(F.max(phase) / (2 * math.pi)).alias("_b")).where("_b > _a")
    marks = ends.select(*by, "_b", F.explode(F.sequence(F.col("_a") * n, F.col("_b") * n)).alias("_k")).withColumn(phase, F.col("_k") * width)
    timed = interpolate(once, marks, "_t", by, t=phase, cell=cell)
    after = timed.select(*by, (F.col("_k") - 1).alias("_k"), F.col("_t").alias("stop"))
    parts = timed.join(after, [*by, "_k"])
    return parts.select(*by, F.floor(F.col("_k") / n).alias("cycle"), (F.pmod("_k", F.lit(n)) + 1).alias("subcycle"), F.col("_t").alias("start"), "stop")


def detrended(samples: DataFrame, value: str, by: Sequence[str], t: str = "t") -> DataFrame:
    """Samples with ``detrended``: the value less its regression line on time, by series."""
    from .statistics import residuals

    return residuals(samples, t, value, by).withColumnRenamed("residual", "detrended")


def above_threshold(spikes: DataFrame, amplitude: str, by: Sequence[str], factor: float) -> DataFrame:
    """Spikes of at least ``factor`` times the least amplitude of their unit."""
    least = spikes.groupBy(*by).agg(F.min(amplitude).alias("_least"))
    return spikes.join(least, list(by)).where(F.col(amplitude) >= factor * F.col("_least")).drop("_least")


def tuned_times(samples: DataFrame, times: DataFrame, value: str, by: Sequence[str], before: float, after: float, slope: bool = True, t: str = "t", cell: float | None = None) -> DataFrame:
    """Times with ``tuned``: the nearby sample of steepest slope, or of largest size; the earliest of equal ones."""
    from .series import windowed

    steep = lambda rows, keys: rows.withColumn("_x", F.abs(F.lead(value).over(Window.partitionBy(*keys).orderBy(t)) - F.col(value)))
    sized = windowed(samples, by, t, cell, 1, steep) if slope else samples.withColumn("_x", F.abs(value))
    spans = times.select(*by, F.col(t).alias("_time"), (F.col(t) - before).alias("start"), (F.col(t) + after).alias("stop"))
    near = range_join(sized.select(*by, t, "_x"), spans, before + after, by, t)
    best = near.where(F.col("_x").isNotNull()).groupBy(*by, "_time").agg(F.max_by(t, F.struct("_x", -F.col(t))).alias("tuned"))
    return times.join(best.withColumnRenamed("_time", t), [*by, t], "left")


def distance_transform(cells: DataFrame, flag: str, rows: int, row: str = "row", column: str = "column") -> DataFrame:
    """Cells of a dense grid with ``distance`` to the nearest one whose flag is true; null without any.

    First along columns by windows, then the least over each row's columns, so
    work is cells times columns, of a grid of fixed size.
    """
    at = F.when(F.col(flag), F.col(row))
    w = Window.partitionBy(column).orderBy(row)
    up = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    along = cells.select(row, column, F.least(F.col(row) - up, down - F.col(row)).alias("_g"))
    other = along.where("_g is not null").select(row, F.col(column).alias("_c"), "_g")
    least = along.select(row, column).join(other, row).groupBy(row, column).agg(F.sqrt(F.min((F.col(column) - F.col("_c")) ** 2 + F.col("_g") ** 2)).alias("distance"))
    return cells.join(least, [row, column], "left")


def normalised_fields(fields: DataFrame, by: Sequence[str], n: int, rate: bool = True) -> DataFrame:
    """(by, bin, rate): each field (bin from 1, rate) alone, stretched over ``n`` bins, with a peak of one.

    A field begins at its first bin above zero and ends before the next zero,
    also round the end of the axis.
    """

    def stretch(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n)
        x[group["bin"].to_numpy(int) - 1] = group["rate"].to_numpy(float)
        rises = np.flatnonzero((x[1:] != 0) & (x[:-1] == 0)) + 1
        x = np.roll(x, -int(rises[-1])) if len(rises) else x
        falls = np.flatnonzero((x[1:] == 0) & (x[:-1] != 0)) + 1
        stop = int(falls[-1]) if len(falls) else n
        y = np.interp(np.linspace(0, stop - 1, n), np.arange(stop), x[:stop])
        y = y / y.max() if rate and y.max() > 0 else y
        out = pd.DataFrame({"bin": np.arange(1, n + 1), "rate": y})
        return out.assign(**{c: pd.Series([group[c].iloc[0]] * n, dtype=object) for c in by})[[*by, "bin", "rate"]]

    kinds = dict(fields.dtypes)
    return fields.groupBy(*by).applyInPandas(stretch, ", ".join([*(f"{c} {kinds[c]}" for c in by), "bin int", "rate double"]))


def field_shift(control: DataFrame, test: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(by, shift, relative): the lag, in parts of the axis, at which a field's test agrees best with its control.

    ``relative`` is in parts of the mean field size; the smallest lag of equal ones counts.
    """
    from .waves import cross_correlation

    both = control.select(*by, F.col("bin").cast("int").alias("i"), F.col("rate").alias("x")).join(test.select(*by, F.col("bin").cast("int").alias("i"), F.col("rate").alias("y")), [*by, "i"])
    r = cross_correlation(both, by, "x", "y", n - 1)
    best = r.groupBy(*by).agg(F.max_by("lag", F.struct("r", -F.abs("lag"), -F.col("lag"))).alias("lag"))
    sizes = both.groupBy(*by).agg((F.sum((F.col("x") > 0).cast("int")) + F.sum((F.col("y") > 0).cast("int"))).alias("_s"))
    return best.join(sizes, list(by)).select(*by, (F.col("lag") / n).alias("shift"), (2 * F.col("lag") / F.nullif("_s", F.lit(0))).alias("relative"))


def concentration_test(rows: DataFrame, angle: str, group: str) -> DataFrame:
    """Equal concentrations of groups (Fisher): f, degrees of freedom, two-sided p.

    The statistic compares the groups' mean absolute sines about their own
    mean directions; its law holds for concentrations of one and more.
    """
    from ..functions.distributions import f_tail, udf_of

    a = F.col(angle)
    means = rows.where(a.isNotNull()).groupBy(group).agg(C.circular_mean(a).alias("_m"))
    d = rows.where(a.isNotNull()).join(means, group).select(group, F.abs(F.sin(a - F.col("_m"))).alias("d"))
    g = d.groupBy(group).agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") ** 2).alias("q"))
    s = g.agg(F.count("*").alias("r"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") ** 2 / F.col("n")).alias("between"), F.sum("q").alias("q"))
    f = (F.col("n") - F.col("r")) * (F.col("between") - F.col("s") ** 2 / F.col("n")) / ((F.col("r") - 1) * (F.col("q") - F.col("between")))
    made = s.select(f.alias("f"), (F.col("r") - 1).alias("df1"), (F.col("n") - F.col("r")).alias("df2"))
    tail = udf_of(f_tail)("f", "df1", "df2")
    return made.withColumn("p", 2 * F.least(tail, 1 - tail))


def decoded_classes(rows: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 5, iterations: int = 50) -> DataFrame:
    """Rows with ``predicted``, by linear support vector machines that did not see the row's fold.

    Folds come from a hash of ``key``; labels are whole numbers from 0.
    """
    from functools import reduce

    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import VectorAssembler

    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(rows.withColumn("_fold", fold))
    made = []
    for k in range(folds):
        machine = OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.01), featuresCol="_v", labelCol=label, predictionCol="predicted")
        made.append(machine.fit(vectors.where(F.col("_fold") != k)).transform(vectors.where(F.col("_fold") == k)))
    return reduce(DataFrame.unionByName, made).drop("_v", "_fold")


def glm_gain(rows: DataFrame, features: Sequence[str], target: str, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(gain, error, shuffled): mean squared error of a target exchanged between rows over that of the target itself.

    Both are predicted by a generalised linear model (normal, logarithmic link)
    of the other folds. The exchange pairs rows by the order of two hashes.
    """
    from functools import reduce

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from .series import ranked

    h = lambda k: F.shiftrightunsigned(F.xxhash64(key, F.lit(seed + k)), 11) / float(2**53)
    numbered = ranked(rows.withColumn("_h", h(1)), [], "_h", 1 / 64, "_i")
    others = ranked(rows.select(F.col(target).alias("_other"), h(2).alias("_h2")), [], "_h2", 1 / 64, "_i")
    mixed = VectorAssembler(inputCols=list(features), outputCol="_v").transform(numbered.join(others.drop("_h2"), "_i")).withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    made = []
    for k in range(folds):
        model = GeneralizedLinearRegression(family="gaussian", link="log", featuresCol="_v", labelCol=target, predictionCol="_p", maxIter=25, regParam=1e-6).fit(mixed.where(F.col("_fold") != k))
        made.append(model.transform(mixed.where(F.col("_fold") == k)))
    errors = reduce(DataFrame.unionByName, made).agg(F.avg((F.col(target) - F.col("_p")) ** 2).alias("error"), F.avg((F.col("_other") - F.col("_p")) ** 2).alias("shuffled"))
    return errors.select((F.col("shuffled") / F.col("error")).alias("gain"), "error", "shuffled")


def _relaxed(grid: np.ndarray, weights: tuple[float, float], tolerance: float, most: int) -> tuple[np.ndarray, int, float]:
    """The grid with its missing cells filled, how many rounds it took and the greatest residual."""
    rows, columns = grid.shape
    gap = np.isnan(grid)
    border = np.ones_like(gap)
    border[1:-1, 1:-1] = False
    if not gap.any() or gap[border].all():
        return grid, 0, 0.0
    inner_row = np.zeros((rows, 1))
    inner_row[1:-1] = weights[0]
    inner_column = np.zeros((1, columns))
    inner_column[:, 1:-1] = weights[1]
    down, across = np.broadcast_to(inner_row, grid.shape).copy(), np.broadcast_to(inner_column, grid.shape).copy()
    corner = np.zeros_like(gap)
    corner[[0, 0, -1, -1], [0, -1, 0, -1]] = True
    down[corner] = across[corner] = 1.0
    total = np.where(corner, 2.0, 2 * (down + across))
    v = np.where(gap, grid[~gap].mean(), grid)
    colour = np.add.outer(np.arange(rows), np.arange(columns)) % 2
    parts = [gap & (colour == c) for c in (0, 1)]
    factor = 2 / (1 + math.sin(math.pi / max(rows, columns)))
    scale = max(1.0, float(np.abs(grid[~gap]).max()))

    def off() -> np.ndarray:
        around = np.pad(v, 1)
        return down * (around[:-2, 1:-1] + around[2:, 1:-1]) + across * (around[1:-1, :-2] + around[1:-1, 2:]) - total * v

    for n in range(1, most + 1):
        for part in parts:
            v[part] += factor * (off() / total)[part]
        worst = float(np.abs(off()[gap]).max())
        if worst <= tolerance * scale:
            break
    return v, n, worst


def filled_map(cells: DataFrame, by: Sequence[str], row: str, column: str, value: str, rows: int, columns: int, weights: tuple[float, float] = (1.0, 1.0), tolerance: float = 1e-12, most: int = 20_000) -> DataFrame:
    """(by, row, column, value, filled, rounds, residual): maps whose missing cells are harmonic in their neighbours.

    A map has cells 1..rows by 1..columns, at least two each; null, NaN or
    absent ones are missing. The weighted second differences down and across
    are 0 in a missing cell; on an edge only the one along it counts, and a
    corner is its two neighbours' mean. A map without any known cell on its
    border stays as it is, since the equations have no one solution; of repeated
    cells the mean counts; cells outside are left out. One map a task, whose
    size is fixed by the arguments.
    """
    if rows < 2 or columns < 2:
        raise ValueError("a map has at least two rows and two columns")
    inside = F.col(row).between(1, rows) & F.col(column).between(1, columns)
    once = cells.where(inside).groupBy(*by, F.col(row).cast("int").alias(row), F.col(column).cast("int").alias(column)).agg(F.avg(C.finite(F.col(value))).alias(value))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((rows, columns), np.nan)
        grid[part[row] - 1, part[column] - 1] = part[value].astype(float)
        made, n, worst = _relaxed(grid, weights, tolerance, most)
        out = part.iloc[[0] * grid.size][list(by)].reset_index(drop=True)
        out[row], out[column] = np.repeat(np.arange(1, rows + 1), columns), np.tile(np.arange(1, columns + 1), rows)
        flat = made.ravel()
        out[value] = pd.Series(flat).astype(object).where(~np.isnan(flat), None)
        out["filled"] = np.isnan(grid.ravel()) & ~np.isnan(flat)
        out["rounds"], out["residual"] = n, worst
        return out

    keys = ", ".join(f"`{c}` {once.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}{', ' if by else ''}`{row}` int, `{column}` int, `{value}` double, filled boolean, rounds int, residual double"
    return once.groupBy(*by).applyInPandas(fill, schema)
