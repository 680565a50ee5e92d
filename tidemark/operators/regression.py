"""Regression of an angle on a line: by greatest resultant, by parallel lines, by the median slope.

Rows whose position or angle is null or NaN take no part; a group without any
has no row. Only sums and counts a group leave the rows' tasks, so a group may
have any number of rows; tables of one row a group are kept between rounds.
Slopes are in radians to a unit of ``x``.
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
from ..functions.distributions import normal_two_tailed, udf_of
from .lineage import cut

BLOCK = 4096  # rows of neighbouring positions that one task compares among themselves
TURN = 2 * math.pi


def _joined(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their group's columns; null keys are equal. Without keys there is one group, a row of fixed size."""
    if not by:
        return rows.withColumn("_one", F.lit(1)).join(F.broadcast(groups.withColumn("_one", F.lit(1))), "_one").drop("_one")
    right = groups.withColumnsRenamed({c: f"_right_{c}" for c in by})
    return rows.join(right, [rows[c].eqNullSafe(right[f"_right_{c}"]) for c in by]).drop(*[f"_right_{c}" for c in by])


def _pairs(rows: DataFrame, by: Sequence[str], x: str, angle: str) -> DataFrame:
    return rows.select(*by, C.finite(F.col(x)).alias("_x"), C.finite(F.col(angle)).alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def _best_slope(rows: DataFrame, by: Sequence[str], centre: Column, reach: float, steps: int) -> DataFrame:
    """(by, _a): the slope of greatest resultant among ``steps`` within ``reach`` of ``centre``, ties to the least."""
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    tried = rows.withColumn("_k", k).withColumn("_a", centre - reach + 2 * reach * F.col("_k") / (steps - 1))
    turned = F.col("_y") - F.col("_a") * F.col("_x")
    sums = tried.groupBy(*by, "_k").agg(F.first("_a").alias("_a"), F.round(C.resultant(turned), 15).alias("_r"))
    return sums.groupBy(*by).agg(F.max_by("_a", F.struct(F.col("_r"), -F.col("_k"))).alias("_a"))


def resultant_regression(rows: DataFrame, by: Sequence[str], x: str = "x", angle: str = "phase", slope: float = 0.0, most: float = TURN, steps: int = 41, rounds: int = 5) -> DataFrame:
    """(by, n, slope, offset, r2, p): the slope whose residuals have the greatest resultant, and the circular correlation's test of no slope.

    The slope is looked for on ``steps`` even steps within ``most`` of
    ``slope``, then around the best one in ``rounds`` finer grids. The peak has
    a width of about the reciprocal of x's range: ``steps`` must resolve that.
    """
    x_y = _pairs(rows, by, x, angle)
    fit = cut(_best_slope(x_y, by, F.lit(float(slope)), most, steps))
    reach = most
    for _ in range(rounds):
        reach = 2 * reach / (steps - 1)
        fit = cut(_best_slope(_joined(x_y, fit, by), by, F.col("_a"), reach, steps))
    y, theta = F.col("_y"), F.abs("_a") * F.col("_x")
    at = _joined(x_y, fit, by)
    means = at.groupBy(*by).agg(F.first("_a").alias("_a"), C.circular_mean(y - F.col("_a") * F.col("_x")).alias("_b"), C.circular_mean(y).alias("_my"), C.circular_mean(theta).alias("_mt"))
    u, v = F.sin(y - F.col("_my")), F.sin(theta - F.col("_mt"))
    sums = _joined(x_y, means, by).groupBy(*by).agg(F.count("*").alias("n"), F.first("_a").alias("slope"), F.first("_b").alias("offset"), F.avg(u * u).alias("_uu"), F.avg(v * v).alias("_vv"), F.avg(u * v).alias("_uv"), F.avg(u * u * v * v).alias("_uuvv"))
    rho = F.col("_uv") / F.nullif(F.sqrt(F.col("_uu") * F.col("_vv")), F.lit(0.0))
    z = rho * F.sqrt(F.col("n") * F.col("_uu") * F.col("_vv") / F.nullif("_uuvv", F.lit(0.0)))
    made = sums.select(*by, "n", "slope", "offset", (rho * rho).alias("r2"), z.alias("_z"))
    return made.withColumn("p", F.when(F.col("_z").isNotNull(), udf_of(normal_two_tailed)(F.coalesce("_z", F.lit(0.0))))).drop("_z")


def _off(a: str = "_a", b: str = "_b") -> Column:
    return F.col("_y") - F.col(a) * F.col("_x") - F.col(b)


def pole_regression(rows: DataFrame, by: Sequence[str], x: str = "x", angle: str = "phase", slope: float = 0.0, most: float = TURN, steps: int = 41, rounds: int = 20) -> DataFrame:
    """(by, n, slope, offset, r2): least squares to the nearest of three parallel lines a turn apart.

    From the fit of greatest resultant on, points go to their nearest line and
    the line to its points' least squares until the error stays, at most
    ``rounds`` times: the error falls each time, to a minimum near that fit.
    Of points at one position the slope is 0.
    """
    x_y = _pairs(rows, by, x, angle)
    fit = cut(resultant_regression(rows, by, x, angle, slope, most, steps).select(*by, F.col("slope").alias("_a"), F.col("offset").alias("_b"), F.lit(float("inf")).alias("_e")))
    for _ in range(rounds):
        k = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(_off() / TURN)))
        at = _joined(x_y, fit, by).withColumn("_z", F.col("_y") - TURN * k).withColumn("_d", _off() - TURN * k)
        sums = at.groupBy(*by).agg(F.covar_pop("_x", "_z").alias("_xz"), F.var_pop("_x").alias("_xx"), F.avg("_x").alias("_mx"), F.avg("_z").alias("_mz"), F.sum(F.col("_d") ** 2).alias("_sum"), F.first("_e").alias("_before"))
        a = F.when(F.col("_xx") > 0, F.col("_xz") / F.col("_xx")).otherwise(0.0)
        fit = cut(sums.select(*by, a.alias("_a"), (F.col("_mz") - a * F.col("_mx")).alias("_b"), F.col("_sum").alias("_e"), (F.col("_before") - F.col("_sum") > 1e-12 * F.col("_sum")).alias("_moves")))
        if fit.where("_moves").isEmpty():
            break
        fit = fit.drop("_moves")
    return _explained(x_y, fit.select(*by, "_a", "_b"), by, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(_off() / TURN))))


def _explained(x_y: DataFrame, fit: DataFrame, by: Sequence[str], turns: Column) -> DataFrame:
    """The fits with n and the share of the angles' squared distances to their mean direction that they explain."""
    mean = x_y.groupBy(*by).agg(C.circular_mean(F.col("_y")).alias("_m"))
    at = _joined(_joined(x_y, fit, by), mean, by)
    sums = at.groupBy(*by).agg(F.count("*").alias("n"), F.first("_a").alias("slope"), F.first("_b").alias("offset"), F.sum((_off() - TURN * turns) ** 2).alias("_e"), F.sum((F.col("_y") - F.col("_m")) ** 2).alias("_t"))
    return sums.select(*by, "n", "slope", "offset", (1 - F.col("_e") / F.nullif("_t", F.lit(0.0))).alias("r2"))


def _turned(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: float) -> int:
    """Weight of the pairs, in order of x, whose direction is at most ``theta``: those a turn by it puts out of order."""
    r = np.cos(theta) * y - np.sin(theta) * x
    place, total = np.arange(len(x)), 0
    for level in range(max(1, (len(x) - 1).bit_length())):
        node, right = place >> (level + 1), (place >> level) & 1
        order = np.lexsort((-right, r, node))
        upto = np.cumsum(np.where(right, w, 0)[order])
        before = np.concatenate([[0], upto])[np.searchsorted(node[order], node[order])]
        total += int((np.where(right, 0, w)[order] * (upto - before)).sum())
    return total


def median_slope(rows: DataFrame, by: Sequence[str], x: str, y: str, steps: int = 31, rounds: int = 10) -> DataFrame:
    """(by, slope): the median of the slopes of all pairs of rows at different x, without the pairs.

    Pairs whose direction is at most an angle are those that turning the plane
    by it puts out of order. They are counted at ``steps`` angles at once, and
    the angles between which the middle pair lies are divided again, ``rounds``
    times, to ``(steps + 1) ** -rounds`` of the half circle. A count sorts: pairs
    within a block of 4,096 neighbours in one task, others by running sums over
    halves of blocks, halves of those and so on, each cut into as many cells as
    it has blocks. So the work grows as rows times the logarithm of the blocks.
    Null if no two rows differ in x. Exact up to four thousand million rows a group.
    """
    points = _pairs(rows, by, x, y).groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w"))
    spans = points.groupBy(*by).agg(F.min("_x").alias("_x0"), (F.max("_x") - F.min("_x")).alias("_xr"), F.min("_y").alias("_y0"), (F.max("_y") - F.min("_y")).alias("_yr"), F.count("*").alias("_n"), F.sum("_w").alias("_all"))
    same = points.groupBy(*by, "_x").agg(F.sum("_w").alias("_s")).groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_same"))
    groups = cut(_joined(spans, same, by).withColumn("_pairs", F.expr("(_all * _all - _same) div 2")).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK)))
    scaled = _joined(points, groups, by).where("_pairs > 0").withColumn("_x", (F.col("_x") - F.col("_x0")) / F.col("_xr")).withColumn("_y", F.coalesce((F.col("_y") - F.col("_y0")) / F.nullif("_yr", F.lit(0.0)), F.lit(0.0)))
    # Places in order of x: within cells of x, after the rows of earlier cells.
    cells = scaled.select(*by, "_x", "_y", "_w", "_blocks", F.floor(F.col("_x") * F.col("_blocks")).alias("_cell"))
    sizes = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_c"))
    base = sizes.withColumn("_base", F.sum("_c").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_c")).drop("_c")
    local = cells.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_x", "_y")) - 1)
    placed = cut(_joined(local, base, [*by, "_cell"]).select(*by, "_x", "_y", "_w", "_blocks", (F.col("_place") + F.col("_base")).alias("_place")).withColumn("_block", F.expr(f"_place div {BLOCK}")))
    middles = F.array_distinct(F.array(F.expr("(_pairs + 1) div 2"), F.expr("_pairs div 2 + 1")))
    asked = groups.where("_pairs > 0").select(*by, F.explode(middles).alias("_k"), F.lit(-math.pi / 2).alias("_lo"), F.lit(math.pi / 2).alias("_hi"))
    keys = [*by, "_k"]
    schema = T.StructType([*[placed.schema[c] for c in by], T.StructField("_k", T.LongType()), T.StructField("_c", T.IntegerType()), T.StructField("_sum", T.LongType())])

    def within(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_place")
        a, b, w = (block[c].to_numpy() for c in ("_x", "_y", "_w"))
        lo, hi = block["_lo"].iat[0], block["_hi"].iat[0]
        made = block.iloc[[0] * steps][keys].reset_index(drop=True)
        made["_c"] = np.arange(1, steps + 1, dtype=np.int32)
        made["_sum"] = [_turned(a, b, w, lo + (hi - lo) * c / (steps + 1)) for c in made["_c"]]
        return made

    for _ in range(rounds):
        at = _joined(placed, asked, by)
        inside = at.groupBy(*keys, "_block").applyInPandas(within, schema)
        theta = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_c") / (steps + 1)
        halves = at.where("_blocks > 1").withColumn("_level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("_blocks")).cast("int") - 1)))
        halves = halves.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("_r", F.cos(theta) * F.col("_y") - F.sin(theta) * F.col("_x"))
        halves = halves.select(*keys, "_c", "_level", F.expr("shiftright(_block, _level + 1)").alias("_node"), F.expr("shiftright(_block, _level) & 1").alias("_right"), "_w", "_r", F.floor(F.col("_r") * F.least(F.col("_blocks"), F.pow(F.lit(2.0), F.col("_level") + 1))).alias("_cell"))
        node = [*keys, "_c", "_level", "_node"]
        amount = F.col("_w") * F.col("_right")
        sums = halves.groupBy(*node, "_cell").agg(F.sum(amount).alias("_s"))
        earlier = sums.withColumn("_base", F.sum("_s").over(Window.partitionBy(*node).orderBy("_cell")) - F.col("_s")).drop("_s")
        counted = _joined(halves.withColumn("_upto", F.sum(amount).over(Window.partitionBy(*node, "_cell").orderBy("_r"))), earlier, [*node, "_cell"])
        between = counted.groupBy(*keys, "_c").agg(F.sum(F.col("_w") * (1 - F.col("_right")) * (F.col("_upto") + F.col("_base"))).alias("_sum"))
        counts = inside.unionByName(between.select(*keys, F.col("_c").cast("int").alias("_c"), "_sum")).groupBy(*keys, "_c").agg(F.sum("_sum").alias("_sum"))
        first = counts.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_sum") >= F.col("_k"), F.col("_c"))), F.lit(steps + 1)).alias("_f"))
        part = (F.col("_hi") - F.col("_lo")) / (steps + 1)
        asked = cut(_joined(asked, first, keys).select(*keys, (F.col("_lo") + part * (F.col("_f") - 1)).alias("_lo"), (F.col("_lo") + part * F.col("_f")).alias("_hi")))
    slope = F.tan((F.col("_lo") + F.col("_hi")) / 2) * F.col("_yr") / F.col("_xr")
    middle = _joined(asked, groups.select(*by, "_xr", "_yr"), by).groupBy(*by).agg(F.avg(slope).alias("slope"))
    none = groups.where("_pairs = 0").select(*by, F.lit(None).cast("double").alias("slope"))
    return middle.unionByName(none)


def median_value(rows: DataFrame, by: Sequence[str], value: str, bins: int = 256, rounds: int = 7) -> DataFrame:
    """(by, median): found by counts in ``bins`` bins, the one that holds it divided again, ``rounds`` times."""
    v = rows.select(*by, C.finite(F.col(value)).alias("_v")).where(F.col("_v").isNotNull())
    ends = v.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    asked = cut(ends.select(*by, F.explode(F.array_distinct(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")))).alias("_k"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_below")))
    keys = [*by, "_k"]
    for _ in range(rounds):
        at = _joined(v, asked, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        b = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col("_v") - F.col("_lo")) / width * bins), F.lit(0)))
        # Ends are values that occur, so a bin is never empty by rounding.
        counts = at.groupBy(*keys, b.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_below").alias("_from"))
        upto = counts.withColumn("_upto", F.col("_from") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin")))  # at most so many bins
        held = upto.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
        asked = cut(held.select(*keys, "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_below")))
    return asked.groupBy(*by).agg(F.avg((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def theil_sen_regression(rows: DataFrame, by: Sequence[str], x: str = "x", angle: str = "phase", slope: float = 0.0, most: float = TURN, steps: int = 41) -> DataFrame:
    """(by, n, slope, offset, r2): median slope of all pairs, once angles are moved by whole turns to the parallel lines' fit, and median of what is left.

    All pairs count. Pairs at one position have no slope; of points at one position only the slope is null, and so is the rest.
    """
    x_y = _pairs(rows, by, x, angle)
    pole = cut(pole_regression(rows, by, x, angle, slope, most, steps).select(*by, F.col("slope").alias("_a"), F.col("offset").alias("_b")))
    moved = _joined(x_y, pole, by).select(*by, "_x", (F.col("_y") - TURN * F.round(_off() / TURN)).alias("_z"))
    slopes = cut(median_slope(moved, by, "_x", "_z").select(*by, F.col("slope").alias("_a")))
    offsets = median_value(_joined(moved, slopes, by).select(*by, (F.col("_z") - F.col("_a") * F.col("_x")).alias("_left")), by, "_left")
    fit = _left(slopes, offsets.select(*by, F.col("median").alias("_b")), by)
    pole = pole.withColumnsRenamed({"_a": "_pa", "_b": "_pb"})
    return _explained(_joined(x_y, pole, by), fit, by, F.round(_off("_pa", "_pb") / TURN))


def _left(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """As ``_joined``, but rows without a group stay."""
    if not by:
        return rows.withColumn("_one", F.lit(1)).join(F.broadcast(groups.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    right = groups.withColumnsRenamed({c: f"_right_{c}" for c in by})
    return rows.join(right, [rows[c].eqNullSafe(right[f"_right_{c}"]) for c in by], "left").drop(*[f"_right_{c}" for c in by])
