"""Group statistics and tests, each one aggregation and a closed form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.distributions import chi2_tail, f_tail, normal_two_tailed, t_two_tailed, udf_of
from .regression import _joined
from .series import join_cells, running_sum


def circular_summary(rows: DataFrame, angle: str, by: Sequence[str]) -> DataFrame:
    """n, mean direction, resultant, variance, concentration, Rayleigh p, PPC of each group."""
    a = F.col(angle)
    base = rows.groupBy(*by).agg(F.count(a).alias("n"), C.circular_mean(a).alias("direction"), C.resultant(a).alias("r"), C.pairwise_phase_consistency(a).alias("ppc"))
    return base.withColumns({"variance": 1 - F.col("r"), "kappa": C.concentration(F.col("r"), F.col("n")), "p": C.rayleigh_p(F.col("r"), F.col("n"))})


def circular_histogram(rows: DataFrame, angle: str, n: int, by: Sequence[str]) -> DataFrame:
    """Share of each group in ``n`` bins of [0, 2 pi)."""
    import math

    binned = rows.withColumn("bin", C.bin_index(C.wrap(F.col(angle), False), 0, 2 * math.pi, n)).where("bin is not null")
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def bartlett(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Bartlett's statistic of equal variances with its p-value."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.var_samp(value).alias("v")).where("n > 1")
    s = g.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        (F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("pooled"),
        F.sum((F.col("n") - 1) * F.log("v")).alias("logs"),
        F.sum(1 / (F.col("n") - 1)).alias("inverse"),
        F.sum(F.col("n") - 1).alias("df"),
    )
    top = F.col("df") * F.log("pooled") - F.col("logs")
    bottom = 1 + (F.col("inverse") - 1 / F.col("df")) / (3 * (F.col("k") - 1))
    made = s.select(F.col("k"), (top / bottom).alias("statistic"))
    return made.withColumn("p", udf_of(chi2_tail)(F.col("statistic"), F.col("k") - 1))


def variance_ratio(rows: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """F of the variances of two groups, one-sided p."""
    x = lambda g: F.when(F.col(group) == g, F.col(value))
    s = rows.agg(F.var_samp(x(a)).alias("va"), F.var_samp(x(b)).alias("vb"), F.count(x(a)).alias("na"), F.count(x(b)).alias("nb"))
    made = s.select((F.col("va") / F.col("vb")).alias("f"), "na", "nb")
    return made.withColumn("p", udf_of(f_tail)(F.col("f"), F.col("na") - 1, F.col("nb") - 1))


def compare_slopes(rows: DataFrame, x: str, y: str, group: str, a, b) -> DataFrame:
    """t of the difference of two regression slopes, two-sided p."""
    g = rows.where(F.col(group).isin(a, b)).groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)).alias("rest"), F.regr_count(y, x).alias("n"))
    pick = lambda k, c: F.max(F.when(F.col(group) == k, F.col(c)))
    s = g.agg(*[pick(k, c).alias(f"{c}_{i}") for i, k in enumerate((a, b)) for c in ("slope", "sxx", "rest", "n")])
    df = F.col("n_0") + F.col("n_1") - 4
    spread = F.sqrt((F.col("rest_0") + F.col("rest_1")) / df * (1 / F.col("sxx_0") + 1 / F.col("sxx_1")))
    made = s.select(((F.col("slope_0") - F.col("slope_1")) / spread).alias("t_value"), df.alias("df"))
    return made.withColumn("p", udf_of(t_two_tailed)("t_value", "df"))


def proportions(rows: DataFrame, flag: str, group: str, a, b) -> DataFrame:
    """z and two-sided p of a flag's shares in two groups."""
    one = lambda g: F.sum(F.when(F.col(group) == g, F.col(flag).cast("double")))
    n = lambda g: F.count(F.when(F.col(group) == g, F.col(flag)))
    made = rows.agg(one(a).alias("s1"), n(a).alias("n1"), one(b).alias("s0"), n(b).alias("n0"))
    z = made.withColumn("z", C.binomial_z(*[F.col(c) for c in ("s1", "n1", "s0", "n0")]))
    return z.withColumn("p", udf_of(normal_two_tailed)("z"))


def residuals(rows: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rows with ``residual`` of y after regression on x within each group."""
    fit = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return rows.join(fit, list(by)).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


RANK_CELLS = 1024  # into which a group's range is cut to rank its values


def _mean_ranks(values: DataFrame, by: Sequence[str], c: str, name: str) -> DataFrame:
    """(by, c, name): mean rank of each value of a group, of numbers; NaN is above all.

    Values are counted first, running counts are made within cells of the
    group's range, and one sum a cell is carried on.
    """
    v = F.col(c).cast("double")
    counts = values.groupBy(*by, c).agg(F.sum("_n").alias("_n"))
    ends = counts.groupBy(*by).agg(F.min(C.finite(F.col(c))).alias("_lo"), F.max(C.finite(F.col(c))).alias("_hi"))
    place = F.floor((v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * RANK_CELLS)
    cell = F.when(F.isnan(v), RANK_CELLS + 1).when(v == float("inf"), RANK_CELLS).when(v == float("-inf"), -1).otherwise(F.least(F.coalesce(place, F.lit(0)), F.lit(RANK_CELLS - 1)))
    local = _joined(counts, ends, by).select(*by, c, "_n", cell.cast("bigint").alias("_cell"))
    upto = local.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy(c)))
    sums = local.groupBy(*by, "_cell").agg(F.sum("_n").alias("_sum"))
    based = sums.select(*by, "_cell", (F.sum("_sum").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_sum")).alias("_base"))
    return join_cells(upto, based, by).select(*by, c, (F.col("_base") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by, rho, n): rank correlation of two numbers with mean ranks for ties, by group. Rows where either is null take no part.

    Equal pairs are counted before they meet their ranks, and no window holds a group's values.
    """
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_n"))
    made = _joined(_joined(pairs, _mean_ranks(pairs, by, x, "_x"), [*by, x]), _mean_ranks(pairs, by, y, "_y"), [*by, y])
    w, a, b = F.col("_n"), F.col("_x"), F.col("_y")
    total = made.groupBy(*by).agg(F.sum(w).alias("n"))
    # Ranks run from 1 to n, so both means are known before any sum is made.
    middle = (F.col("n") + 1) / 2
    dx, dy = a - middle, b - middle
    sums = _joined(made, total, by).groupBy(*by).agg(F.first("n").alias("n"), F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy"))
    return sums.select(*by, (F.col("_xy") / F.nullif(F.sqrt("_xx") * F.sqrt("_yy"), F.lit(0.0))).alias("rho"), "n")


def zscores(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows with ``z`` of a value within its group."""
    moments = rows.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_deviation"))
    return _joined(rows, moments, by).withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_deviation")).drop("_mean", "_deviation")


def without_outliers(rows: DataFrame, value: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Rows within ``reach`` quartile ranges of their group's quartiles."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    joined = _joined(rows, q, by).withColumn("_d", reach * (F.col("_q")[1] - F.col("_q")[0]))
    return joined.where((F.col(value) >= F.col("_q")[0] - F.col("_d")) & (F.col(value) <= F.col("_q")[1] + F.col("_d"))).drop("_q", "_d")


def distribution_distance(rows: DataFrame, value: str, group: str, a, b, by: Sequence[str], cell: float | None = None) -> DataFrame:
    """Watson's U2 and the largest gap of two empirical distributions, by key.

    Equal values are summed before the running counts, so ties are one step.
    With a ``cell``, a length of the value, running counts are made in cells,
    so that no task holds a key's values.
    """
    x = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    steps = x.groupBy(*by, value).agg(F.count(F.when(F.col(group) == a, 1)).alias("ca"), F.count(F.when(F.col(group) == b, 1)).alias("cb"))
    totals = steps.groupBy(*by).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    upto = running_sum(running_sum(steps, F.col("ca"), by, value, cell, "_a"), F.col("cb"), by, value, cell, "_b")
    d = _joined(upto, totals, by).withColumn("d", F.col("_a") / F.col("na") - F.col("_b") / F.col("nb"))
    n = F.col("ca") + F.col("cb")
    s = d.groupBy(*by).agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum(n * F.col("d")).alias("s"), F.sum(n * F.col("d") ** 2).alias("q"), F.max(F.abs("d")).alias("gap"))
    total = F.col("na") + F.col("nb")
    u2 = F.col("na") * F.col("nb") / (total * total) * (F.col("q") - F.col("s") ** 2 / total)
    return s.select(*by, "na", "nb", u2.alias("u2"), "gap")


def gap_tail(gap, na, nb):
    """Chance of a larger gap of two samples of one distribution (asymptotic, the first 101 terms)."""
    root = F.sqrt(na * nb / (na + nb))
    reach = gap * (root + 0.12 + 0.11 / root)
    terms = F.transform(F.sequence(F.lit(1), F.lit(101)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * reach * reach * j * j))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def field_skewness(fields: DataFrame, by: Sequence[str], n: int, bin: str = "bin", rate: str = "rate") -> DataFrame:
    """(keys, skewness) of fields over bins 1 to ``n``, as distributions of rates, without its bias.

    Absent bins are zero; a field without a rate, or all in one bin, has a null.
    """
    x, w = F.col(bin).cast("double"), F.col(rate)
    sums = fields.groupBy(*by).agg(F.sum(w).alias("_0"), *[F.sum(w * x**k).alias(f"_{k}") for k in (1, 2, 3)])
    m, q, c = (F.try_divide(F.col(f"_{k}"), F.col("_0")) for k in (1, 2, 3))
    spread = q - m * m
    third = c - 3 * m * q + 2 * m * m * m
    return sums.select(*by, F.when((F.col("_0") > 0) & (spread > 1e-12), third / F.pow(spread, 1.5) * (math.sqrt(n * (n - 1)) / (n - 2))).alias("skewness"))


def compare_skewness(fields: DataFrame, unit: Sequence[str], group: str, a, b, n: int, by: Sequence[str] = (), bin: str = "bin", rate: str = "rate") -> DataFrame:
    """(keys, na, nb, mean_a, mean_b, gap, p): do the fields of two conditions lean alike?

    ``gap`` is the largest one of the two distributions of skewness over
    units, ``p`` the chance of a larger one.
    """
    skew = field_skewness(fields.where(F.col(group).isin(a, b)), [*by, *unit, group], n, bin, rate).where("skewness is not null")
    one = skew.withColumn("_all", F.lit(1)) if not by else skew
    keys = list(by) or ["_all"]
    means = one.groupBy(*keys).agg(F.avg(F.when(F.col(group) == a, F.col("skewness"))).alias("mean_a"), F.avg(F.when(F.col(group) == b, F.col("skewness"))).alias("mean_b"))
    told = distribution_distance(one, "skewness", group, a, b, keys, cell=0.05).join(means, keys)
    return told.select(*by, "na", "nb", "mean_a", "mean_b", "gap", gap_tail(F.col("gap"), F.col("na"), F.col("nb")).alias("p"))


def otsu(rows: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """The bin above which a value is split with the largest variance between classes."""
    counts = rows.groupBy(C.bin_index(F.col(value), low, high, n).alias("bin")).agg(F.count("*").alias("c")).where("bin is not null")
    # at most n rows
    run = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    m = F.col("bin") * F.col("c")
    s = counts.withColumns({"w": F.sum("c").over(run), "m": F.sum(m).over(run), "tw": F.sum("c").over(whole), "tm": F.sum(m).over(whole)}).where("w < tw")
    between = F.pow(F.col("tm") * F.col("w") / F.col("tw") - F.col("m"), 2) / (F.col("w") * (F.col("tw") - F.col("w")))
    return s.agg(F.max_by("bin", F.struct(between, -F.col("bin"))).alias("bin"))


def circular_anova(rows: DataFrame, angle: str, group: str) -> DataFrame:
    """Equal mean directions of groups (Watson and Williams): statistic, degrees of freedom, p.

    Statistics at a mean concentration between 2 and 10 get Stephens' factor.
    """
    a = F.col(angle)
    g = rows.where(a.isNotNull()).groupBy(group).agg(F.count(a).alias("n"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"))
    each = g.withColumn("r", F.hypot("c", "s") / F.col("n")).withColumn("k", C.concentration(F.col("r"), F.col("n")))
    sums = each.agg(F.count("*").alias("q"), F.sum("n").alias("n"), F.hypot(F.sum("c"), F.sum("s")).alias("whole"), F.sum(F.col("n") * F.col("r")).alias("within"), (F.sum(F.col("n") * F.col("k")) / F.sum("n")).alias("kappa"))
    ratio = (F.col("n") - F.col("q")) / (F.col("q") - 1) * (F.col("within") - F.col("whole")) / (F.col("n") - F.col("within"))
    factor = F.when((F.col("kappa") > 2) & (F.col("kappa") < 10), 1 + 3 / (8 * F.col("kappa"))).otherwise(1.0)
    made = sums.select((ratio * factor).alias("f"), (F.col("q") - 1).alias("df1"), (F.col("n") - F.col("q")).alias("df2"))
    return made.withColumn("p", udf_of(f_tail)("f", "df1", "df2"))


def circular_interval(rows: DataFrame, angle: str, by: Sequence[str], z: float = 1.959963984540054) -> DataFrame:
    """Mean direction with its interval of ``z`` standard errors (large samples, Fisher): n, mean, low, high."""
    a = F.col(angle)
    s = rows.groupBy(*by).agg(F.count(a).alias("n"), C.circular_mean(a).alias("mean"), C.resultant(a).alias("r1"), C.resultant(2 * a).alias("r2"))
    reach = z * F.sqrt((1 - F.col("r2")) / (2 * F.col("r1") ** 2) / F.col("n"))
    error = F.when(reach < 1, F.asin(F.least(reach, F.lit(1.0)))).otherwise(F.lit(3.141592653589793))
    return s.select(*by, "n", "mean", (F.col("mean") - error).alias("low"), (F.col("mean") + error).alias("high"))


def multinomial_intervals(rows: DataFrame, kind: str, alpha: float = 0.05) -> DataFrame:
    """Share of each kind with simultaneous bounds (Fitzpatrick and Scott): n, share, low, high."""
    wide = {0.1: 1.0, 0.05: 1.13, 0.01: 1.4}
    if alpha not in wide:
        raise ValueError(f"alpha must be one of {sorted(wide)}")
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    share, b = F.col("n") / F.col("_all"), wide[alpha] / F.sqrt("_all")
    joined = counts.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")  # one row
    return joined.select(kind, "n", share.alias("share"), F.greatest(share - b, F.lit(0.0)).alias("low"), F.least(share + b, F.lit(1.0)).alias("high"))


def cdf_at(samples: DataFrame, points: DataFrame, value: str, by: Sequence[str], cell: float | None = None) -> DataFrame:
    """Points with ``p``, the share of the samples of equal keys below their value.

    With a ``cell``, a length of the value, one key's values are dealt over tasks.
    """
    from .series import running_sum

    counts = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    asked = points.select(*by, value).where(F.col(value).isNotNull()).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    steps = counts.unionByName(asked).groupBy(*by, value).agg(F.sum("_n").alias("_n"))
    below = running_sum(steps, F.col("_n"), by, value, cell, "_upto").withColumn("_below", F.col("_upto") - F.col("_n")).drop("_upto", "_n")
    whole = samples.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    found = points.join(below, [*by, value])
    whole = found.join(whole, list(by)) if by else found.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return whole.withColumn("p", F.col("_below") / F.col("_all")).drop("_below", "_all")


def residual_correlation(rows: DataFrame, x: str, y: str, control: str, by: Sequence[str]) -> DataFrame:
    """Correlation of what is left of x and y after regression on ``control``, by group."""
    left = residuals(residuals(rows, control, x, by).withColumnRenamed("residual", "_rx"), control, y, by)
    return left.groupBy(*by).agg(F.corr("_rx", "residual").alias("r"), F.count("*").alias("n"))
