"""Resampling tests: permutations, bootstraps and jitters, by repetition.

Each repetition is a key; rows are copied to the repetitions and drawn or
shuffled by hashes of (row, repetition, seed), which gives the same result on
every run and after a lost executor. No repetition has all its rows in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 8
MOST_EDGES = 1 << 20


def repeated(rows: DataFrame, n: int) -> DataFrame:
    """Rows with ``repetition`` 1..n."""
    return rows.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(n))))


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11) / float(2**53)


def bootstrap_means(rows: DataFrame, value: str, key: str, by: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """(by, repetition, mean) under Poisson resampling.

    Every row gets a Poisson weight of mean one in each repetition, the
    streaming form of drawing with replacement.
    """
    u = uniform(F.col(key), F.col("repetition"), seed=seed)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    drawn = repeated(rows, n).withColumn("_w", weight)
    return drawn.groupBy(*by, "repetition").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"))


def interval(statistics: DataFrame, value: str, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """(by, low, high): quantiles of a repeated statistic."""
    edge = (1 - level) / 2
    return statistics.groupBy(*by).agg(F.percentile(value, F.lit(edge)).alias("low"), F.percentile(value, F.lit(1 - edge)).alias("high"))


def permutation_difference(rows: DataFrame, value: str, group: str, a, b, key: str, by: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """(by, difference, p): difference of two groups' means against shuffled labels.

    A shuffle gives the label ``a`` to the right number of rows of lowest hash.
    Counts by bins of the hash tell in which bin that number is reached; rows
    of lower bins are only added up, and those of that bin, one in 256, ranked.
    The bins that are asked for, one a repetition and group, are broadcast if
    they are few; the copies of the rows, ``n`` times as many as the table has, never are.
    """
    x = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    observed = x.groupBy(*by).agg((mean(a) - mean(b)).alias("difference"), F.count(F.when(F.col(group) == a, 1)).alias("_na"), F.count("*").alias("_all"), F.sum(value).alias("_whole"))
    h = F.xxhash64(key, "repetition", F.lit(seed))
    # a small file is one task, and its copies are many
    dealt = x.select(*by, key, F.col(value).alias("_v")).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    mixed = repeated(dealt, n).withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 64 - HASH_BITS))
    keys = [*by, "repetition"]
    bins = mixed.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.sum("_v").alias("_s"))
    upto = Window.partitionBy(*keys).orderBy("_bin")
    running = bins.select(*keys, "_bin", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), "_c", F.coalesce(F.sum("_s").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_below"))
    at = _join(running, observed, by).where((F.col("_before") < F.col("_na")) & (F.col("_before") + F.col("_c") >= F.col("_na")))
    edge = at.select(*keys, "_bin", (F.col("_na") - F.col("_before")).alias("_k"), "_below")
    few = not by or observed.count() * n <= MOST_EDGES
    ranked = mixed.join(F.broadcast(edge) if few else edge.hint("shuffle_merge"), [*keys, "_bin"]).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key)))
    drawn = ranked.groupBy(*keys).agg((F.first("_below") + F.sum(F.when(F.col("_r") <= F.col("_k"), F.col("_v")).otherwise(0.0))).alias("_s"))
    other = (F.col("_whole") - F.col("_s")) / (F.col("_all") - F.col("_na"))
    tested = _join(drawn, observed, by).withColumn("_beyond", (F.abs(F.col("_s") / F.col("_na") - other) >= F.abs("difference") * (1 - 1e-12)).cast("int"))
    return tested.groupBy(*by).agg(F.first("difference").alias("difference"), ((F.sum("_beyond") + 1) / (F.count("*") + 1)).alias("p"))


def _join(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their group's columns; without keys there is one group, a row of fixed size."""
    return rows.join(groups, list(by)) if by else rows.join(F.broadcast(groups.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")


def jittered(points: DataFrame, key: str, reach: float, n: int, t: str = "t", seed: int = 0) -> DataFrame:
    """Points with ``repetition``, each moved by up to ``reach`` either way."""
    move = (2 * uniform(F.col(key), F.col("repetition"), seed=seed) - 1) * reach
    return repeated(points, n).withColumn(t, F.col(t) + move)


def poisson_train(spark, by: str, units: int, rate: float, length: float, seed: int = 0) -> DataFrame:
    """(unit, t): independent uniform points, ``rate * length`` for each unit."""
    n = round(rate * length)
    cells = spark.range(units * n).select((F.col("id") % units).alias(by), F.col("id"))
    return cells.select(by, (uniform(F.col("id"), seed=seed) * length).alias("t"))
