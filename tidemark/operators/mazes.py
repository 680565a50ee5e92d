"""Scores of radial-maze visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def maze_scores(visits: DataFrame, by: Sequence[str], baited: Sequence) -> DataFrame:
    """Visits, rewards, errors and performance of each trial.

    ``arm`` is visited in order of ``visit``. The first visit to a baited arm
    is a reward, to another arm a reference error; any later one is a working
    error. ``performance`` is rewards over visits.
    """
    k = F.row_number().over(Window.partitionBy(*by, "arm").orderBy("visit"))
    marked = visits.withColumn("_k", k).withColumn("_baited", F.col("arm").isin(list(baited)))
    count = lambda c: F.count(F.when(c, 1))
    first = F.col("_k") == 1
    sums = marked.groupBy(*by).agg(F.count("*").alias("visits"), count(first & F.col("_baited")).alias("rewards"), count(~first).alias("working"), count(first & ~F.col("_baited")).alias("reference"))
    made = sums.withColumn("performance", F.col("rewards") / F.col("visits"))
    return made.withColumn("errors_index", F.sqrt(F.col("working") + F.col("reference") + 1)).withColumn("performance_index", F.asin(F.sqrt("performance")))


def turns(visits: DataFrame, by: Sequence[str], arms: int) -> DataFrame:
    """How often each turn, the arm less the previous one, is taken in a trial."""
    before = F.lag("arm").over(Window.partitionBy(*by).orderBy("visit"))
    turn = F.pmod(F.col("arm") - before + arms // 2, F.lit(arms)) - arms // 2
    return visits.withColumn("turn", turn).where("turn is not null").groupBy(*by, "turn").agg(F.count("*").alias("n"))
