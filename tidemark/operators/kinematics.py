"""Positions: LED cleaning, head direction, velocity, zones, phase precession."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bin_index, clip, wrap
from .series import windowed


def clean_leds(positions: DataFrame, least: float, most: float) -> DataFrame:
    """Rows whose two LEDs are detected and between ``least`` and ``most`` apart."""
    apart = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    return positions.where(apart.between(least, most))


def normalised(positions: DataFrame, width: float, height: float) -> DataFrame:
    """Coordinates clipped to the video and scaled to 0..1."""
    names = [c for c in ("x", "y", "x2", "y2") if c in positions.columns]
    return positions.withColumns({c: clip(F.col(c), 0.0, height if c.startswith("y") else width) / (height if c.startswith("y") else width) for c in names})


def head_direction(positions: DataFrame) -> DataFrame:
    """Add ``angle`` of the line from the first LED to the second."""
    return positions.withColumn("angle", F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")))


def linear_velocity(positions: DataFrame, by: Sequence[str], t: str = "t", cell: float | None = None) -> DataFrame:
    """Add ``velocity`` by central differences (one-sided at the ends)."""

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(t)
        near = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.col(c))
        d = lambda c: near(c, -1) - near(c, 1)
        return rows.withColumn("velocity", F.hypot(d("x"), d("y")) / F.nullif(d(t), F.lit(0.0)))

    return windowed(positions, by, t, cell, 1, made)


def angular_velocity(angles: DataFrame, by: Sequence[str], angle: str = "angle", t: str = "t", cell: float | None = None) -> DataFrame:
    """Add ``velocity`` of an angle, the difference taken the short way round."""

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(t)
        d = wrap(F.lead(angle).over(w) - F.col(angle))
        return rows.withColumn("velocity", d / (F.lead(t).over(w) - F.col(t)))

    return windowed(angles, by, t, cell, 1, made)


def distance(a: Column, b: Column, circular: bool = False) -> Column:
    """Distance of two coordinates in 0..1, on a circle the shorter way."""
    d = F.abs(a - b)
    return F.least(d, 1 - d) if circular else d


def in_zone(positions: DataFrame, zone: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Add ``in_zone``: whether the cell of a position is in the zone, a table of cells.

    The zone has at most one row a cell of the grid, so it is broadcast.
    """
    binned = positions.withColumns({f"_{c}": bin_index(F.col(c), lo, hi, n) for c, (lo, hi, n) in axes.items()})
    cells = zone.select(*[F.col(c).alias(f"_{c}") for c in axes]).distinct().withColumn("_in", F.lit(True))
    joined = binned.join(F.broadcast(cells), [f"_{c}" for c in axes], "left")
    return joined.withColumn("in_zone", F.coalesce("_in", F.lit(False))).select(*positions.columns, "in_zone")


def phase_precession(spikes: DataFrame, by: Sequence[str], x: str = "x", phase: str = "phase", most: float = 1.0, steps: int = 401) -> DataFrame:
    """Slope (turns per unit of x), offset and strength of a circular-linear regression.

    The slope of greatest mean resultant among ``steps`` between -most and
    most; each is one pair of sums, so a group's rows are read once.
    """
    slopes = [-most + 2 * most * k / (steps - 1) for k in range(steps)]
    turned = lambda s: F.col(phase) - 2 * math.pi * s * F.col(x)
    sums = spikes.groupBy(*by).agg(F.count(phase).alias("n"), *[F.avg(f(turned(s))).alias(f"_{name}{k}") for k, s in enumerate(slopes) for name, f in (("c", F.cos), ("s", F.sin))])
    fits = F.array(*[F.struct(F.hypot(f"_c{k}", f"_s{k}").alias("r"), F.lit(s).alias("slope"), F.atan2(f"_s{k}", f"_c{k}").alias("offset")) for k, s in enumerate(slopes)])
    return sums.select(*by, "n", F.array_max(fits).alias("_f")).select(*by, "n", "_f.slope", "_f.offset", "_f.r")


def mango(positions: DataFrame, spikes: DataFrame, by: Sequence[str], width: float, axes: dict[str, tuple[float, float, int]], t: str = "t", cell: float | None = None) -> DataFrame:
    """Counts of spikes on a grid of speed and acceleration around each sample."""
    from .joins import range_join

    def made(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(t)
        slope = (F.lead("velocity").over(w) - F.lag("velocity").over(w)) / (F.lead(t).over(w) - F.lag(t).over(w))
        return rows.withColumns({"acceleration": slope, "stop": F.lead(t).over(w)})

    steps = windowed(linear_velocity(positions, by, t, cell), by, t, cell, 1, made).withColumnRenamed(t, "start")
    held = range_join(spikes.select(*by, t), steps, width, by, t).where(F.col(t) < F.col("stop"))
    binned = held.select(*[bin_index(F.col(c), lo, hi, n).alias(c) for c, (lo, hi, n) in axes.items()])
    return binned.groupBy(*axes).agg(F.count("*").alias("n"))
