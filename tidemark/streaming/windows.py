"""Streaming forms: rates in sliding windows and bursts as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(stream: DataFrame, unit: str, width: str, step: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Points of each unit in sliding windows; rows later than ``late`` are dropped."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, width, step), unit).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), unit, "n")


def bursts(stream: DataFrame, unit: str, gap: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Runs of points of a unit without a gap of ``gap`` or more."""
    run = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), unit).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return run.select(unit, "first", "last", "n")


def synchronised(samples: DataFrame, events: DataFrame, unit: str, before: str, after: str, late: str = "10 minutes") -> DataFrame:
    """Samples around events of the same unit, as a stream-stream range join.

    Watermarks on both sides and the time bounds let old state go.
    """
    s = samples.withWatermark("ts", late).alias("s")
    e = events.withWatermark("ts", late).alias("e")
    near = F.expr(f"s.{unit} = e.{unit} and s.ts >= e.ts - interval {before} and s.ts <= e.ts + interval {after}")
    joined = s.join(e, near)
    return joined.select(F.col(f"s.{unit}").alias(unit), F.col("e.ts").alias("event_ts"), F.col("s.ts").alias("ts"), F.expr("(unix_micros(s.ts) - unix_micros(e.ts)) / 1e6").alias("relative"))
