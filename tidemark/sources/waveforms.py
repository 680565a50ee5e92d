"""Waveforms of spikes as a Spark data source, in byte ranges of records.

A record is one spike's samples, all channels of a sample together. Options:
``path``, ``channels``, ``samples``, ``precision`` (default int16), ``spikes``
(comma-separated numbers of records from 0) and ``chunk`` (records a
partition). Filters on ``spike`` (equal, in a list, bounds) reach the reader
where ``spark.sql.python.filterPushdown.enabled`` is set; only the records
asked for are read, in runs of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .binary import PRECISIONS, _open


@dataclass
class Records(InputPartition):
    """Runs of neighbouring records: (first, how many)."""

    runs: tuple


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spike_waveforms"

    def schema(self) -> str:
        kind = "double" if self.options.get("precision", "int16").startswith("float") else "int"
        return f"spike long, waveform array<array<{kind}>>"

    def reader(self, schema) -> WaveformReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else WaveformReader)(self.options)


class WaveformReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.channels, self.samples = int(options["channels"]), int(options["samples"])
        precision = options.get("precision", "int16")
        if precision not in PRECISIONS:
            raise ValueError(f"unknown precision: {precision}")
        self.kind = np.dtype(precision).newbyteorder("<")
        self.width = self.channels * self.samples * self.kind.itemsize
        listed = [int(x) for x in options.get("spikes", "").split(",") if x]
        self.asked: set[int] | None = set(listed) if "spikes" in options else None
        self.low, self.high = 0, None

    def partitions(self) -> list[Records]:
        system, where = _open(self.options["path"])
        n = system.get_file_info(where).size // self.width
        low, high = self.low, n if self.high is None else min(n, self.high)
        chunk = int(self.options.get("chunk", 50_000))
        if self.asked is None:
            return [Records(((a, min(chunk, high - a)),)) for a in range(low, high, chunk)] or [Records(())]
        wanted = np.array(sorted(x for x in self.asked if x is not None and low <= x < high), np.int64)
        made = []
        for a in range(0, len(wanted), chunk):
            part = wanted[a : a + chunk]
            runs = np.split(part, np.flatnonzero(np.diff(part) > 1) + 1)
            made.append(Records(tuple((int(r[0]), len(r)) for r in runs)))
        return made or [Records(())]

    def read(self, partition: Records):
        import pyarrow as pa

        system, where = _open(self.options["path"])
        with system.open_input_file(where) as source:
            for first, count in partition.runs:
                for a in range(first, first + count, 10_000):
                    n = min(10_000, first + count - a)
                    source.seek(a * self.width)
                    x = np.frombuffer(source.read(n * self.width), self.kind).reshape(n, self.samples, self.channels)
                    flat = np.ascontiguousarray(x.transpose(0, 2, 1)).ravel().astype(np.float64 if self.kind.kind == "f" else np.int32)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.channels * self.samples + 1, self.samples), pa.int32()), pa.array(flat))
                    shaped = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.channels + 1, self.channels), pa.int32()), rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), shaped], ["spike", "waveform"])


class FilteredReader(WaveformReader):
    """Where Spark allows it, filters choose the records."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep what names records; Spark applies the rest."""
        for f in filters:
            if getattr(f, "attribute", None) != ("spike",):
                yield f
            elif isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked = named if self.asked is None else self.asked & named
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f


def read_waveforms(spark: SparkSession, path: str, channels: int, samples: int, spikes: Iterable[int] | None = None, **options) -> DataFrame:
    """(spike, waveform): a list of channels, each with its samples; ``spikes`` names records to read."""
    spark.dataSource.register(WaveformSource)
    allowed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("spike_waveforms").option("path", path).option("channels", channels).option("samples", samples).option("pushdown", allowed)
    if spikes is not None:
        reader = reader.option("spikes", ",".join(map(str, spikes)))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_amplitudes(spark: SparkSession, path: str, times: DataFrame, channels: int, samples: int, peak: int, **options) -> DataFrame:
    """``times`` (spike, ...) with ``amplitudes``, each channel's value at sample ``peak``, counted from 1."""
    found = read_waveforms(spark, path, channels, samples, **options)
    return times.join(found.select("spike", F.transform("waveform", lambda x: F.element_at(x, peak)).alias("amplitudes")), "spike")
