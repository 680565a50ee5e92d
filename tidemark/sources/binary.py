"""Multiplexed binary signals as a Spark data source, in byte-range partitions.

Options: ``path``, ``channels``, ``rate`` (Hz), ``precision`` (numpy type,
default int16), ``select`` (comma-separated channels from 0), ``start`` and
``duration`` in seconds or ``offset`` and ``records``, ``skip`` (records left
out after each one read) and ``chunk`` (records a partition).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PRECISIONS = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64")


@dataclass
class Stretch(InputPartition):
    """Records of a signal: how many, from which, and the files that hold them with the first record there."""

    first: int
    count: int
    files: tuple


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return system, where


class BinarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_multiplexed"

    def _selected(self) -> list[int]:
        n = int(self.options["channels"])
        chosen = [int(c) for c in self.options.get("select", "").split(",") if c] or list(range(n))
        if any(not 0 <= c < n for c in chosen):
            raise ValueError("a channel outside the file")
        return chosen

    def schema(self) -> str:
        kind = "double" if self.options.get("precision", "int16").startswith("float") else "long"
        return "t double, " + ", ".join(f"ch{c} {kind}" for c in self._selected())

    def reader(self, schema) -> BinaryReader:
        return BinaryReader(self.options, self._selected())


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict, selected: list[int]) -> None:
        self.options, self.selected = dict(options), selected
        self.channels = int(options["channels"])
        self.rate = float(options["rate"])
        precision = options.get("precision", "int16")
        if precision not in PRECISIONS:
            raise ValueError(f"unknown precision: {precision}")
        self.kind = np.dtype(precision).newbyteorder("<")
        self.width = self.channels * self.kind.itemsize
        seconds = {"start", "duration"} & set(options)
        if seconds and {"offset", "records"} & set(options):
            raise ValueError("give start and duration, or offset and records, not both")
        self.step = int(options.get("skip", 0)) + 1

    def _files(self) -> list[tuple[str, int]]:
        """(file, records) of the signal: one file, or the parts of a folder in order of their names."""
        from pyarrow import fs

        system, where = _open(self.options["path"])
        found = system.get_file_info(where)
        if found.type != fs.FileType.Directory:
            return [(where, found.size // self.width)]
        parts = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(where)) if f.base_name.endswith(".dat"))
        return [(p, size // self.width) for p, size in parts]

    def partitions(self) -> list[Stretch]:
        files = self._files()
        begins = np.r_[0, np.cumsum([n for _, n in files])].astype(int).tolist()
        o = self.options
        first = int(o["offset"]) if "offset" in o else round(float(o.get("start", 0)) * self.rate)
        end = begins[-1]
        if "records" in o:
            end = min(end, first + int(o["records"]) * self.step)
        elif "duration" in o:
            end = min(end, first + round(float(o["duration"]) * self.rate))
        chunk = max(int(o.get("chunk", 100_000)) // self.step, 1) * self.step
        made = []
        for a in range(first, end, chunk):
            n = min(chunk, end - a)
            held = tuple((path, begin) for (path, size), begin in zip(files, begins) if begin < a + n and a < begin + size)
            made.append(Stretch(a, n, held))
        return made or [Stretch(0, 0, ())]

    def read(self, partition: Stretch):
        import pyarrow as pa

        if not partition.count:
            return
        system, _ = _open(self.options["path"])
        pieces, end = [], partition.first + partition.count
        for path, begin in partition.files:
            with system.open_input_file(path) as source:
                skipped = max(partition.first - begin, 0)
                source.seek(skipped * self.width)
                pieces.append(source.read((end - begin - skipped) * self.width))
        data = b"".join(pieces)
        data = data[: len(data) // self.width * self.width]
        rows = np.frombuffer(data, self.kind).reshape(-1, self.channels)[:: self.step]
        t = (partition.first + self.step * np.arange(len(rows))) / self.rate
        target = np.float64 if self.kind.kind == "f" else np.int64
        yield pa.RecordBatch.from_arrays([pa.array(t), *(pa.array(rows[:, c].astype(target)) for c in self.selected)], ["t", *(f"ch{c}" for c in self.selected)])


def read_binary(spark: SparkSession, path: str, channels: int, rate: float, **options) -> DataFrame:
    """A multiplexed file, or a folder of its parts as ``write_binary`` makes, as (t, ch0, ch1, ...)."""
    spark.dataSource.register(BinarySource)
    reader = spark.read.format("binary_multiplexed").option("path", path).option("channels", channels).option("rate", rate)
    for k, v in options.items():
        reader = reader.option(k, ",".join(map(str, v)) if isinstance(v, (list, tuple)) else v)
    return reader.load()


def write_binary(samples: DataFrame, path: str, columns: list[str], precision: str = "int16", t: str = "t") -> int:
    """Write samples in order of ``t``, multiplexed, as numbered parts of a new folder.

    Range partitions are sorted and written in parallel, each under a name of
    its attempt that is changed when it is whole; read in order of their names
    the parts are one signal. A folder that is there already is an error.
    Returns the number of records.
    """
    from pyarrow import fs

    system, where = _open(path)
    if system.get_file_info(where).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(where, recursive=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        system, where = _open(path)
        with system.open_output_stream(f"{where}/part-{part:06d}.{attempt}") as out:
            for batch in batches:
                values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))], axis=1)
                out.write(np.ascontiguousarray(values.astype(np.dtype(precision).newbyteorder("<"))).tobytes())
                n += len(values)
        system.move(f"{where}/part-{part:06d}.{attempt}", f"{where}/part-{part:06d}.dat")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = samples.repartitionByRange(t).sortWithinPartitions(t).select(*columns)
    return sum(r.n for r in ordered.mapInArrow(run, "n long").collect())  # a row a partition
