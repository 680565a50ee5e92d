"""Stored results: a table keyed by experiment and name."""

from __future__ import annotations

import getpass
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "eid string, name string, comments string, parameters string, code string, ts timestamp, user string, md5 string, payload binary"


class ResultStore:
    """Results in Parquet folders, one row for each (eid, name).

    Each version of the table is a folder; the last of the numbered pointers
    names the one that counts. One writer at a time: two that add the same key at once are
    not told apart.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _current(self) -> str:
        """Folder of the version that counts: of the pointers the last one."""
        root = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        pointers = sorted(n for n in names if n.startswith("current-"))
        return f"{self.path}/{pointers[-1].split('@')[1]}" if pointers else f"{self.path}/version-0"

    def _point(self, version: str) -> None:
        root = self._path(self.path)
        pointers = sorted(f.getPath().getName() for f in self._fs.listStatus(root) if f.getPath().getName().startswith("current-"))
        n = int(pointers[-1].split("@")[0].split("-")[1]) + 1 if pointers else 1
        self._fs.create(self._path(f"{self.path}/current-{n:08d}@{version}"), False).close()

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self._current())
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def add(self, results: DataFrame) -> None:
        """Append (eid, name, comments, parameters, code, payload); a key that is there is an error."""
        made = results.select("eid", "name", "comments", "parameters", "code", F.current_timestamp().alias("ts"), F.lit(getpass.getuser()).alias("user"), F.md5("payload").alias("md5"), "payload")
        twice = made.groupBy("eid", "name").count().where("count > 1").select("eid", "name")
        there = made.join(self.rows().select("eid", "name"), ["eid", "name"], "left_semi").select("eid", "name")
        clash = twice.unionByName(there).first()
        if clash:
            raise ValueError(f"already stored: {clash.eid}, {clash.name}")
        made.write.mode("append").parquet(self._current())

    def get(self, where: str = "true", output: str = "full") -> DataFrame:
        """Rows under an SQL condition: ``full``, ``info`` (no payload), ``keys`` or ``variables``."""
        rows = self.rows().where(where)
        return {"full": rows, "info": rows.drop("payload"), "keys": rows.select("eid", "name"), "variables": rows.select("eid", "name", "payload")}[output]

    def remove(self, where: str) -> None:
        """Delete rows under an SQL condition.

        What is left is written as a version of its own, and then the pointer
        to the version is changed, so that a crash leaves the old or the new one.
        """
        left = f"{self.path}/version-{uuid.uuid4().hex}"
        self.rows().where(f"not coalesce({where}, false)").write.parquet(left)
        self._point(left.rsplit("/", 1)[1])


def match_values(a: DataFrame, b: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of two results joined by the key that a pattern takes from ``eid``; and what is left of each."""
    x = a.withColumn("key", F.regexp_extract("eid", pattern, 1))
    y = b.withColumn("key", F.regexp_extract("eid", pattern, 1))
    both = x.join(y.select("key", *[F.col(c).alias(f"other_{c}") for c in b.columns]), "key")
    return both, x.join(y, "key", "left_anti"), y.join(x, "key", "left_anti")
