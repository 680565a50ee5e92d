"""Token counts: rollups kept up to date by signed deltas.

A batch of changes (inserted, deleted and revised counts) is added up by
source, language and tokenizer version before it is written; totals are the
sum of all committed batches. Revising a count is a deletion under the old
version and an insertion under the new one. A batch is committed once, under
its id: what its folder holds counts only when Spark has marked it complete,
and a repeated commit of the same id changes nothing.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
SUMS = ["docs", "tokens", "chars"]
# What one token is, by tokenizer version.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"}
_SCHEMA = "source string, lang string, version string, docs long, tokens long, chars long"


def token_count(text: Column, version: str) -> Column:
    """Tokens of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("bigint")


def inserted(rows: DataFrame, tokens: str, version: str, times: str | None = None) -> DataFrame:
    """Changes that add rows (source, lang, chars, and the named count), each ``times``."""
    n = (F.col(times) if times else F.lit(1)).cast("bigint")
    sums = {"docs": n, "tokens": n * F.col(tokens), "chars": n * F.col("chars")}
    return rows.select("source", "lang", F.lit(version).alias("version"), *[v.cast("bigint").alias(k) for k, v in sums.items()])


def deleted(rows: DataFrame, tokens: str, version: str, times: str | None = None) -> DataFrame:
    """Changes that take rows away again."""
    return inserted(rows, tokens, version, times).withColumns({c: -F.col(c) for c in SUMS})


def revised(rows: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Changes from one (count column, version) to another."""
    return deleted(rows, *old).unionByName(inserted(rows, *new))


class Rollup:
    """Totals in a folder of the shared store.

    Null sources and languages are keys of their own. Committing an empty
    batch is a commit. Extra columns of changes are left out. A batch id has
    one committer at a time: attempts one after another count once, but two
    at the same moment are not told apart.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        root = self._path("")
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        """A batch's folder: its id with all but letters, digits and -._~ as in a URL."""
        return f"{self.path}/batches/batch-{quote(batch, safe='')}"

    def committed(self) -> list[str]:
        """Ids of the committed batches, sorted."""
        fs, root = self._fs(), self._path("batches")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(unquote(n.removeprefix("batch-")) for n in names if fs.exists(self._path(f"batches/{n}/_SUCCESS")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing is done, if its id is committed.

        An attempt that failed left no mark, so the next one replaces it.
        """
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        changed = sums.where(" or ".join(f"{c} <> 0" for c in SUMS))
        changed.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._folder(batch))
        return True

    def compact(self) -> None:
        """Write the totals of all committed batches as a snapshot that names them, which ``totals`` reads instead."""
        names = self.committed()
        at = f"{self.path}/snapshots/{len(names):012d}-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{at}/sums")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{at}/covers")

    def _snapshot(self) -> tuple[list[str], set[str]]:
        """(folders of sums, batches that they cover) of the last whole snapshot."""
        fs, root = self._fs(), self._path("snapshots")
        names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        whole = [n for n in names if fs.exists(self._path(f"snapshots/{n}/covers/_SUCCESS"))]
        if not whole:
            return [], set()
        at = f"{self.path}/snapshots/{whole[-1]}"
        return [f"{at}/sums"], {r.batch for r in self.spark.read.schema("batch string").parquet(f"{at}/covers").collect()}

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens, chars); keys at zero are left out."""
        folders, covered = self._snapshot()
        folders += [self._folder(n) for n in self.committed() if n not in covered]
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        read = self.spark.read.schema(_SCHEMA).parquet(*folders)
        sums = read.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))
