"""Shared helpers: tables, shared storage, hashing of words in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only a local master, as in
    tests, may leave it unset and gets a temporary folder of its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value):
    """A session setting that holds within a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tidy(spark: SparkSession):
    """A block in which a query's shuffles are removed with its end."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage.

    A later stage that loses an executor rereads the files instead of
    repeating what produced them. The shuffles of the write are removed with
    its end, not only when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete kept tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


BITMAP = 23


def bitmap(hashes: DataFrame, column: str, bits: int = BITMAP) -> DataFrame:
    """(word, bits) of a bitmap of 2 ** ``bits`` bits with those of ``column``.

    It has a fixed size, so it can be broadcast whatever the number of hashes;
    a full one only says maybe of everything.
    """
    at = F.shiftrightunsigned(column, 64 - bits)
    marked = hashes.select(F.shiftright(at, 6).alias("word"), at.alias("at"))
    return marked.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, maybe): each document, and whether its id may be one of ``ids``."""
    known = bitmap(ids.select(F.xxhash64("doc_id").alias("h")), "h")
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITMAP)
    looked = docs.select(F.struct(*docs.columns).alias("row"), F.shiftright(at, 6).alias("word"), at.alias("at")).join(F.broadcast(known), "word", "left")
    return looked.select("row", F.coalesce(F.expr("bits & shiftleft(1L, cast(at & 63 as int))") != 0, F.lit(False)).alias("maybe"))


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of documents in ``ids``; few other texts are shuffled."""
    some = _marked(docs.select("doc_id", "text"), ids).where("maybe").select("row.*")
    return some.join(ids.select("doc_id").distinct(), "doc_id").select("doc_id", "text")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents not in ``ids``, with all their columns; a null id stays."""
    marked = _marked(docs, ids)
    rest = marked.where("maybe").select("row.*").join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
    return marked.where("not maybe").select("row.*").unionByName(rest.select(*docs.columns))


# --- words of Arrow batches, as 64-bit hashes --------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, kept for the usual length of a slice."""
    out = _POWERS.get(int(base))
    if out is None or len(out) < n:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        np.multiply.accumulate(out, out=out)
        if n <= 4 * CHUNK:
            _POWERS[int(base)] = out
    return out[:n]


CHUNK = 500_000


def text_chunks(batch, column: str = "text", max_bytes: int = CHUNK):
    """Slices of an Arrow batch as (first row, row offsets, bytes).

    A slice holds whole texts of at most ``max_bytes`` together, or one longer
    text. Offsets have one entry more than there are rows; a null is empty.
    What is computed of a slice takes some fifty times its bytes, so slices
    are kept small.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + max_bytes, "right")) - 1)
        yield row, at[row : end + 1] - at[row], raw[at[row] : at[end]]
        row = end


def words(offsets: np.ndarray, raw: np.ndarray, fold: bool = True, breaks: np.ndarray = _SPACE):
    """(hash, row, first byte, end byte) of each word in a slice of texts.

    A word is a run of bytes other than space, tab, line feed, vertical tab,
    form feed and carriage return, or than those ``breaks`` marks; with
    ``fold`` A-Z count as a-z.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[:-1] = inside
    edge[1:-1] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    edge[begins] |= inside[begins]
    start = np.flatnonzero(edge[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    finals = offsets[1:][np.diff(offsets) > 0] - 1
    last[finals] |= inside[finals]
    end = np.flatnonzero(last) + 1
    value = _BYTE[_LOWER[raw] if fold else raw]
    value = value * _powers(_BASE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    back = _powers(_INVERSE, len(raw))
    h = mix((total[end] - total[start]) * back[start])
    row = np.searchsorted(offsets, start, "right") - 1
    return h, row, start, end


def shingles(h: np.ndarray, row: np.ndarray, k: int):
    """(hash, row) of each run of ``k`` words inside one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_powers(np.uint64(0xD6E8FEB86659FD93), k + 1)[1:]):
        out += h[j : j + n] * c
    same = row[:n] == row[k - 1 :]
    return mix(out[same]), row[:n][same]
