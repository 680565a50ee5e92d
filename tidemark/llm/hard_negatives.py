"""Hard negatives by a vector-approximation file.

Each component of a vector becomes a cell number of its dimension (cells hold
equal shares of a sample). For a query, a table of dimensions by cells has the
least and the largest product with any value of the cell, so sums of looked-up
entries bound a row's score from both sides. Only rows whose bounds let them
enter a result are scored exactly; nothing depends on the sample but speed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against, column, lanes_for, matrix, numbers, usable, usual_size
from .common import keep

BITS = 6
SAMPLE = 4096
BLOCK = 4096
_GROUP = 32
_SLAB = 4096
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _edges(rows: DataFrame, dims: int, bits: int) -> np.ndarray:
    """(dims, cells - 1) first values of each cell but the first, from at most SAMPLE rows."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    if not some.num_rows:
        return np.zeros((dims, 0), np.int64)
    share = np.arange(1, 1 << bits) / (1 << bits)
    return np.quantile(matrix(some, "v", dims, np.int64), share, axis=0, method="higher").T.copy()


def approximate(rows: DataFrame, dims: int, edges: np.ndarray) -> DataFrame:
    """The file: ``id``, ``label``, ``v`` and ``cells``, one byte a dimension."""

    def coded(batches):
        for batch in batches:
            v = matrix(batch, "v", dims, np.int64)
            cells = np.empty(v.shape, np.uint8)
            for d in range(dims):
                cells[:, d] = np.searchsorted(edges[d], v[:, d], "right")
            packed = pa.Array.from_buffers(pa.binary(dims), len(v), [None, pa.py_buffer(cells.tobytes())]).cast(pa.binary()) if len(v) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "label"), column(batch, "v"), packed], ["id", "label", "v", "cells"])

    return rows.select("id", "label", "v").mapInArrow(coded, "id long, label long, v array<long>, cells binary")


class _Slab:
    """Rows with what their cells can hold, as far as these rows go."""

    def __init__(self, batch, dims: int, edges: np.ndarray):
        self.ids, self.labels = numbers(batch, "id"), numbers(batch, "label")
        self.v = matrix(batch, "v", dims, np.int64)
        flat = b"".join(column(batch, "cells").to_pylist())
        self.cells = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(-1, dims).T)
        ends = [self.v.min(0, initial=0)[:, None], self.v.max(0, initial=0)[:, None]]
        self.low = np.hstack([np.minimum(ends[0], edges[:, :1]) if edges.shape[1] else ends[0], edges]).astype(float)
        self.high = np.hstack([edges - 1, np.maximum(ends[1], edges[:, -1:]) if edges.shape[1] else ends[1]]).astype(float)

    def bounds(self, queries: np.ndarray, at: np.ndarray | slice):
        """(least, largest) score of each query with each row of ``at``, by table lookup."""
        q = queries[:, :, None].astype(float)
        one, two = q * self.low, q * self.high
        least, most = np.minimum(one, two), np.maximum(one, two)
        reach = np.maximum(np.abs(least), np.abs(most)).max(2).sum(1)
        narrow = reach.max(initial=0) < 1e30
        table = np.empty(least.shape, np.complex64 if narrow else np.complex128)
        table.real, table.imag = least, most
        cells = self.cells[:, at]
        total = np.zeros((len(queries), cells.shape[1]), table.dtype)
        for d in range(len(cells)):
            total += np.take(table[:, d], cells[d], axis=1)
        slack = (reach * (len(cells) * 2.0 ** (-22 if narrow else -51)) + 1)[:, None]
        return total.real - slack, total.imag + slack

    def score(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.v[at] * query).sum(1)


def _slabs(batch, dims: int, edges: np.ndarray):
    for a in range(0, batch.num_rows, _SLAB):
        yield _Slab(batch.slice(a, _SLAB), dims, edges)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: higher scores first, ties by smaller id."""
    if len(scores) > 4 * k:
        enough = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return enough[np.lexsort((ids[enough], -scores[enough]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class _Positives:
    """The first k rows of each query's label."""

    def __init__(self, queries: pa.Table, dims: int, edges: np.ndarray, k: int):
        self.dims, self.edges, self.k = dims, edges, k
        self.ids, self.labels, self.v = numbers(queries, "id"), numbers(queries, "label"), matrix(queries, "v", dims, np.int64)
        self.of = {label: np.flatnonzero(self.labels == label) for label in np.unique(self.labels)}
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def feed(self, batch) -> None:
        for slab in _slabs(batch, self.dims, self.edges):
            for label in np.unique(slab.labels):
                at, asked = np.flatnonzero(slab.labels == label), self.of.get(label, [])
                for a in range(0, len(asked), _GROUP):
                    self._look(slab, at, asked[a : a + _GROUP])

    def _look(self, slab: _Slab, at: np.ndarray, asked: np.ndarray) -> None:
        least, most = slab.bounds(self.v[asked], at)
        own = slab.ids[at] == self.ids[asked][:, None]
        least[own], most[own] = -np.inf, -np.inf
        held = np.array([float(self.best[i][0][-1]) if len(self.best[i][0]) == self.k else -np.inf for i in asked])
        may = most >= np.maximum(held, _kth(least, self.k))[:, None]
        may &= ~own
        for j in np.flatnonzero(may.any(1)):
            rows, i = at[may[j]], asked[j]
            scores = np.concatenate([self.best[i][0], slab.score(self.v[i], rows)])
            ids = np.concatenate([self.best[i][1], slab.ids[rows]])
            keep_ = _first(scores, ids, self.k)
            self.best[i] = scores[keep_], ids[keep_]

    def finish(self) -> pa.RecordBatch:
        n = [len(b[0]) for b in self.best]
        flat = lambda j: np.concatenate([b[j] for b in self.best]) if self.best else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(flat(1)), pa.array(flat(0))], ["anchor_id", "positive_id", "positive_score"])


class _Negatives:
    """The first k rows of another label in each of a query's windows."""

    def __init__(self, queries: pa.Table, dims: int, edges: np.ndarray, k: int):
        self.dims, self.edges, self.k = dims, edges, k
        self.ids, self.labels, self.v = numbers(queries, "id"), numbers(queries, "label"), matrix(queries, "v", dims, np.int64)
        lows, highs = column(queries, "lows").to_pylist(), column(queries, "highs").to_pylist()
        self.windows = [[(a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(lows, highs, strict=True)]
        self.best = [{w: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for w in ws if w[0] <= w[1]} for ws in self.windows]

    def feed(self, batch) -> None:
        for slab in _slabs(batch, self.dims, self.edges):
            for a in range(0, len(self.ids), _GROUP):
                self._look(slab, np.arange(a, min(a + _GROUP, len(self.ids))))

    def _floor(self, i: int, w) -> float:
        """What a score in this window must reach to be among the first k."""
        scores = self.best[i][w][0]
        return float(scores[-1]) if len(scores) == self.k else float(w[0])

    def _look(self, slab: _Slab, asked: np.ndarray) -> None:
        least, most = slab.bounds(self.v[asked], slice(None))
        other = slab.labels != self.labels[asked][:, None]
        floor = np.array([min((self._floor(i, w) for w in self.best[i]), default=np.inf) for i in asked])
        ceiling = np.array([max((w[1] for w in self.best[i]), default=_LOW) for i in asked], float)
        may = other & (most >= floor[:, None]) & (least <= ceiling[:, None])
        for j in np.flatnonzero(may.any(1)):
            i, rows = asked[j], np.flatnonzero(may[j])
            lo, hi = least[j, rows], most[j, rows]
            wanted = np.zeros(len(rows), bool)
            inside = {}
            for w in self.best[i]:
                maybe = (hi >= self._floor(i, w)) & (lo <= w[1])
                certain = lo[maybe & (lo >= w[0]) & (hi <= w[1])]
                if len(certain) >= self.k:
                    maybe &= hi >= np.partition(certain, len(certain) - self.k)[len(certain) - self.k]
                inside[w] = maybe
                wanted |= maybe
            scores = np.full(len(rows), _LOW)
            scores[wanted] = slab.score(self.v[i], rows[wanted])
            for w, maybe in inside.items():
                maybe &= (scores >= w[0]) & (scores <= w[1])
                if not maybe.any():
                    continue
                s, n = np.concatenate([self.best[i][w][0], scores[maybe]]), np.concatenate([self.best[i][w][1], slab.ids[rows[maybe]]])
                keep_ = _first(s, n, self.k)
                self.best[i][w] = s[keep_], n[keep_]

    def finish(self) -> pa.RecordBatch:
        out: list[tuple] = [(int(self.ids[i]), w[0], w[1], int(n), int(s)) for i, found in enumerate(self.best) for w, (ss, ns) in found.items() for s, n in zip(ss, ns, strict=True)]
        names = ["anchor_id", "low", "high", "negative_id", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(len(names))], names)


def mine(
    rows: DataFrame,
    anchors,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 3,
    least: int = 50,
    most: int = 95,
    bits: int = BITS,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``rows`` that picks the anchors. A component
    x counts as floor(scale * x), a score is the integer inner product with
    the anchor. An anchor's positives are the first ``n_positives`` other rows
    of its label, its negatives the first ``n_negatives`` rows of other labels
    whose score is between ``least`` and ``most`` percent of the positive's.
    Higher scores are first, ties go to the smaller id.

    Exact whatever ``bits`` (1 to 8) and ``block`` (anchors held by a task).
    Rows take no part if id, label or vector is null, the vector is empty, has
    a null or non-finite component or a length other than the usual one.
    Every row of a repeated id is a candidate; of anchors with one id that of
    the smallest label and vector asks, and rows of its id are not "other".
    An anchor without positives or negatives gives no row, so an empty table
    gives none. Scores that leave 64 bits wrap. Other columns are ignored.
    """
    spark = rows.sparkSession
    clean = rows.where(usable(vector)).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null")
    dims, n = usual_size(clean, "v")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    clean = clean.where(F.size("v") == dims)
    edges = _edges(clean, dims, bits)
    file = keep(approximate(clean, dims, edges), "approximation")
    asked = keep(clean.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "anchors")
    n_blocks, lanes = -(-asked.count() // block), lanes_for(n)
    near = against(asked, file, lambda t: _Positives(t, dims, edges, n_positives), "anchor_id long, positive_id long, positive_score long", "id", n_blocks, lanes)
    turn = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = keep(near.withColumn("n", F.row_number().over(turn)).where(F.col("n") <= n_positives), "positives")
    # the window of a negative score is empty
    bounded = positives.where("positive_score >= 0").withColumn("low", F.expr(f"(positive_score * {least} + 99) div 100")).withColumn("high", F.expr(f"(positive_score * {most}) div 100"))
    windows = bounded.groupBy("anchor_id").agg(F.collect_set(F.struct("low", "high")).alias("w"))
    sought = keep(asked.join(windows, asked["id"] == windows["anchor_id"]).select("id", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "windows")
    found = against(sought, file, lambda t: _Negatives(t, dims, edges, n_negatives), "anchor_id long, low long, high long, negative_id long, negative_score long", "id", n_blocks, lanes)
    turn = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("negative_score"), "negative_id")
    first = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= n_negatives)
    return bounded.select("anchor_id", "positive_id", "positive_score", "low", "high").join(first, ["anchor_id", "low", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
