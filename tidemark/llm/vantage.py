"""Nearest neighbours by cosine in vantage-point trees, one tree a shard.

Rows are taken as unit vectors, whose straight distances obey the triangle
inequality and order them as cosines do. A shard is some thousands of
consecutive rows of a task; its tree is the order of its rows, and the
distances at which each vantage point's two halves lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against, column, lanes_for, matrix, numbers, usable, usual_size
from .common import keep

SHARD = 8192
LEAF = 256
BLOCK = 4096
#: Distances and cosines are trusted to this much before exact scores decide.
_MARGIN = 1e-6
_TREE = "id long, v array<double>, shard long, pos int, size int, near double, far_from double, far_to double"


def _norms(v: np.ndarray) -> np.ndarray:
    """Lengths, by sums from the first component to the last."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        return np.sqrt(np.cumsum(v * v, axis=1)[:, -1])


def _halves(a: int, b: int) -> int:
    """Where the outer half of the node over places a to b begins."""
    return a + 1 + (b - a) // 2


def _grow(unit: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and (near, far_from, far_to) of the places that are vantage points."""
    order, reach = np.arange(len(unit)), np.full((len(unit), 3), np.nan)
    todo = [(0, len(unit))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            continue
        some = order[np.linspace(a, b - 1, 64).astype(int)]
        tries = some[::9]
        spread = (unit[tries] @ unit[some].T).std(axis=1)
        point = int(tries[int(spread.argmax())])
        place = a + int(np.flatnonzero(order[a:b] == point)[0])
        order[a], order[place] = order[place], order[a]
        rest = order[a + 1 : b]
        d = np.sqrt(np.maximum(0, 2 - 2 * (unit[rest] @ unit[point])))
        turn = np.argsort(d, kind="stable")
        order[a + 1 : b], d = rest[turn], d[turn]
        m = _halves(a, b)
        reach[a] = d[m - a - 2], d[m - a - 1], d[-1]
        todo += [(a + 1, m), (m, b)]
    return order, reach


def index(rows: DataFrame, id_col: str, vector: str, dims: int, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """All usable rows, as trees: id, v, shard, pos, size and the node's distances.

    A shard is made of consecutive rows of a task, without a shuffle and
    whatever ids or vectors repeat.
    """
    clean = rows.where(usable(vector) & (F.size(vector) == dims)).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("id is not null")

    def planted(found: list, number: int):
        table = pa.Table.from_batches(found).combine_chunks()
        v = matrix(table, "v", dims, float)
        order, reach = _grow(v / _norms(v)[:, None], leaf)
        n = len(v)
        flat = pa.array(v[order].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dims, dims), pa.int32()), flat)
        made = [pa.array(numbers(table, "id")[order]), lists, pa.array(np.full(n, number)), pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, n), pa.int32())]
        made += [pa.array(reach[:, j], from_pandas=True) for j in range(3)]
        return pa.RecordBatch.from_arrays(made, ["id", "v", "shard", "pos", "size", "near", "far_from", "far_to"])

    def trees(batches):
        from pyspark import TaskContext

        number, found, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            length = _norms(matrix(batch, "v", dims, float))
            batch = batch.filter(pa.array(np.isfinite(length) & (length > 0)))
            while batch.num_rows:
                part = batch.slice(0, shard - n)
                found, n, batch = [*found, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == shard:
                    yield planted(found, number)
                    number, found, n = number + 1, [], 0
        if n:
            yield planted(found, number)

    return clean.mapInArrow(trees, _TREE)


class _Search:
    """The first k of all rows fed, for each query of a block."""

    def __init__(self, queries: pa.Table, dims: int, k: int, factor: float, leaf: int):
        self.dims, self.k, self.factor, self.leaf = dims, k, factor, leaf
        self.ids, self.v = numbers(queries, "id"), matrix(queries, "v", dims, float)
        self.length = _norms(self.v)
        self.unit = self.v / self.length[:, None]
        n = len(self.ids)
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * n
        self.least = np.full(n, -np.inf)  # cosine of the k-th found
        self.seen, self.compared = 0, 0
        self.held: list = []
        self.shard = None

    def feed(self, batch) -> None:
        shards = numbers(batch, "shard")
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if a == b:
                continue
            if shards[a] != self.shard:
                self._shard_over()
                self.shard = shards[a]
            self.held.append(batch.slice(a, b - a))

    def _shard_over(self) -> None:
        if not self.held:
            return
        table = pa.Table.from_batches(self.held).combine_chunks()
        self.held = []
        self.row_ids, self.rows = numbers(table, "id"), matrix(table, "v", self.dims, float)
        self.row_length = _norms(self.rows)
        self.row_unit = self.rows / self.row_length[:, None]
        n, everyone = len(self.rows), np.arange(len(self.ids))
        self.seen += n * len(everyone)
        pos = numbers(table, "pos")
        if len(pos) != numbers(table, "size")[0] or (np.diff(pos) != 1).any():
            self._scan(0, n, everyone)  # a tree cut between two tasks is a list
            return
        self.reach = np.column_stack([np.asarray(numbers(table, c), float) for c in ("near", "far_from", "far_to")])
        self._descend(everyone)
        self._walk(0, n, everyone)

    def _limits(self, asked: np.ndarray) -> np.ndarray:
        """The distance of each query's k-th found row."""
        return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(self.least[asked], -1))) + np.where(np.isinf(self.least[asked]), np.inf, 0)

    def _to(self, place: int, asked: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.unit[asked] @ self.row_unit[place])))

    def _descend(self, asked: np.ndarray) -> None:
        """Scan the leaf on each query's own side, so that limits are near from the start."""
        todo = [(0, len(self.rows), asked)]
        while todo:
            a, b, some = todo.pop()
            if not len(some):
                continue
            if b - a <= self.leaf:
                self._scan(a, b, some, record=False)
                continue
            d, m = self._to(a, some), _halves(a, b)
            inner = d <= (self.reach[a, 0] + self.reach[a, 1]) / 2
            todo += [(a + 1, m, some[inner]), (m, b, some[~inner])]

    def _walk(self, a: int, b: int, asked: np.ndarray) -> None:
        """Visit the halves that can hold something nearer than a query's limit."""
        if b - a <= self.leaf:
            self._scan(a, b, asked)
            return
        self._scan(a, a + 1, asked)
        d, m = self._to(a, asked), _halves(a, b)
        near, far_from, far_to = self.reach[a]
        for lo, hi, inside in ((a + 1, m, d - near), (m, b, np.maximum(far_from - d, d - far_to))):
            open_ = np.maximum(inside, 0) * self.factor <= self._limits(asked) + _MARGIN
            if hi > lo and open_.any():
                self._walk(lo, hi, asked[open_])

    def _scan(self, a: int, b: int, asked: np.ndarray, record: bool = True) -> None:
        self.compared += (b - a) * len(asked) * record
        cosines = self.unit[asked] @ self.row_unit[a:b].T
        may = cosines >= self.least[asked][:, None] - _MARGIN
        for j in np.flatnonzero(may.any(1)):
            i, at = asked[j], a + np.flatnonzero(may[j])
            at = at[(self.row_ids[at] != self.ids[i])]
            if not len(at):
                continue
            if len(at) > 4 * self.k:  # the exact scores of the clearly worse are not needed
                c = cosines[j, at - a]
                at = at[c >= np.partition(c, len(c) - self.k)[len(c) - self.k] - _MARGIN]
            score = np.cumsum(self.v[i] * self.rows[at], axis=1)[:, -1] / (self.length[i] * self.row_length[at])
            if record:
                scores, ids = np.concatenate([self.found[i][0], score]), np.concatenate([self.found[i][1], self.row_ids[at]])
                first = np.lexsort((ids, -scores))[: self.k]
                self.found[i] = scores[first], ids[first]
                score = scores[first]
            if len(score) >= self.k:  # a look ahead only moves the limit: its rows are scanned again when they are visited
                self.least[i] = max(self.least[i], np.partition(score, len(score) - self.k)[len(score) - self.k])

    def finish(self) -> pa.RecordBatch:
        self._shard_over()
        n = [len(f[0]) for f in self.found]
        ids = np.concatenate([f[1] for f in self.found]) if n else np.zeros(0, np.int64)
        scores = np.concatenate([f[0] for f in self.found]) if n else np.zeros(0)
        seen, compared = np.full(len(ids), self.seen), np.full(len(ids), self.compared)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(self.ids, n), ids, scores, seen, compared)], ["query_id", "vec_id", "score", "seen", "compared"])


def nearest(
    rows: DataFrame,
    queries,
    k: int = 5,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector: str = "embedding",
    shard: int = SHARD,
    leaf: int = LEAF,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score, share): each query's ``k`` nearest rows by cosine.

    ``queries`` is a condition on ``rows``; every row but the query's own is a
    candidate. A half of a tree is left out if its least possible distance
    times ``factor`` exceeds that of the k-th row found: one is exact, more
    leaves out more (``share`` is the share of pairs that its task compared).
    Ties go to the smaller id; all candidates are returned if there are fewer.

    Rows take no part if the id or vector is null, the vector is empty, zero,
    has a null or non-finite component, a length other than the usual one or a
    norm that leaves the range of doubles. Each row of a repeated id is a
    candidate, none of them for that id; of queries with one id that of the
    smallest vector asks. An empty table gives no rows. Other columns are
    ignored.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, share double"
    dims, n = usual_size(rows.where(usable(vector)), vector)
    if not n:
        return spark.createDataFrame([], schema)
    trees = keep(index(rows, id_col, vector, dims, shard, leaf), "vantage")
    ok = usable(vector) & (F.size(vector) == dims) & F.col(id_col).isNotNull()
    vectors = rows.where(F.coalesce(queries, F.lit(False)) & ok).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    asked = keep(vectors.where((length > 0) & (length < float("inf"))).groupBy("id").agg(F.min("v").alias("v")), "vantage-queries")
    found = against(
        asked, trees, lambda t: _Search(t, dims, k, factor, leaf), "query_id long, vec_id long, score double, seen long, compared long",
        "id", -(-asked.count() // block), lanes_for(n), F.xxhash64("shard"), ("shard", "pos"),
    )
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    share = F.sum("compared").over(Window.partitionBy("query_id")) / F.sum("seen").over(Window.partitionBy("query_id"))
    return found.withColumn("rank", F.row_number().over(turn)).withColumn("share", share).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "share")
