"""Every query row against every row of a table, block by block.

Queries are dealt into blocks of bounded size and rows into lanes; a task
holds one block of queries and streams the rows of one lane past it, so its
memory depends on neither table. With one block its queries travel with the
task and no row is shuffled; with more, each row is copied once a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE_ROWS = 1 << 20
LEAST_LANES = 16


def lanes_for(rows: int) -> int:
    """So many that a lane holds about a million rows, and sixteen at least."""
    return max(LEAST_LANES, -(-rows // LANE_ROWS))


def against(
    queries: DataFrame,
    rows: DataFrame,
    work: Callable,
    schema: str,
    query_key: str,
    n_blocks: int,
    lanes: int,
    lane: Column | None = None,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """What ``work`` finds for all queries in all rows.

    ``work(table)`` gets an Arrow table of a block's queries; of what it
    returns, ``feed(batch)`` is called with Arrow batches of rows and
    ``finish()`` gives an Arrow batch of ``schema``. It runs once a block and
    lane, so its results must be merged over lanes. ``lane`` deals out rows
    (by default in turn, so no key can gather in a lane); rows of equal lane
    come in the order of the columns ``order``. ``query_key`` must not repeat.
    """
    if n_blocks <= 1:
        held = queries.toArrow()

        def once(batches):
            state = work(held)
            for batch in batches:
                state.feed(batch)
            yield state.finish()

        return rows.coalesce(lanes).mapInArrow(once, schema)

    block = F.pmod(F.xxhash64(query_key), F.lit(n_blocks)).cast("int")
    own = queries.select(F.struct(*queries.columns).alias("q"), block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))
    turn = F.pmod(F.monotonically_increasing_id() if lane is None else lane, F.lit(lanes)).cast("int")
    dealt = rows.select(F.struct(*rows.columns).alias("r"), turn.alias("_lane")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    both = own.unionByName(dealt, allowMissingColumns=True).withColumn("_part", F.col("_block") * lanes + F.col("_lane"))
    sorted_ = both.repartition(n_blocks * lanes, "_part").sortWithinPartitions("_part", F.col("q").isNull(), *(f"r.{c}" for c in order))

    def by_part(batches):
        now, found, state = None, [], None

        def ended():
            if found:
                yield (state or work(pa.Table.from_batches(found))).finish()

        for batch in batches:
            part = batch.column(batch.schema.get_field_index("_part")).to_numpy(zero_copy_only=False)
            q, r = (batch.column(batch.schema.get_field_index(c)) for c in ("q", "r"))
            is_row = q.is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    yield from ended()
                    now, found, state = part[a], [], None
                if not is_row[a]:
                    found.append(pa.RecordBatch.from_struct_array(q.slice(a, b - a)))
                    continue
                if state is None and found:
                    state = work(pa.Table.from_batches(found))
                if state is not None:
                    state.feed(pa.RecordBatch.from_struct_array(r.slice(a, b - a)))
        yield from ended()

    return sorted_.select("_part", "q", "r").mapInArrow(by_part, schema)


def column(batch, name: str):
    """A column of an Arrow batch or table, in one piece."""
    found = batch.column(batch.schema.get_field_index(name))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def matrix(batch, name: str, dims: int, kind) -> np.ndarray:
    """A column of lists of ``dims`` numbers as a matrix."""
    flat = column(batch, name).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(-1, dims)


def numbers(batch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def ragged(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists; a null list is empty."""
    lists = column(batch, name)
    sizes = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), out=sizes[1:])
    return sizes, lists.flatten().to_numpy(zero_copy_only=False)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def usual_size(rows: DataFrame, vector: str) -> tuple[int, int]:
    """The length most vectors have (of equally frequent ones the largest), and how many have it."""
    most = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (most["d"], most["count"]) if most else (0, 0)
