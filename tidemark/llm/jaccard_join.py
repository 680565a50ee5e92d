"""Exact n-gram Jaccard join in a metric space, down to components.

Jaccard distance is a metric, so pivots can divide the documents: each goes to
the region of its nearest pivot, and also to every region whose pivot is at
most twice the radius farther, since by the triangle inequality any partner
beyond that window is too far. Between unrelated texts, however, all distances
are close to one, so every document would lie in every window and each region
would hold the whole table. The first pivots are therefore single shingles.

1. First regions. A one-shingle pivot is nearest to the sets that hold it, all
   equally; ties are cut by one order of all shingles, the rarest first. By the
   radius, linked sets miss few of each other's shingles, so a set is
   replicated to the pivots of as many of its first shingles as it can miss,
   and a few more: linked sets then meet in at least ``need`` regions. Rarity
   is read from counts of all documents' shingles in cells of a hash; the
   order changes how much is compared and never the result.
2. Small regions. Pairs that meet as often as links must are measured: first
   each document with the one that it meets most often, then the pairs whose
   ends are still in different components. Texts move only for pairs that the
   counts of their shingles by bucket, a lower bound of the distance, leave open.
3. Large regions. The most central document, which is in the largest regions,
   is the pivot; regions with the same pivot are joined, and every member is
   measured against it. Regions whose members are all connected are done.
4. Recursion. Regions that still hold several components are divided. First
   into rings by the distance to their pivot, each replicated to the next one,
   as a link spans one ring at most. Then into the Voronoi regions of two new
   pivots from different components; members for which the two distances
   differ by no more than twice the radius are replicated to both. This is
   repeated on what still is large and mixed. A region of at most ``leaf``
   members compares its pairs. One that pivots can't divide, since all its
   distances are about equal, is cut into blocks that are compared exactly by
   x ^ y = (x ^ p) ^ (y ^ p), as matrices of the elements that both blocks have.
   No pair is emitted but the links.

Equal sets are one vertex from the start, so copies cost nothing further.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, discard, keep, mix, only, setting, shingles, text_chunks, without, words
from .components import connected_components

K_WORDS = 4
PERCENT = 85
LEAF = 64
BLOCK = 512
CELLS = 18
REGION_BITS = (25, 28)  # of the bitmap of regions: at least so many, and at most
# long texts come in pairs, so the usual number of rows of an Arrow batch would not fit
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def document_sets(offsets: np.ndarray, raw: np.ndarray, k: int):
    """The sorted distinct shingle hashes of each text of a slice."""
    h, row, _, _ = words(offsets, raw)
    s, at = shingles(h, row, k)
    first = np.searchsorted(row, np.arange(len(offsets)))
    grams = np.searchsorted(at, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        if grams[i] < grams[i + 1]:
            yield np.unique(s[grams[i] : grams[i + 1]])
        elif first[i] < first[i + 1]:  # fewer words than a shingle: the sequence is one
            few = h[first[i] : first[i + 1]]
            yield np.array([np.bitwise_xor.reduce((few + np.uint64(len(few))) * np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, len(few) + 1, dtype=np.uint64))], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_hash(s: np.ndarray) -> int:
    """One 64-bit number for a set; sums of mixed hashes, whatever the order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(s) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))]))[0].astype(np.int64))


def most_apart(total: int, percent: int = PERCENT) -> int:
    """How many shingles can differ between linked sets of ``total`` together."""
    return (100 - percent) * total // (100 + percent)


def most_of(n, percent: int):
    """How far apart a set of ``n`` shingles and a linked one can be at most."""
    return most_apart(n + n * 100 // percent, percent)


def need(n: int) -> int:
    """How many regions linked sets share at least, by the size of the smaller one."""
    return 1 + n // 32


def first_shingles(s: np.ndarray, rarity: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of a sorted set whose regions it goes to.

    Linked sets have at least ``percent`` hundredths of the larger one in
    common. The last of their first ``need`` common shingles has the other
    common ones after it, so it is among the first ones taken here of both.
    """
    n = len(s)
    take = n - -(-percent * n // 100) + need(n)
    return s[np.argsort(rarity[_cell(s)], kind="stable")[:take]]


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS)).astype(np.int64)


def shingle_rarity(docs: DataFrame, k: int = K_WORDS) -> np.ndarray:
    """For each cell of shingle hashes, a byte that grows with its count.

    The counts are of all documents; there are 2 ** CELLS cells of fixed size,
    which are added up by Spark in parts before they reach the driver.
    """
    part = 1 << 12
    schema = "part int, counts binary"

    def rows(parts):
        import pyarrow as pa

        numbers, counts = zip(*parts) if parts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([x.tobytes() for x in counts], pa.binary())], ["part", "counts"])

    def count(batches):
        total = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for _, offsets, raw in text_chunks(batch):
                total += np.bincount(_cell(np.concatenate([np.zeros(0, np.uint64), *document_sets(offsets, raw, k)])), minlength=1 << CELLS)
        yield rows(list(enumerate(total.reshape(-1, part))))

    def add(batches):
        total = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[i] = total.get(i, 0) + np.frombuffer(x.as_py(), np.int64)
        yield rows(list(total.items()))

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    total = np.zeros(((1 << CELLS) // part, part), np.int64)
    for i, x in counted.repartition("part").mapInArrow(add, schema).collect():
        total[i] += np.frombuffer(x, np.int64)
    return np.minimum(np.round(8 * np.log2(1 + total.ravel())), 255).astype(np.uint8)


def shingle_sets(docs: DataFrame, k: int = K_WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_hash, counts) of each document; a set of none has hash null.

    ``counts`` are those of ``bucket_counts``.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, h, counts = [], [], []
            for _, offsets, raw in text_chunks(batch):
                for s in document_sets(offsets, raw, k):
                    n.append(len(s))
                    h.append(set_hash(s) if len(s) else None)
                    counts.append(bucket_counts(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(counts, pa.binary())], ["doc_id", "n_shingles", "set_hash", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash long, counts binary")


def first_regions(docs: DataFrame, rarity: np.ndarray, k: int = K_WORDS, percent: int = PERCENT, wanted: np.ndarray | None = None) -> DataFrame:
    """(region, set_hash) of each set; equal sets of a task come once.

    ``wanted``, a bitmap as of ``bitmap`` of any size, leaves out regions that are not in it.
    """

    bits = 0 if wanted is None else len(wanted).bit_length() + 5

    def run(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            for _, offsets, raw in text_chunks(batch):
                regions, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for s in document_sets(offsets, raw, k):
                    if not len(s) or (h := set_hash(s)) in seen:
                        continue
                    seen.add(h)
                    region = first_shingles(s, rarity, percent)
                    if wanted is not None:
                        at = region >> np.uint64(64 - bits)
                        region = region[wanted[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1]
                    regions.append(region)
                    owners.append(np.full(len(region), h, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(regions).view(np.int64)), pa.array(np.concatenate(owners))], ["region", "set_hash"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "region long, set_hash long")


def shared_regions(docs: DataFrame, vertices: DataFrame, k: int, percent: int) -> DataFrame:
    """(region, id, n, size) of the regions that hold several sets, kept.

    Most regions hold one set, so a first pass shuffles only half of each
    region's hash and the sets' least and largest of that half. Halves of
    several sets are marked in a bitmap that grows with the regions up to a
    fixed size, with which a second pass lists the sets of few regions besides
    those wanted. These are found and dropped behind the one shuffle by region,
    before anything is joined or kept.
    """
    rarity = shingle_rarity(docs, k)
    taken = F.col("n") - F.ceil(F.col("n") * percent / 100) + need_of("n")
    rows = vertices.agg(F.coalesce(F.sum(taken), F.lit(0))).first()[0]
    bits = min(max(int(rows).bit_length(), REGION_BITS[0]), REGION_BITS[1])
    half = F.shiftright("region", 32).cast("int").alias("half")
    dealt = first_regions(docs, rarity, k, percent).select(half, "set_hash").repartition("half")
    held = dealt.groupBy("half").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo <> hi")
    marks = keep(bitmap(held.select(F.shiftleft(F.col("half").cast("long"), 32).alias("region")), "region", bits), "several")
    found = marks.toPandas()
    wanted = np.zeros(1 << (bits - 6), np.uint64)
    wanted[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    listed = first_regions(docs, rarity, k, percent, wanted).repartition("region").dropDuplicates(["region", "set_hash"])
    several = listed.withColumn("size", F.count("*").over(Window.partitionBy("region"))).where("size > 1")
    cells = keep(several.join(vertices, "set_hash").select("region", "id", "n", "size"), "cells")
    discard(marks)
    return cells


def measure(pairs: DataFrame, texts: DataFrame, k: int = K_WORDS, percent: int = PERCENT, differences: bool = False) -> DataFrame:
    """(p, x, linked, n, d, apart) of pairs of document ids: exact, by their texts.

    ``n`` is the size of x's set, ``d`` the number of shingles that only one of
    the sets has, and ``apart`` these shingles, sorted (empty unless asked for).
    """
    left = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x"))

    def sets_of(batch, column):
        for _, offsets, raw in text_chunks(batch, column):
            yield from document_sets(offsets, raw, k)

    right = texts.select(F.col("doc_id").alias("p"), F.col("text").alias("text_p"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pivots, members = (sets_of(batch, c) for c in ("text_p", "text_x"))
            linked, n, sizes, apart = [], [], [], []
            for p, x in zip(pivots, members):
                d = np.setxor1d(x, p, assume_unique=True)
                linked.append(len(d) * (100 + percent) <= (len(x) + len(p)) * (100 - percent))
                n.append(len(x))
                sizes.append(len(d))
                apart.append(d.view(np.int64) if differences else d[:0].view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(n, pa.int32()), pa.array(sizes, pa.int32()), pa.array(apart, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["p", "x", "linked", "n", "d", "apart"])

    joined = pairs.select("p", "x").join(right, "p").join(left, "x").select("p", "x", "text_p", "text_x")
    return joined.mapInArrow(run, "p long, x long, linked boolean, n int, d int, apart array<long>")


def bucket_counts(s: np.ndarray) -> bytes:
    """How many elements of a set fall in each of a power of two of buckets.

    Sets differ by at least the sum of the differences of their counts. There
    are at most as many buckets as elements; a full byte makes it empty.
    """
    size = 1 << max(len(s).bit_length() - 1, 0)
    counts = np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 255 else b""


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the difference of two sets from their bucket counts."""
    if not a or not b:
        return 0
    size = min(len(a), len(b))
    one, two = (np.frombuffer(x, np.uint8).reshape(-1, size).sum(0, dtype=np.int32) for x in (a, b))
    return int(np.abs(one - two).sum())


def maybe_linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(p, x, met) of the pairs whose bucket counts do not rule out a link."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, m, a, b = (batch.column(i) for i in (3, 4, 5, 6))
            total = n.to_numpy() + m.to_numpy()
            may = [least_apart(u.as_py(), v.as_py()) <= most_apart(int(t), percent) for u, v, t in zip(a, b, total)]
            yield batch.select(["p", "x", "met"]).filter(pa.array(may, pa.bool_()))

    of = lambda key, n, counts: sets.select(F.col("doc_id").alias(key), F.col("n_shingles").alias(n), F.col("counts").alias(counts))
    joined = pairs.select("p", "x", "met").join(of("p", "n", "a"), "p").join(of("x", "m", "b"), "x")
    return joined.select("p", "x", "met", "n", "m", "a", "b").mapInArrow(run, "p long, x long, met long")


def compare_blocks(measured: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b) of links between members of a cell in different components.

    ``measured`` has (cell, x, n, component, apart), ``apart`` being the
    difference of x to the cell's pivot. A task compares two blocks of some
    ``block`` members each, whatever the cell holds; blocks of one component
    are not compared.
    """
    sizes = measured.groupBy("cell").agg(F.count("*").alias("members"))
    cut = F.pmod(F.xxhash64("x"), F.ceil(F.col("members") / block)).cast("int")
    placed = keep(measured.join(sizes, "cell").select("cell", cut.alias("part"), "x", "n", "apart", "component"), "blocks")
    blocks = placed.groupBy("cell", "part").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    other = blocks.select("cell", F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    mixed = (F.least("lo", "lo2") != F.greatest("hi", "hi2")) & (F.col("part") <= F.col("part2"))
    tasks = blocks.join(other, "cell").where(mixed).select("cell", "part", "part2", F.xxhash64("cell", "part", "part2").alias("task"))
    sides = tasks.select("cell", "task", F.inline(F.array(F.struct("part", F.lit(0).alias("side")), F.struct(F.col("part2").alias("part"), F.lit(1).alias("side")))))
    rows = sides.join(placed, ["cell", "part"]).select("task", "side", "x", "n", "apart", "component")

    def links(group):
        import pandas as pd

        one, two = (group[group["side"] == i] for i in (0, 1))
        d1, d2 = ([np.asarray(d) for d in side["apart"]] for side in (one, two))
        flat1, flat2 = np.concatenate([*d1, np.zeros(0, np.int64)]), np.concatenate([*d2, np.zeros(0, np.int64)])
        shared = np.intersect1d(flat1, flat2)

        def incidence(d, flat):
            at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
            hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
            row = np.repeat(np.arange(len(d)), [len(x) for x in d])
            return row[hit], at[hit]

        (r1, c1), (r2, c2) = incidence(d1, flat1), incidence(d2, flat2)
        both = np.zeros((len(d1), len(d2)), np.float32)
        for begin in range(0, len(shared), 8192):
            a, b = np.zeros((len(d1), 8192), np.float32), np.zeros((len(d2), 8192), np.float32)
            for m, r, c in ((a, r1, c1), (b, r2, c2)):
                own = (c >= begin) & (c < begin + 8192)
                m[r[own], c[own] - begin] = 1
            both += a @ b.T
        s1, s2 = np.array([len(x) for x in d1]), np.array([len(x) for x in d2])
        apart = s1[:, None] + s2[None, :] - 2 * both.astype(np.int64)
        total = one["n"].to_numpy(np.int64)[:, None] + two["n"].to_numpy(np.int64)[None, :]
        near = apart * (100 + percent) <= total * (100 - percent)
        near &= one["component"].to_numpy()[:, None] != two["component"].to_numpy()[None, :]
        i, j = np.nonzero(near)
        return pd.DataFrame({"a": one["x"].to_numpy()[i], "b": two["x"].to_numpy()[j]})

    return rows.groupBy("task").applyInPandas(links, "a long, b long").distinct()


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, from, to) of the pairs whose ends have different components."""
    one = labels.select(F.col("id").alias("a"), F.col("component").alias("from"))
    two = labels.select(F.col("id").alias("b"), F.col("component").alias("to"))
    return pairs.join(one, "a").join(two, "b").where(F.col("from") != F.col("to")).select("a", "b", "from", "to")


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after more links: what they join are whole components."""
    if not links.limit(1).count():
        return labels
    joined = connected_components(between(links, labels).select(F.col("from").alias("a"), F.col("to").alias("b")))
    moved = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return keep(moved.select("id", F.coalesce("to", "component").alias("component")), "labels")


def join_components(docs: DataFrame, k: int = K_WORDS, percent: int = PERCENT, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link when the Jaccard likeness of their sets of distinct
    ``k``-word shingles is at least ``percent`` hundredths, counted exactly;
    component_id is the smallest doc_id that links reach. A document of fewer
    than ``k`` words has one shingle, its sequence; a null, empty or blank one
    has none and links with nothing. Equal documents are in one component, a
    null doc_id stays null and is not linked, an empty table gives no rows,
    and extra columns are left out. Regions of at most ``leaf`` members compare
    pairs; larger ones that pivots don't divide compare blocks of ``block`` members.
    """
    with setting(docs.sparkSession, *BATCH):
        return _components(docs.select("doc_id", "text"), k, percent, leaf, block)


def linked(measured: DataFrame) -> DataFrame:
    return measured.where("linked and p <> x").select(F.col("p").alias("a"), F.col("x").alias("b"))


def _components(docs: DataFrame, k: int, percent: int, leaf: int, block: int) -> DataFrame:
    sets = keep(shingle_sets(docs, k), "sets")
    real = sets.where("set_hash is not null and doc_id is not null")
    vertices = keep(real.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n")), "vertices")
    cells = shared_regions(docs.where("doc_id is not null"), vertices, k, percent)

    # small regions: pairs that meet often enough, and whose sizes allow a link
    x = cells.where(F.col("size") <= leaf).select("region", "id", "n")
    y = x.select("region", F.col("id").alias("x"), F.col("n").alias("m"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    met = x.join(y, "region").where((F.col("id") < F.col("x")) & fits).groupBy(F.col("id").alias("p"), "x").agg(F.count("*").alias("met"), F.min(F.least("n", "m")).alias("least"))
    often = met.where(F.col("met") >= need_of("least")).select("p", "x", "met")
    near = keep(maybe_linked(often, sets, percent), "near")
    closest = near.groupBy("x").agg(F.max_by("p", F.struct("met", (-F.col("p")).alias("p"))).alias("p"))
    # large ones: members against the most central one, by the sizes of its regions
    large = cells.where(F.col("size") > leaf).select("region", "id", "size")
    crowded = bool(large.limit(1).count())
    weighed = large.join(large.groupBy("id").agg(F.sum("size").alias("weight")), "id")
    pivots = weighed.groupBy("region").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("best")).select("region", (-F.col("best.id")).alias("p"))
    asked = near.select("p", "x")
    if crowded:
        members = keep(large.join(pivots, "region").select("p", F.col("id").alias("x")).distinct(), "members")
        asked = asked.unionByName(members)
    texts = keep(only(docs, asked.select(F.explode(F.array("p", "x")).alias("doc_id")).distinct()), "texts")
    discard(cells)
    links = linked(measure(closest, texts, k, percent))
    if crowded:
        star = keep(measure(members, texts, k, percent).drop("apart"), "star")
        links = links.unionByName(linked(star))
        discard(members)
    found = connected_components(keep(links, "linked"))
    labels = keep(vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    # texts are moved again only for candidates that their closest ones have not connected
    rest = between(near.select(F.col("p").alias("a"), F.col("x").alias("b")), labels).select(F.col("a").alias("p"), F.col("b").alias("x"))
    labels = connect(labels, keep(linked(measure(rest, texts, k, percent)), "linked"))
    discard(near)
    if crowded:
        labels = divide(star, labels, sets, texts, k, percent, leaf, block)
        discard(star)
    discard(texts)

    component = vertices.join(labels, "id").select("set_hash", F.col("component").alias("component_id"))
    joined = sets.join(component, "set_hash", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def need_of(column: str):
    """``need`` of a column."""
    return 1 + F.floor(F.col(column) / 32)


def divide(star: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int, leaf: int, block: int) -> DataFrame:
    """Labels after all links inside the regions of ``star`` (p, x, n, d).

    ``d`` is the distance of the member x to the region's pivot p. Each round
    ends small regions by their pairs, divides large ones by two pivots, and
    compares those by blocks that were hardly divided; both pivots are done
    with, as they were measured against every member.
    """
    widths = star.groupBy("p").agg(F.max(_reach("n", percent)).alias("width"))
    ring = F.floor(F.col("d") / F.greatest("width", F.lit(1)))
    rings = star.where("p <> x").join(widths, "p").select(F.explode(F.array(ring, ring + 1)).alias("ring"), "p", "x", "n")
    cells = keep(rings.select(F.xxhash64("p", "ring").alias("cell"), "x", "n", F.lit(False).alias("stuck")), "cells")
    while True:
        named = cells.join(labels.withColumnRenamed("id", "x"), "x")
        sizes = named.groupBy("cell").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed = keep(named.join(sizes.where("lo <> hi"), "cell"), "mixed")
        discard(cells)
        small, large = mixed.where(F.col("size") <= leaf), mixed.where(F.col("size") > leaf)
        kinds = [g.limit(1).count() for g in (small, large.where("stuck"), large.where("not stuck"))]
        links = []
        if kinds[0]:
            one = small.select("cell", F.col("x").alias("p"), "n", "component")
            two = small.select("cell", "x", F.col("n").alias("m"), F.col("component").alias("other"))
            fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
            pairs = one.join(two, "cell").where((F.col("p") < F.col("x")) & (F.col("component") != F.col("other")) & fits).select("p", "x", F.lit(0).cast("long").alias("met")).distinct()
            links.append(linked(measure(maybe_linked(pairs, sets, percent), texts, k, percent)))
        # two pivots of different components
        first = F.min_by("x", F.struct(F.xxhash64("x"), "x"))
        ends = large.where("component = lo").groupBy("cell").agg(first.alias("p")).join(large.where("component = hi").groupBy("cell").agg(first.alias("q")), "cell")
        if kinds[1]:
            blocks = large.where("stuck").join(ends, "cell").select("cell", "p", "x", "component")
            told = measure(blocks.select("p", "x").distinct(), texts, k, percent, differences=True).select("p", "x", "n", "apart")
            links.append(compare_blocks(blocks.join(told, ["p", "x"]).select("cell", "x", "n", "component", "apart"), percent, block))
        if kinds[2]:
            halves = keep(large.where("not stuck").join(ends, "cell").select("cell", "x", "n", "size", "p", "q"), "halves")
            told = keep(measure(halves.select(F.explode(F.array("p", "q")).alias("p"), "x").distinct(), texts, k, percent).drop("apart"), "told")
            links.append(linked(told))
        if links:
            labels = connect(labels, keep(reduce(DataFrame.unionByName, links).distinct(), "linked"))
        discard(mixed)
        if not kinds[2]:
            return labels
        to_q = told.select(F.col("p").alias("q"), "x", F.col("d").alias("dq"))
        both = halves.join(told.select("p", "x", "d"), ["p", "x"]).join(to_q, ["q", "x"]).where("x <> p and x <> q")
        window = 2 * _reach("n", percent)
        sides = F.array(F.when(F.col("d") - F.col("dq") <= window, F.lit(0)), F.when(F.col("dq") - F.col("d") <= window, F.lit(1)))
        split = both.select("cell", F.explode(F.array_compact(sides)).alias("side"), "x", "n", "size")
        fullest = split.groupBy("cell", "side", "size").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.col("n") / F.col("size")).alias("share"))
        judged = split.join(fullest, "cell").withColumn("stuck", F.col("share") > 0.75)
        whole = F.when(F.col("stuck"), F.col("cell")).otherwise(F.xxhash64("cell", "side"))
        cells = keep(judged.select(whole.alias("cell"), "x", "n", "stuck").distinct(), "cells")
        discard(halves, told)


def _reach(n: str, percent: int):
    """``most_of`` of a column."""
    total = F.col(n) + F.floor(F.col(n) * 100 / percent)
    return F.floor(total * (100 - percent) / (100 + percent))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays, the one of the smallest id.

    Of repeated rows with that id one stays; a null id always does. Texts are
    shuffled only where a bitmap of fixed size says that a row may go.
    """
    found = keep(join_components(docs, **options), "components")
    gone = found.where("doc_id <> component_id").select("doc_id")
    often = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    single = without(docs, gone.unionByName(often))
    again = docs.join(often, "doc_id").select(*docs.columns)
    if not often.limit(1).count():
        return single
    first = Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])
    return single.unionByName(again.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
