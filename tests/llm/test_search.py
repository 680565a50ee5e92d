"""Hard negatives, nearest neighbours and ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, hard_negatives, ranked_search, vantage

from .util import ODD, docs, empty, prose

VECTORS = "vec_id long, embedding array<float>, label int, score double, id string, v int, _lane string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, 7.0, "x", 3, "y") for i, v, label in rows], VECTORS)


def odd_rows(n=400, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    grid = rng.integers(-3, 4, (n, dims)) / 4  # many ties
    rows = [(i, [float(x) for x in grid[i]], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(60)]  # one vector many times
    same = rows[50]
    rows += [same, same, (50, [1.0] * dims, 0)]  # repeated ids
    rows += [(1000, None, 1), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1100, [NAN] + [1.0] * 5, 1), (1150, [INF] + [1.0] * 5, 2), (1200, [], 1), (1250, [1.0, 2.0], 1), (1300, [0.0] * dims, 2), (None, [1.0] * dims, 1), (1350, [1.0] * dims, None)]
    return rows


def good(rows, dims=6):
    return [(i, v, label) for i, v, label in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def mined(rows, every=50):
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in good(rows) if label is not None]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    asked = {}
    for i, v, label in own:
        if i % every == 0:
            asked[i] = min(asked.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in asked.items():
        others = sorted((-score(v, w), j, m) for j, w, m in own if j != i)
        for s, j, _ in [x for x in others if x[2] == label][:5]:
            inside = [(t, k) for t, k, m in others if m != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(inside[:3])]
    return sorted(out)


@pytest.mark.parametrize(("block", "bits"), [(4096, 6), (3, 2), (3, 8)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, bits):
    monkeypatch.setattr(blocks, "LEAST_LANES", 3)
    monkeypatch.setattr(hard_negatives, "_SLAB", 64)
    rows = odd_rows()
    made = hard_negatives.mine(vectors(spark, rows).repartition(5), F.col("vec_id") % 50 == 0, bits=bits, block=block)
    assert made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert len(want) > 50 and sorted(map(tuple, made.collect())) == want


def test_negatives_of_few_and_of_large_numbers(spark):
    few = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.6, 0.0], 2)]
    assert [tuple(r) for r in hard_negatives.mine(vectors(spark, few), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 256 * 230, 256 * 153)]
    large = [(i, [x * 1e5 for x in v], label) for i, v, label in few]
    assert hard_negatives.mine(vectors(spark, large), F.col("vec_id") == 0).first()["negative_id"] == 2
    assert hard_negatives.mine(vectors(spark, few[:2]), F.col("vec_id") == 0).collect() == []
    assert hard_negatives.mine(vectors(spark, few), F.lit(None).cast("boolean")).collect() == []


def test_bounds_enclose_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-200, 200, (500, 9))
    edges = np.quantile(v[:100], np.arange(1, 8) / 8, axis=0, method="higher").T.copy()
    frame = spark.createDataFrame([(i, 0, [int(x) for x in r]) for i, r in enumerate(v)], "id long, label long, v array<long>")
    table = hard_negatives.approximate(frame, 9, edges).toArrow()
    slab = hard_negatives._Slab(table.combine_chunks().to_batches()[0], 9, edges)
    least, most = slab.bounds(slab.v[:20], slice(None))
    exact = slab.v[:20] @ slab.v.T
    assert (least <= exact).all() and (exact <= most).all()
    assert (most - least).mean() < 0.5 * (exact.max() - exact.min())


def cosines(rows, every=50, k=5, dims=6):
    own = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in good(rows, dims) if any(v)]
    length = lambda v: math.sqrt(np.cumsum(v * v)[-1])
    asked = {}
    for i, v in own:
        if i % every == 0 and (i not in asked or list(v) < list(asked[i])):
            asked[i] = v
    out = []
    for i, v in asked.items():
        near = sorted((-(np.cumsum(v * w)[-1] / (length(v) * length(w))), j) for j, w in own if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "shard", "leaf"), [(4096, 8192, 256), (3, 50, 8), (4096, 37, 4)])
def test_neighbours_equal_brute_force(spark, monkeypatch, block, shard, leaf):
    monkeypatch.setattr(blocks, "LEAST_LANES", 3)
    rows = odd_rows()
    made = vantage.nearest(vectors(spark, rows).repartition(4), F.col("vec_id") % 50 == 0, shard=shard, leaf=leaf, block=block)
    assert sorted(map(tuple, made.drop("share").collect())) == cosines(rows)


def clustered(n=3000, dims=16):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, dims))
    v = centres[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, dims))
    return [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]


def test_factor_trades_recall_for_work(spark):
    rows = clustered()
    frame = vectors(spark, rows).coalesce(1)
    want = {(q, j) for q, _, j, _ in cosines(rows, dims=16)}
    recalls, shares = [], []
    for factor in (1.0, 2.0, 50.0):
        made = vantage.nearest(frame, F.col("vec_id") % 50 == 0, factor=factor, leaf=32).collect()
        recalls.append(len(want & {(r["query_id"], r["vec_id"]) for r in made}) / len(want))
        shares.append(made[0]["share"])
    assert recalls[0] == 1 and recalls[1] >= 0.9 > recalls[2]
    assert shares[0] < 0.5 and shares[1] < shares[0] and shares[2] < shares[1]


def test_a_tree_cut_in_two_loses_nothing(spark):
    """Rows of a shard that a task gets only a part of are compared one by one."""
    rows = odd_rows()
    trees = vantage.index(vectors(spark, rows).coalesce(1), "vec_id", "embedding", 6, shard=100, leaf=8).toArrow()
    asked = spark.createDataFrame([(100, [float(x) for x in rows[100][1]])], "id long, v array<double>").toArrow()
    halves = []
    for part in (trees.slice(0, 170), trees.slice(170)):
        state = vantage._Search(asked, 6, 5, 1.0, 8)
        for batch in part.to_batches(max_chunksize=33):
            state.feed(batch)
        made = state.finish()
        halves += list(zip(made.column(2).to_pylist(), made.column(1).to_pylist(), strict=True))
    first = sorted((-s, j) for s, j in halves)[:5]
    assert [(100, r + 1, j, -s) for r, (s, j) in enumerate(first)] == [x for x in cosines(rows) if x[0] == 100]


def test_no_vectors_no_rows(spark):
    for rows in ([], [(0, None, 1)], [(50, [0.0, 0.0], 1)], [(50, [1.0, 2.0], 1)]):
        assert vantage.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect() == []
        assert hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect() == []


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranked(rows, items, k):
    found = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    asked.pop(None, None)
    out = []
    for i, wanted in asked.items():
        scores = []
        for j, c in found:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0 and j is not None:
                scores.append((-s, j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


TEXTS = [*ODD, "Ünï-cödé, x1 X1!", "a,b;c d\x00e", *[prose(30, s) for s in range(60)], *[prose(12, 3)] * 40, prose(20000, 9), "the " * 500 + prose(5, 2)]
ITEMS = [(0, prose(25, 3)), (1, "Ünï cödé X1"), (2, None), (3, "..."), (4, "nothing_like_it"), (5, "a B c d E"), (5, "x the"), (None, "a b"), (6, prose(4000, 9)), (7, "the the it")]


@pytest.mark.parametrize(("k", "block_terms", "triples"), [(50, 200_000, 1_000_000), (3, 5, 7)])
def test_search_equals_brute_force(spark, monkeypatch, k, block_terms, triples):
    monkeypatch.setattr(blocks, "LEAST_LANES", 3)
    monkeypatch.setattr(ranked_search, "TRIPLES", triples)
    rows = list(enumerate(TEXTS)) + [(None, "x the a"), (3, "it the it")]
    frame = spark.createDataFrame([(i, t, 1, "n", 2, 3) for i, t in rows], "doc_id long, text string, id int, term string, n int, terms int").repartition(6)
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, rank int, id int")
    made = ranked_search.search(frame, items, k, block_terms=block_terms)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, made.collect())) == ranked(rows, ITEMS, k)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(empty(spark), items).collect() == []
    assert ranked_search.search(docs(spark, [None, "", "..."]), items).collect() == []
    assert ranked_search.search(docs(spark, TEXTS), items.limit(0)).collect() == []


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    for top in (3, 70_000, 1 << 47):
        keys = rng.integers(0, top, 5000)
        assert (ranked_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_long_documents_keep_whole_numbers(spark):
    ranking = ranked_search._Ranking(spark.createDataFrame([(1, [5], [10])], "id long, terms array<long>, weights array<long>").toArrow(), 10**11, 10**14, 5)
    n = np.array([10, 10**7, 10**12])
    assert ranking._lengths(n).tolist() == [20 * (50 + 50 * int(x) * 10**11 // 10**14) for x in n]
