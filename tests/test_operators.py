"""Documented examples and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import distributions as D
from tidemark.operators import histograms as H
from tidemark.operators import intervals as I
from tidemark.operators import joins as J
from tidemark.operators import mazes, signals
from tidemark.operators import ordered as O
from tidemark.operators import populations as P
from tidemark.operators import statistics as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def spans(spark, rows, k=0):
    return frame(spark, [(k, i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "k int, iid int, start double, stop double")


def pairs(df):
    return sorted((r.start, r.stop) for r in df.collect())


@pytest.mark.parametrize("x,low,high,n,want", [([2, 2.3, 4, 4.7], 2, 5, 3, [1, 1, 3, 3]), ([2, 2.3, 4, 4.7], 2, 5, 6, [1, 1, 5, 6]), ([2, 2.3, 4, 4.2, 5], 2, 5, 3, [1, 1, 3, 3, 3]), ([1, 9], 2, 5, 3, [1, 3])])
def test_bins(spark, x, low, high, n, want):
    df = frame(spark, [(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    assert [r.b for r in df.select("i", C.bin_index(F.col("x"), low, high, n).alias("b")).orderBy("i").collect()] == want


def test_bins_trim_and_missing(spark):
    df = frame(spark, [(1.0,), (2.0,), (5.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(C.bin_index(F.col("x"), 2, 5, 3, trim=True)).collect()] == [None, 1, 3, None, None]


def test_restarting_sum(spark):
    x = [1, 4, 6, 2, 13, 2, 4, 6, 5, 10, 1]
    df = frame(spark, [(0, i, v, i in (0, 5)) for i, v in enumerate(x, 0)], "k int, t int, v int, s boolean")
    # a restart after row 1 and row 6
    got = [r.total for r in O.cumulative(df, "v", "s", ["k"]).orderBy("t").collect()]
    assert got == [1, 4, 10, 12, 25, 27, 4, 10, 15, 25, 26]


def test_runs_of_true(spark):
    flags = [0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 0]
    df = frame(spark, [(0, i + 1, bool(v)) for i, v in enumerate(flags)], "k int, t int, v boolean")
    assert pairs(I.to_intervals(df, "v", ["k"])) == [(3, 5), (9, 10)]


def test_consolidation(spark):
    assert pairs(I.consolidate(spans(spark, [(10, 20), (15, 25)]), ["k"])) == [(10, 25)]
    touching = spans(spark, [(0, 1), (1, 2), (3, 2), (4, 4)])
    assert pairs(I.consolidate(touching, ["k"])) == [(0, 2), (4, 4)]
    assert pairs(I.consolidate(touching, ["k"], strict=True)) == [(0, 1), (1, 2), (4, 4)]
    assert pairs(I.consolidate(touching, ["k"], epsilon=2)) == [(0, 4)]
    r = np.random.default_rng(0)
    many = [(a, a + w) for a, w in zip(r.uniform(0, 500, 200), r.exponential(2, 200))]
    assert pairs(I.consolidate(spans(spark, many), ["k"])) == pairs(I.consolidate(spans(spark, many), cell=7.0))
    assert I.consolidate(touching.limit(0), ["k"]).count() == 0


def test_intersection_and_difference(spark):
    a, b = spans(spark, [(10, 20), (25, 35), (45, 50)]), spans(spark, [(15, 30), (55, 70)])
    assert pairs(I.intersect(a, b, 10.0, ["k"])) == [(15, 20), (25, 30)]
    assert pairs(I.subtract(a, b, 10.0, ["k"])) == [(10, 15), (30, 35), (45, 50)]
    assert pairs(I.subtract(spans(spark, [(0, 10)]), spans(spark, [(2, 3), (5, 6)]), 3.0, ["k"])) == [(0, 2), (3, 5), (6, 10)]
    assert pairs(I.exclude(a, b, 10.0, ["k"])) == [(45, 50)]
    assert [r.intersects for r in I.intersecting(a, b, 10.0, ["k"]).orderBy("iid").collect()] == [True, True, False]


def test_splitting(spark):
    x = spans(spark, [(2, 5), (6, 10)])
    assert pairs(I.split(x, 2.0)) == [(2, 4), (6, 8), (8, 10)]
    assert pairs(I.split_evenly(x, 2)) == [(2, 3.5), (3.5, 5), (6, 8), (8, 10)]
    y = spans(spark, [(0, 2.1)])
    assert pairs(I.split(y, 1.0)) == [(0, 1), (1, 2)]
    assert pairs(I.split(y, 1.0, keep="keep")) == [(0, 1), (1, 2), (2, 2.1)]
    assert pairs(I.split(y, 1.0, keep="keep", extend=True)) == [(0, 1), (1, 2), (2, 3)]


def test_membership(spark):
    points = frame(spark, [(0, i, float(t)) for i, t in enumerate([0, 1, 1, 2, 5, 9])] + [(0, 6, None)], "k int, id int, t double")
    got = I.in_intervals(points, spans(spark, [(1, 2), (2, 5)]), 2.0, ["k"], "id").orderBy("id").collect()
    assert [r.iid for r in got] == [None, 0, 0, 1, 1, None, None]
    assert [r.place for r in got] == [None, 1, 2, 1, 2, None, None]
    counts = I.count_in_intervals(points, spans(spark, [(1, 2), (3, 4), (0, 100)]), 2.0, ["k"]).orderBy("iid").collect()
    assert [r.n for r in counts] == [3, 0, 6]
    moved = I.restrict(points, spans(spark, [(1, 2), (5, 9)]), 2.0, ["k"], shift=True).orderBy("t").collect()
    assert [r.t for r in moved] == [0, 0, 1, 1, 5]
    back = I.unshift(I.restrict(points, spans(spark, [(1, 2), (5, 9)]), 2.0, ["k"], shift=True).where("t <> 1"), spans(spark, [(1, 2), (5, 9)]), 2.0, ["k"])
    assert sorted(r.t for r in back.collect()) == [1, 1, 9]


def test_matching(spark):
    left = frame(spark, [(0, float(t)) for t in (1, 2, 5, 9)], "k int, t double")
    right = frame(spark, [(0, float(t)) for t in (2, 4, 6)], "k int, t double")
    times = lambda d, **o: [r.matched_t for r in J.match(left, right, ["k"], d, **o).orderBy("t").collect()]
    assert times("up") == [2, 2, 6, None]
    assert times("down") == [None, None, 4, 6]
    assert times("down", strict_down=False) == [None, 2, 4, 6]
    assert times("closest") == [2, 2, 6, 6]
    assert times("closest", error=1.0) == [2, 2, 6, None]
    y = J.interpolate(right.withColumn("v", F.col("t") * 10), left, "v", ["k"]).orderBy("t").collect()
    assert [r.v for r in y] == [None, 20, 50, None]


def test_repetitions_and_numbers(spark):
    df = frame(spark, [(0, i, v) for i, v in enumerate([1, 1, 3, 4, 5, 5, 5, 2, 1], 1)], "k int, t int, v int")
    assert [r.t for r in O.without_repetitions(df, "v", ["k"]).orderBy("t").collect()] == [1, 3, 4, 5, 8]
    assert [r.t for r in O.without_repetitions(df, "v", ["k"], immediate=True).orderBy("t").collect()] == [1, 3, 4, 5, 8, 9]
    df = frame(spark, [(0, i, v) for i, v in enumerate([30, 4, 4, 5, 30, 6])], "k int, t int, v int")
    assert [r.number for r in O.renumber(df, "v", ["k"]).orderBy("t").collect()] == [1, 2, 2, 3, 1, 4]


@pytest.mark.parametrize("args,z,p", [((16, 20, 59, 98), 1.6764, 0.0937)])
def test_two_proportions(spark, args, z, p):
    got = spark.range(1).select(C.binomial_z(*map(F.lit, args)).alias("z")).first().z
    assert got == pytest.approx(z, abs=1e-4) and D.normal_two_tailed(got) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize("s,n,q,z", [(9, 11, 0.5, 2.1106), (26, 321, 0.05, 2.5481)])
def test_one_proportion(spark, s, n, q, z):
    assert spark.range(1).select(C.proportion_z(F.lit(s), F.lit(n), q)).first()[0] == pytest.approx(z, abs=1e-4)


def test_tails():
    assert D.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert D.t_two_tailed(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.poisson_tail(3, 1.0) == pytest.approx(1 - math.exp(-1) * 2.5, abs=1e-12)


def test_correlogram_is_symmetric(spark):
    r = np.random.default_rng(1)
    rows = [(0, int(u), float(t)) for u, t in zip(r.integers(0, 3, 300), np.sort(r.uniform(0, 50, 300)))]
    got = {(x.a, x.b, x.bin): x.n for x in H.correlogram(frame(spark, rows, "k int, unit int, t double"), "unit", 0.5, 4, ["k"]).collect()}
    want = {}
    for _, u, t in rows:
        for _, v, s in rows:
            b = math.floor((s - t) / 0.5 + 0.5)
            if abs(b) <= 4 and (u != v or s != t):
                want[u, v, b] = want.get((u, v, b), 0) + 1
    assert got == want


def test_histogram_counts_events_without_points(spark):
    e = frame(spark, [(0, 0, 10.0), (0, 1, 100.0)], "k int, id int, t double")
    p = frame(spark, [(0, 9.0), (0, 10.0), (0, 12.0)], "k int, t double")
    got = H.peth(p, e, 2.0, 2.0, 4, ["k"]).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 1, 1, 1] and got[1].rate == 0.5


def test_map_rates(spark):
    s = frame(spark, [(0, float(i), float(i % 2)) for i in range(11)], "k int, t double, x double")
    p = frame(spark, [(0, 0.5), (0, 2.5), (0, 3.5)], "k int, t double")
    got = {r.x: (r.time, r["count"], r.rate) for r in H.rate_map(s, p, {"x": (0, 1, 2)}, ["k"], 2.0, 2.0).collect()}
    assert got == {1: (6.0, 2, 2 / 6), 2: (5.0, 1, 0.2)}


def test_circular_statistics(spark):
    r = np.random.default_rng(2)
    a = r.vonmises(1.0, 4.0, 500)
    df = frame(spark, [("g", float(x)) for x in a], "g string, x double").unionByName(frame(spark, [("g", None)], "g string, x double"))
    got = S.circular_summary(df, "x", ["g"]).first()
    z = np.exp(1j * a).mean()
    assert (got.n, got.direction, got.r) == (500, pytest.approx(np.angle(z)), pytest.approx(abs(z)))
    assert got.kappa == pytest.approx(4.0, rel=0.2) and got.p < 1e-6
    pairs_mean = (abs(np.exp(1j * a).sum()) ** 2 - 500) / (500 * 499)
    assert got.ppc == pytest.approx(pairs_mean)


def test_watson_statistic(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 6.0]
    df = frame(spark, [(0, "a", x) for x in a] + [(0, "b", x) for x in b], "k int, g string, x double")
    got = S.distribution_distance(df, "x", "g", "a", "b", ["k"]).first()
    n = sorted(a + b)
    d = np.array([np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x) for x in n])
    assert got.u2 == pytest.approx(4 * 3 / 49 * ((d**2).sum() - d.sum() ** 2 / 7)) and got.gap == pytest.approx(abs(d).max())


def test_filter_and_phase_do_not_depend_on_cuts(spark):
    t = np.arange(2000) / 100
    v = np.sin(2 * np.pi * 8 * t) + np.sin(2 * np.pi * 1 * t)
    df = frame(spark, [(0, float(a), float(b)) for a, b in zip(t, v)], "k int, t double, v double")
    run = lambda n: np.array([r.filtered for r in signals.band_pass(df, "v", ["k"], 5, 12, 100.0, half=100, segment=n).orderBy("t").collect()])
    whole, cut = run(100_000), run(300)
    inner = slice(200, 1800)
    assert np.allclose(whole[inner], cut[inner])
    assert np.corrcoef(cut[inner], np.sin(2 * np.pi * 8 * t)[inner])[0, 1] > 0.999
    narrow = df.select("k", "t", F.sin(2 * math.pi * 8 * F.col("t")).alias("v"))
    got = signals.phase(narrow, "v", ["k"], 100.0, segment=500, halo=250).orderBy("t").collect()
    want = np.mod(2 * np.pi * 8 * t - np.pi / 2, 2 * np.pi)
    error = np.angle(np.exp(1j * (np.array([r.phase for r in got]) - want)))
    assert np.abs(error[inner]).max() < 0.05


def test_spectrogram_peak(spark):
    t = np.arange(1000) / 100
    df = frame(spark, [(0, float(x), float(np.sin(2 * np.pi * 20 * x))) for x in t], "k int, t double, v double")
    got = signals.spectrogram(df, "v", ["k"], 100.0, 200, 100)
    assert got.select("t").distinct().count() == 9
    top = got.groupBy("t").agg(F.max_by("f", "power").alias("f")).collect()
    assert all(abs(r.f - 20) <= 1.5 for r in top)


def test_spectrogram_of_a_text_key_against_numpy(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=90)
    df = frame(spark, [("a", i / 10, float(v)) for i, v in enumerate(x)] + [("b", 0.0, 1.0)], "k string, t double, v double")
    got = {(q.k, round(q.t, 6), round(q.f, 6)): q.power for q in signals.spectrogram(df, "v", ["k"], 10.0, 40, 20).collect()}
    v = signals.tapers(40, 3.0, 5)
    assert np.allclose(v @ v.T, np.eye(5))
    want = {}
    for w in range(3):
        y = x[20 * w : 20 * w + 40]
        for f, p in zip(np.fft.rfftfreq(40, 0.1), (np.abs(np.fft.rfft(v * (y - y.mean()))) ** 2).mean(0) / 10):
            want["a", round(2.0 * w + 2, 6), round(f, 6)] = p
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_gap_parts_a_series(spark):
    x = np.random.default_rng(9).normal(size=300)
    at = np.r_[0:150, 170:320]
    df = frame(spark, [("a", float(t) / 100, float(v)) for t, v in zip(at, x)], "k string, t double, v double")
    for segment in (64, 1000):
        got = np.array([q.filtered for q in signals.band_pass(df, "v", ["k"], 5.0, 20.0, 100.0, half=16, segment=segment).orderBy("t").collect()])
        taps = signals.band_pass_taps(5.0, 20.0, 100.0, 16)
        want = np.r_[tuple(np.convolve(np.pad(p, 16, "reflect"), taps, "valid") for p in (x[:150], x[150:]))]
        assert np.allclose(got, want), segment


def test_isolation_distance(spark):
    r = np.random.default_rng(3)
    x = np.r_[r.normal(0, 1, (60, 3)), r.normal(6, 1, (80, 3))]
    label = [0] * 60 + [1] * 80
    df = frame(spark, [(int(k), [float(v) for v in row]) for k, row in zip(label, x)], "label int, f array<double>")
    got = {q.cluster: q.distance for q in P.isolation_distance(df, "f", "label").collect()}
    m, c = x[:60].mean(0), np.cov(x[:60].T)
    d = np.sort([(v - m) @ np.linalg.inv(c) @ (v - m) for v in x[60:]])
    assert got[0] == pytest.approx(d[59])


def test_isolation_distance_query_takes_all_features(spark, tmp_path):
    from tidemark.plans import catalog

    r = np.random.default_rng(5)
    x = np.r_[r.normal(0, 1, (60, 12)), r.normal(0, 1, (80, 12)) + np.r_[np.zeros(8), np.full(4, 5.0)], r.normal(0, 1, (12, 12))]
    label = [0] * 60 + [1] * 80 + [2] * 12
    frame(spark, [(i, [float(v) for v in row], int(k)) for i, (row, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {q.cluster: (q.n, q.distance) for q in catalog.isolation_distance(spark, str(tmp_path)).collect()}
    m, c = x[:60].mean(0), np.cov(x[:60].T)
    d = np.sort([(v - m) @ np.linalg.inv(c) @ (v - m) for v in x[60:]])
    assert got[0] == (60, pytest.approx(d[59], abs=1e-5))
    assert got[1] == (80, None)  # 72 rows outside
    assert got[2] == (12, None)  # no more rows than features


def test_maze(spark):
    visits = frame(spark, [(1, i, a) for i, a in enumerate(["A", "B", "A", "C"])], "rat int, visit int, arm string")
    got = mazes.maze_scores(visits, ["rat"], ["A", "D"]).first()
    assert (got.visits, got.rewards, got.working, got.reference, got.performance) == (4, 1, 1, 2, 0.25)


def test_coherence_and_point_spectra_against_numpy(spark):
    r = np.random.default_rng(11)
    n, w, rate = 240, 80, 20.0
    a = r.normal(size=n)
    b = 0.5 * np.roll(a, 3) + r.normal(size=n)
    df = frame(spark, [("k", i / rate, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k string, t double, a double, b double")
    spectra = signals.coherogram(df, "a", "b", ["k"], rate, w, 40)
    v = signals.tapers(w, 3.0, 5)
    parts = []
    for i in range(5):
        ja, jb = (np.fft.rfft(v * (x - x.mean())) for x in (a[40 * i : 40 * i + w], b[40 * i : 40 * i + w]))
        parts.append(((np.conj(ja) * jb).mean(0), (np.abs(ja) ** 2).mean(0), (np.abs(jb) ** 2).mean(0)))
    got = {(round(q.t, 6), round(q.f, 6)): q for q in spectra.collect()}
    f = np.round(np.fft.rfftfreq(w, 1 / rate), 6)
    assert len(got) == 5 * len(f)
    for i, (s, pa, pb) in enumerate(parts):
        for j, x in enumerate(f):
            assert got[2.0 * i + 2, x].coherence == pytest.approx(abs(s[j]) / math.sqrt(pa[j] * pb[j]))
            assert got[2.0 * i + 2, x].phase == pytest.approx(np.angle(s[j]))
    s, pa, pb = (np.mean(x, 0) for x in zip(*parts))
    whole = {round(q.f, 6): q.coherence for q in signals.coherence(spectra, ["k"]).collect()}
    assert all(whole[x] == pytest.approx(abs(s[j]) / math.sqrt(pa[j] * pb[j])) for j, x in enumerate(f))
    mean = {round(q.f, 6): (q.power, q.n) for q in signals.spectrum(signals.spectrogram(df, "a", ["k"], rate, w, 40), ["k"]).collect()}
    assert all(mean[x] == (pytest.approx(pa[j] / rate), 5) for j, x in enumerate(f))
    assert signals.band_power(spectra, ["k"], {"low": (0.0, 3.0)}, "coherence").count() == 5

    beat = [float(x) for x in np.arange(0.05, 12, 0.25)]
    power = signals.point_spectrogram(frame(spark, [("k", x) for x in beat], "k string, t double"), ["k"], rate, w, 40).where("t < 10")
    top = power.where("f > 1").groupBy("t").agg(F.max_by("f", "power").alias("f")).collect()
    assert len(top) == 4 and all(min(abs(q.f - 4), abs(q.f - 8)) < 1 for q in top)


def test_wavelets_and_cuts(spark):
    x = np.sin(2 * np.pi * 5 * np.arange(600) / 100)
    df = frame(spark, [("k", i / 100, float(v)) for i, v in enumerate(x)], "k string, t double, v double")
    one, cut = ([q.power for q in signals.wavelet_power(df, "v", ["k"], 100.0, [5.0, 20.0], segment=s).orderBy("t").collect()] for s in (10_000, 150))
    assert np.allclose(one, cut) and np.allclose(np.array(one)[200:400, 0], 1, atol=0.01) and np.array(one)[200:400, 1].max() < 0.01


def test_pairs_of_units_by_blocks(spark):
    # blocks of two or three units, and one unit whose count is the same in every bin
    from tidemark.operators.populations import cofiring
    from tidemark.operators.unit_pairs import correlation_of_correlations

    rng = np.random.default_rng(4)
    x = rng.poisson(0.7, (2, 13, 20))
    x[:, 0, :10] = 0
    x[:, 1, 10:] = 0
    tables = [frame(spark, [(f"u{u}", int(b), int(m[u, b])) for u, b in zip(*np.nonzero(m))], "unit string, bin long, n long") for m in x]
    pairs = [{(f"u{i}", f"u{j}"): np.corrcoef(m[i], m[j])[0, 1] for i in range(13) for j in range(13) if f"u{i}" < f"u{j}" and m[i] @ m[j]} for m in x]
    got = H.unit_correlations(tables[0], 20, block=3)
    assert got.columns == ["a", "b", "r"] and {(r.a, r.b): r.r for r in got.collect()} == pytest.approx(pairs[0])
    both = sorted(set(pairs[0]) & set(pairs[1]))
    want = np.corrcoef([pairs[0][p] for p in both], [pairs[1][p] for p in both])[0, 1]
    for made in (correlation_of_correlations(tables[0], 20, tables[1], 20, block=2), cofiring(tables[0], 20, tables[1], 20)):
        row = made.first()
        assert row.coefficient == pytest.approx(want) and row.n == len(both)
    plan = H.unit_correlations(tables[0], 20, block=3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # no row for a pair and bin is shuffled
    assert cofiring(tables[0].where("false"), 20, tables[1], 20).collect() == [(None, 0)]
    assert H.unit_correlations(tables[0].where("false"), 20).count() == 0


def test_correlogram_of_dense_and_equal_points(spark):
    # few units with many points (counted by places), many with few, equal times, null units, differences at the bins' edges
    rng = np.random.default_rng(6)
    for units, n, half, size in ((2, 400, 3, 0.5), (40, 120, 2, 0.1), (3, 60, 0, 1.0)):
        rows = [(int(u) if u else None, float(x) / 10, int(k)) for u, x, k in zip(rng.integers(0, units, n), rng.integers(0, 90, n), rng.integers(0, 2, n))] + [(1, None, 0)]
        want = {}
        for a, x, j in rows[:-1]:
            for b, y, k in rows[:-1]:
                lag = math.floor((y - x) / size + 0.5)
                apart = x != y or (a is not None and b is not None and a != b)
                if j == k and apart and abs(lag) <= half:
                    want[j, a, b, lag] = want.get((j, a, b, lag), 0) + 1
        got = H.counted_correlogram(frame(spark, rows, "unit int, t double, k int"), "unit", size, half, ["k"]).collect()
        assert {(r.k, r.a, r.b, r.bin): r.n for r in got} == want and len(got) == len(want)
        assert sorted(map(repr, H.correlogram(frame(spark, rows, "unit int, t double, k int"), "unit", size, half, ["k"]).collect())) == sorted(map(repr, got))
    points = frame(spark, rows, "unit int, t double, k int").where("t is not null")
    plan = H.short_time_correlogram(points, "unit", 1.0, 2, 4.0, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Inner" not in plan  # no row for a pair


@pytest.mark.parametrize("rows_of_cell", [1, 30, 1 << 16])
def test_event_histograms_of_a_value_by_running_sums(spark, monkeypatch, rows_of_cell):
    # against the joined form, with times on the bins' edges, null values, events that share a key or see no sample
    monkeypatch.setattr(H, "CELL_ROWS", rows_of_cell)
    rng = np.random.default_rng(9)
    t0 = 1704067200.0
    samples = frame(spark, [(t0 + float(x) / 4, None if x % 11 == 0 else float(v), 1) for x, v in zip(rng.integers(0, 400, 300), rng.normal(50, 9, 300))] + [(None, 1.0, 1)], "t double, value double, k int")
    events = frame(spark, [(int(i // 2), t0 + float(x) / 4, 1) for i, x in enumerate(rng.integers(-40, 440, 60))] + [(99, t0 + 1e6, 1), (98, None, 1)], "id int, t double, k int")
    drop = lambda df: df.drop("k")
    made = H.peth(drop(samples), drop(events), 5.0, 5.0, 10, key="id", value="value")
    want = {(r.event_id, r.bin): r for r in H.peth(samples, events, 5.0, 5.0, 10, ["k"], key="id", value="value").collect()}
    got = {(r.event_id, r.bin): r for r in made.collect()}
    assert made.columns == ["event_id", "bin", "n", "mean", "deviation"] and set(got) == set(want) and len(got) > 100
    for at, r in got.items():
        assert r.n == want[at].n and r.mean == pytest.approx(want[at].mean) and r.deviation == pytest.approx(want[at].deviation, abs=1e-6)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # samples are not joined to the events around them
    assert H.peth(drop(samples).where("false"), drop(events), 5.0, 5.0, 10, key="id", value="value").count() == 0
