"""Whole-session operators against NumPy, whatever the cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import histograms as H
from tidemark.operators import intervals as I  # noqa: E741
from tidemark.operators import populations as P
from tidemark.operators import recursive as R
from tidemark.operators import sharp_waves as W
from tidemark.operators import statistics as T
from tidemark.sources import waveforms as S

# --- sharp waves ------------------------------------------------------------------

RATE = 250.0
OPTIONS = {"wave_band": (1.0, 8.0), "ripple_band": (30.0, 60.0), "block": 0.2, "around": 2.0, "apart": 0.3, "shortest": (0.02, 0.025), "longest": 1.5}


def session(n=12_000, seed=2):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / RATE
    ripple, sharp = 0.2 * rng.normal(size=(2, n))
    planted = np.arange(5, n / RATE - 5, 3.7)
    for p in planted:
        bump = np.exp(-0.5 * ((t - p) / 0.06) ** 2)
        ripple += 1.5 * bump + 2 * bump * np.sin(2 * np.pi * 45 * (t - p))
        sharp -= 1.5 * bump
    return t, ripple, sharp, planted


def smooth(x, taps):
    half = len(taps) // 2
    return np.convolve(np.pad(x, half, "reflect"), taps, "valid")


def plain(ripple, sharp):
    """The whole session in one piece."""
    dog = lambda x, band: (lambda low: low - smooth(low, W.gaussian_taps(band[0], RATE)))(smooth(x, W.gaussian_taps(band[1], RATE)))
    wave = dog(ripple - sharp, OPTIONS["wave_band"])
    power = smooth(np.abs(dog(ripple, OPTIONS["ripple_band"])), W.gaussian_taps(np.mean(OPTIONS["ripple_band"]) / np.pi, RATE))
    size, bound, n = int(RATE * OPTIONS["block"]), int(OPTIONS["around"] * RATE), len(wave)
    half, peaks = size // 2, []
    for a in range(0, n, size):
        i = a + int(wave[a : a + size].argmax())
        if (i % size in (0, size - 1)) and (i in (0, n - 1) or wave[i - 1 : i + 2].argmax() != 1):
            continue
        peaks.append((i, wave[i], power[max(i - half, 0) : i + half + 1].max()))
    at, w, c = (np.array(x) for x in zip(*peaks, strict=True))
    centres = np.array([[w.min(), c.min()], [w.max(), c.max()]])
    while True:
        side = ((w - centres[1, 0]) ** 2 + (c - centres[1, 1]) ** 2) < ((w - centres[0, 0]) ** 2 + (c - centres[0, 1]) ** 2)
        new = np.array([[w[side == i].mean(), c[side == i].mean()] for i in (False, True)])
        if np.allclose(new, centres, rtol=1e-12, atol=0):
            break
        centres = new
    event = side if side.sum() * 2 <= len(side) else ~side
    nth = lambda x, share: np.sort(x)[max(int(np.ceil(len(x) * share)), 1) - 1]
    chosen = event & (w > nth(w[event], 0.1)) & (c > nth(c[~event], 0.5))
    found, last = [], None
    for i, top in zip(at[chosen], c[chosen], strict=True):
        if i < bound or i + bound >= n:
            continue
        near, last = last is not None and (i - last) / RATE < OPTIONS["apart"], i
        s, p = wave[i - bound : i + bound + 1], power[i - bound : i + bound + 1]
        level, quiet = np.median(s) + 0.5 * s.std(ddof=1), np.median(p) + 0.5 * p.std(ddof=1)
        if near or s[bound] < np.median(s) + 2.5 * s.std(ddof=1) or top < np.median(p) + 2.5 * p.std(ddof=1):
            continue
        a = max([j for j in range(bound + 1) if s[j] < level], default=0)
        b = min([j for j in range(bound, len(s)) if s[j] < level], default=2 * bound)
        k = bound - half + int(p[bound - half : bound + half + 1].argmax())
        first = max([j for j in range(k + 1) if p[j] < quiet], default=0)
        end = min([j for j in range(k, len(p)) if p[j] < quiet], default=2 * bound)
        if (end - first < int(0.025 * RATE) and b - a + 1 < int(0.02 * RATE)) or b - a + 1 > int(1.5 * RATE):
            continue
        found.append(((i - bound + a) / RATE, i / RATE, (i - bound + b) / RATE, (s[bound] - np.median(s)) / s.std(ddof=1), (s < s[bound]).mean(), (top - np.median(p)) / p.std(ddof=1), (p < top).mean()))
    return found


@pytest.mark.parametrize("segment", [1_000, 65_536])
def test_sharp_waves_equal_one_pass(spark, segment):
    t, ripple, sharp, planted = session()
    want = plain(ripple, sharp)
    assert len(want) > 0.7 * len(planted) and all(min(abs(planted - peak)) < 0.1 for _, peak, *_ in want)
    rows = spark.createDataFrame([("a", *map(float, r)) for r in zip(t, ripple, sharp, strict=True)], "who string, t double, r double, s double").repartition(4)
    got = sorted(map(tuple, W.detect(rows, "r", "s", RATE, ["who"], segment=segment, **OPTIONS).drop("who").collect()))
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-9)


def test_sharp_waves_of_nothing(spark):
    rows = spark.createDataFrame([], "t double, r double, s double")
    assert W.detect(rows, "r", "s", RATE, **OPTIONS).collect() == []
    assert W.detect(spark.createDataFrame([(0.0, 1.0, None)], rows.schema), "r", "s", RATE, **OPTIONS).collect() == []


def test_order_statistic_is_exact(spark):
    rng = np.random.default_rng(1)
    values = {k: np.round(rng.normal(size=n), 1) for k, n in (("a", 1000), ("b", 1), ("c", 7))}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double")
    for share in (0.0, 0.1, 0.5, 1.0):
        got = {r.k: r.q for r in W.order_statistic(rows, ["k"], "x", share, "q", bins=8).collect()}
        assert got == {k: float(np.sort(v)[max(int(np.ceil(len(v) * share)), 1) - 1]) for k, v in values.items()}


# --- transitions and responses ----------------------------------------------------


def brute_transition(f, method):
    n, best = len(f), []
    for th in range(1, n):
        a, b = f[:th], f[th:]
        if method == "ml" and a.sum() and b.sum():
            l1, l2 = a.sum() / (th + 1), b.sum() / (n - th)
            best.append((-(a.sum() * np.log(l1) + b.sum() * np.log(l2)), th))
        if method == "ls" and th >= 2:
            y, t = np.r_[0, np.cumsum(f)[:-1]], np.arange(1, n + 1)
            design = np.column_stack([np.minimum(t, th), np.maximum(t - th, 0)])
            rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
            best.append(((rest**2).sum(), th))
    return min((round(s, 7), th) for s, th in best)


@pytest.mark.parametrize("method", ["ml", "ls"])
def test_transitions_equal_brute_force(spark, method):
    rng = np.random.default_rng(3)
    series = {k: np.r_[rng.poisson(a, c), rng.poisson(b, 30 - c)] for k, (a, b, c) in {"up": (2, 20, 12), "down": (30, 4, 20), "late": (0, 5, 27)}.items()}
    rows = spark.createDataFrame([(k, i + 1, int(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, bin int, n long")
    got = {r.k: (r.score, r.bin) for r in H.transition(rows, ["k"], method).collect()}
    for k, v in series.items():
        score, th = brute_transition(v, method)
        assert got[k][1] == th and abs(abs(got[k][0]) - abs(score)) < 1e-5
    assert abs(got["up"][1] - 12) <= 1


def test_deconvolution_equals_the_solved_system(spark):
    rng = np.random.default_rng(4)
    n, before, after = 7, 3.5, 3.5
    points = {k: (np.sort(rng.uniform(0, 400, 90)), np.sort(rng.uniform(0, 400, 60))) for k in ("a", "b")}
    frame = lambda i: spark.createDataFrame([(k, float(x)) for k, v in points.items() for x in v[i]], "k string, t double")
    got = {(r.k, r.bin): (r.center, r.response) for r in H.deconvolved(frame(0), frame(1), before, after, n, ["k"]).collect()}
    for k, (signal, events) in points.items():

        def histogram(x):
            d = (x[:, None] - events[None, :]).ravel()
            d = d[abs(d) <= 2 * before]
            return np.bincount(np.minimum((np.floor((d + 2 * before) / (4 * before) * (2 * n - 1))).astype(int), 2 * n - 2), minlength=2 * n - 1).astype(float)

        raw, own = histogram(signal), histogram(events)
        matrix = np.array([[own[n - 1 + i - j] for j in range(n)] for i in range(n)])
        want = np.linalg.solve(matrix, raw[(n + 1) // 2 - 1 :][:n] - raw.mean()) + raw.mean() / len(events)
        assert [got[k, i + 1][1] for i in range(n)] == pytest.approx(want, abs=1e-6)
    assert got["a", 4][0] == pytest.approx(0)
    assert {r.response for r in H.deconvolved(frame(0).limit(0), frame(1), before, after, n, ["k"]).collect()} == {0.0}
    assert H.deconvolved(frame(0), frame(1).limit(0), before, after, n, ["k"]).collect() == []


def test_random_intervals_lie_in_their_spans(spark):
    spans = spark.createDataFrame([("a", 0.0, 10.0), ("b", 100.0, 101.0)], "k string, start double, stop double")
    rows = sorted(I.random_intervals_within(spans, 8, 0.25, ["k"]).collect())
    for k, a, b in (("a", 0, 10), ("b", 100, 101)):
        own = [(r.start, r.stop) for r in rows if r.k == k]
        assert len(own) == 8 and own == sorted(own) and all(a <= x <= y <= b for x, y in own)
        assert all(y <= z for (_, y), (z, _) in zip(own, own[1:]))
        assert sum(y - x for x, y in own) == pytest.approx(0.25 * (b - a))


# --- recursive filters and resampling ------------------------------------------------


@pytest.mark.parametrize(("bands", "passed", "stopped"), [({"passband": (0, 20)}, [1, 5], [40, 100]), ({"passband": (40, 80)}, [55], [5, 20, 115]), ({"stopband": (45, 55)}, [5, 110], [50]), ({"passband": (40, np.inf)}, [90], [3, 15])])
def test_filters_pass_and_stop(bands, passed, stopped):
    parts = R.chebyshev2(5, 30, 250.0, **bands)
    assert (abs(parts.poles) < 1).all()
    assert all(abs(abs(parts.gain(f, 250.0)) - 1) < 0.02 for f in passed)
    assert all(abs(parts.gain(f, 250.0)) < 10 ** (-30 / 20) * 1.001 for f in stopped)


def recursion(x, parts):
    """The filter as a difference equation over its parts, sample by sample."""
    state, out = x[0] / (1 - parts.poles), []
    for v in x:
        state = parts.poles * state + v
        out.append(parts.direct * v + (parts.weights * state).sum().real)
    return np.array(out)


@pytest.mark.parametrize("zero_phase", [False, True])
def test_cells_filter_as_one_pass(spark, zero_phase):
    rng = np.random.default_rng(6)
    parts = R.chebyshev2(5, 20, 250.0, passband=(4, 12))
    x = {"a": rng.normal(size=3000).cumsum(), "b": rng.normal(size=900)}
    rows = spark.createDataFrame([(k, i / 250.0, float(v)) for k, s in x.items() for i, v in enumerate(s)], "k string, t double, x double").repartition(3)
    want = {k: recursion(recursion(s, parts)[::-1], parts)[::-1] if zero_phase else recursion(s, parts) for k, s in x.items()}
    for segment in (170, 65_536):
        got = R.recursive_filter(rows, parts, "x", ["k"], 250.0, zero_phase, segment).orderBy("k", "t").collect()
        for k in x:
            np.testing.assert_allclose([r.filtered for r in got if r.k == k], want[k], atol=1e-9)


def test_an_impulse_is_filtered_as_its_frequencies(spark):
    parts = R.chebyshev2(3, 25, 100.0, passband=(10, 30))
    x = np.zeros(512)
    x[1] = 1.0
    spectrum = np.fft.rfft(recursion(x, parts))
    frequencies = np.fft.rfftfreq(512, 1 / 100.0)
    want = [parts.gain(f, 100.0) * np.exp(-2j * np.pi * f / 100.0) for f in frequencies]
    np.testing.assert_allclose(spectrum, want, atol=1e-6)


@pytest.mark.parametrize(("up", "down"), [(3, 2), (1, 4), (5, 7), (4, 2)])
def test_resampling_equals_a_convolution(spark, up, down):
    rng = np.random.default_rng(8)
    n = 700
    x = rng.normal(size=(n, 2))
    g = np.gcd(up, down)
    u, w = up // g, down // g
    taps = R.resampling_taps(u, w)
    spread = np.zeros((n * u, 2))
    spread[::u] = x
    dense = np.column_stack([np.convolve(spread[:, c], taps)[len(taps) // 2 :][: n * u] for c in (0, 1)])
    want = dense[::w]
    rows = spark.createDataFrame([(i / 50.0, *map(float, r)) for i, r in enumerate(x)], "t double, a double, b double")
    for segment in (64, 65_536):
        got = R.resample(rows, ["a", "b"], [], 50.0, up, down, segment).orderBy("t").collect()
        np.testing.assert_allclose([[r.a, r.b] for r in got], want, atol=1e-12)
        np.testing.assert_allclose([r.t for r in got], np.arange(len(want)) * w / (u * 50.0))
    flat = R.resample(rows.withColumn("a", F.lit(1.0)), ["a"], [], 50.0, up, down).orderBy("t").collect()
    assert all(abs(r.a - 1) < 0.05 for r in flat[len(flat) // 3 : 2 * len(flat) // 3])


def test_gains_stay_in_range(spark):
    row = R.gained(spark.createDataFrame([(100, -30000)], "a long, b long"), {"a": 2.5, "b": 2.0}).first()
    assert (row.a, row.b) == (250, -32768)


# --- waveforms ------------------------------------------------------------------------


def test_waveforms_read_only_the_records_asked_for(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.integers(-32768, 32767, (200, 6, 3), dtype=np.int16)
    path = tmp_path / "s.spk.1"
    x.tofile(path)
    for options in ({}, {"chunk": 7}):
        got = S.read_waveforms(spark, str(path), 3, 6, **options).orderBy("spike").collect()
        assert [r.spike for r in got] == list(range(200))
        assert np.array_equal([r.waveform for r in got], x.transpose(0, 2, 1))
    some = [3, 4, 5, 90, 199, 500]
    got = S.read_waveforms(spark, str(path), 3, 6, some).orderBy("spike").collect()
    assert [r.spike for r in got] == some[:-1] and np.array_equal([r.waveform for r in got], x[some[:-1]].transpose(0, 2, 1))
    reader = S.WaveformReader({"path": str(path), "channels": "3", "samples": "6", "spikes": ",".join(map(str, some))})
    assert [p.runs for p in reader.partitions()] == [((3, 3), (90, 1), (199, 1))]
    assert S.read_waveforms(spark, str(path), 3, 6, []).collect() == []
    times = spark.createDataFrame([(4, 0.5), (90, 0.7)], "spike long, t double")
    amplitudes = S.read_amplitudes(spark, str(path), times, 3, 6, 2, spikes=[4, 90]).orderBy("spike").collect()
    assert [list(r.amplitudes) for r in amplitudes] == [x[i, 1].tolist() for i in (4, 90)]


def test_waveform_filters_reach_the_reader(spark, tmp_path):
    x = np.arange(100 * 4 * 2, dtype=np.int16).reshape(100, 4, 2)
    x.tofile(tmp_path / "s.spk.1")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = S.read_waveforms(spark, str(tmp_path / "s.spk.1"), 2, 4)
        assert [r.spike for r in rows.where("spike in (7, 8, 60)").orderBy("spike").collect()] == [7, 8, 60]
        assert [r.spike for r in rows.where("spike >= 97 and waveform is not null").orderBy("spike").collect()] == [97, 98, 99]
        assert rows.where("spike = 5").first()["waveform"] == x[5].T.tolist()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = S.FilteredReader({"path": str(tmp_path / "s.spk.1"), "channels": "2", "samples": "4"})
    assert list(reader.pushFilters([S.In(("spike",), (7, 8, 60)), S.LessThan(("spike",), 60)])) == []
    assert [p.runs for p in reader.partitions()] == [((7, 2),)]


# --- assemblies and distributions ----------------------------------------------------


def test_planted_assemblies_are_found(spark):
    rng = np.random.default_rng(12)
    units, bins = 16, 1500
    counts = rng.poisson(2.0, (units, bins)).astype(float)
    planted = np.zeros((2, units))
    planted[0, [0, 1, 2, 3]] = planted[1, [3, 8, 9, 10, 11]] = 1  # one unit is in both
    for members in planted:
        counts += members[:, None] * 8 * (rng.random(bins) < 0.04)
    rows = spark.createDataFrame([(f"u{i}", b, int(counts[i, b])) for i in range(units) for b in range(bins)], "unit string, bin long, n long")
    z = P.dense_zscores(rows, 0, bins)
    made = P.assemblies(z, units, bins, independent=True).toPandas().pivot(index="assembly", columns="unit", values="weight")
    made = made[[f"u{i}" for i in range(units)]].to_numpy()
    assert made.shape == (2, units) and np.allclose((made**2).sum(1), 1)
    likeness = made @ (planted / np.linalg.norm(planted, axis=1, keepdims=True)).T
    assert (likeness.max(0) > 0.95).all()
    plain = P.assemblies(z, units, bins).toPandas()
    x = (counts - counts.mean(1, keepdims=True)) / counts.std(1, ddof=1, keepdims=True)
    values = np.linalg.eigvalsh(x @ x.T / (bins - 1))[::-1]
    assert sorted(plain["eigenvalue"].unique(), reverse=True) == pytest.approx(values[:2])


def test_gaps_in_cells_equal_one_window(spark):
    rng = np.random.default_rng(13)
    rows = spark.createDataFrame([("ab"[i % 2], "xy"[int(rng.integers(2))], float(np.round(rng.normal(), 1))) for i in range(600)], "k string, g string, v double")
    one, two = (sorted(map(tuple, T.distribution_distance(rows, "v", "g", "x", "y", ["k"], cell).collect())) for cell in (None, 0.3))
    assert [x[:3] for x in one] == [x[:3] for x in two] and np.allclose([x[3:] for x in one], [x[3:] for x in two])


def test_skewness_of_fields(spark):
    rng = np.random.default_rng(14)
    fields = rng.poisson(3, (5, 12)).astype(float)
    rows = spark.createDataFrame([(u, i + 1, float(x)) for u, f in enumerate(fields) for i, x in enumerate(f)] + [(7, 3, 2.0), (8, 1, 0.0)], "unit int, bin int, rate double")
    got = {r.unit: r.skewness for r in T.field_skewness(rows, ["unit"], 12).collect()}
    x = np.arange(1, 13)
    for u, f in enumerate(fields):
        p = f / f.sum()
        m = (x * p).sum()
        assert got[u] == pytest.approx(((x - m) ** 3 * p).sum() / (((x - m) ** 2 * p).sum()) ** 1.5 * np.sqrt(12 * 11) / 10)
    assert got[7] is None and got[8] is None
