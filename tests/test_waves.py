"""Cycles, waves and waveforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import waves


@pytest.fixture(scope="module")
def tone(spark):
    t = np.arange(400) / 100
    return spark.createDataFrame([(0, float(a), float(np.sin(2 * np.pi * 2 * a - 0.1))) for a in t], "k int, t double, v double")


def test_cycles_hold_points(spark, tone):
    got = waves.cycles(tone, "v", ["k"]).orderBy("iid").collect()
    assert len(got) == 7 and all(r.stop - r.start == pytest.approx(0.5, abs=1e-3) for r in got)
    p = spark.createDataFrame([(0, got[0].start + 0.1), (0, got[0].start + 0.2), (0, got[2].start + 0.1)], "k int, t double")
    assert [r.n for r in waves.points_per_cycle(p, tone, "v", ["k"], 0.5).orderBy("iid").collect()] == [2, 0, 1, 0, 0, 0, 0]


def test_waves_of_the_right_length(spark, tone):
    got = waves.delta_waves(tone, "v", ["k"], 0.4, 0.6, 0.9, -0.9).collect()
    assert 6 <= len(got) <= 8 and all(r.height > 0.99 for r in got)
    assert waves.delta_waves(tone, "v", ["k"], 0.6, 0.9, 0.9, -0.9).count() == 0


def test_artefacts_are_filled(spark):
    s = spark.createDataFrame([(0, float(i), 99.0 if i == 5 else float(i)) for i in range(10)], "k int, t double, v double")
    a = spark.createDataFrame([(0, 5.0)], "k int, t double")
    got = waves.without_artefacts(s, a, "v", ["k"], 0.5, 0.5).orderBy("t").collect()
    assert [r.v for r in got] == [float(i) for i in range(10)]


def test_spindles(spark):
    v = [1.0 + 0.01 * (i % 3) for i in range(400)]
    for i in range(100, 150):
        v[i] = 10.0
    s = spark.createDataFrame([(0, i / 100, x) for i, x in enumerate(v)], "k int, t double, v double")
    got = waves.spindles(s, "v", ["k"], low=1.0, high=2.0).collect()
    assert [(r.start, r.stop) for r in got] == [(1.0, 1.49)]


def test_waveforms(spark):
    d = spark.createDataFrame([([0.0, -1.0, -4.0, -3.0, 1.0, 2.0, 0.0],)], "w array<double>")
    r = d.select(waves.waveform_shape(F.col("w")).alias("s")).first().s
    assert (r.trough, r.peak_after, r.width) == (2, 5, 2)


def test_cross_correlation_finds_a_shift(spark):
    x = np.exp(-((np.arange(40) - 15.0) ** 2) / 8)
    d = spark.createDataFrame([(0, i, float(x[i]), float(x[i - 3])) for i in range(40)], "k int, i int, x double, y double")
    got = waves.cross_correlation(d, ["k"], "x", "y", 5).orderBy(F.desc("r")).first()
    assert got.lag == 3 and got.r == pytest.approx(1.0, abs=1e-3)


def test_replay_line(spark):
    rows = [(0, w, x, 0.9 if x == 2 + 2 * w else 0.1 / 19) for w in range(6) for x in range(1, 21)]
    d = spark.createDataFrame(rows, "k int, window int, x int, p double")
    got = waves.replay_score(d, ["k"], [-2, -1, 0, 1, 2], [1, 2, 3, 10], 0).first()
    assert (got.slope, got.offset) == (2.0, 2.0) and got.score == pytest.approx(0.9)


def test_sequences(spark):
    p = spark.createDataFrame([(0, 1.0, "b"), (0, 2.0, "a"), (0, 3.0, "b"), (0, 11.0, "c")], "k int, t double, u string")
    i = spark.createDataFrame([(0, 1, 0.0, 5.0), (0, 2, 10.0, 12.0)], "k int, iid int, start double, stop double")
    got = {r.iid: r.sequence for r in waves.visit_sequences(p, i, 5.0, ["k"], "u").collect()}
    assert got == {1: ["b", "a"], 2: ["c"]}
