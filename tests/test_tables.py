"""Whole-table helpers and shapes of fields."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import fields, tables

from .test_operators import frame


def test_draws_follow_the_weights(spark):
    h = frame(spark, [(1, 3.0), (2, 0.0), (3, 1.0)], "bin int, w double")
    got = [r.bin for r in tables.drawn_bins(h, "bin", "w", 4000, seed=5).collect()]
    assert len(got) == 4000 and set(got) == {1, 3} and abs(got.count(1) / 4000 - 0.75) < 0.03
    assert sorted((r.i, r.flag) for r in tables.flags(frame(spark, [(2,), (4,)], "i int"), "i", 5).collect()) == [(1, False), (2, True), (3, False), (4, True), (5, False)]


def test_log_factorial_and_steps(spark):
    rows = frame(spark, [(n,) for n in (0, 1, 2, 7, 20, 170)], "n int").select("n", C.log_factorial(F.col("n")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.n + 1), abs=1e-9) for r in rows)
    one = spark.range(1).select(C.circular_steps(4).alias("a"), C.gamma_steps(1.0, 3.0, 2.0, 5).alias("g")).first()
    assert one.a == pytest.approx([-math.pi, -math.pi / 2, 0, math.pi / 2])
    assert one.g == pytest.approx(list(np.linspace(0, 1, 5) ** 0.5 * 2 + 1))


def test_fields_alone_and_shifted(spark):
    x = [0, 0, 1, 3, 2, 0, 0, 0]
    y = [0, 0, 0, 0, 1, 3, 2, 0]
    rows = lambda v: frame(spark, [("f", i + 1, float(r)) for i, r in enumerate(v)], "k string, bin int, rate double")
    got = [r.rate for r in fields.normalised_fields(rows(x), ["k"], 8).orderBy("bin").collect()]
    want = np.interp(np.linspace(0, 2, 8), [0, 1, 2], [1, 3, 2])
    assert got == pytest.approx(list(want / want.max()))
    shift = fields.field_shift(rows(x), rows(y), ["k"], 8).first()
    assert (shift.shift, shift.relative) == (2 / 8, pytest.approx(2 / 3))


def test_subcycles_and_phase_grid(spark):
    df = frame(spark, [("k", i / 100, 2 * math.pi * i / 40) for i in range(101)], "k string, t double, phase double")
    got = fields.subcycles(df, ["k"], 4).orderBy("start").collect()
    assert [(r.cycle, r.subcycle) for r in got] == [(c, s) for c in (0, 1) for s in (1, 2, 3, 4)]
    assert [r.start for r in got] == pytest.approx([0.1 * i for i in range(8)])
    grid = fields.along_phase(df.withColumn("v", F.col("phase") * 2), "v", ["k"], 10, cell=3.0).orderBy("phase").collect()
    assert len(grid) == 25 and all(r.v == pytest.approx(2 * r.phase) for r in grid)


def test_gain_of_a_model(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=400)
    df = frame(spark, [(i, float(v), float(np.exp(0.5 + 0.8 * v) + 0.05 * r.random())) for i, v in enumerate(x)], "id int, x double, y double")
    assert fields.glm_gain(df, ["x"], "y", "id", folds=2).first().gain > 10
