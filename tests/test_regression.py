"""Circular regressions against brute force."""

import math

import numpy as np
import pytest

from tidemark.operators import regression as R

SCHEMA = "k string, x double, phase double"


def sample(seed, n, slope, offset, noise, ties=False):
    r = np.random.default_rng(seed)
    x = np.round(r.random(n), 1) if ties else r.random(n)
    phase = (slope * x + offset + noise * r.standard_normal(n) + math.pi) % (2 * math.pi) - math.pi
    return x, np.round(phase, 1) if ties else phase


def frame(spark, groups):
    rows = [(k, float(a), float(b)) for k, (x, y) in groups.items() for a, b in zip(x, y)]
    return spark.createDataFrame(rows + [("none", None, 1.0), ("none", 1.0, float("nan"))], SCHEMA).repartition(3)


def slopes(x, y):
    i, j = np.triu_indices(len(x), 1)
    keep = x[i] != x[j]
    return (y[i] - y[j])[keep] / (x[i] - x[j])[keep]


def test_resultant_regression(spark):
    groups = {"a": sample(1, 300, -4.0, 1.0, 0.4), "b": sample(2, 80, 2.5, -2.0, 0.8), None: sample(3, 50, 0.0, 0.5, 0.5)}
    got = {r.k: r for r in R.resultant_regression(frame(spark, groups), ["k"]).collect()}
    assert set(got) == set(groups)
    for k, (x, y) in groups.items():
        strength = lambda a: abs(np.exp(1j * (y - a * x)).mean())
        grid = max(np.linspace(-2 * math.pi, 2 * math.pi, 20001), key=strength)
        best = max(np.linspace(grid - 1e-3, grid + 1e-3, 2001), key=strength)
        assert got[k].n == len(x) and abs(got[k].slope - best) < 2e-6
        a = got[k].slope
        assert abs(got[k].offset - np.angle(np.exp(1j * (y - a * x)).mean())) < 1e-9
        t = abs(a) * x
        u, v = np.sin(y - np.angle(np.exp(1j * y).mean())), np.sin(t - np.angle(np.exp(1j * t).mean()))
        rho = (u * v).sum() / math.sqrt((u * u).sum() * (v * v).sum())
        z = rho * math.sqrt(len(x) * (u * u).mean() * (v * v).mean() / (u * u * v * v).mean())
        assert abs(got[k].r2 - rho**2) < 1e-9 and abs(got[k].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-9


@pytest.mark.parametrize("block, ties", [(4096, False), (64, True)])
def test_median_slope(spark, monkeypatch, block, ties):
    monkeypatch.setattr(R, "BLOCK", block)
    groups = {"a": sample(4, 400 if block == 64 else 2000, -3.0, 0.0, 0.5, ties), "b": sample(5, 33, 1.0, 0.0, 2.0, ties), None: sample(6, 2, 1.0, 0.0, 0.1)}
    got = {r.k: r.slope for r in R.median_slope(frame(spark, groups), ["k"], "x", "phase", steps=255, rounds=5).collect()}
    for k, (x, y) in groups.items():
        assert abs(got[k] - np.median(slopes(x, y))) < 1e-9 * max(1, abs(got[k])), k


def test_median_slope_needs_two_positions(spark):
    rows = frame(spark, {"one": (np.ones(3), np.arange(3.0)), "flat": (np.arange(4.0), np.ones(4))})
    assert {r.k: r.slope for r in R.median_slope(rows, ["k"], "x", "phase", rounds=3).collect()} == {"one": None, "flat": pytest.approx(0.0, abs=1e-3)}
    assert R.median_slope(rows.where("false"), ["k"], "x", "phase", rounds=1).count() == 0


def test_median_value(spark):
    r = np.random.default_rng(7)
    groups = {"a": r.standard_cauchy(501), "b": np.round(r.random(100), 1), None: np.array([3.0, 3.0, 5.0, 9.0])}
    got = {r.k: r.median for r in R.median_value(frame(spark, {k: (v, v) for k, v in groups.items()}), ["k"], "x").collect() if r.k != "none"}
    assert all(abs(got[k] - np.median(v)) < 1e-12 for k, v in groups.items())
    one = frame(spark, {"a": (groups["a"], groups["a"])})
    assert abs(R.median_value(one.where("k = 'a'"), [], "x").first().median - np.median(groups["a"])) < 1e-12


def test_pole_and_theil_sen(spark):
    x, y = sample(8, 250, -5.0, 2.0, 0.3)
    y[:20] = (y[:20] + 1.5 + math.pi) % (2 * math.pi) - math.pi  # what moves least squares
    rows = frame(spark, {"a": (x, y)})
    pole = R.pole_regression(rows, ["k"]).first()
    error = lambda a, b: np.min([(y - a * x - b - 2 * math.pi * k) ** 2 for k in (-1, 0, 1)], axis=0).sum()
    least = error(pole.slope, pole.offset)
    near = [error(pole.slope + da, pole.offset + db) for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3)]
    assert least <= min(near) and abs(pole.slope + 5) < 0.6
    mean = np.angle(np.exp(1j * y).mean())
    assert abs(pole.r2 - (1 - least / ((y - mean) ** 2).sum())) < 1e-9
    ts = R.theil_sen_regression(rows, ["k"]).first()
    z = y - 2 * math.pi * np.round((y - pole.slope * x - pole.offset) / (2 * math.pi))
    a = np.median(slopes(x, z))
    b = np.median(z - a * x)
    assert abs(ts.slope + 5) < 0.3 and abs(ts.slope - a) < 1e-9 and abs(ts.offset - b) < 1e-9
    assert abs(ts.r2 - (1 - ((z - a * x - b) ** 2).sum() / ((y - mean) ** 2).sum())) < 1e-9
