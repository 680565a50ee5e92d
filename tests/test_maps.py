"""Filled maps against a direct solution."""

import numpy as np
import pytest

from tidemark.operators import fields


def direct(grid, weights):
    rows, columns = grid.shape
    a, b = [], []
    for i in range(rows):
        for j in range(columns):
            line = np.zeros((rows, columns))
            if not np.isnan(grid[i, j]):
                line[i, j] = 1
                a.append(line.ravel())
                b.append(grid[i, j])
                continue
            corner = i in (0, rows - 1) and j in (0, columns - 1)
            for w, di, dj, far in ((weights[0], 1, 0, 0 < i < rows - 1), (weights[1], 0, 1, 0 < j < columns - 1)):
                if far:
                    line[i, j] -= 2 * w
                    line[i - di, j - dj] += w
                    line[i + di, j + dj] += w
            if corner:
                line[i, j] = -2
                line[1 if i == 0 else i - 1, j] += 1
                line[i, 1 if j == 0 else j - 1] += 1
            a.append(line.ravel())
            b.append(0)
    return np.linalg.solve(np.array(a), np.array(b)).reshape(grid.shape)


@pytest.mark.parametrize("shape, weights, share", [((50, 50), (1.0, 1.0), 0.6), ((20, 35), (1.0, 3.0), 0.9), ((2, 9), (1.0, 1.0), 0.4)])
def test_relaxed_equals_direct(shape, weights, share):
    r = np.random.default_rng(1)
    grid = r.random(shape) * 10
    grid[r.random(shape) < share] = np.nan
    grid[: shape[0] // 2, : shape[1] // 2] = np.nan  # a corner and its edges
    grid[-1, -1] = 4.0
    made, n, worst = fields._relaxed(grid, weights, 1e-12, 20_000)
    assert 0 < n < 5_000 and worst < 1e-10
    assert np.abs(made - direct(grid, weights)).max() < 1e-8


def test_filled_map(spark):
    r = np.random.default_rng(2)
    grid = r.random((6, 7))
    grid[2:4, 1:5] = np.nan
    rows = [("a", i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(grid)] + [("a", 9, 1, 5.0), ("ring", 3, 3, 1.0), (None, 1, 1, 2.0)]
    made = fields.filled_map(spark.createDataFrame(rows, "k string, i int, j int, v double"), ["k"], "i", "j", "v", 6, 7).toPandas()
    a = made[made.k == "a"].sort_values(["i", "j"])
    assert np.abs(a.v.to_numpy().reshape(6, 7) - direct(grid, (1.0, 1.0))).max() < 1e-9
    assert a.filled.sum() == 8 and a.residual.max() < 1e-10 and a.rounds.nunique() == 1
    assert made[made.k == "ring"].v.count() == 1  # no known border
    lone = made[made.k.isna()]
    assert len(lone) == 42 and np.abs(lone.v - 2.0).max() < 1e-9


def test_filled_map_of_nothing(spark):
    empty = spark.createDataFrame([], "i int, j int, v double")
    assert fields.filled_map(empty, [], "i", "j", "v", 3, 3).count() == 0
    with pytest.raises(ValueError):
        fields.filled_map(empty, [], "i", "j", "v", 1, 3)
