"""The remapping test against NumPy with the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import remapping

SCHEMA = "k string, unit long, bin long, rate double"
N = 20


def bumps(seed, units, places=None):
    r = np.random.default_rng(seed)
    at = r.integers(3, N - 3, units) if places is None else places
    return at, np.array([[float(max(0, 9 - (b - p) ** 2)) for b in range(1, N + 1)] for p in at])


def frame(spark, groups):
    rows = [(k, u, b + 1, float(rate)) for k, fields in groups.items() for u, field in enumerate(fields) for b, rate in enumerate(field) if rate]
    return spark.createDataFrame([*rows, ("a", 900, 1, 1.0), ("a", 1, None, 1.0), ("a", None, 2, 1.0)], SCHEMA).repartition(3)


def lag(x, y, circular):
    n = len(x)
    r = {m: sum(x[i] * y[i + m] for i in range(n) if 0 <= i + m < n) for m in range(1 - n, n)}
    best = max(r, key=lambda m: (r[m], -abs(m), -m))
    return best - n * np.sign(best) if circular and 2 * abs(best) > n else best


def relative(x, y, circular):
    return lag(x, y, circular) / (((x > 0).sum() + (y > 0).sum()) / 2)


@pytest.mark.parametrize("circular", [False, True])
def test_shifts(spark, circular):
    _, x = bumps(1, 30)
    _, y = bumps(2, 30)
    got = {r.unit: (r.shift, r.relative) for r in remapping.field_shifts(frame(spark, {"b": x}).where("k = 'b'"), frame(spark, {"b": y}).where("k = 'b'"), ["k", "unit"], N, circular).collect()}
    assert got == {u: pytest.approx((lag(x[u], y[u], circular) / N, relative(x[u], y[u], circular))) for u in range(30)}


def test_remapping(spark):
    at, control = bumps(3, 25)
    _, repeat = bumps(4, 25, at + np.arange(25) % 2)
    _, near = bumps(5, 25, at + 1)
    _, other = bumps(6, 25)
    of = lambda a, b: frame(spark, {"a": a, None: b})
    made = {r.k: r for r in remapping.remapping_test(of(control, control), of(repeat, repeat), of(near, other).where("unit < 900 or unit is null"), ["k"], "unit", N, 60, seed=3).collect()}
    assert set(made) == {"a", None}
    units = frame(spark, {"a": control}).where("unit < 900").select("unit").distinct().withColumn("_at", remapping.uniform("unit", seed=3)).orderBy("_at").toPandas()["unit"].tolist()
    numbered = spark.createDataFrame([(i, 25) for i in range(25)], "_rank long, _n long")
    draws = remapping._draws(numbered, 60, 3).select("repetition", "_rank", "_other").collect()
    for k, test in (("a", near), (None, other)):
        want = np.array([relative(x, y, False) for x, y in zip(control, test)])
        assert (made[k].n, made[k].shift) == (25, pytest.approx(np.abs(want).mean()))
        assert made[k].control_shift == pytest.approx(np.mean([abs(relative(x, y, False)) for x, y in zip(control, repeat)]))
        null = {}
        for d in draws:
            null.setdefault(d.repetition, []).append(abs(relative(control[units[d._rank]], control[units[d._other]], False)))
        assert made[k].p == pytest.approx(np.mean([np.mean(v) <= np.abs(want).mean() * (1 + 1e-12) for v in null.values()]))
        assert made[k].relative_low <= want.mean() <= made[k].relative_high
    assert made["a"].p == 0 and made[None].p > 0.05
    assert made["a"].shift_low == pytest.approx(1 / N) == made["a"].shift_high


def test_edge_cases(spark):
    _, x = bumps(7, 3)
    fields = frame(spark, {"a": x})
    none = fields.where("false")
    assert remapping.remapping_test(none, none, none, [], "unit", N, 5).collect() == []
    silent = spark.createDataFrame([("a", 1, 1, 0.0), ("a", 2, 3, 0.0)], SCHEMA)
    made = remapping.remapping_test(silent, silent, silent, ["k"], "unit", N, 5).collect()
    assert [(r.k, r.n, r.shift, r.p, r.relative_low) for r in made] == [("a", 0, None, None, None)]
    twice = fields.unionByName(fields).where(F.col("unit") < 3)
    assert remapping.remapping_test(twice, fields, fields, ["k"], "unit", N, 5).first().shift == 0
