"""Long series: cells give what one window a series gives, without a window over the whole table."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import histograms, intervals, joins, kinematics, ordered, series, signals, statistics, waves
from tidemark.operators.resampling import permutation_difference
from tidemark.operators.statistics import cdf_at

from .test_operators import frame


@pytest.fixture
def samples(spark, monkeypatch):
    monkeypatch.setattr(series, "SEGMENT", 16)
    r = random.Random(4)
    t, rows = 0.0, []
    for i in range(300):
        t += r.choice([0.5, 1.0, 7.0, 40.0])
        rows.append((i, t, float(r.randint(-5, 5)), r.random() < 0.1))
    return frame(spark, rows, "id int, t double, v double, stop boolean")


OPERATORS = {
    "derivative": lambda s, c: ordered.derivative(s, "v", [], cell=c).select("id", "mid", "slope"),
    "cumulative": lambda s, c: ordered.cumulative(s, "v", "stop", [], cell=c).select("id", "total"),
    "moving_average": lambda s, c: ordered.moving_average(s, "v", [], 4, cell=c).select("id", F.round("smoothed", 9)),
    "gaussian": lambda s, c: ordered.gaussian(s, "v", [], 2.0, cell=c).select("id", F.round("smoothed", 9)),
    "extrema": lambda s, c: ordered.extrema(s, "v", [], cell=c).select("id", "kind"),
    "zero_crossings": lambda s, c: ordered.zero_crossings(s, "v", [], cell=c).select("id", "up", "crossing"),
    "trains": lambda s, c: ordered.trains(s, [], 5.0, cell=c).select("start", "stop", "n"),
    "burst_flags": lambda s, c: ordered.burst_flags(s, [], 2.0, cell=c).select("id", "burst"),
    "variation": lambda s, c: ordered.variation(s, [], 2, cell=c).select(F.round("cv", 9), F.round("cv2", 9), "n"),
    "inverse_rate": lambda s, c: ordered.inverse_rate(s, [], cell=c).select("id", "rate"),
    "without_repetitions": lambda s, c: ordered.without_repetitions(s, "v", [], immediate=True, cell=c).select("id"),
    "to_intervals": lambda s, c: intervals.to_intervals(s.withColumn("f", F.col("v") > 0), "f", [], cell=c),
    "threshold": lambda s, c: intervals.threshold(s, "v", 0.0, [], bridge=8.0, cell=c),
    "durations": lambda s, c: histograms.durations(s, [], 10.0, cell=c).select("id", "dt"),
    "ranked": lambda s, c: series.ranked(s, [], "t", c).select("id", "_rank"),
    "asof_down": lambda s, c: joins.asof_join(s.where("id % 3 = 0"), s.where("id % 7 = 1"), ["v"], [], "down", cell=c),
    "asof_up": lambda s, c: joins.asof_join(s.where("id % 3 = 0"), s.where("id % 7 = 1"), ["v"], [], "up", True, cell=c),
    "closest": lambda s, c: joins.match(s.where("id % 3 = 0"), s.where("id % 7 = 1"), [], cell=c),
    "interpolate": lambda s, c: joins.interpolate(s.where("id % 5 = 0"), s.select("id", "t"), "v", [], cell=c),
    "first_after": lambda s, c: joins.first_after(s.where("id % 3 = 0"), s.where("id % 7 = 1"), [], cell=c),
    "match_pairs": lambda s, c: joins.match_pairs(s.where("id % 3 = 0"), s.where("id % 2 = 1"), [], 1.2, cell=c),
    "cycles": lambda s, c: waves.cycles(s, "v", [], cell=c),
    "points_per_cycle": lambda s, c: waves.points_per_cycle(s.where("id % 2 = 0").select("t"), s, "v", [], 50.0, cell=c).select("iid", "n"),
    "delta_waves": lambda s, c: waves.delta_waves(s, "v", [], 1.0, 200.0, 1.0, -1.0, cell=c),
    "spindles": lambda s, c: waves.spindles(s, "v", [], 0.2, 1.0, 2.0, 0.0, 500.0, cell=c).select("start", "peak", "stop", F.round("height", 9)),
    "ripples": lambda s, c: signals.ripples(s, "v", [], 1.0, 0.2, 0.8, 3, 2.0, 0.0, 500.0, cell=c).select("start", "peak", "stop", F.round("power", 9)),
    "linear_velocity": lambda s, c: kinematics.linear_velocity(s.select("id", "t", F.col("v").alias("x"), (F.col("v") * 2).alias("y")), [], cell=c).select("id", F.round("velocity", 9)),
    "angular_velocity": lambda s, c: kinematics.angular_velocity(s, [], "v", cell=c).select("id", F.round("velocity", 9)),
    "mango": lambda s, c: kinematics.mango(s.select("t", F.col("v").alias("x"), F.col("v").alias("y")), s.where("id % 3 = 0").select((F.col("t") + 0.25).alias("t")), [], 50.0, {"velocity": (0.0, 20.0, 4), "acceleration": (-20.0, 20.0, 4)}, cell=c),
    "cdf_at": lambda s, c: cdf_at(s.where("id % 3 = 0").withColumn("v", F.col("t") % 50), s.select("id", (F.col("t") % 50).alias("v")), "v", [], cell=c and 5.0),
}


def rows(df):
    return sorted(map(repr, (tuple(None if x != x else x for x in r) for r in df.toPandas().astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_cells_change_nothing(samples, name):
    f = OPERATORS[name]
    one = rows(f(samples, None))
    assert one and rows(f(samples, 25.0)) == one


@pytest.mark.parametrize("name", ["gaussian", "asof_down", "trains", "cumulative"])
def test_no_window_over_all_rows(samples, name):
    plan = OPERATORS[name](samples, 25.0)._jdf.queryExecution().optimizedPlan().toString()
    for window in re.findall(r"Window \[.*\], \[([^\]]*)\]", plan):
        assert window, plan
    # without keys only the table of cells is in one window
    whole = re.findall(r"Window \[[^\n]*\], (?=\[_cell)", plan)
    assert whole


def brute_pairs(x, y, error):
    out, j = [], 0
    for v in sorted(x):
        while j < len(y) and v > y[j] + error:
            out.append((None, y[j]))
            j += 1
        if j < len(y) and v >= y[j] - error:
            out.append((v, y[j]))
            j += 1
        else:
            out.append((v, None))
    return out + [(None, v) for v in y[j:]]


def test_pairs_against_brute_force(samples):
    x, y = (sorted(r.t for r in samples.where(c).collect()) for c in ("id % 3 = 0", "id % 2 = 1"))
    got = joins.match_pairs(samples.where("id % 3 = 0"), samples.where("id % 2 = 1"), [], 1.2).collect()
    assert sorted(map(repr, ((r.left_t, r.right_t) for r in got))) == sorted(map(repr, brute_pairs(x, y, 1.2)))


def test_permutation_against_brute_force(spark):
    r = random.Random(2)
    data = [(i, "a" if i % 3 else "b", r.gauss(0.3 * (i % 3 > 0), 1)) for i in range(60)]
    df = frame(spark, data, "id int, g string, v double")
    got = permutation_difference(df, "v", "g", "a", "b", "id", [], 50, seed=3).first()
    hashes = {(q.id, q.n): q.h for q in df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).select("id", "n", F.xxhash64("id", "n", F.lit(3)).alias("h")).collect()}
    mean = lambda s: sum(s) / len(s)
    want = mean([v for _, g, v in data if g == "a"]) - mean([v for _, g, v in data if g == "b"])
    na, beyond = sum(g == "a" for _, g, _ in data), 0
    for n in range(1, 51):
        order = [v for _, v in sorted((hashes[i, n], v) for i, _, v in data)]
        beyond += abs(mean(order[:na]) - mean(order[na:])) >= abs(want) * (1 - 1e-12)
    assert got.difference == pytest.approx(want) and got.p == pytest.approx((beyond + 1) / 51)


def test_random_intervals(spark):
    got = intervals.random_intervals(spark, 200, 0.3).orderBy("iid").collect()
    assert [q.iid for q in got] == list(range(200)) and got[0].start >= 0 and got[-1].stop <= 1
    assert all(a.stop <= b.start for a, b in zip(got, got[1:]))
    assert sum(q.stop - q.start for q in got) == pytest.approx(0.3)
    assert [tuple(q) for q in intervals.bins(spark, 0.0, 5.0, 2.0, 1.0).collect()] == [(i, float(i), i + 2.0) for i in range(4)]
    assert intervals.bins(spark, 0.0, 1.0, 2.0).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_spearman_against_ranks(spark, monkeypatch, by):
    monkeypatch.setattr(statistics, "RANK_CELLS", 7)
    r = random.Random(5)
    x = [r.choice([1.0, 2.0, 2.5, 40.0, float("inf"), float("-inf"), r.gauss(0, 5)]) for _ in range(200)]
    data = [("a" if i % 3 else None, v, r.choice([v if abs(v) < 100 else 0.0, r.gauss(0, 9), 3.0])) for i, v in enumerate(x)]
    got = {q[0] if by else "all": (q.rho, q.n) for q in statistics.spearman(frame(spark, [*data, ("a", None, 1.0), ("a", 1.0, None)], "g string, x double, y double"), "x", "y", by).collect()}
    for k in ("a", None) if by else ("all",):
        rows = pd.DataFrame([q[1:] for q in data if not by or q[0] == k], columns=["x", "y"])
        assert got.pop(k) == (pytest.approx(rows["x"].rank().corr(rows["y"].rank())), len(rows))
    assert not got
    flat = frame(spark, [("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert [tuple(q) for q in statistics.spearman(flat, "x", "y", ["g"]).collect()] == [("a", None, 2)]


def test_pairs_of_many_short_chains_are_one_task_group(spark):
    # keys with nulls, null times, and chains that go on over Arrow batches
    r = random.Random(8)
    keys = [None, "a", "b"]
    rows = [(r.choice(keys), float(r.randint(0, 60)), side) for side in (0, 1) for _ in range(150)] + [("a", None, 0), (None, None, 1)]
    df = frame(spark, rows, "k string, t double, side int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for error in (0.0, 1.2):
            want = []
            for k in keys:
                x, y = (sorted(t for c, t, s in rows if c == k and s == side and t is not None) for side in (0, 1))
                want += [(k, *p) for p in brute_pairs(x, y, error)]
            want += [("a", None, None), (None, None, None)]
            made = joins.match_pairs(df.where("side = 0"), df.where("side = 1"), ["k"], error, cell=10.0)
            assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "InArrow" in plan and "FlatMapGroups" not in plan  # no call for each chain
