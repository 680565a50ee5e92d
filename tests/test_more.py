"""Kinematics and resampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kinematics as K
from tidemark.operators import resampling as R


def test_leds(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 3.0, 4.0), (0, 1.0, None, None, 1.0, 1.0), (0, 2.0, 0.0, 0.0, 90.0, 0.0)], "k int, t double, x double, y double, x2 double, y2 double")
    kept = K.head_direction(K.clean_leds(df, 1, 10)).collect()
    assert len(kept) == 1 and kept[0].angle == pytest.approx(math.atan2(4, 3))
    assert K.normalised(df, 10.0, 8.0).orderBy("t").collect()[2].x2 == 1.0


def test_velocities(spark):
    df = spark.createDataFrame([(0, float(i), 3.0 * i, 4.0 * i, 3.0 + i) for i in range(5)], "k int, t double, x double, y double, angle double")
    assert [r.velocity for r in K.linear_velocity(df, ["k"]).orderBy("t").collect()] == [5.0] * 5
    turning = K.angular_velocity(df.withColumn("angle", F.col("angle") % (2 * math.pi)), ["k"]).orderBy("t").collect()
    assert all(r.velocity == pytest.approx(1.0) for r in turning[:-1]) and turning[-1].velocity is None


def test_zone(spark):
    axes = {"x": (0, 1, 2), "y": (0, 1, 2)}
    p = spark.createDataFrame([(0.1, 0.1), (0.9, 0.1), (None, 0.1)], "x double, y double")
    zone = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "x int, y int")
    assert [r.in_zone for r in K.in_zone(p, zone, axes).collect()] == [True, False, False]


def test_precession(spark):
    r = np.random.default_rng(0)
    x = r.uniform(0, 1, 300)
    rows = [(0, float(a), float(1.0 - 2 * np.pi * 0.5 * a + r.normal(0, 0.2))) for a in x]
    got = K.phase_precession(spark.createDataFrame(rows, "k int, x double, phase double"), ["k"]).first()
    assert got.slope == pytest.approx(-0.5, abs=0.05) and got.offset == pytest.approx(1.0, abs=0.1) and got.r > 0.9


def test_bootstrap_and_permutation(spark):
    r = np.random.default_rng(1)
    rows = [("g", i, "ab"[i % 2], float(r.normal(i % 2, 1))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, g string, v double")
    means = R.bootstrap_means(df, "v", "id", ["k"], 200)
    got = R.interval(means, "mean", ["k"]).first()
    v = np.array([x[3] for x in rows])
    half = 1.96 * v.std(ddof=1) / 20
    assert got.low == pytest.approx(v.mean() - half, abs=0.05) and got.high == pytest.approx(v.mean() + half, abs=0.05)
    test = R.permutation_difference(df, "v", "g", "a", "b", "id", ["k"], 99).first()
    assert test.p == 0.01 and test.difference == pytest.approx(v[::2].mean() - v[1::2].mean())
    none = R.permutation_difference(df.withColumn("v", R.uniform(F.col("id"), seed=5)), "v", "g", "a", "b", "id", ["k"], 99).first()
    assert none.p > 0.05


def test_jitter_and_trains(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id int, t double")
    got = R.jittered(df, "id", 0.5, 3)
    assert got.count() == 150 and got.where(F.abs(F.col("t") - F.col("id")) > 0.5).count() == 0
    train = R.poisson_train(spark, "unit", 4, 2.0, 100.0)
    assert train.count() == 800 and train.agg(F.min("t") >= 0, F.max("t") < 100).first() == (True, True)


def test_permutations_do_not_broadcast_the_copies(spark):
    # the copies are n times the rows, which a plan's estimate of size does not see
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    for by in ([], ["k"]):
        got = R.permutation_difference(df, "v", "g", "a", "b", "id", by, 30)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        join = next(line for line in plan.splitlines() if "Join Inner" in line and "_bin" in line)
        assert "rightHint=(strategy=broadcast)" in join and "leftHint" not in join
    # brute force: the labels of a go to the rows of lowest hash
    rows = df.crossJoin(spark.range(1, 31).select(F.col("id").cast("int").alias("repetition"))).withColumn("h", F.xxhash64("id", "repetition", F.lit(0))).toPandas()
    na = int((rows[rows.repetition == 1].g == "a").sum())
    seen = rows[rows.repetition == 1].groupby("g").v.mean()
    beyond = 0
    for _, one in rows.groupby("repetition"):
        v = one.sort_values(["h", "id"]).v.to_numpy()
        beyond += abs(v[:na].mean() - v[na:].mean()) >= abs(seen["a"] - seen["b"]) * (1 - 1e-12)
    found = R.permutation_difference(df, "v", "g", "a", "b", "id", [], 30).first()
    assert abs(found.difference - (seen["a"] - seen["b"])) < 1e-9 and found.p == (beyond + 1) / 31
