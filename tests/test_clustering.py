"""Functional clustering against brute force, whatever the segments."""

import numpy as np
import pytest

from tidemark.operators import clustering

SCHEMA = "k string, unit string, t double, id long"
REPETITIONS = 12


def points(seed, units, n, copies=()):
    """Random trains; units of ``copies`` follow another one closely."""
    r = np.random.default_rng(seed)
    trains = {f"u{i:02d}": np.sort(r.random(n + 3 * i) * 200) for i in range(units)}
    for a, b in copies:
        trains[f"u{b:02d}"] = trains[f"u{a:02d}"] + 0.05 * r.standard_normal(len(trains[f"u{a:02d}"]))
    return trains


def frame(spark, groups):
    rows = [(k, u, float(t)) for k, trains in groups.items() for u, train in trains.items() for t in train]
    rows += [("a", None, 1.0), ("a", "u00", None), ("a", "u00", float("nan"))]
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], SCHEMA).repartition(3)


def amd(x, y, span):
    gap = lambda p, q: np.abs(p[:, None] - q[None, :]).min(1).mean()
    f, g = len(x) / span, len(y) / span
    return (gap(x, y) + gap(y, x)) / 2 / ((f + g) / (4 * f * g))


def scaled(trains, a, b, span):
    """Distance and significance from ``trains[repetition][cluster]``."""
    d = [amd(trains[r][a], trains[r][b], span) for r in sorted(trains)]
    middle, edge = (np.quantile(d[1:], q, method="hazen") for q in (0.5, 0.05))
    return d[0], (d[0] - middle) / (edge - middle)


def moved_trains(spark, rows, deviation):
    out = {}
    for r in clustering.moved(rows, ["k"], "unit", "id", deviation, REPETITIONS, 7).collect():
        out.setdefault(r.k, {}).setdefault(r._repetition, {}).setdefault(r._name, []).append(r._t)
    return {k: {r: {u: np.array(t) for u, t in units.items()} for r, units in reps.items()} for k, reps in out.items()}


def tree(trains, span):
    names = sorted(trains[0])
    now = {r: {i: t[u] for i, u in enumerate(names, 1)} for r, t in trains.items()}
    members = {i: [u] for i, u in enumerate(names, 1)}
    out = []
    for step in range(1, len(names)):
        pairs = [(i, j) for i in now[0] for j in now[0] if i < j]
        made = {p: scaled(now, *p, span) for p in pairs}
        i, j = max(pairs, key=lambda p: (made[p][1], -p[1], -p[0]))
        new = len(names) + step
        members[new] = sorted(members[i] + members[j])
        out.append((step, i, j, made[i, j][1], made[i, j][0], members[new]))
        for r in now:
            now[r][new] = np.concatenate([now[r].pop(i), now[r].pop(j)])
    return out


@pytest.mark.parametrize("segment, cell", [(4096, None), (37, None), (23, 11.0)])
def test_distances(spark, monkeypatch, segment, cell):
    monkeypatch.setattr(clustering, "SEGMENT", segment)
    groups = {"a": points(1, 4, 40, [(0, 2)]), None: points(2, 3, 15)}
    rows = frame(spark, groups)
    trains = moved_trains(spark, rows, 3.0)
    made = clustering.train_distances(rows, ["k"], "unit", "id", 3.0, REPETITIONS, cell, 7).collect()
    assert len(made) == 6 + 3
    for r in made:
        every = np.concatenate(list(trains[r.k][0].values()))
        assert (r.distance, r.significance) == pytest.approx(scaled(trains[r.k], r.a, r.b, np.ptp(every)), rel=1e-9), (r.k, r.a, r.b)
    assert next(r.significance for r in made if (r.k, r.a, r.b) == ("a", "u00", "u02")) > 1


@pytest.mark.parametrize("units, segment, cell", [(12, 150, 25.0)])
def test_tree(spark, monkeypatch, units, segment, cell):
    monkeypatch.setattr(clustering, "SEGMENT", segment)
    groups = {"a": points(3, units, 20, [(0, 3)]), "b": points(4, 3, 12), "one": points(5, 1, 9)}
    rows = frame(spark, groups)
    trains = moved_trains(spark, rows, 2.0)
    made = clustering.functional_clusters(rows, ["k"], "unit", "id", 2.0, REPETITIONS, cell, 7).collect()
    assert {r.k for r in made} == {"a", "b"}
    for k in ("a", "b"):
        got = sorted((r.step, r.first, r.second, r.significance, r.distance, r.members) for r in made if r.k == k)
        want = tree(trains[k], np.ptp(np.concatenate(list(trains[k][0].values()))))
        assert [(*g[:3], g[5]) for g in got] == [(*w[:3], w[5]) for w in want]
        assert [x for g in got for x in g[3:5]] == pytest.approx([x for w in want for x in w[3:5]], rel=1e-9)
    assert min((r.step, r.members) for r in made if r.k == "a")[1] == ["u00", "u03"]


def test_edge_cases(spark):
    same = spark.createDataFrame([("x", 1.0, 1), ("y", 1.0, 2)], "unit string, t double, id long")
    assert [tuple(r) for r in clustering.train_distances(same, [], "unit", "id", 1.0, 3).collect()] == [("x", "y", None, None)]
    assert [tuple(r) for r in clustering.functional_clusters(same, [], "unit", "id", 1.0, 3).collect()] == [(1, 1, 2, None, None, ["x", "y"])]
    twin = spark.createDataFrame([("x", t, int(t)) for t in (1.0, 5.0)] + [("y", t, 10 + int(t)) for t in (1.0, 5.0)], "unit string, t double, id long")
    assert clustering.train_distances(twin, [], "unit", "id", 1.0, 0).first().distance == 0
    for make in (clustering.train_distances, clustering.functional_clusters):
        assert make(same.where("false"), [], "unit", "id", 1.0, 2).collect() == []
