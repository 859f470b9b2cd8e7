"""Isolation forest, segmentation and tree rules against plain twins and planted truth."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import detection as D
from chronoloom.operators import policy as P


def test_isolation_forest_finds_planted_outliers_and_equals_a_twin(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(900)] + [(1000 + i, rng.choice([-9.0, 9.0]) + rng.random(), 30.0 * rng.random() - 40) for i in range(8)] + [(2000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: r.score for r in D.isolation_forest(df, "id", ["a", "b"], trees=40, sample=64).collect()}
    assert got.pop(2000) is None and len(got) == 908
    assert {i for i in sorted(got, key=got.get)[-8:]} == {1000 + i for i in range(8)}
    drawn, size = D.forest_draws(df.dropna(), "id", ["a", "b"], 40, 64, 11)
    samples = {}
    for r in drawn.orderBy("row").collect():
        samples.setdefault(r.tree, []).append((r.a, r.b))
    assert size == 64 and len(samples) == 40 and 30 < sum(map(len, samples.values())) / 40 < 100
    trees = [D.grow(np.array(s), np.random.default_rng([11, t])) for t, s in samples.items()]

    def path(nodes, x, at=0):
        f, cut, left, right, length = nodes[at]
        return length if f < 0 else path(nodes, x, left if x[f] <= cut else right)

    for i, *x in rows[::37]:
        mean = sum(path(nodes, x) for nodes in trees) / len(trees)
        assert got[i] == pytest.approx(2 ** (-mean / float(D.expected_path(64))), rel=1e-9)


def test_trees_hold_their_sample():
    x = np.random.default_rng(2).normal(size=(64, 3))
    nodes = D.grow(x, np.random.default_rng(3))
    inner = [v for v in nodes if v[0] >= 0]
    assert len(nodes) == 2 * len(inner) + 1 and all(v[4] <= 6 + D.expected_path(64) for v in nodes)
    assert D.grow(np.ones((9, 2)), np.random.default_rng(3)) == [(-1, 0.0, -1, -1, pytest.approx(float(D.expected_path(9))))]


def unpruned(x, penalty, least, width):
    n = len(x)
    k = np.exp(-width * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(0, e - least + 1):
            c = best[s] + (e - s) - k[s:e, s:e].sum() / (e - s) + penalty
            if c < best[e]:
                best[e], back[e] = c, s
    out, e = [], n
    while e > 0:
        e = back[e]
        out += [e] if e else []
    return out[::-1], best[n]


def test_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    for i in range(25):
        n, least = int(rng.integers(10, 90)), int(rng.integers(1, 8))
        x = rng.normal(size=(n, 2)) + 4 * (np.arange(n)[:, None] // int(rng.integers(8, 40)) % 2)
        penalty, width = float(rng.choice([0.2, 1.0, 3.0])), D.kernel_width(x)
        if n >= 2 * least:
            borders, cost = D.pelt(x, penalty, least, width)
            want, total = unpruned(x, penalty, least, width)
            assert cost == pytest.approx(total, rel=1e-9) and borders == want
    assert D.pelt(np.zeros((5, 1)), 1.0, 3, 1.0)[0] == []


def test_change_points_of_several_keys(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    rows = [(k, t0 + timedelta(hours=i), rng.gauss(6.0 * (i >= at) - 6.0 * (i >= 2 * at), 1), rng.gauss(0, 1)) for k, at in (("a", 60), ("b", 90)) for i in range(240)]
    rows += [("c", t0, 1.0, 1.0), ("a", t0, None, 1.0)]
    got = D.change_points(spark.createDataFrame(rows, "k string, t timestamp_ntz, x double, z double"), "k", "t", ["x", "z"], least=20, multiples=(1.0, 50.0)).collect()
    assert {(r.k, r.number) for r in got if r.multiple == 50} == {("a", 0), ("b", 0), ("c", 0)}
    by = {(r.k, r.number): r for r in got if r.multiple == 1}
    assert sorted(by) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("c", 0)]
    assert by["a", 0].rows == by["a", 1].rows_before
    for k, at in (("a", 60), ("b", 90)):
        for i in (1, 2):
            assert abs(by[k, i].rows_before - i * at) <= 2 and by[k, i].at == t0 + timedelta(hours=by[k, i].rows_before)


def test_rules_reproduce_the_trees(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(5))
        rows.append((i, a, b, c, int((a > 0.5 and c >= 2) or (b < -1)) if rng.random() < 0.95 else 1))
    rows.append((9999, None, 1.0, 1.0, 1))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    rules, scored = D.boosted_rules(df, "y", ["a", "b", "c"], F.col("id") % 3 != 0, trees=6)
    scored = scored.collect()
    assert len(scored) == 500 and all(r.model_p == pytest.approx(r.rules_p, rel=1e-9) for r in scored)
    rules = rules.collect()
    ops = {"<=": lambda v, c: v <= c, ">": lambda v, c: v > c}
    for r in rules:
        parts = json.loads(r.rule)["parts"]
        hit = [x for x in scored if all(ops[p["op"]](x[p["feature"]], p["value"]) for p in parts)]
        assert (r.n, r.positives) == (len(hit), sum(x.y for x in hit))
        assert isinstance(P.from_json(r.rule), P.And)
    assert all(sum(r.n for r in rules if r.tree == t) == 500 for t in range(6)) and max(r.lift for r in rules if r.n >= 20) > 2
