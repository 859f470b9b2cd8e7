"""Placebos and one-feature fits against exact values and plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import conditional as C
from chronoloom.operators import placebo as P


def test_redrawn_labels_equal_exact_chances(spark):
    rng = random.Random(1)
    rows = [(s, i, int(rng.random() < 0.5), int(rng.random() < 0.3), i < m) for s, n, m in (("a", 6, 2), ("b", 7, 3), ("c", 4, 0)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", 99, None, 1, True)], "s string, i int, x int, z int, hit boolean")
    got = {r.score: r for r in P.stratum_placebo(df, ["s"], ["x", "z"], "hit", replicates=19_999).collect()}
    sums = []
    for pick in itertools.product(*[list(itertools.combinations([r for r in rows if r[0] == s], m)) for s, m in (("a", 2), ("b", 3))]):
        own = [r for part in pick for r in part]
        sums.append((sum(r[2] for r in own), sum(r[3] for r in own)))
    seen = [sum(r[k] for r in rows if r[4]) for k in (2, 3)]
    center = np.mean(sums, axis=0)
    for k, name in enumerate("xz"):
        exact = sum(v[k] >= seen[k] for v in sums) / len(sums)
        assert got[name].n == 5 and got[name].observed == seen[k] / 5
        assert abs(got[name].p_value - exact) < 4 * math.sqrt(exact * (1 - exact) / 19_999) + 1e-3
        assert got[name].null_mean == pytest.approx(center[k] / 5, abs=0.01)
    exact = sum(max(np.array(v) - center) >= max(seen - center) - 1e-9 for v in sums) / len(sums)
    assert abs(got["x"].max_p_value - exact) < 0.03 and got["x"].max_p_value == got["z"].max_p_value
    again = P.stratum_placebo(df.repartition(7), ["s"], ["x", "z"], "hit", replicates=19_999).collect()
    assert {r.score: r.p_value for r in again} == {k: r.p_value for k, r in got.items()}
    assert P.stratum_placebo(df.limit(0), ["s"], ["x"], "hit").count() == 0
    free = P.stratum_placebo(df, ["s"], ["x"], "hit", replicates=19_999, replace=True).first()
    assert free.p_value != got["x"].p_value and abs(free.null_mean - got["x"].null_mean) < 0.02


def test_uniform_cells(spark):
    rows = [("even", i % 60) for i in range(600)] + [("odd", i % 7) for i in range(300)] + [("few", 1)] * 2 + [("even", None), ("even", 75)]
    got = {r.g: r for r in P.uniform_cells(spark.createDataFrame(rows, "g string, s int"), ["g"], "s", 60).collect()}
    assert got["even"].chi_square == 0 and got["even"].p_value == 1 and got["odd"].p_value == 1 / 20_000
    assert got["few"].n == 2 and abs(got["few"].p_value - 1 / 60) < 0.004  # both in one cell


def strata(rng, n=120):
    rows = []
    for g in range(n):
        cands = [(g, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 0.3)) for _ in range(rng.randrange(2, 8))]
        w = [math.exp(o + 1.2 * x) for _, x, _, o in cands]
        case = rng.choices(range(len(cands)), weights=w)[0]
        rows += [(*c, int(i == case)) for i, c in enumerate(cands)]
    return rows


def plain_ll(rows, k, beta):
    total = 0.0
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        eta = [r[3] + beta * r[k] for r in own]
        total += eta[[r[4] for r in own].index(1)] - math.log(sum(map(math.exp, eta)))
    return total


def test_fits_equal_golden_section(spark):
    rows = strata(random.Random(2))
    df = spark.createDataFrame([*rows, (0, None, 1.0, 0.0, 0)], "g int, x double, z double, o double, y int")
    got = {r.feature: r for r in C.fit_single_features(df, ["g"], "y", "o", ["x", "z"]).collect()}
    ratio = (math.sqrt(5) - 1) / 2
    for k, name in ((1, "x"), (2, "z")):
        a, b = -8.0, 8.0
        while b - a > 1e-9:
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            a, b = (a, d) if plain_ll(rows, k, c) > plain_ll(rows, k, d) else (c, b)
        assert got[name].beta == pytest.approx(a, abs=1e-5) and got[name].ll == pytest.approx(plain_ll(rows, k, a), rel=1e-10)
        assert got[name].null_ll == pytest.approx(plain_ll(rows, k, 0.0), rel=1e-10)
    tested = {r.feature: r for r in C.randomized_gain(df, ["g"], "y", "o", {f: r.beta for f, r in got.items()}, replicates=999).collect()}
    assert tested["x"].gain == pytest.approx(got["x"].gain, rel=1e-9) and tested["x"].p_value == 0.001 and tested["z"].p_value > 0.02
    with pytest.raises(ValueError, match="exactly one case"):
        C.fit_single_features(df.withColumn("y", F.lit(0)), ["g"], "y", "o", ["x"])
