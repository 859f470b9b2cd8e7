"""Sequence models against plain loops and planted truth."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import sequences as Q

T0 = datetime(2024, 1, 1)


def two_states(rng, n):
    """Two keys; a state stays with 0.95, and the features' means are four deviations apart."""
    rows = []
    for key in "ab":
        s = 0
        for i in range(n):
            s = s if rng.random() < 0.95 else 1 - s
            rows.append((key, T0 + timedelta(hours=i), len(rows), rng.gauss(4.0 * s, 1), rng.gauss(-2.0 * s, 1), s))
    return rows


def plain_likelihood(h, rows):
    total = 0.0
    for key in "ab":
        a = None
        for _, _, _, *x, _ in (r for r in rows if r[0] == key):
            e = [math.exp(-0.5 * sum((v - m) ** 2 / s + math.log(2 * math.pi * s) for v, m, s in zip(x, h.mean[k], h.var[k], strict=True))) for k in range(len(h.start))]
            a = [p * e[k] for k, p in enumerate(h.start)] if a is None else [e[k] * sum(a[j] * h.move[j, k] for j in range(len(e))) for k in range(len(e))]
            total += math.log(sum(a))
            a = [v / sum(a) for v in a]
    return total


@pytest.mark.parametrize("size", [3, 256])
def test_hidden_states(spark, size):
    rows = two_states(random.Random(5), 220)
    df = spark.createDataFrame([*rows, ("a", T0, -1, None, 1.0, 0)], "key string, ts timestamp_ntz, id long, x double, z double, truth int")
    fits = Q.fit_hidden(df, "key", "ts", "id", ["x", "z"], most=3, rounds=12, rows=size)
    for h, ll, sizes, _ in fits:
        assert ll == pytest.approx(plain_likelihood(h, rows), rel=1e-9) and sizes.sum() == len(rows)
    table = {r.states: r for r in Q.hidden_selection(spark, fits, 2).collect()}
    assert table[2].chosen and table[1].bic > table[2].bic < table[3].bic
    h = fits[1][0]
    assert sorted(h.mean[:, 0]) == pytest.approx([0, 4], abs=0.3) and min(np.diag(h.move)) > 0.9
    got = {r.id: r.state for r in Q.hidden_labels(df, h, "key", "ts", "id", ["x", "z"], rows=size).collect()}
    assert len(got) == len(rows) and sum(got[r[2]] == r[5] for r in rows) > 0.98 * len(rows)


def test_blocks_do_not_change_the_fit(spark):
    rows = two_states(random.Random(6), 60)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, id long, x double, z double, truth int")
    a, b = (Q.fit_hidden(df, "key", "ts", "id", ["x", "z"], most=2, rounds=3, rows=n) for n in (4, 100))
    for (h, ll, _, _), (g, mm, _, _) in zip(a, b, strict=True):
        assert ll == pytest.approx(mm, rel=1e-10) and np.allclose(h.move, g.move) and np.allclose(h.mean, g.mean) and np.allclose(h.start, g.start)


def plain_excitation(rows, w, jump, decay):
    ll = [0.0, 0.0]
    state = {}
    for key, t, _, y, part, z in rows:
        r = 0.0
        if key in state:
            r0, t0, y0 = state[key]
            r = math.exp(-decay * (t - t0)) * (r0 + y0)
        state[key] = r, t, y
        p = 1 - (1 - 1 / (1 + math.exp(-(w[0] + w[1] * z)))) * math.exp(-jump * r)
        ll[part] += y * math.log(p) + (1 - y) * math.log(1 - p)
    return ll


def exciting(rng, n, jump=0.06, decay=0.02):
    rows = []
    for key in "ab":
        t = r = 0.0
        y = 0
        for i in range(n):
            gap = rng.choice([0.0, rng.expovariate(0.1)])
            t += gap
            r = math.exp(-decay * gap) * (r + y)
            z = rng.gauss(0, 1)
            p = 1 - (1 - 1 / (1 + math.exp(3.0 - 0.7 * z))) * math.exp(-jump * r)
            y = int(rng.random() < p)
            rows.append((key, t, len(rows), y, int(i > 0.8 * n), z))
    return rows


def frame(spark, rows):
    data = [(k, T0 + timedelta(seconds=t), i, y, part, 1.0, z) for k, t, i, y, part, z in rows]
    return spark.createDataFrame(data, "key string, ts timestamp_ntz, id long, y int, part int, one double, z double")


def test_excitation_is_recovered(spark):
    rows = exciting(random.Random(7), 6000)
    df = frame(spark, rows)
    v, ll = Q.fit_excitation(df, "key", "ts", "id", "y", ["one", "z"], "part", decays=(0.2, 0.002), rows=100)
    rounded = [(k, round(t * 1e6) / 1e6, *rest) for k, t, *rest in rows]  # as timestamps keep it
    assert ll == pytest.approx(plain_excitation(rounded, v[:2], math.exp(v[2]), math.exp(v[3])), rel=1e-6)
    assert v[:2] == pytest.approx([-3.0, 0.7], abs=0.25) and math.exp(v[2]) == pytest.approx(0.06, rel=0.3) and math.exp(v[3]) == pytest.approx(0.02, rel=0.35)
    _, base = Q.fit_excitation(df, "key", "ts", "id", "y", ["one", "z"], "part")
    assert ll[0] > base[0] + 20 and ll[1] > base[1]


def test_gradient_equals_differences(spark):
    df = frame(spark, exciting(random.Random(8), 150))
    blocks = Q.packed(df, "key", "ts", "id", ["y", "part", "one", "z"], 16)
    v = np.array([-2.0, 0.3, -0.5, -3.0])
    (ll, g, info), *more = Q._excited_sums(blocks, [v, *[v + e * d for d in np.eye(4) for e in (1e-5, -1e-5)]], True)
    for i in range(4):
        assert g[i] == pytest.approx((more[2 * i][0][0] - more[2 * i + 1][0][0]) / 2e-5, rel=1e-4, abs=1e-4)
    assert np.allclose(info, info.T) and (np.linalg.eigvalsh(info) > 0).all()
