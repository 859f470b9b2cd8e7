"""Operators against plain twins: paths, as-of by buckets, windows, folds, fitted models."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import folds as K
from chronoloom.operators import models as M
from chronoloom.operators import paths as X
from chronoloom.operators import windows_at as T

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.mark.parametrize("exact,forward", [(True, False), (False, False), (True, True), (False, True)])
def test_asof_by_buckets_equals_a_search(spark, exact, forward):
    rng = random.Random(3)
    right = {k: sorted(rng.sample(range(500), 25)) for k in "ab"}
    left = [(i, rng.choice("abc"), rng.randrange(-20, 520)) for i in range(300)]
    l = spark.createDataFrame([(i, k, at(t)) for i, k, t in left] + [(900, None, at(5))], "id int, key string, t timestamp_ntz")
    r = spark.createDataFrame([(k, at(t), t) for k, ts in right.items() for t in ts], "key string, rt timestamp_ntz, v int")
    for bucket in (30, 86400):
        got = {x.id: x.v for x in A.asof(l, r, on="key", left_ts="t", right_ts="rt", take=["v"], exact=exact, forward=forward, bucket=bucket).collect()}
        assert len(got) == 301 and got[900] is None
        for i, k, t in left:
            ok = [x for x in right.get(k, []) if (x >= t if forward else x <= t) and (exact or x != t)]
            assert got[i] == ((min(ok) if forward else max(ok)) if ok else None)


def test_extremes_and_gaps_of_long_intervals(spark):
    rng = random.Random(9)
    ticks = [(k, rng.randrange(12 * 86400), rng.randrange(100)) for k in "ab" for _ in range(400)]
    iv = [(i, rng.choice("abc"), s, s + rng.choice([0, 10, 3000, 40_000, 300_000, 800_000])) for i, s in enumerate(rng.randrange(12 * 86400) for _ in range(120))]
    t = spark.createDataFrame([(k, at(s), float(v), float(v) + 1) for k, s, v in ticks], "key string, ts timestamp_ntz, bid double, ask double")
    v = spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in iv], "id int, key string, s timestamp_ntz, e timestamp_ntz")
    for closed in (True, False):
        got = {r.id: r for r in X.interval_extremes(t, v, on="key", key="id", start="s", end="e", high="bid", low="ask", closed_end=closed).collect()}
        for i, k, s, e in iv:
            inside = [(x, u) for q, u, x in ticks if q == k and s <= u and (u <= e if closed else u < e)]
            assert (i in got) == bool(inside)
            if inside:
                hi, lo = max(x for x, _ in inside), min(x for x, _ in inside)
                r = got[i]
                assert (r.n, r.hi, r.hi_low, r.lo, r.lo_high) == (len(inside), hi, lo, lo + 1, hi + 1)
                assert r.hi_ts == at(min(u for x, u in inside if x == hi)) and r.lo_ts == at(min(u for x, u in inside if x == lo))
    points = spark.createDataFrame([(n, k, at(s)) for n, (k, s, _) in enumerate(ticks)], "n int, key string, p timestamp_ntz")
    free = {r.n for r in X.outside(points, v.where("id < 25"), on="key", ts="p", start="s", end="e").collect()}
    assert free == {n for n, (k, u, _) in enumerate(ticks) if not any(q == k and s <= u < e for i, q, s, e in iv if i < 25)}


def test_window_bundle_is_causal_unless_legacy(spark):
    ticks = spark.createDataFrame([("a", at(s), m, 2 * m - 1, 2 * m + 1, 1) for s, m in ((10, 100), (11, 103), (12, 101), (20, 110))], "key string, ts timestamp_ntz, mid long, bid long, ask long, spread long")
    targets = spark.createDataFrame([(1, "a", at(12)), (2, "a", at(5)), (3, "a", at(60))], "id int, key string, t timestamp_ntz")
    run = lambda legacy: {(r.id, r.seconds): r for r in T.window_bundle(targets, ticks, on="key", key="id", at="t", windows=(1.0, 2.0), legacy=legacy).collect()}
    causal, legacy = run(False), run(True)
    assert (causal[1, 2.0].tick_count, causal[1, 2.0].ret_mid, causal[1, 2.0].above_low) == (2, 3, 3)
    assert (legacy[1, 2.0].tick_count, legacy[1, 2.0].ret_mid, legacy[1, 2.0].acceleration) == (3, 1, -5)
    assert causal[2, 1.0].spread is None and legacy[2, 1.0].spread == 1  # the first later tick
    assert (causal[3, 1.0].tick_count, causal[3, 1.0].spread, causal[3, 1.0].ret_mid) == (0, 1, 0)
    vector = T.tick_vector(targets, ticks.select("key", "ts", "mid", "spread"), on="key", key="id", at="t", last=1.5, short=3, long=30)
    r = {x.id: x for x in T.rescaled(vector, None).collect()}
    assert (r[1].n_long, r[1].displacement, r[1].ret_last, r[1].jump_z) == (2, 3, 3, None)
    assert r[2].coverage == 0 and r[2].ret_last is None


def test_folds_read_keys_in_order(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.random() < 0.9, rng.random() < 0.4) for k in "abc" for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, us long, open_ boolean, trigger boolean").repartition(7)
    start, step = K.session_machine(4, 2)
    got = {(r.symbol, r.us): (r.state, r.entered) for r in K.fold(df, key="symbol", order="us", start=start, step=step, schema="symbol string, us long, state int, entered boolean").collect()}
    for k in "abc":
        state, timer = 0, 0
        for _, i, o, t in (r for r in rows if r[0] == k):
            entered = False
            if not o:
                state, timer = 0, 0
            elif state == 2:
                timer -= 1
                state, timer = (3, 2) if timer <= 0 else (2, timer)
            elif state == 3:
                timer -= 1
                state, timer = (1, 0) if timer <= 0 else (3, timer)
            elif t:
                state, timer, entered = 2, 4, True
            else:
                state = 1
            assert got[k, i] == (state, entered)


def strata(rng, beta, n=120):
    rows = []
    for s in range(n):
        x = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(12)]
        w = [math.exp(sum(b * v for b, v in zip(beta, u))) for u in x]
        pick = rng.choices(range(12), w)[0]
        rows += [("k", s, s % 30 + 1, float(i == pick), *u) for i, u in enumerate(x)]
    return rows


def test_conditional_fit_solves_its_equations(spark):
    rows = strata(random.Random(2), (1.0, -0.5))
    d = spark.createDataFrame(rows, "symbol string, day int, d int, y double, a double, b double")
    beta = M.stratified_fit(d, ["a", "b"], 0.5, steps=8)
    x = np.array([r[4:] for r in rows]).reshape(-1, 12, 2)
    y = np.array([r[3] for r in rows]).reshape(-1, 12)
    p = np.exp(x @ beta)
    p /= p.sum(axis=1, keepdims=True)
    gradient = ((y - p)[..., None] * x).sum(axis=(0, 1)) - 0.5 * beta
    assert np.abs(gradient).max() < 1e-6 and abs(beta[0] - 1) < 0.35 and abs(beta[1] + 0.5) < 0.35
    more = spark.createDataFrame(strata(random.Random(3), (1.0, -0.5), 600), "symbol string, day int, d int, y double, a double, b double")
    steps = M.ladder(more, [[], ["a"], ["a", "b"]]).orderBy("model").collect()
    assert steps[0].gain == 0 and steps[1].gain > 0.1 and steps[2].gain > steps[1].gain


def test_exit_risk_and_hazards(spark):
    rng = random.Random(6)
    rows = [("Buy" if i % 2 else "Sell", at(i % 25 * 86400), at(i % 25 * 86400 + int(rng.expovariate(1 / (4 if i % 2 else 12)) * 7200))) for i in range(1500)]
    risk = M.exit_risk(spark.createDataFrame(rows, "side string, open_time timestamp_ntz, close_time timestamp_ntz"))
    got = {(r.day, r.side, r.age): (r.at_risk, r.exits) for r in risk.collect()}
    want = {}
    for side, o, c in rows:
        last = min(60, int((c - o).total_seconds() // 7200))
        for age in range(last + 1):
            n, e = want.get((o.day, side, age), (0, 0))
            want[o.day, side, age] = (n + 1, e + (age == last < 60))
    assert got == want
    models = {r.model: r for r in M.exit_hazard(risk).collect()}
    assert models["logistic"].bits > models["constant"].bits + 0.05 and models["spline_poisson"].bits > models["constant"].bits + 0.05
    assert abs(models["logistic"].expected / models["logistic"].exits - 1) < 0.15


def test_models_find_what_is_planted(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        mid = rng.uniform(100, 200)
        rows.append((float(rng.random() < 1 / (1 + math.exp(-(mid - 185) / 5))), 1.0, i % 30 + 1, mid, 0.05, i % 24))
    d = spark.createDataFrame(rows, "label double, w double, day int, mid double, spread double, hour int")
    base = np.mean([r[0] for r in rows])
    none = (base * math.log(base) + (1 - base) * math.log(1 - base)) / base / math.log(2)
    for r in M.weighted_logistic(d).collect():
        assert r.bits > none + 1 and r.used >= 1
    trades = [(at(i), at(i + int(math.exp(rng.gauss(6 if i % 2 else 11, 0.3)))), rng.gauss(-50 if i % 2 else 80, 5)) for i in range(800)]
    m = M.mixture_selection(spark.createDataFrame(trades, "open_time timestamp_ntz, close_time timestamp_ntz, pnl double"), most=3).collect()
    assert m[0].bic > m[1].bic + 100 and m[1].stability > 0.99
    panel = spark.createDataFrame([(i, at(i * 600), "purchase", rng.uniform(100, 200), 0.05, i % 100) for i in range(4000)], "event_id int, ts timestamp_ntz, symbol string, mid double, spread double, k int")
    led = panel.where("mid > 170 and event_id % 7 > 0").select("event_id")
    for kind in ("logistic", "forest"):
        for r in M.walk_forward(M.panel(panel, led), kind).collect():
            assert r.auc > 0.9 and r.n > 500


def test_lags_go_on_over_days(spark):
    from chronoloom.operators import series as S

    rng = random.Random(12)
    rows = []
    for k in "ab":
        t = 0
        for i in range(200):
            t += rng.choice([60, 7000, 200_000])
            rows.append((k, at(t), None if rng.random() < 0.2 else float(i)))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double")
    lag = {(r.k, r.ts): r.p for r in S.lagged(df, "x", key="k", order="ts", out="p").collect()}
    for k in "ab":
        before = None
        for _, t, x in (r for r in rows if r[0] == k):
            assert lag[k, t] == before
            before = x
    assert len(lag) == len(rows)
