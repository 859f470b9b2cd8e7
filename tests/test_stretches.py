"""Windows read as positions in sorted ticks, against brute force, and plans that hold no pairs of targets and ticks."""

import datetime as dt
import random

import pytest

from chronoloom import registry
from chronoloom.operators import windows_at as T

DAY = dt.datetime(2024, 1, 1)


def at(s):
    return DAY + dt.timedelta(seconds=s)


def drawn(spark, n=400):
    """Ticks of two keys, some at equal times, and targets, some at ticks' times, of no key or at no time."""
    rng = random.Random(4)
    ticks = [(rng.choice("ab"), rng.randrange(3000), rng.randrange(100, 140), rng.randrange(1, 9)) for _ in range(n)]
    targets = [(i, rng.choice("abc"), rng.randrange(3200)) for i in range(80)]
    t = spark.createDataFrame([(k, at(s), m, 2 * m - p, 2 * m + p, p) for k, s, m, p in ticks], "key string, ts timestamp_ntz, mid long, bid long, ask long, spread long")
    rows = [(i, k, at(s)) for i, k, s in targets] + [(900, None, at(50)), (901, "a", None)]
    return ticks, targets, t, spark.createDataFrame(rows, "id int, key string, t timestamp_ntz")


def test_vector_equals_brute_force(spark):
    ticks, targets, t, g = drawn(spark)
    got = {r.id: r for r in T.tick_vector(g, t.select("key", "ts", "mid", "spread"), on="key", key="id", at="t", last=20, short=100, long=500).collect()}
    assert len(got) == 82 and got[900].n_long is None and got[901].coverage == 0
    for i, k, s in targets:
        w = lambda width: sorted((u, m, p) for q, u, m, p in ticks if q == k and s - width <= u < s)  # noqa: B023, E731
        long, short, r = w(500), w(100), got[i]
        assert (r.n_long or 0) == len(long) and (r.n_short or 0) == len(short)
        if long:
            assert r.spread_now == long[-1][2] and abs(r.mean_spread - sum(p for *_, p in long) / len(long)) < 1e-12
        if len(short) > 1:
            assert r.displacement == sum(abs(y[1] - x[1]) for x, y in zip(short, short[1:])) and r.abs_move == abs(short[-1][1] - short[0][1])


def test_bundle_equals_brute_force(spark):
    ticks, targets, t, g = drawn(spark)
    for legacy in (False, True):
        got = {(r.id, r.seconds): r for r in T.window_bundle(g, t, on="key", key="id", at="t", windows=(30.0, 400.0), legacy=legacy).collect()}
        assert len(got) == 164
        for i, k, s in targets:
            for width in (30, 400):
                w = sorted((u, m, 2 * m - p, 2 * m + p, p) for q, u, m, p in ticks if q == k and s - width <= u and (u <= s if legacy else u < s))
                r = got[i, width]
                assert r.tick_count == len(w)
                if len(w) > 1:
                    d = [y[1] - x[1] for x, y in zip(w, w[1:])]
                    assert (r.ret_mid, r.ups, r.downs, r.acceleration) == (w[-1][1] - w[0][1], sum(x > 0 for x in d), sum(x < 0 for x in d), w[-1][1] + w[0][1] - 2 * w[len(w) // 2][1])
                    assert r.quote_changes == sum(x[2:4] != y[2:4] for x, y in zip(w, w[1:])) and r.below_high + r.above_low == max(x[1] for x in w) - min(x[1] for x in w)
                    mean = sum(d) / len(d)
                    assert r.volatility == pytest.approx((sum((x - mean) ** 2 for x in d) / len(d)) ** 0.5 if len(d) > 1 else 0, abs=1e-6)


def paired(spark, name):
    """Whether a query's plan joins targets with ticks or reads frames anew for each row, not stretches."""
    return "FlatMapCoGroupsInArrow" not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_vector_has_no_pairs(spark):
    assert not paired(spark, "t07_feature_vector")


def test_bundle_has_no_pairs(spark):
    assert not paired(spark, "t09_multi_window")


def test_replay_reads_a_key_in_batches(spark):
    """Small batches give the trades of one, and no task is handed a whole key."""
    rows = lambda: sorted(map(str, registry.QUERIES["p13_replay"](spark, "/root/testdata/sf0.001").collect()))
    want = rows()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert rows() == want and len(want) > 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = registry.QUERIES["p13_replay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    scores = registry.QUERIES["p24_policy_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas run" in scores


def test_archetypes_have_no_pairs(spark):
    assert not paired(spark, "f17_archetypes")


def test_rescaled_vector_has_no_pairs(spark):
    assert not paired(spark, "t08_rescaled_vector")


def test_half_split_has_no_pairs(spark):
    assert not paired(spark, "t10_half_split")


def test_causal_window_reads_no_frames(spark):
    assert not paired(spark, "t01_causal_window")


def test_tick_bundle_reads_no_frames(spark):
    assert not paired(spark, "t06_tick_bundle")


def test_exit_grid_searches_hours(spark):
    assert not paired(spark, "p18_exit_grid")
