"""Blocks with a halo, exponential means and the full indicator sets against pandas, whatever the block size."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import blocks as K
from chronoloom.operators import features as E

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, note string"


def made(keys=("a", "b", None), n=700, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for key in keys:
        at = dt.datetime(2024, 1, 1) + np.cumsum(r.choice([1, 1, 1, 5, 400], n)) * dt.timedelta(hours=1)
        c = 100 + np.cumsum(r.normal(0, 1, n)).round(2)
        o = c + r.normal(0, 0.5, n).round(2)
        for i in range(n):
            high, low = max(o[i], c[i]) + abs(r.normal()), min(o[i], c[i]) - abs(r.normal())
            out.append((key, at[i], float(o[i]), float(high), float(low), float(c[i]), float(r.integers(0, 5)), "n"))
    return out


def wide(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("rows,halo", [(50, 7), (7, 7), (1000, 60)])
def test_frames_in_blocks_equal_frames_over_the_key(spark, rows, halo):
    df = wide(spark, made(n=300))
    whole = W.partitionBy("symbol").orderBy("ts")
    want = {(r.symbol, r.ts): (r.lag, r.m) for r in df.select("symbol", "ts", F.lag("close", halo).over(whole).alias("lag"), F.max("close").over(whole.rowsBetween(-halo, 0)).alias("m")).collect()}
    d = K.with_halo(K.places(df, "symbol", "ts"), "place", rows=rows, halo=halo)
    w = W.partitionBy("symbol", "block").orderBy("place")
    got = d.withColumns({"lag": F.lag("close", halo).over(w), "m": F.max("close").over(w.rowsBetween(-halo, 0))}).where("own").collect()
    assert len(got) == len(want) == 900
    assert {(r.symbol, r.ts): (r.lag, r.m) for r in got} == want
    assert sorted(r.place for r in got if r.symbol is None) == list(range(300))


def test_a_halo_is_no_longer_than_a_block(spark):
    with pytest.raises(ValueError):
        K.with_halo(K.places(wide(spark, made(n=3)), "symbol", "ts"), "place", rows=5, halo=6)


@pytest.mark.parametrize("rows", [1, 9, 200])
def test_means_keep_their_state_over_nulls_and_blocks(spark, rows):
    r = np.random.default_rng(5)
    x = [(k, i, None if r.random() < 0.4 or i < 12 else float(r.normal())) for k in ("a", "b") for i in range(120)] + [("none", i, None) for i in range(4)]
    df = spark.createDataFrame(x, "k string, place int, x double").withColumn("z", F.col("place").cast("double"))
    got = K.exponential_means(df, {"y": ("x", 0.3), "q": ("x", 0.9), "s": ("z", 1 / 14)}, key="k", place="place", least={"q": 5}, rows=rows)
    got = {(g.k, g.place): g for g in got.collect()}
    assert len(got) == 244
    for k in ("a", "b", "none"):
        state, seen, s = {}, 0, None
        for key, i, v in (t for t in x if t[0] == k):
            if v is not None:
                seen += 1
                state = {a: v if not state else (1 - a) * state[a] + a * v for a in (0.3, 0.9)} if state else {0.3: v, 0.9: v}
            s = float(i) if s is None else 13 / 14 * s + i / 14
            g = got[key, i]
            assert (g.y is None and not state) or math.isclose(g.y, state[0.3], rel_tol=1e-9, abs_tol=1e-12)
            assert (g.q is None and seen < 5) or math.isclose(g.q, state[0.9], rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(g.s, s, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("alpha", [0, 1, -0.5])
def test_alpha_is_a_proper_weight(spark, alpha):
    with pytest.raises(ValueError):
        K.exponential_means(spark.range(1).withColumn("x", F.lit(1.0)), {"y": ("x", alpha)}, key="id", place="id")


def test_the_mean_of_a_mean_needs_no_second_pass(spark):
    x = np.random.default_rng(1).normal(50, 3, 400)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, place int, x double")
    a, b = 2 / 13, 2 / 10
    d = K.exponential_means(df, {"inner": ("x", a), "outer": ("x", b)}, key="k", place="place", rows=60)
    got = d.orderBy("place").select(K.mean_of_mean(F.col("inner"), a, F.col("outer"), b).alias("m")).toPandas().m
    want = pd.Series(x).ewm(alpha=a, adjust=False).mean().ewm(alpha=b, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-10)


def test_market_features_do_not_depend_on_blocks_and_equal_pandas(spark):
    df = wide(spark, made(keys=("a", "b")))
    got = {n: E.market_features(df, rows=n).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for n in (240, 4800)}
    assert list(got[240].columns) == list(got[4800].columns) and len(got[240]) == 1400
    numbers = [c for c in got[240].columns if got[240][c].dtype == float]
    assert len(numbers) > 55 and np.allclose(got[240][numbers], got[4800][numbers], rtol=1e-9, atol=1e-10, equal_nan=True)
    for key, g in got[240].groupby("symbol"):
        c = g.close.reset_index(drop=True)
        d = c.diff()
        up, down = (s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for s in (d.clip(lower=0), -d.clip(upper=0)))
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        want = {
            "rsi_14": 100 - 100 / (1 + up / down), "ema_200": c.ewm(span=200, adjust=False).mean(), "macd_signal": macd.ewm(span=9, adjust=False).mean(),
            "sma_100": c.rolling(100).mean(), "return_60": c.pct_change(60), "distance_low_50": c / g.low.reset_index(drop=True).rolling(50).min().shift(1) - 1,
        }
        for name, v in want.items():
            assert np.allclose(g[name], v, rtol=1e-9, atol=1e-9, equal_nan=True), (key, name)


@pytest.mark.parametrize("features", [E.market_features, E.indicator_set])
def test_flat_few_or_no_bars_and_further_columns(spark, features):
    flat = [("f", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0.0, "x") for i in range(30)]
    g = features(wide(spark, flat + [("one", dt.datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 1.0, None)])).toPandas()
    assert len(g) == 31 and set(g[g.symbol == "f"].note) == {"x"}
    last = g[g.symbol == "f"].sort_values("ts").iloc[-1]
    assert abs(last.macd) < 1e-12 and last.return_1 == 0
    if "vwap_session" in g:
        assert math.isnan(last.vwap_session) and math.isnan(last.rsi_14) and math.isnan(last.stochastic_k_14)
    else:
        assert last.rsi_14 == 0 and last.stoch_k == 0
    assert features(wide(spark, [])).count() == 0
