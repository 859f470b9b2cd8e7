"""Hand-computed fixtures and metamorphic checks of the operators."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars, tails
from chronoloom.operators import asof, bars, matching, policy, series, windows_at
from chronoloom.plans import views
from chronoloom.sources import coverage, readers
from chronoloom.streaming import jobs


def at(s, base="2026-01-01"):
    return dt.datetime.fromisoformat(base) + dt.timedelta(seconds=s)


def test_vendor_bars(spark, tmp_path):
    (tmp_path / "b.csv").write_text("<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<TICKVOL>\n2025.09.25,19:30:00,1,2,0.5,1.5,7\n2025.09.25,19:31:00,x,2,1,1,1\n2025.09.25,19:30:00,1,3,0.5,1.6,8\nbad,,1,1,1,1,1\n")
    rows = readers.read_bars(spark, str(tmp_path / "b.csv")).collect()
    assert [(r.timestamp, r.high, r.volume) for r in rows] == [(dt.datetime(2025, 9, 25, 19, 30), 3.0, 8.0)]


def test_ledger_reader(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("0012\tBuy\t2025.09.25 10:00:00\t2025.09.25 10:05:00\tX\t0.01\t100.5\t-1.5\n")
    r = readers.read_ledger(spark, str(tmp_path / "l.tsv")).first()
    assert (r.ticket, r.open_time, r.pnl) == ("0012", dt.datetime(2025, 9, 25, 10), -1.5)
    (tmp_path / "m.tsv").write_text("1\tHold\t2025.09.25 10:00:00\t2025.09.25 10:05:00\tX\t0.01\t100.5\t-1.5\n")
    with pytest.raises(Exception, match="Buy or Sell"):
        readers.read_ledger(spark, str(tmp_path / "m.tsv")).collect()


def test_tick_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([[1000, 101, 100], [2000, 99, 100], [3000, 103, 102, 1, 1]]))
    (tmp_path / "b.json").write_text(json.dumps([{"timestamp": 4000, "askPrice": 2.0, "bidPrice": 1.0}]))
    (tmp_path / "c.json").write_text("[]")
    rows = sorted(tuple(r)[1:] for r in readers.read_ticks(spark, str(tmp_path)).collect())
    assert rows == [(1.0, 2.0), (100.0, 101.0), (102.0, 103.0)]


def test_header_roles(spark):
    cases = {"timestamp,bid,ask,volume": "TICK_QUOTE_CANDIDATE", "timestamp,price,volume": "UNKNOWN_SCHEMA", "time,open,high,low,close": "OHLC_BAR_ONLY"}
    d = spark.createDataFrame(list(cases.items()), "h string, want string").withColumn("got", coverage.header_role(F.split("h", ",")))
    assert all(r.want == r.got for r in d.collect())


def test_lagged_candle_and_resample(spark):
    rows = [("S", at(60 * i), 100 + i - 0.25, 100 + i + 0.5, 100 + i - 0.5, 100.0 + i, i + 1.0) for i in range(30)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = bars.lagged_candle(b, series.over("symbol", order=["ts"])).orderBy("ts").collect()
    assert got[0].m1_close is None and got[1].m1_close == 100.0 and got[10].m1_body == 0.25
    wide = views.resample(b, "5 minutes").orderBy("ts").first()
    assert (wide.ts, wide.close - wide.open) == (at(0), 104 - 99.75)


def test_boundaries(spark):
    d = spark.createDataFrame([(630,), (631,), (633,)], "m int").select(scalars.boundary(F.col("m"), 30).alias("b"), (F.col("m") % 30 < 2).cast("int").alias("p"), scalars.boundary(F.col("m"), 60).alias("h"))
    assert [tuple(r) for r in d.collect()] == [(1, 1, 0), (0, 1, 0), (0, 0, 0)]


def test_causal_window_and_invariance(spark):
    ticks = [("S", at(s), 100 + s / 10 - 0.5, 100 + s / 10 + 0.5) for s in (0, 9, 10)]
    schema = "symbol string, ts timestamp_ntz, bid double, ask double"
    target = spark.createDataFrame([("S", at(10))], "symbol string, at timestamp_ntz")
    r = windows_at.features(target, spark.createDataFrame(ticks, schema), on="symbol", at="at", lookback=10, slack=1).first()
    assert (r.n, r.status) == (2, "observed") and abs(r.ret - (100.9 / 100 - 1)) < 1e-12
    more = windows_at.features(target, spark.createDataFrame([*ticks, ("S", at(11), 1.0, 2.0)], schema), on="symbol", at="at", lookback=10, slack=1).first()
    assert tuple(more) == tuple(r)
    late = windows_at.features(target, spark.createDataFrame(ticks[:1], schema), on="symbol", at="at", lookback=10, slack=1).first()
    assert late.status == "unknown" and late.ret is None
    with pytest.raises(Exception, match="at or after"):
        windows_at.assert_causal(spark.createDataFrame([(at(1), at(1))], "at timestamp_ntz, max_input_time timestamp_ntz"), "at").collect()


def test_asof_ties(spark):
    left = spark.createDataFrame([("k", at(10), 1), ("k", at(10), 2), ("z", at(10), 3)], "k string, t timestamp_ntz, id int")
    right = spark.createDataFrame([("k", at(5), "a"), ("k", at(10), "b"), ("k", at(15), "c")], "k string, r timestamp_ntz, v string")
    run = lambda **o: {x.id: x.v for x in asof.asof(left, right, on="k", left_ts="t", right_ts="r", take=["v"], **o).collect()}
    assert run() == {1: "b", 2: "b", 3: None}
    assert run(exact=False) == {1: "a", 2: "a", 3: None}
    assert run(forward=True) == {1: "b", 2: "b", 3: None}
    assert run(forward=True, exact=False) == {1: "c", 2: "c", 3: None}
    assert run(exact=False, tolerance=4) == {1: None, 2: None, 3: None}


def test_timer_grid(spark):
    got = [r.ts for r in coverage.timer_grid(spark, "2026-01-01 00:00:02", "2026-01-01 00:02:02", 60).collect()]
    assert got == [at(60), at(120)]


def test_matching_fixtures(spark):
    schema = "side string, {0}_id string, {0}_ts timestamp_ntz"
    obs = spark.createDataFrame([("Buy", "o", at(10))], schema.format("o"))
    pred = spark.createDataFrame([("Buy", "p1", at(9)), ("Buy", "p2", at(11)), ("Sell", "p3", at(10))], schema.format("p"))
    got = matching.match_one_to_one(obs, pred, on=["side"], tolerance=2).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"tp": 1, "fp": 2}


def test_alignment_against_brute_force():
    import itertools
    import random

    from chronoloom.operators import matching as M

    def best(o, p, tol):
        for k in range(min(len(o), len(p)), 0, -1):
            costs = [sum(abs(o[i] - p[j]) for i, j in zip(a, b)) for a in itertools.combinations(range(len(o)), k) for b in itertools.permutations(range(len(p)), k) if all(abs(o[i] - p[j]) <= tol for i, j in zip(a, b))]
            if costs:
                return k, min(costs)
        return 0, 0

    def greedy(o, p, tol):
        free, out = set(range(len(p))), []
        for i, x in enumerate(o):
            near = [j for j in free if abs(p[j] - x) <= tol]
            if near:
                j = min(near, key=lambda j: (abs(p[j] - x), j))
                free.remove(j)
                out.append((i, j))
        return out

    rng = random.Random(5)
    for _ in range(300):
        o, p = (sorted(rng.randrange(30) for _ in range(rng.randrange(0, 6))) for _ in range(2))
        tol = rng.randrange(0, 8)
        got = M.aligned(o, p, tol)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert (len(got), sum(abs(o[i] - p[j]) for i, j in got)) == best(o, p, tol)
    for _ in range(300):
        o, p = (sorted(rng.randrange(200) for _ in range(rng.randrange(0, 60))) for _ in range(2))
        tol = rng.randrange(0, 40)
        assert M.nearest_left(o, p, tol) == greedy(o, p, tol)


def test_conditions(spark):
    t = policy.Threshold("x", ">", 1)
    rule = policy.from_json(policy.to_json(policy.And((policy.Not(t), policy.Or((t, policy.Hours(0, 23)))))))
    d = spark.createDataFrame([(None, at(0)), (2.0, at(0)), (0.0, at(0))], "x double, ts timestamp_ntz")
    assert [tuple(r) for r in d.select(t.column(), policy.Not(t).column(), rule.column()).collect()] == [(False, True, True), (True, False, False), (False, True, True)]
    assert policy.description_bits(rule) == 64 + 32 * 6


def _replay(spark, quotes, decisions, p):
    q = spark.createDataFrame([("S", at(s), b, a) for s, b, a in quotes], "k string, ts timestamp_ntz, bid double, ask double")
    d = spark.createDataFrame([("S", at(s), x, st) for s, x, st in decisions], "k string, ts timestamp_ntz, ret5 double, status string")
    return policy.replay(q, d, [p], on="k").orderBy("trade_id").collect()


def test_replay_contract(spark):
    up = policy.Threshold("ret5", ">", 0.005)
    quotes = [(0, 100.0, 101.0), (1, 100.0, 101.0), (10, 101.0, 102.0)]
    got = _replay(spark, quotes, [(0, 0.01, "observed"), (10, 0.01, "unknown")], policy.Policy("p", up))
    assert [(r.open_price, r.reason) for r in got] == [(101.0, "open")]
    got = _replay(spark, [(0, 100.0, 101.0), (1, 100.0, 101.0), (5, 102.0, 103.0)], [(0, 0.01, "observed")], policy.Policy("p", up, take_profit=1.0))
    assert [(r.open_price, r.close_price, r.reason) for r in got] == [(101.0, 102.0, "take_profit")]
    assert not _replay(spark, [(0, 101.0, 102.0), (1, 101.0, 102.0)], [(0, 0.01, "observed")], policy.Policy("p", up, limit=101.0))
    got = _replay(spark, [(0, 100.0, 101.0), (2, 102.0, 103.0)], [(0, 0.01, "observed")], policy.Policy("p", up, delay=1))
    assert got[0].open_price == 103.0


def test_threshold_grid():
    assert policy.thresholds([-0.1, 0, 0.1], 2) == [-0.05, 0.05]
    assert policy.thresholds([0, 1, 2, 3, 4], 2) == [0.5, 3.5]


def test_crossing_and_persistence_reset_at_gaps():
    fired = jobs.arm([0, 1, 2, 100, 101, 102], [False, True, True, True, False, True], False, None, None, 0, 10)[0]
    assert fired == [False, True, False, False, False, True]


def test_ewm_equals_loop(spark):
    rng = random.Random(3)
    vals = [None if rng.random() < 0.1 else rng.random() for _ in range(900)]
    d = spark.createDataFrame([("S", at(i * 500), v) for i, v in enumerate(vals)], "k string, ts timestamp_ntz, x double").repartition(5)
    got = [r.e for r in series.ewm(d, "x", 0.3, key="k", order="ts", out="e", least=3).orderBy("ts").collect()]
    y, n = None, 0
    for g, v in zip(got, vals, strict=True):
        if v is not None:
            n += 1
            y = v if y is None else 0.7 * y + 0.3 * v
        assert (g is None) == (n < 3) and (g is None or abs(g - y) < 1e-12)


def test_multiple_testing_and_tails():
    assert abs(tails.gamma_upper(0.5, 3.841458820694124 / 2) - 0.05) < 1e-12
    assert abs(tails.gamma_upper(5.0, 20.0) - math.exp(-20) * sum(20**k / math.factorial(k) for k in range(5))) < 1e-15
    assert abs(tails.binomial_upper(8, 10, 0.5) - 56 / 1024) < 1e-12


def test_daylight_saving(spark):
    d = spark.createDataFrame([(dt.datetime(2026, 3, 29, 0, 59),), (dt.datetime(2026, 3, 29, 1, 0),), (dt.datetime(2026, 10, 25, 0, 59),), (dt.datetime(2026, 10, 25, 1, 0),)], "ts timestamp_ntz")
    assert [r[0] for r in d.select(scalars.offset_hours(F.col("ts"), "eu")).collect()] == [2, 3, 3, 2]
    u = spark.createDataFrame([(dt.datetime(2026, 3, 7, 12),), (dt.datetime(2026, 3, 8, 12),), (dt.datetime(2026, 11, 1, 12),)], "ts timestamp_ntz")
    assert [r[0] for r in u.select(scalars.offset_hours(F.col("ts"), "eastern")).collect()] == [-5, -4, -5]


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    s = jobs.drained(jobs.armed_trigger(jobs.ticks(spark, sf), "mid > 150", 3600, 21600), "armed")
    b = jobs.armed_batch(views.ticks(spark, sf), "mid > 150", 3600, 21600)
    assert sorted(map(tuple, s.select("event_id", "symbol").collect())) == sorted(map(tuple, b.collect()))


def test_unique_key_fails(spark):
    d = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="must be unique"):
        matching.unique_key(d, ["k"]).collect()
