"""Replays on bars: session machine, single-position and two-model replayers, entry ablation, exit candidates (parts of SURVEY ST and P).

Bars are hours where the survey has minutes; limits are in units of these tables.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import bars as B
from chronoloom.operators import folds as K
from chronoloom.operators import series as S
from chronoloom.operators import splits as D
from chronoloom.plans import views as V
from chronoloom.plans.queries_windows import _ema_sql
from chronoloom.plans.views import DAYS, FIRST, WITH, r6
from chronoloom.registry import query

_RECURSIVE = WITH.replace("WITH ", "WITH RECURSIVE ", 1)
_HOUR = 3_600_000_000
_BARS = """, x0 AS (SELECT symbol, ts, epoch_us(ts) AS us, open, high, low, close, row_number() OVER w AS i, close / lag(close) OVER w - 1 AS ret, lag(close - open) OVER w AS move, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
x1 AS (SELECT *, CASE WHEN i >= 14 THEN 100 * avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) / close END AS atr, hour(ts) AS h, isodow(ts) AS dow FROM x0),
x2 AS (SELECT *, h BETWEEN 5 AND 16 AND NOT (dow = 5 AND h >= 20) AS open_, coalesce(abs(ret) >= 0.3 AND atr >= 25, false) AS cond FROM x1),
x AS (SELECT *, cond AND NOT coalesce(lag(cond) OVER (PARTITION BY symbol ORDER BY ts), false) AS edge, coalesce(h BETWEEN 7 AND 16 AND atr >= 25 AND abs(move) >= 30, false) AS signal FROM x2)"""


def _bars(spark, sf):
    """Bars with position, returns, the last bar's move, relative range, session, edge trigger and entry signal."""
    w = S.over("symbol", order=["ts"])
    b = V.bars_1h(spark, sf).withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "i": F.row_number().over(w).cast("long"), "ret": F.col("close") / F.lag("close").over(w) - 1, "move": F.lag(F.col("close") - F.col("open")).over(w), "tr": B.true_range(w)})
    h = F.hour("ts")
    b = b.withColumn("atr", F.when(F.col("i") >= 14, 100 * F.avg("tr").over(w.rowsBetween(-13, 0)) / F.col("close")))
    b = b.withColumns({"open_": h.between(5, 16) & ~((F.weekday("ts") == 4) & (h >= 20)), "cond": F.coalesce((F.abs("ret") >= 0.3) & (F.col("atr") >= 25), F.lit(False))})
    return b.withColumns({"edge": F.col("cond") & ~F.coalesce(F.lag("cond").over(w), F.lit(False)), "signal": F.coalesce(h.between(7, 16) & (F.col("atr") >= 25) & (F.abs("move") >= 30), F.lit(False))})


def _time(c):
    return F.timestamp_micros(c).cast("timestamp_ntz")


@query(
    "st7_session_machine",
    _RECURSIVE + _BARS + """, r AS (SELECT symbol, us, i, CASE WHEN NOT open_ THEN 0 WHEN cond THEN 2 ELSE 1 END AS state, CASE WHEN open_ AND cond THEN 4 ELSE 0 END AS timer, open_ AND cond AS entered FROM x WHERE i = 1 UNION ALL
SELECT x.symbol, x.us, x.i, CASE WHEN NOT x.open_ THEN 0 WHEN r.state = 2 THEN CASE WHEN r.timer <= 1 THEN 3 ELSE 2 END WHEN r.state = 3 THEN CASE WHEN r.timer <= 1 THEN 1 ELSE 3 END WHEN x.cond THEN 2 ELSE 1 END,
  CASE WHEN NOT x.open_ THEN 0 WHEN r.state = 2 THEN CASE WHEN r.timer <= 1 THEN 2 ELSE r.timer - 1 END WHEN r.state = 3 THEN CASE WHEN r.timer <= 1 THEN 0 ELSE r.timer - 1 END WHEN x.cond THEN 4 ELSE 0 END, x.open_ AND r.state IN (0, 1) AND x.cond FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1)
SELECT symbol, make_timestamp(us) AS ts, CAST(state AS INTEGER) AS state, entered FROM r""",
)
def st7_session_machine(spark, sf):
    """Four states with timers along the bars: outside hours, scanning, in position, cooling down (ST7)."""
    start, step = K.session_machine(4, 2)
    b = _bars(spark, sf).select("symbol", "us", "open_", F.col("cond").alias("trigger"))
    return K.fold(b, key="symbol", order="us", start=start, step=step, schema="symbol string, us long, state int, entered boolean").select("symbol", _time("us").alias("ts"), "state", "entered")


_TWO = """, r AS (SELECT symbol, us, i, ret, CASE WHEN open_ AND edge THEN i END AS entry, CAST(-1 AS BIGINT) AS clear, open_ AND edge AS entered FROM x WHERE i = 1 UNION ALL
SELECT x.symbol, x.us, x.i, x.ret, CASE WHEN r.entry IS NOT NULL THEN CASE WHEN x.i - r.entry < 12 THEN r.entry END WHEN x.open_ AND x.edge AND x.i > r.clear THEN x.i END, CASE WHEN r.entry IS NOT NULL AND x.i - r.entry >= 12 THEN x.i + 2 ELSE r.clear END, r.entry IS NULL AND x.open_ AND x.edge AND x.i > r.clear FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1),
sim AS (SELECT symbol, make_timestamp(us) AS ts, i AS bar, CASE WHEN ret > 0 THEN 'BUY' ELSE 'SELL' END AS direction FROM r WHERE entered)"""


def _two_model(spark, sf):
    start, step = K.two_model_machine(12, 2)
    b = _bars(spark, sf).select("symbol", "us", "i", F.col("open_").alias("eligible"), "edge", "ret")
    return K.fold(b, key="symbol", order="us", start=start, step=step, schema="symbol string, us long, bar long, direction string").select("symbol", _time("us").alias("ts"), "bar", "direction")


@query("p15_two_model_replay", _RECURSIVE + _BARS + _TWO + " SELECT * FROM sim")
def p15_two_model_replay(spark, sf):
    """Entries of the eligibility and trigger models: edge trigger, 12 bars of holding, 2 of cooldown."""
    return _two_model(spark, sf)


@query(
    "p15_expanding_splits",
    _RECURSIVE + _BARS + _TWO + """, k AS (SELECT k, """ + FIRST + """ + to_days(CAST(ceil(""" + DAYS + """ * (5 + k) / 10.0) AS INTEGER)) AS a, """ + FIRST + """ + to_days(CAST(ceil(""" + DAYS + """ * (6 + k) / 10.0) AS INTEGER)) AS b FROM range(5) r(k)),
n1 AS (SELECT s.symbol, s.ts, least(coalesce(epoch_us(s.ts) - epoch_us(p.open_time), 9e18), coalesce(epoch_us(f.open_time) - epoch_us(s.ts), 9e18)) AS d FROM sim s ASOF LEFT JOIN ledger p ON p.symbol = s.symbol AND s.ts >= p.open_time ASOF LEFT JOIN ledger f ON f.symbol = s.symbol AND s.ts <= f.open_time),
n2 AS (SELECT l.open_time AS ts, least(coalesce(epoch_us(l.open_time) - epoch_us(p.ts), 9e18), coalesce(epoch_us(f.ts) - epoch_us(l.open_time), 9e18)) AS d FROM ledger l ASOF LEFT JOIN sim p ON p.symbol = l.symbol AND l.open_time >= p.ts ASOF LEFT JOIN sim f ON f.symbol = l.symbol AND l.open_time <= f.ts)
SELECT CAST(k AS INTEGER) AS split, (SELECT count(*) FROM sim WHERE ts < a) AS train_entries, (SELECT count(*) FROM n1 WHERE ts >= a AND ts < b) AS simulated, (SELECT count(*) FROM n1 WHERE ts >= a AND ts < b AND d <= 18000000000) AS matched, (SELECT count(*) FROM n2 WHERE ts >= a AND ts < b) AS real_trades, (SELECT count(*) FROM n2 WHERE ts >= a AND ts < b AND d <= 18000000000) AS captured FROM k""",
)
def p15_expanding_splits(spark, sf):
    """The replay against the ledger on five expanding splits: what lies within five bars of a partner."""
    sim = _two_model(spark, sf)
    led = V.ledger(spark, sf).select("symbol", "open_time", "ticket")
    unique = led.select("symbol", "open_time").distinct()
    n1 = A.nearest(sim, unique, on="symbol", left_ts="ts", right_ts="open_time", take=[]).select("ts", (F.abs(A.seconds(F.col("ts"), F.col("open_time"))) <= 18000).alias("hit"), F.lit("sim").alias("of"))
    n2 = A.nearest(led, sim.select("symbol", F.col("ts").alias("sim_ts")), on="symbol", left_ts="open_time", right_ts="sim_ts", take=[]).select(F.col("open_time").alias("ts"), (F.abs(A.seconds(F.col("open_time"), F.col("sim_ts"))) <= 18000).alias("hit"), F.lit("real").alias("of"))
    first, days = D.span(V.ticks(spark, sf), "ts")
    u = n1.unionByName(n2).withColumn("day", F.datediff("ts", F.lit(first)))
    aggs = []
    for k in range(5):
        a, b = D.cut(days, (5 + k) / 10), D.cut(days, (6 + k) / 10)
        test = (F.col("day") >= a) & (F.col("day") < b)
        is_sim, hit = F.col("of") == "sim", F.coalesce("hit", F.lit(False))
        aggs.append(F.struct(F.lit(k).alias("split"), F.count_if(is_sim & (F.col("day") < a)).alias("train_entries"), F.count_if(is_sim & test).alias("simulated"), F.count_if(is_sim & test & hit).alias("matched"), F.count_if(~is_sim & test).alias("real_trades"), F.count_if(~is_sim & test & hit).alias("captured")))
    return u.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


@query(
    "p14_bar_replay",
    _RECURSIVE + _BARS + """, r AS (SELECT symbol, i, CASE WHEN signal THEN CASE WHEN move > 0 THEN 1 ELSE -1 END ELSE 0 END AS side, open AS price, us AS entry_us, 0.01::DOUBLE AS lot, 0.0::DOUBLE AS peak, false AS win, NULL::VARCHAR AS reason, NULL::DOUBLE AS xat, NULL::DOUBLE AS pnl, 0 AS x_side, 0.0::DOUBLE AS x_price, 0::BIGINT AS x_us, 0.0::DOUBLE AS x_lot, 0.0::DOUBLE AS x_peak, us FROM x WHERE i = 1 UNION ALL
SELECT symbol, i, CASE WHEN enter THEN CASE WHEN move > 0 THEN 1 ELSE -1 END WHEN reason IS NOT NULL THEN 0 ELSE side END, CASE WHEN enter THEN open ELSE price END, CASE WHEN enter THEN us ELSE entry_us END, CASE WHEN enter THEN CASE WHEN win1 THEN 0.02 ELSE 0.01 END ELSE lot END, CASE WHEN enter THEN 0.0 ELSE peak1 END, win1, reason, xat, pnl, side, price, entry_us, lot, peak1, us FROM (
  SELECT *, (side = 0 OR reason IS NOT NULL) AND signal AS enter, CASE WHEN reason IS NOT NULL THEN pnl > 0 ELSE win END AS win1 FROM (SELECT *, side * (xat - price) * lot * 100 AS pnl FROM (
  SELECT *, CASE reason WHEN 'stop' THEN price - side * 50.0 WHEN 'trailing' THEN price + side * (peak1 - 20.0) WHEN 'time' THEN open END AS xat FROM (
  SELECT *, CASE WHEN side <> 0 THEN CASE WHEN worst >= 50 THEN 'stop' WHEN peak1 >= 60 THEN CASE WHEN side * (close - price) <= peak1 - 20 THEN 'trailing' END WHEN us - entry_us >= 43200000000 THEN 'time' END END AS reason FROM (
  SELECT *, CASE WHEN side <> 0 THEN greatest(peak, CASE WHEN side > 0 THEN high - price ELSE price - low END) ELSE peak END AS peak1, CASE WHEN side > 0 THEN price - low ELSE high - price END AS worst FROM (
  SELECT x.symbol, x.i, x.us, x.open, x.high, x.low, x.close, x.signal, x.move, r.side, r.price, r.entry_us, r.lot, r.peak, r.win FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1)))))))
SELECT symbol, make_timestamp(x_us) AS entry_ts, round(x_price, 6) AS entry_price, CASE WHEN x_side > 0 THEN 'Buy' ELSE 'Sell' END AS side, x_lot AS lot, make_timestamp(us) AS exit_ts, round(xat, 6) AS exit_price, round(pnl, 6) AS pnl, reason, round(x_peak, 6) AS peak FROM r WHERE reason IS NOT NULL""",
)
def p14_bar_replay(spark, sf):
    """Single-position replay on bars with stop, trailing and time exits, the lot set by the last outcome."""
    start, step = K.bar_machine(stop=50.0, trail_from=60.0, trail=20.0, max_us=12 * _HOUR, lots=(0.01, 0.02))
    b = _bars(spark, sf).select("symbol", "us", "open", "high", "low", "close", "move", "signal")
    schema = "symbol string, entry_us long, entry_price double, side string, lot double, exit_us long, exit_price double, pnl double, reason string, peak double"
    t = K.fold(b, key="symbol", order="us", start=start, step=step, schema=schema)
    return t.select("symbol", _time("entry_us").alias("entry_ts"), r6("entry_price").alias("entry_price"), "side", "lot", _time("exit_us").alias("exit_ts"), r6("exit_price").alias("exit_price"), r6("pnl").alias("pnl"), "reason", r6("peak").alias("peak"))


_STAGES = ("A_session", "B_range", "C_impulse", "D_direction", "E_single_position")


@query(
    "p17_ablation",
    _RECURSIVE + _BARS + """, r AS (SELECT symbol, i, us, CASE WHEN signal AND NOT hit THEN CASE WHEN move > 0 THEN 1 ELSE -1 END ELSE 0 END AS side, open AS price, i AS at_i, CASE WHEN signal THEN CASE WHEN move > 0 THEN high - open ELSE open - low END ELSE 0 END::DOUBLE AS peak, signal AS taken FROM (SELECT *, false AS hit FROM x WHERE i = 1) UNION ALL
SELECT symbol, i, us, CASE WHEN side1 <> 0 AND (worst >= 50 OR (peak1 >= 60 AND side1 * (close - price1) <= peak1 - 20) OR i - at1 >= 12) THEN 0 ELSE side1 END, price1, at1, peak1, taken FROM (
  SELECT *, CASE WHEN side1 <> 0 THEN greatest(peak0, CASE WHEN side1 > 0 THEN high - price1 ELSE price1 - low END) ELSE peak0 END AS peak1, CASE WHEN side1 > 0 THEN price1 - low ELSE high - price1 END AS worst FROM (
  SELECT *, CASE WHEN taken THEN CASE WHEN move > 0 THEN 1 ELSE -1 END ELSE side END AS side1, CASE WHEN taken THEN open ELSE price END AS price1, CASE WHEN taken THEN i ELSE at_i END AS at1, CASE WHEN taken THEN 0.0 ELSE peak END AS peak0 FROM (
  SELECT x.symbol, x.i, x.us, x.open, x.high, x.low, x.close, x.move, r.side, r.price, r.at_i, r.peak, r.side = 0 AND x.signal AND x.move <> 0 AS taken FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1)))),
e AS (SELECT DISTINCT symbol, date_trunc('hour', open_time) AS ts FROM ledger),
p AS (SELECT x.symbol, e.ts IS NOT NULL AS y, coalesce(h BETWEEN 7 AND 16, false) AS s0, coalesce(h BETWEEN 7 AND 16 AND atr >= 25, false) AS s1, signal AS s2, signal AND move <> 0 AS s3, r.taken AS s4 FROM x JOIN r ON r.symbol = x.symbol AND r.i = x.i LEFT JOIN e ON e.symbol = x.symbol AND e.ts = x.ts),
c AS (SELECT stage, count(*) FILTER (f AND y) AS tp, count(*) FILTER (f AND NOT y) AS fp, count(*) FILTER (NOT f AND y) AS fn, count(*) FILTER (NOT f AND NOT y) AS tn FROM (SELECT 'A_session' AS stage, y, s0 AS f FROM p UNION ALL SELECT 'B_range', y, s1 FROM p UNION ALL SELECT 'C_impulse', y, s2 FROM p UNION ALL SELECT 'D_direction', y, s3 FROM p UNION ALL SELECT 'E_single_position', y, s4 FROM p) GROUP BY 1)
SELECT stage, tp AS captured, tp + fn AS observed, tp + fp AS generated, fp AS false_positives, round(100.0 * tp / nullif(tp + fn, 0), 6) AS recall, round(100.0 * tp / nullif(tp + fp, 0), 6) AS precision, round(100.0 * fp / nullif(tn + fp, 0), 6) AS fp_rate, round((tp + 0.5) * (tn + 0.5) / ((fp + 0.5) * (fn + 0.5)), 6) AS odds_ratio FROM c""",
)
def p17_ablation(spark, sf):
    """Entry conditions one on top of the other, the last with a single position whose exits are simulated to block."""
    b = _bars(spark, sf)
    start, step = K.gate_machine(stop=50.0, trail_from=60.0, trail=20.0, max_bars=12)
    gate = b.select("symbol", "us", "i", "open", "high", "low", "close", "move", (F.col("signal") & (F.col("move") != 0)).alias("signal"))
    taken = K.fold(gate, key="symbol", order="us", start=start, step=step, schema="symbol string, us long").withColumn("taken", F.lit(True))
    e = V.ledger(spark, sf).select("symbol", F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("ts")).distinct().withColumn("y", F.lit(True))
    p = b.join(taken, ["symbol", "us"], "left").join(e, ["symbol", "ts"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    h = F.hour("ts").between(7, 16)
    flags = [h, h & (F.col("atr") >= 25), F.col("signal"), F.col("signal") & (F.col("move") != 0), F.col("taken")]
    flags = [F.coalesce(f, F.lit(False)) for f in flags]
    g = p.agg(F.array(*[F.struct(F.lit(n).alias("stage"), F.count_if(f & F.col("y")).alias("tp"), F.count_if(f & ~F.col("y")).alias("fp"), F.count_if(~f & F.col("y")).alias("fn"), F.count_if(~f & ~F.col("y")).alias("tn")) for n, f in zip(_STAGES, flags, strict=True)]).alias("s"))
    c = g.select(F.explode("s").alias("s")).select("s.*")
    pct = lambda a, b: r6(F.expr(f"100d * {a} / nullif({b}, 0)"))
    return c.select("stage", F.col("tp").alias("captured"), (F.col("tp") + F.col("fn")).alias("observed"), (F.col("tp") + F.col("fp")).alias("generated"), F.col("fp").alias("false_positives"), pct("tp", "tp + fn").alias("recall"), pct("tp", "tp + fp").alias("precision"), pct("fp", "tn + fp").alias("fp_rate"), r6(F.expr("(tp + 0.5d) * (tn + 0.5d) / ((fp + 0.5d) * (fn + 0.5d))")).alias("odds_ratio"))


_EXITS = _RECURSIVE + ", " + _ema_sql(2 / 10) + """, f AS (SELECT b.symbol, b.ts, b.high, b.low, b.close, b.close - y.y AS ema_dist, b.close - sum(b.close * b.volume) OVER (PARTITION BY b.symbol, CAST(b.ts AS DATE) ORDER BY b.ts) / sum(b.volume) OVER (PARTITION BY b.symbol, CAST(b.ts AS DATE) ORDER BY b.ts) AS vwap_dist, b.close - lag(b.close, 3) OVER w AS mom3,
  greatest(b.high - b.low, abs(b.high - lag(b.close) OVER w), abs(b.low - lag(b.close) OVER w)) AS tr, row_number() OVER w AS i FROM bars_1h b JOIN y USING (symbol, ts) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts)),
fe AS (SELECT *, CASE WHEN i >= 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) END AS atr FROM f),
t AS (SELECT l.ticket, l.symbol, CASE WHEN l.side = 'Buy' THEN 1 ELSE -1 END AS side, l.price, l.open_time, l.close_time, date_trunc('hour', l.open_time) AS h0, (epoch_us(l.close_time) - epoch_us(l.open_time)) / 3.6e9 AS hours, l.pnl / (l.lot * 100) AS moved, fe.atr FROM ledger l LEFT JOIN fe ON fe.symbol = l.symbol AND fe.ts = date_trunc('hour', l.open_time)),
k AS (SELECT k, """ + FIRST + """ + to_days(CAST(ceil(""" + DAYS + """ * (5 + 2 * k) / 15.0) AS INTEGER)) AS a, """ + FIRST + """ + to_days(CAST(ceil(""" + DAYS + """ * (7 + 2 * k) / 15.0) AS INTEGER)) AS b FROM range(5) r(k)),
q AS (SELECT k, any_value(a) AS a, any_value(b) AS b, quantile_cont(hours, 0.5) AS med, least(greatest(quantile_cont(hours, 0.95), 15), 48) AS horizon, quantile_cont(-moved, 0.5) FILTER (moved < 0) AS stop, quantile_cont(moved, 0.5) FILTER (moved > 0) AS target, quantile_cont(-moved / atr, 0.5) FILTER (moved < 0 AND atr > 0) AS stop_atr, quantile_cont(moved / atr, 0.5) FILTER (moved > 0 AND atr > 0) AS target_atr FROM k JOIN t ON t.close_time < k.a GROUP BY 1),
p AS (SELECT q.k, t.ticket, t.side, t.price, t.h0, q.stop, q.target, q.stop_atr * t.atr AS stop2, q.target_atr * t.atr AS target2, fe.ts, fe.close, CASE WHEN t.side > 0 THEN fe.high - t.price ELSE t.price - fe.low END AS fav, CASE WHEN t.side > 0 THEN t.price - fe.low ELSE fe.high - t.price END AS adv, t.side * fe.ema_dist < 0 AS c1, t.side * fe.vwap_dist < 0 AS c2, t.side * fe.mom3 < 0 AS c3, abs(epoch_us(fe.ts) - epoch_us(t.h0) - CAST(round(q.med * 3.6e9) AS BIGINT)) AS off
  FROM q JOIN t ON t.open_time >= q.a AND t.open_time < q.b JOIN fe ON fe.symbol = t.symbol AND fe.ts >= t.h0 AND epoch_us(fe.ts) <= epoch_us(t.h0) + CAST(round(q.horizon * 3.6e9) AS BIGINT)),
g AS (SELECT k, ticket, any_value(side) AS side, any_value(price) AS price, any_value(stop) AS stop, any_value(target) AS target, any_value(stop2) AS stop2, any_value(target2) AS target2, arg_max(close, ts) AS last, arg_min(close, off * 100000 + (epoch_us(ts) - epoch_us(h0)) // 3600000000) AS timed, min(ts) FILTER (adv >= stop) AS s1, min(ts) FILTER (fav >= target) AS t1, min(ts) FILTER (adv >= stop2) AS s2, min(ts) FILTER (fav >= target2) AS t2,
  arg_min(close, ts) FILTER (c1) AS e1, arg_min(close, ts) FILTER (c2) AS e2, arg_min(close, ts) FILTER (c3) AS e3 FROM p GROUP BY 1, 2),
o AS (SELECT k, 'median_time' AS candidate, 'time' AS reason, side * (timed - price) AS move FROM g
UNION ALL SELECT k, 'fixed_barriers', CASE WHEN s1 IS NULL AND t1 IS NULL THEN 'horizon' WHEN s1 = t1 THEN 'both_adverse_first' WHEN t1 IS NULL OR s1 < t1 THEN 'stop' ELSE 'target' END, CASE WHEN s1 IS NULL AND t1 IS NULL THEN side * (last - price) WHEN t1 IS NULL OR s1 <= t1 THEN -stop ELSE target END FROM g
UNION ALL SELECT k, 'atr_barriers', CASE WHEN s2 IS NULL AND t2 IS NULL THEN 'horizon' WHEN s2 = t2 THEN 'both_adverse_first' WHEN t2 IS NULL OR s2 < t2 THEN 'stop' ELSE 'target' END, CASE WHEN s2 IS NULL AND t2 IS NULL THEN side * (last - price) WHEN t2 IS NULL OR s2 <= t2 THEN -stop2 ELSE target2 END FROM g
UNION ALL SELECT k, 'ema_failure', CASE WHEN e1 IS NULL THEN 'horizon' ELSE 'failure' END, side * (coalesce(e1, last) - price) FROM g UNION ALL SELECT k, 'vwap_failure', CASE WHEN e2 IS NULL THEN 'horizon' ELSE 'failure' END, side * (coalesce(e2, last) - price) FROM g UNION ALL SELECT k, 'momentum_failure', CASE WHEN e3 IS NULL THEN 'horizon' ELSE 'failure' END, side * (coalesce(e3, last) - price) FROM g)
SELECT CAST(k AS INTEGER) AS fold, candidate, reason, count(*) AS n, round(avg(move), 4) AS mean_move FROM o GROUP BY 1, 2, 3"""


@query("p20_exit_candidates", _EXITS)
def p20_exit_candidates(spark, sf):
    """Exit candidates with limits fitted on each fold's past: median time, fixed and range-scaled barriers (both hit: the
    adverse one), failure of the mean, of the session's price or of momentum (P20)."""
    w = S.over("symbol", order=["ts"])
    day = W.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    b = S.ewm(V.bars_1h(spark, sf), "close", 2 / 10, key="symbol", order="ts", out="ema")
    f = b.withColumns({"tr": B.true_range(w), "i": F.row_number().over(w)}).select(
        "symbol", "ts", "high", "low", "close", (F.col("close") - F.col("ema")).alias("ema_dist"), (F.col("close") - F.sum(F.col("close") * F.col("volume")).over(day) / F.sum("volume").over(day)).alias("vwap_dist"),
        (F.col("close") - F.lag("close", 3).over(w)).alias("mom3"), F.when(F.col("i") >= 14, F.avg("tr").over(w.rowsBetween(-13, 0))).alias("atr"),
    )
    h0 = F.date_trunc("hour", "open_time").cast("timestamp_ntz")
    t = V.ledger(spark, sf).select("ticket", "symbol", F.when(F.col("side") == "Buy", 1).otherwise(-1).alias("side"), "price", "open_time", "close_time", h0.alias("h0"), ((F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(F.col("open_time").cast("timestamp"))) / 3.6e9).alias("hours"), (F.col("pnl") / (F.col("lot") * 100)).alias("moved"))
    t = t.join(f.select("symbol", F.col("ts").alias("h0"), "atr"), ["symbol", "h0"], "left")
    first_day, days = D.span(V.ticks(spark, sf), "ts")
    cuts = [D.cut(days, (5 + 2 * k) / 15) for k in range(6)]
    day_of = lambda c: F.datediff(c, F.lit(first_day))
    # a trade teaches all folds that begin after its close: at most five copies
    q = t.withColumn("k", F.explode(F.array_compact(F.array(*[F.when(day_of("close_time") < cuts[k], F.lit(k)) for k in range(5)]))))
    med = lambda v, c: F.percentile(F.when(F.expr(c), F.expr(v)), F.lit(0.5))
    q = q.groupBy("k").agg(F.percentile("hours", F.lit(0.5)).alias("med"), F.least(F.greatest(F.percentile("hours", F.lit(0.95)), F.lit(15.0)), F.lit(48.0)).alias("horizon"), med("-moved", "moved < 0").alias("stop"), med("moved", "moved > 0").alias("target"), med("-moved / atr", "moved < 0 and atr > 0").alias("stop_atr"), med("moved / atr", "moved > 0 and atr > 0").alias("target_atr"))
    fold = F.coalesce(*[F.when((day_of("open_time") >= cuts[k]) & (day_of("open_time") < cuts[k + 1]), F.lit(k)) for k in range(5)])
    test = t.withColumn("k", fold).where("k is not null").join(F.broadcast(q), "k")  # five rows
    # bars of the path meet by hour; the horizon is at most two days
    hours = F.sequence(F.lit(0), F.floor(F.round(F.col("horizon") * 3.6e9) / _HOUR).cast("int"))
    test = test.withColumn("ts", F.explode(F.transform(hours, lambda i: F.timestamp_micros(F.unix_micros(F.col("h0").cast("timestamp")) + i * _HOUR).cast("timestamp_ntz"))))
    p = test.join(f.drop("atr"), ["symbol", "ts"])
    buy = F.col("side") > 0
    off = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("h0").cast("timestamp")) - F.round(F.col("med") * 3.6e9).cast("long"))
    p = p.withColumns({"fav": F.when(buy, F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low")), "adv": F.when(buy, F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price")), "stop2": F.col("stop_atr") * F.col("atr"), "target2": F.col("target_atr") * F.col("atr"), "off": off})
    first = lambda c: F.min(F.when(F.expr(c), F.col("ts")))
    fails = lambda c: F.min(F.when(F.expr(f"side * {c} < 0"), F.struct("ts", "close")))["close"]
    g = p.groupBy("k", "ticket", "side", "price", "stop", "target", "stop2", "target2").agg(
        F.max_by("close", "ts").alias("last"), F.min(F.struct("off", "ts", "close"))["close"].alias("timed"), first("adv >= stop").alias("s1"), first("fav >= target").alias("t1"), first("adv >= stop2").alias("s2"), first("fav >= target2").alias("t2"),
        fails("ema_dist").alias("e1"), fails("vwap_dist").alias("e2"), fails("mom3").alias("e3"),
    )
    signed = lambda c: F.col("side") * (c - F.col("price"))
    out = [F.struct(F.lit("median_time").alias("candidate"), F.lit("time").alias("reason"), signed(F.col("timed")).alias("move"))]
    for name, s, x, stop, target in (("fixed_barriers", "s1", "t1", "stop", "target"), ("atr_barriers", "s2", "t2", "stop2", "target2")):
        reason = F.expr(f"case when {s} is null and {x} is null then 'horizon' when {s} = {x} then 'both_adverse_first' when {x} is null or {s} < {x} then 'stop' else 'target' end")
        move = F.when(F.expr(f"{s} is null and {x} is null"), signed(F.col("last"))).when(F.expr(f"{x} is null or {s} <= {x}"), -F.col(stop)).otherwise(F.col(target))
        out.append(F.struct(F.lit(name).alias("candidate"), reason.alias("reason"), move.alias("move")))
    for name, e in (("ema_failure", "e1"), ("vwap_failure", "e2"), ("momentum_failure", "e3")):
        out.append(F.struct(F.lit(name).alias("candidate"), F.when(F.col(e).isNull(), "horizon").otherwise("failure").alias("reason"), signed(F.coalesce(e, "last")).alias("move")))
    o = g.select("k", F.explode(F.array(*out)).alias("o"))
    return o.groupBy(F.col("k").alias("fold"), "o.candidate", "o.reason").agg(F.count("*").alias("n"), F.round(F.avg("o.move"), 4).alias("mean_move"))
