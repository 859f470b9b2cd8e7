"""Tick windows, trade paths, clocks, folds, sources and coverage (SURVEY T, C, S)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import paths as X
from chronoloom.operators import windows_at as T
from chronoloom.operators import splits as S
from chronoloom.plans import views as V
from chronoloom.plans.views import DAYS, FIRST, HOURS, WITH, r6
from chronoloom.registry import query
from chronoloom.sources import coverage as C

_L, _SLACK = 7200, 1800
_WIN = f"""w AS (SELECT l.ticket, l.open_time, count(t.ts) AS n, arg_min((t.bid + t.ask) / 2, t.ts) AS m0, arg_max((t.bid + t.ask) / 2, t.ts) AS m1, arg_max(t.ask - t.bid, t.ts) AS sp, min(t.ts) AS t0, max(t.ts) AS t1
FROM ledger l LEFT JOIN ticks t ON t.symbol = l.symbol AND t.ts >= l.open_time - INTERVAL '{_L} seconds' AND t.ts < l.open_time GROUP BY 1, 2)"""
_COV = f"(epoch_us(open_time) - epoch_us(t0) >= {(_L - _SLACK) * 1_000_000} AND epoch_us(open_time) - epoch_us(t1) <= {_SLACK * 1_000_000})"


@query(
    "t01_causal_window",
    WITH + ", " + _WIN + f" SELECT ticket, CASE WHEN {_COV} THEN 'observed' ELSE 'unknown' END AS status, CASE WHEN {_COV} THEN round(m1 / m0 - 1, 9) END AS ret, CASE WHEN {_COV} THEN round(n / {_L}.0, 9) END AS rate, CASE WHEN epoch_us(open_time) - epoch_us(t1) <= {_SLACK * 1_000_000} THEN round(sp, 6) END AS spread_now, n, t1 AS max_input_time FROM w",
)
def t01_causal_window(spark, sf):
    """Return, rate and spread over [t - L, t) with statuses and latest input time."""
    f = T.features(V.ledger(spark, sf).select("ticket", "symbol", "open_time"), V.ticks(spark, sf).select("symbol", "ts", "bid", "ask"), on="symbol", at="open_time", lookback=_L, slack=_SLACK)
    f = T.assert_causal(f, "open_time")
    return f.select("ticket", "status", F.round("ret", 9).alias("ret"), F.round("rate", 9).alias("rate"), r6("spread_now").alias("spread_now"), "n", "max_input_time")


@query(
    "t06_tick_bundle",
    WITH + """, d AS (SELECT *, ln(mid) - ln(lag(mid) OVER (PARTITION BY symbol ORDER BY ts)) AS dl FROM ticks)
SELECT event_id, round(mid / first_value(mid) OVER w - 1, 9) AS ret, round(max(mid) OVER w - min(mid) OVER w, 6) AS range_, round(sqrt(greatest(sum(dl * dl) OVER w - coalesce(first_value(dl) OVER w * first_value(dl) OVER w, 0), 0)), 6) AS vol, count(*) OVER w AS n
FROM d WINDOW w AS (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)""",
)
def t06_tick_bundle(spark, sf):
    """Features at a tick over the closed window that ends in it."""
    t = V.ticks(spark, sf).select("event_id", "symbol", "mid", T.micros(F.col("ts")).alias("us"))
    b = T.closed_bundle(t, on="symbol", lookback=7200)
    return b.select("event_id", F.round("ret", 9).alias("ret"), r6("range_").alias("range_"), r6("vol").alias("vol"), "n")


#: The survey's windows are of seconds; ticks of the tables are minutes apart, so all are so many times as long.
_SCALE = 240
_UNITS = """, u AS (SELECT symbol, ts, epoch_us(ts) AS us, CAST(round(mid * 100) AS BIGINT) AS mid, CAST(2 * round(mid * 100) AS BIGINT) - 1 - k % 10 AS bid, CAST(2 * round(mid * 100) AS BIGINT) + 1 + k % 10 AS ask, 1 + k % 10 AS spread FROM ticks)"""
_VECTOR = _UNITS + f""", g AS (SELECT l.ticket, any_value(epoch_us(l.open_time)) AS t, any_value(hour(l.open_time)) AS hour, count(u.us) AS n_long, min(u.us) AS first_us, sum(u.spread) AS spread_sum, arg_max(u.spread, u.us) AS spread_now, arg_max(u.mid, u.us) AS now_mid,
  list(u.mid ORDER BY u.us) FILTER (u.us >= epoch_us(l.open_time) - {30 * _SCALE * 1_000_000}) AS s, count(u.us) FILTER (u.us >= epoch_us(l.open_time) - {5 * _SCALE * 1_000_000}) AS n_last, arg_min(u.mid, u.us) FILTER (u.us >= epoch_us(l.open_time) - {5 * _SCALE * 1_000_000}) AS from_last
  FROM ledger l LEFT JOIN u ON u.symbol = l.symbol AND u.ts < l.open_time AND u.us >= epoch_us(l.open_time) - {300 * _SCALE * 1_000_000} GROUP BY 1),
v AS (SELECT ticket, hour, nullif(n_long, 0) AS n_long, CASE WHEN n_long > 0 THEN least(1.0, (t - first_us) / {300 * _SCALE}e6) ELSE 0 END AS coverage, spread_now, spread_sum / n_long AS mean_spread, CASE WHEN n_long > 0 THEN coalesce(len(s), 0) END AS n_short, CASE WHEN len(s) >= 2 THEN abs(s[-1] - s[1]) END AS abs_move,
  CASE WHEN len(s) >= 2 THEN list_sum(list_transform(range(2, len(s) + 1), lambda i: abs(s[i] - s[i - 1]))) END AS displacement, CASE WHEN n_last >= 2 THEN now_mid - from_last WHEN n_last = 1 AND len(s) >= 1 THEN now_mid - s[1] END AS ret_last FROM g),
x AS (SELECT *, n_short / {30.0 * _SCALE} AS rate_short, CASE WHEN n_short >= 2 THEN n_short / {30.0 * _SCALE} / (n_long / {300.0 * _SCALE}) END AS rate_ratio FROM v)"""
_VECTOR_OUT = "ticket, CAST(n_long AS BIGINT) AS n_long, round(coverage, 9) AS coverage, round(spread_now / 100.0, 6) AS spread_now, CAST(n_short AS INTEGER) AS n_short, round(abs_move / 100.0, 6) AS abs_move, round(displacement / 100.0, 6) AS displacement, round(ret_last / 100.0, 6) AS ret_last, round(rate_short, 9) AS rate_short, round(rate_ratio, 9) AS rate_ratio"


def _units(spark, sf):
    """Ticks with prices in integer cents (bid and ask in halves) and the spread in points."""
    cents, points = F.round(F.col("mid") * 100).cast("long"), (1 + F.col("k") % 10).cast("long")
    return V.ticks(spark, sf).select("symbol", "ts", cents.alias("mid"), (2 * cents - points).alias("bid"), (2 * cents + points).alias("ask"), points.alias("spread"))


def _vector(spark, sf):
    return T.tick_vector(V.ledger(spark, sf).select("ticket", "symbol", "open_time"), _units(spark, sf).select("symbol", "ts", "mid", "spread"), on="symbol", key="ticket", at="open_time", last=5 * _SCALE, short=30 * _SCALE, long=300 * _SCALE)


def _vector_out(v):
    per = lambda c: r6(F.col(c) / 100).alias(c)
    return v.select("ticket", "n_long", F.round("coverage", 9).alias("coverage"), per("spread_now"), "n_short", per("abs_move"), per("displacement"), per("ret_last"), F.round("rate_short", 9).alias("rate_short"), F.round("rate_ratio", 9).alias("rate_ratio"), r6("jump_z").alias("jump_z"), r6("spread_ratio").alias("spread_ratio"))


@query("t07_feature_vector", WITH + _VECTOR + f" SELECT {_VECTOR_OUT}, CAST(NULL AS DOUBLE) AS jump_z, round(spread_now / mean_spread, 6) AS spread_ratio FROM x")
def t07_feature_vector(spark, sf):
    """Eight figures over three nested causal windows, without baselines: jump_z is unavailable, not unscaled."""
    return _vector_out(T.rescaled(_vector(spark, sf), None))


@query(
    "t08_rescaled_vector",
    WITH + _VECTOR + f", b AS (SELECT hour, stddev_pop(abs_move) AS sd, avg(mean_spread) AS sp FROM x GROUP BY 1 HAVING count(*) > 1) SELECT {_VECTOR_OUT}, round(CASE WHEN b.hour IS NOT NULL THEN abs_move / coalesce(nullif(sd, 0), 1.0) END, 6) AS jump_z, round(CASE WHEN b.hour IS NOT NULL THEN spread_now / coalesce(nullif(sp, 0), 1.0) ELSE spread_now / mean_spread END, 6) AS spread_ratio FROM x LEFT JOIN b ON b.hour = x.hour",
)
def t08_rescaled_vector(spark, sf):
    """The same put in relation to hourly baselines without reading a tick again; an hour of one entry has none."""
    v = _vector(spark, sf)
    b = v.groupBy("hour").agg(F.stddev_pop("abs_move").alias("std_move"), F.avg("mean_spread").alias("spread"), F.count("*").alias("c")).where("c > 1")
    return _vector_out(T.rescaled(v, b))


_WINDOWS = tuple(w * _SCALE for w in (0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0, 30.0, 60.0))
_BUNDLE = """, e AS (SELECT l.ticket, l.symbol, l.open_time, epoch_us(l.open_time) AS t, u.mid AS entry_mid, u.spread AS entry_spread FROM ledger l ASOF LEFT JOIN u ON u.symbol = l.symbol AND l.open_time > u.ts),
w AS (SELECT e.ticket, v.w AS seconds, any_value(entry_mid) AS entry_mid, any_value(entry_spread) AS entry_spread, count(u.us) AS n, list(u.mid ORDER BY u.us) FILTER (u.us IS NOT NULL) AS m, list(u.bid ORDER BY u.us) FILTER (u.us IS NOT NULL) AS b, list(u.ask ORDER BY u.us) FILTER (u.us IS NOT NULL) AS a, list(u.spread ORDER BY u.us) FILTER (u.us IS NOT NULL) AS s
  FROM e CROSS JOIN (SELECT unnest({windows}) AS w) v LEFT JOIN u ON u.symbol = e.symbol AND u.us < e.t AND u.us >= e.t - CAST(v.w * 1000000 AS BIGINT) GROUP BY 1, 2),
d AS (SELECT *, list_transform(range(2, n + 1), lambda i: m[i] - m[i - 1]) AS d, list_transform(range(2, n + 1), lambda i: b[i] <> b[i - 1] OR a[i] <> a[i - 1]) AS q FROM w)"""


@query(
    "t09_multi_window",
    WITH + _UNITS + _BUNDLE.replace("{windows}", str([float(w) for w in _WINDOWS])) + """ SELECT ticket, seconds, CAST(n AS INTEGER) AS tick_count, CASE WHEN n >= 2 THEN m[-1] - m[1] ELSE 0 END AS ret_mid, CASE WHEN n >= 2 THEN b[-1] - b[1] ELSE 0 END AS ret_bid, CASE WHEN n >= 2 THEN a[-1] - a[1] ELSE 0 END AS ret_ask, CASE WHEN n >= 2 THEN abs(m[-1] - m[1]) ELSE 0 END AS abs_move,
CASE WHEN n >= 2 THEN CAST(len(list_filter(q, lambda x: x)) AS INTEGER) ELSE 0 END AS quote_changes, CASE WHEN n >= 2 THEN CAST(len(list_filter(d, lambda x: x > 0)) AS INTEGER) ELSE 0 END AS ups, CASE WHEN n >= 2 THEN CAST(len(list_filter(d, lambda x: x < 0)) AS INTEGER) ELSE 0 END AS downs, CASE WHEN n >= 2 THEN m[-1] + m[1] - 2 * m[n // 2 + 1] ELSE 0 END AS acceleration,
round(CASE WHEN n >= 3 THEN sqrt(CAST((n - 1) * list_sum(list_transform(d, lambda x: x * x)) - list_sum(d) * list_sum(d) AS DOUBLE)) / (n - 1) ELSE 0 END, 6) AS volatility, CASE WHEN n >= 2 THEN CAST(list_sum(s) AS DOUBLE) / n ELSE entry_spread END AS spread, CASE WHEN n >= 2 THEN CAST(s[-1] - s[1] AS BIGINT) ELSE 0 END AS spread_change,
CASE WHEN n >= 2 THEN list_max(m) - entry_mid ELSE 0 END AS below_high, CASE WHEN n >= 2 THEN entry_mid - list_min(m) ELSE 0 END AS above_low FROM d""",
)
def t09_multi_window(spark, sf):
    """Fourteen figures over ten windows before each entry, in integer units: cents, half cents and points."""
    b = T.window_bundle(V.ledger(spark, sf).select("ticket", "symbol", "open_time"), _units(spark, sf), on="symbol", key="ticket", at="open_time", windows=_WINDOWS)
    return b.withColumn("volatility", r6("volatility"))


_HALVES = tuple(w * _SCALE for w in (1, 3, 5, 10, 30, 60))


@query(
    "t10_half_split",
    WITH + _UNITS + _BUNDLE.replace("{windows}", str([float(w) for w in _HALVES])) + """ SELECT ticket, seconds, CAST(n AS INTEGER) AS tick_count, CASE WHEN n >= 2 THEN m[-1] - m[1] ELSE 0 END AS ret_mid, CASE WHEN n >= 2 THEN CAST(list_sum(s) AS DOUBLE) / n ELSE entry_spread END AS spread, CASE WHEN n >= 2 THEN CAST(len(list_filter(d, lambda x: x > 0)) - len(list_filter(d, lambda x: x < 0)) AS INTEGER) ELSE 0 END AS net_ups, CASE WHEN n >= 2 THEN m[-1] + m[1] - 2 * m[n // 2 + 1] ELSE 0 END AS acceleration FROM d""",
)
def t10_half_split(spark, sf):
    """Five figures over six windows, the acceleration between the two halves of the ticks."""
    b = T.window_bundle(V.ledger(spark, sf).select("ticket", "symbol", "open_time"), _units(spark, sf), on="symbol", key="ticket", at="open_time", windows=_HALVES)
    return b.select("ticket", "seconds", "tick_count", "ret_mid", "spread", (F.col("ups") - F.col("downs")).alias("net_ups"), "acceleration")


@query(
    "t12_trade_path",
    WITH + """, g AS (SELECT s.*, unnest(generate_series(open_time, close_time, INTERVAL '30 minutes')) AS gt FROM ledger s),
q AS (SELECT g.ticket, g.gt, g.open_time, g.side, g.price, t.bid, t.ask FROM g ASOF LEFT JOIN ticks t ON g.symbol = t.symbol AND g.gt >= t.ts),
m AS (SELECT *, CASE WHEN side = 'Buy' THEN bid - price ELSE price - ask END AS move FROM q)
SELECT ticket, round((epoch_us(gt) - epoch_us(open_time)) / 1e6, 3) AS age, round(move, 6) AS move, round(max(move) OVER w, 6) AS mfe, round(min(move) OVER w, 6) AS mae, round(max(move) OVER w - move, 6) AS giveback, round(move - lag(move, 2) OVER (PARTITION BY ticket ORDER BY gt), 6) AS momentum,
round((epoch_us(gt) - coalesce(epoch_us(lag(gt) OVER (PARTITION BY ticket ORDER BY gt)), epoch_us(open_time))) / 1e6, 3) AS exposure FROM m WINDOW w AS (PARTITION BY ticket ORDER BY gt ROWS UNBOUNDED PRECEDING)""",
)
def t12_trade_path(spark, sf):
    """Path of each trade on a grid: move, running extremes, giveback, momentum, exact exposure."""
    s = V.ledger(spark, sf).select("ticket", "symbol", "side", "price", "open_time", F.explode(F.expr("sequence(open_time, close_time, interval 30 minutes)")).alias("at"))
    q = A.asof(s, V.ticks(spark, sf).select("symbol", "ts", "bid", "ask"), on="symbol", left_ts="at", right_ts="ts", take=["bid", "ask"])
    q = q.withColumn("move", F.when(F.col("side") == "Buy", F.col("bid") - F.col("price")).otherwise(F.col("price") - F.col("ask")))
    o = W.partitionBy("ticket").orderBy("at")
    w = o.rowsBetween(W.unboundedPreceding, 0)
    return q.select("ticket", F.round(A.seconds(F.col("at"), F.col("open_time")), 3).alias("age"), r6("move").alias("move"), r6(F.max("move").over(w)).alias("mfe"), r6(F.min("move").over(w)).alias("mae"), r6(F.max("move").over(w) - F.col("move")).alias("giveback"), r6(F.col("move") - F.lag("move", 2).over(o)).alias("momentum"), F.round(A.seconds(F.col("at"), F.coalesce(F.lag("at").over(o), F.col("open_time"))), 3).alias("exposure"))


@query("c01_tick_clock", WITH + "SELECT symbol, ts FROM ticks GROUP BY 1, 2")
def c01_tick_clock(spark, sf):
    return V.ticks(spark, sf).select("symbol", "ts").distinct()


@query("c02_timer_grid", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:05:00', TIMESTAMP '2024-01-02 00:00:00', INTERVAL '15 minutes')) AS ts")
def c02_timer_grid(spark, sf):
    """Grid anchored at the epoch plus a phase, from the first point at or after the start."""
    return C.timer_grid(spark, "2024-01-01 00:00:02", "2024-01-02 00:00:00", every=900, phase=300)


@query(
    "c03_completed_bar_clock",
    WITH + ", e AS (SELECT symbol, ts + INTERVAL '1 hour' AS bar_end FROM bars_1h) SELECT e.symbol, e.bar_end, t.ts AS decision_time FROM e ASOF JOIN ticks t ON e.symbol = t.symbol AND e.bar_end <= t.ts",
)
def c03_completed_bar_clock(spark, sf):
    """The first quote at or after each bar's end is when it is known."""
    e = V.bars_1h(spark, sf).select("symbol", (F.col("ts") + F.expr("interval 1 hour")).alias("bar_end"))
    j = A.asof(e, V.ticks(spark, sf).select("symbol", F.col("ts").alias("decision_time")), on="symbol", left_ts="bar_end", right_ts="decision_time", take=[], forward=True)
    return j.where("decision_time is not null")


@query(
    "c04_opportunity_support",
    WITH + ", g AS (SELECT s.symbol, ts FROM (SELECT DISTINCT symbol FROM ticks) s CROSS JOIN (SELECT unnest(" + HOURS + ") AS ts)), n AS (SELECT symbol, ts, count(*) AS n FROM bars_1h GROUP BY 1, 2), c AS (SELECT symbol, date_trunc('hour', open_time) AS ts, count(*) AS e FROM ledger GROUP BY 1, 2) SELECT g.symbol, g.ts, CASE WHEN n.n IS NULL THEN 'unknown' ELSE 'observed' END AS support_status, CASE WHEN n.n IS NULL THEN NULL ELSE coalesce(c.e, 0) > 0 END AS label FROM g LEFT JOIN n USING (symbol, ts) LEFT JOIN c USING (symbol, ts)",
)
def c04_opportunity_support(spark, sf):
    """Opportunities with support and labels; without support the label is unknown, not negative."""
    t = V.ticks(spark, sf)
    grid = C.inventory(t, *V.period(t)).select("symbol", F.col("hour").alias("ts"))
    n = V.bars_1h(spark, sf).select("symbol", "ts", F.lit(True).alias("seen"))
    c = V.ledger(spark, sf).groupBy("symbol", F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("e"))
    j = grid.join(n, ["symbol", "ts"], "left").join(c, ["symbol", "ts"], "left")
    return j.select("symbol", "ts", F.when(F.col("seen"), "observed").otherwise("unknown").alias("support_status"), F.when(F.col("seen"), F.coalesce("e", F.lit(0)) > 0).alias("label"))


@query(
    "c06_epochs",
    WITH + ", p AS (SELECT ticket, symbol, open_time, coalesce(epoch_us(open_time) - epoch_us(lag(open_time) OVER w) > 1800000000, true) AS new FROM ledger WINDOW w AS (PARTITION BY symbol ORDER BY open_time, ticket)), e AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY symbol ORDER BY open_time, ticket) AS epoch FROM p) SELECT symbol, CAST(epoch AS BIGINT) AS epoch, min(open_time) AS decision_time, count(*) AS record_count, string_agg(ticket, ',' ORDER BY ticket) AS member_tickets FROM e GROUP BY 1, 2",
)
def c06_epochs(spark, sf):
    """Records of one decision grouped to epochs with their members."""
    w = W.partitionBy("symbol").orderBy("open_time", "ticket")
    led = V.ledger(spark, sf)
    new = F.coalesce(A.seconds(F.col("open_time"), F.lag("open_time").over(w)) > 1800, F.lit(True)).cast("int")
    e = led.withColumn("new", new).withColumn("epoch", F.sum("new").over(w))
    return e.groupBy("symbol", "epoch").agg(F.min("open_time").alias("decision_time"), F.count("*").alias("record_count"), F.array_join(F.sort_array(F.collect_list("ticket")), ",").alias("member_tickets"))


@query(
    "c08_risk_sets",
    WITH + ", e AS (SELECT ticket, user_id, symbol, open_time FROM ledger), m AS (SELECT e.ticket, e.user_id, b.ts FROM e JOIN bars_1h b ON b.symbol = e.symbol AND CAST(b.ts AS DATE) = CAST(e.open_time AS DATE) AND b.ts <> date_trunc('hour', e.open_time)), f AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.user_id = m.user_id AND m.ts >= l.open_time AND m.ts < l.close_time)) SELECT ticket, count(*) AS controls, min(ts) AS first_control, max(ts) AS last_control FROM f GROUP BY 1 HAVING count(*) >= 5",
)
def c08_risk_sets(spark, sf):
    """Same-day control bars outside the account's own positions, strata of at least five."""
    led = V.ledger(spark, sf)
    e = led.select("ticket", "user_id", "symbol", "open_time", F.to_date("open_time").alias("day"))
    b = V.bars_1h(spark, sf).select("symbol", "ts", F.to_date("ts").alias("day"))
    m = e.join(b, ["symbol", "day"]).where(F.date_trunc("hour", "open_time").cast("timestamp_ntz") != F.col("ts")).select("ticket", "user_id", "ts")
    f = X.outside(m, led, on="user_id", ts="ts", start="open_time", end="close_time")
    return f.groupBy("ticket").agg(F.count("*").alias("controls"), F.min("ts").alias("first_control"), F.max("ts").alias("last_control")).where("controls >= 5")


@query(
    "c09_sampled_controls",
    WITH + ", r AS (SELECT symbol, ts, event_id, count(*) OVER p AS quotes, row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY md5(concat('7:', event_id))) AS r FROM ticks WINDOW p AS (PARTITION BY symbol, date_trunc('hour', ts))) SELECT symbol, event_id, quotes AS quotes_in_stratum, round(1.0 / quotes, 9) AS inclusion_probability FROM r WHERE r = 1",
)
def c09_sampled_controls(spark, sf):
    """One quote per stratum, drawn by hash, with its inclusion probability."""
    t = V.ticks(spark, sf).withColumn("h", F.date_trunc("hour", "ts"))
    g = t.groupBy("symbol", "h").agg(F.count("*").alias("quotes_in_stratum"), F.min_by("event_id", F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")))).alias("event_id"))
    return g.select("symbol", "event_id", "quotes_in_stratum", F.round(1 / F.col("quotes_in_stratum"), 9).alias("inclusion_probability"))


@query(
    "c11_expanding_folds",
    WITH + ", f AS (SELECT i AS fold, " + FIRST + " + to_days(CAST(ceil(" + DAYS + " * (5 + 2 * i) / 15.0) AS INTEGER)) AS test_start, " + FIRST + " + to_days(CAST(ceil(" + DAYS + " * (7 + 2 * i) / 15.0) AS INTEGER)) AS test_end FROM range(5) r(i)), a AS (SELECT f.fold, CASE WHEN open_time < test_start - INTERVAL '15 minutes' AND close_time < test_start THEN 'train' WHEN open_time >= test_start AND open_time < test_end THEN 'test' ELSE 'excluded' END AS role, pnl FROM ledger CROSS JOIN f) SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n, round(avg(pnl), 6) AS mean_pnl FROM a GROUP BY 1, 2",
)
def c11_expanding_folds(spark, sf):
    """Expanding folds with embargo and purge of trades still open at the test's start."""
    first, days = S.span(V.ticks(spark, sf), "ts")
    cuts = [S.cut(days, (5 + 2 * i) / 15) for i in range(6)]
    return C.folds(V.ledger(spark, sf), str(first), cuts, embargo=900).groupBy("fold", "role").agg(F.count("*").alias("n"), r6(F.avg("pnl")).alias("mean_pnl"))


@query(
    "c14_time_rescaling",
    WITH + ", r AS (SELECT symbol, hour(ts) AS h, count(*) / 30.0 / 3600 AS rate FROM ticks GROUP BY 1, 2), g AS (SELECT t.symbol, t.ts, t.event_id, r.rate * (epoch_us(t.ts) - epoch_us(lag(t.ts) OVER (PARTITION BY t.symbol ORDER BY t.ts, t.event_id))) / 1e6 AS tau FROM ticks t JOIN r ON r.symbol = t.symbol AND r.h = hour(t.ts)) SELECT symbol, round(avg(tau), 6) AS mean_tau, round(max(tau), 6) AS max_tau, count(tau) AS n FROM g GROUP BY 1",
)
def c14_time_rescaling(spark, sf):
    """Gaps on a clock rescaled by the hourly intensity (C14)."""
    t = V.ticks(spark, sf).withColumn("h", F.hour("ts"))
    rate = t.groupBy("symbol", "h").agg((F.count("*") / 30.0 / 3600).alias("rate"))
    w = W.partitionBy("symbol").orderBy("ts", "event_id")
    g = t.join(F.broadcast(rate), ["symbol", "h"]).withColumn("tau", F.col("rate") * (T.micros(F.col("ts")) - F.lag(T.micros(F.col("ts"))).over(w)) / 1e6)  # 24 rows a symbol
    return g.groupBy("symbol").agg(r6(F.avg("tau")).alias("mean_tau"), r6(F.max("tau")).alias("max_tau"), F.count("tau").alias("n"))


@query(
    "s21_quality_profile",
    "SELECT count(*) AS rows_, count(*) - count(DISTINCT o_orderkey) AS duplicate_keys, count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority = '') AS empty_cells, count(*) FILTER (regexp_matches(CAST(o_orderkey AS VARCHAR), '^0')) AS leading_zero, count(*) FILTER (isodow(o_orderdate) >= 6) AS weekend, count(*) FILTER (o_totalprice <= 0) AS not_positive FROM orders",
)
def s21_quality_profile(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.agg(F.count("*").alias("rows_"), (F.count("*") - F.countDistinct("o_orderkey")).alias("duplicate_keys"), F.count_if(F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") == "")).alias("empty_cells"), F.count_if(F.col("o_orderkey").cast("string").rlike("^0")).alias("leading_zero"), F.count_if(F.weekday("o_orderdate") >= 5).alias("weekend"), F.count_if(F.col("o_totalprice") <= 0).alias("not_positive"))


@query(
    "s22_tick_inspection",
    WITH + ", d AS (SELECT symbol, date_trunc('day', ts) AS day, ts, bid, ask, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY event_id)) AS gap FROM ticks) SELECT symbol, day, count(*) AS n, count(*) FILTER (gap < 0) AS backwards, count(*) FILTER (gap = 0) AS duplicates, count(*) FILTER (bid > ask OR bid <= 0) AS crossed, round(max(gap) / 1e6, 3) AS largest_gap, min(ts) AS first_tick, max(ts) AS last_tick FROM d GROUP BY 1, 2",
)
def s22_tick_inspection(spark, sf):
    """Order, duplicates, crossed quotes and gaps of each day's file."""
    return C.inspect(V.ticks(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz")), ["symbol", "day"])


@query(
    "s23_coverage",
    WITH + ", g AS (SELECT s.symbol, ts FROM (SELECT DISTINCT symbol FROM ticks) s CROSS JOIN (SELECT unnest(" + HOURS + ") AS ts)) SELECT g.symbol, count(*) AS expected, count(b.ts) AS observed, count(*) - count(b.ts) AS unknown, min(CASE WHEN b.ts IS NULL THEN g.ts END) AS first_missing FROM g LEFT JOIN bars_1h b ON b.symbol = g.symbol AND b.ts = g.ts GROUP BY 1",
)
def s23_coverage(spark, sf):
    """Expected hours against those with ticks; missing ones stay explicit and make the acquisition plan."""
    t = V.ticks(spark, sf)
    c = C.inventory(t, *V.period(t))
    return c.groupBy("symbol").agg(F.count("*").alias("expected"), F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(F.col("status") == "unknown").alias("unknown"), F.min(F.when(F.col("status") == "unknown", F.col("hour"))).alias("first_missing"))


@query("s29_table_equality", "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, (SELECT count(*) FROM supplier) AS rows_")
def s29_table_equality(spark, sf):
    """Multiset difference of two runs' tables."""
    return C.differences(V.table(spark, sf, "supplier"), V.table(spark, sf, "supplier").repartition(3))


@query("s16_file_hashes")
def s16_file_hashes(spark, sf):
    """SHA-256 and role of input files."""
    return C.artifacts(spark, f"{sf}/region.parquet")
