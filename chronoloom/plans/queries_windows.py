"""Window functions, indicators and bars (SURVEY W)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import bars as B
from chronoloom.operators import series as S
from chronoloom.plans import views as V
from chronoloom.plans.views import WITH, r6
from chronoloom.registry import query

_W = " WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
_ROWS = lambda n, e=0: f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + e} PRECEDING AND {f'{e} PRECEDING' if e else 'CURRENT ROW'})"


def _full(agg, n, e=0, x="close"):
    return f"CASE WHEN count({x}) {_ROWS(n, e)} >= {n} THEN {agg} {_ROWS(n, e)} END"


def _bars(spark, sf):
    return V.bars_1h(spark, sf), S.over("symbol", order=["ts"])


@query("w01_returns", WITH + "SELECT symbol, ts, " + ", ".join(f"round(close / lag(close, {h}) OVER w - 1, 9) AS ret_{h}" for h in (1, 3, 5, 60, 240)) + ", round(close - lag(close) OVER w, 6) AS diff, round(lead(close, 5) OVER w / close - 1, 9) AS fwd_5 FROM bars_1h" + _W)
def w01_returns(spark, sf):
    """Returns over several lags, difference, forward return."""
    b, w = _bars(spark, sf)
    back = [F.round(F.col("close") / F.lag("close", h).over(w) - 1, 9).alias(f"ret_{h}") for h in (1, 3, 5, 60, 240)]
    return b.select("symbol", "ts", *back, r6(F.col("close") - F.lag("close").over(w)).alias("diff"), F.round(F.lead("close", 5).over(w) / F.col("close") - 1, 9).alias("fwd_5"))


@query(
    "w03_rolling",
    WITH + f"""SELECT symbol, ts, round({_full('avg(close)', 20)}, 6) AS sma_20, round({_full('stddev_samp(close)', 20)}, 6) AS std_20, round({_full('min(low)', 14)}, 6) AS min_14, round({_full('max(high)', 14)}, 6) AS max_14,
round({_full('sum(volume)', 10)}, 6) AS vol_10, round({_full('quantile_cont(close, 0.5)', 15)}, 6) AS median_15, round({_full('quantile_cont(close, 0.25)', 15, 1)}, 6) AS q25_prev,
round((ln(1 + volume) - {_full('avg(ln(1 + volume))', 20)}) / nullif({_full('stddev_samp(ln(1 + volume))', 20)}, 0), 6) AS vol_z FROM bars_1h""",
)
def w03_rolling(spark, sf):
    """Rolling mean, deviation, extremes, sum, median, lagged quantile, z-score of log volume."""
    b, w = _bars(spark, sf)
    lv = F.log1p("volume")
    sd = S.rolling(F.stddev_samp(lv), "close", w, 20)
    return b.select(
        "symbol", "ts", r6(S.rolling(F.avg("close"), "close", w, 20)).alias("sma_20"), r6(S.rolling(F.stddev_samp("close"), "close", w, 20)).alias("std_20"),
        r6(S.rolling(F.min("low"), "close", w, 14)).alias("min_14"), r6(S.rolling(F.max("high"), "close", w, 14)).alias("max_14"), r6(S.rolling(F.sum("volume"), "close", w, 10)).alias("vol_10"),
        r6(S.rolling(F.percentile("close", F.lit(0.5)), "close", w, 15)).alias("median_15"), r6(S.rolling(F.percentile("close", F.lit(0.25)), "close", w, 15, shift=1)).alias("q25_prev"),
        r6((lv - S.rolling(F.avg(lv), "close", w, 20)) / F.when(sd != 0, sd)).alias("vol_z"),
    )


@query(
    "w05_percentile_rank",
    WITH + f", l AS (SELECT symbol, ts, close, list(close) {_ROWS(48)} AS v FROM bars_1h) SELECT symbol, ts, CASE WHEN len(v) >= 12 THEN round((len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / len(v), 9) END AS rank FROM l",
)
def w05_percentile_rank(spark, sf):
    b, w = _bars(spark, sf)
    return b.select("symbol", "ts", F.round(S.percentile_rank("close", w, 48, 12), 9).alias("rank"))


def _ema_sql(alpha, x="close", name="y", source="bars_1h"):
    return f"""n AS (SELECT symbol, ts, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM {source}),
{name} AS (SELECT symbol, ts, i, x AS y FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, {1 - alpha!r} * e.y + {alpha!r} * n.x FROM {name} e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


_RECURSIVE = WITH.replace("WITH ", "WITH RECURSIVE ", 1)


@query("w07_ema", _RECURSIVE + ", " + _ema_sql(2 / 21) + " SELECT symbol, ts, round(y, 6) AS ema_20 FROM y")
def w07_ema(spark, sf):
    return S.ewm(V.bars_1h(spark, sf), "close", 2 / 21, key="symbol", order="ts", out="ema").select("symbol", "ts", r6("ema").alias("ema_20"))


@query(
    "w08_rsi_wilder",
    _RECURSIVE + """, d AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars_1h),
y AS (SELECT symbol, ts, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM d WHERE i = 1 UNION ALL SELECT d.symbol, d.ts, d.i, y.g * (1 - 1 / 14.0) + greatest(d.d, 0) / 14.0, y.l * (1 - 1 / 14.0) + greatest(-d.d, 0) / 14.0 FROM y JOIN d ON d.symbol = y.symbol AND d.i = y.i + 1)
SELECT d.symbol, d.ts, CASE WHEN d.i >= 14 THEN round(100 - 100 / (1 + g / nullif(l, 0)), 4) END AS rsi FROM d LEFT JOIN y ON d.symbol = y.symbol AND d.i = y.i""",
)
def w08_rsi_wilder(spark, sf):
    return S.rsi_wilder(V.bars_1h(spark, sf), "close", 14, key="symbol", order="ts", out="rsi").select("symbol", "ts", F.round("rsi", 4).alias("rsi"))


@query(
    "w09_rsi_cutler_atr",
    WITH + f""", d AS (SELECT *, close - lag(close) OVER w AS d, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars_1h{_W})
SELECT symbol, ts, round(100 - 100 / (1 + {_full('avg(greatest(d, 0))', 14, x='d')} / nullif({_full('avg(greatest(-d, 0))', 14, x='d')}, 0)), 4) AS rsi, round(tr, 6) AS tr, round({_full('avg(tr)', 14)}, 6) AS atr_sma FROM d""",
)
def w09_rsi_cutler_atr(spark, sf):
    """Rolling-mean RSI, true range and its rolling mean."""
    b, w = _bars(spark, sf)
    b = b.withColumns({"d": F.col("close") - F.lag("close").over(w), "tr": B.true_range(w)})
    gain, loss = (S.rolling(F.avg(F.when(F.col("d").isNotNull(), F.greatest(x, F.lit(0.0)))), "d", w, 14) for x in (F.col("d"), -F.col("d")))
    return b.select("symbol", "ts", F.round(100 - 100 / (1 + gain / F.when(loss != 0, loss)), 4).alias("rsi"), r6("tr").alias("tr"), r6(S.rolling(F.avg("tr"), "close", w, 14)).alias("atr_sma"))


@query(
    "w11_bands",
    WITH + f""", b AS (SELECT *, {_full('avg(close)', 20)} AS m, {_full('stddev_samp(close)', 20)} AS s, {_full('min(low)', 14)} AS lo, {_full('max(high)', 14)} AS hi, {_full('max(high)', 20, 1)} AS dh, {_full('min(low)', 20, 1)} AS dl FROM bars_1h),
k AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM b)
SELECT symbol, ts, round(m + 2 * s, 6) AS upper, round(m - 2 * s, 6) AS lower, round((close - m) / nullif(s, 0), 6) AS z, round(k, 6) AS stoch_k, round({_full('avg(k)', 3, x='k')}, 6) AS stoch_d, round(close - dh, 6) AS above_high, round(dl - close, 6) AS below_low FROM k""",
)
def w11_bands(spark, sf):
    """Bollinger bands, stochastic, distance from the prior channel."""
    b, w = _bars(spark, sf)
    b = b.withColumns({"m": S.rolling(F.avg("close"), "close", w, 20), "s": S.rolling(F.stddev_samp("close"), "close", w, 20), "lo": S.rolling(F.min("low"), "close", w, 14), "hi": S.rolling(F.max("high"), "close", w, 14), "dh": S.rolling(F.max("high"), "close", w, 20, shift=1), "dl": S.rolling(F.min("low"), "close", w, 20, shift=1)})
    b = b.withColumn("k", 100 * (F.col("close") - F.col("lo")) / F.expr("nullif(hi - lo, 0)"))
    return b.select("symbol", "ts", r6(F.col("m") + 2 * F.col("s")).alias("upper"), r6(F.col("m") - 2 * F.col("s")).alias("lower"), r6((F.col("close") - F.col("m")) / F.expr("nullif(s, 0)")).alias("z"), r6("k").alias("stoch_k"), r6(S.rolling(F.avg("k"), "k", w, 3)).alias("stoch_d"), r6(F.col("close") - F.col("dh")).alias("above_high"), r6(F.col("dl") - F.col("close")).alias("below_low"))


@query("w11_macd", _RECURSIVE + ", " + _ema_sql(2 / 13, name="f") + ", " + _ema_sql(2 / 27, name="s").replace("n AS (", "n2 AS (", 1).replace(" FROM n ", " FROM n2 ").replace("JOIN n ON n.", "JOIN n2 n ON n.") + " SELECT f.symbol, f.ts, round(f.y - s.y, 6) AS macd FROM f JOIN s ON f.symbol = s.symbol AND f.i = s.i")
def w11_macd(spark, sf):
    b = S.ewm(V.bars_1h(spark, sf), "close", 2 / 13, key="symbol", order="ts", out="fast")
    b = S.ewm(b, "close", 2 / 27, key="symbol", order="ts", out="slow")
    return b.select("symbol", "ts", r6(F.col("fast") - F.col("slow")).alias("macd"))


@query(
    "w12_concurrency",
    WITH + """, e AS (SELECT symbol, open_time AS ts, 1 AS d FROM ledger UNION ALL SELECT symbol, close_time, -1 FROM ledger), r AS (SELECT symbol, ts, d, sum(d) OVER (PARTITION BY symbol ORDER BY ts, d ROWS UNBOUNDED PRECEDING) AS o FROM e)
SELECT symbol, CAST(max(o) AS BIGINT) AS most_open, count(*) AS steps FROM r GROUP BY 1""",
)
def w12_concurrency(spark, sf):
    """Most trades open at once, closes before opens at ties."""
    led = V.ledger(spark, sf)
    r = A.running_open(led, on="symbol", start="open_time", end="close_time")
    return r.groupBy("symbol").agg(F.max("open").alias("most_open"), F.sum(F.abs("s")).alias("steps"))


@query(
    "w14_drawdown",
    WITH + """, e AS (SELECT user_id, open_time, event_id, sum(pnl) OVER (PARTITION BY user_id ORDER BY open_time, event_id ROWS UNBOUNDED PRECEDING) AS equity FROM ledger),
d AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY user_id ORDER BY open_time, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
SELECT user_id, round(max(peak - equity), 6) AS max_drawdown, round(arg_max(equity, event_id), 6) AS final, count(*) AS n FROM d GROUP BY 1""",
)
def w14_drawdown(spark, sf):
    """Equity curve from zero, its running peak and the deepest fall, per account."""
    w = W.partitionBy("user_id").orderBy("open_time", "event_id").rowsBetween(W.unboundedPreceding, 0)
    d = V.ledger(spark, sf).withColumn("equity", F.sum("pnl").over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w)))
    return d.groupBy("user_id").agg(r6(F.max(F.col("peak") - F.col("equity"))).alias("max_drawdown"), r6(F.max_by("equity", "event_id")).alias("final"), F.count("*").alias("n"))


@query(
    "w15_session",
    WITH + """SELECT symbol, ts, CAST(sum(CAST(round(close * 100) AS BIGINT) * CAST(volume AS BIGINT)) OVER s AS DOUBLE) / nullif(sum(volume) OVER s, 0) / 100 AS vwap, round(max(high) OVER p, 6) AS high_before, round(min(low) OVER p, 6) AS low_before, count(*) OVER s AS bar_of_day FROM bars_1h
WINDOW s AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def w15_session(spark, sf):
    """Day's VWAP so far (from integer cents, so that no order of addition shows), extremes before the bar, running count."""
    b = V.bars_1h(spark, sf)
    w = W.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    s, p = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    vol = F.sum("volume").over(s)
    return b.select("symbol", "ts", (F.sum(F.round(F.col("close") * 100).cast("long") * F.col("volume").cast("long")).over(s) / F.when(vol != 0, vol) / 100).alias("vwap"), r6(F.max("high").over(p)).alias("high_before"), r6(F.min("low").over(p)).alias("low_before"), F.count("*").over(s).alias("bar_of_day"))


@query("w17_time_rolling", WITH + "SELECT ticket, round(sum(pnl) OVER w, 6) AS pnl_5d, count(*) OVER w AS n_5d FROM ledger WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(open_time) RANGE BETWEEN 431999999999 PRECEDING AND CURRENT ROW)")
def w17_time_rolling(spark, sf):
    """Sum over (t - 5 days, t]: left-open time frame."""
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("open_time").cast("timestamp"))).rangeBetween(-(5 * 86400 * 1_000_000 - 1), 0)
    return V.ledger(spark, sf).select("ticket", r6(F.sum("pnl").over(w)).alias("pnl_5d"), F.count("*").over(w).alias("n_5d"))


@query(
    "w19_streaks",
    WITH + """, f AS (SELECT user_id, pnl > 0 AS win, row_number() OVER (PARTITION BY user_id ORDER BY open_time, event_id) - row_number() OVER (PARTITION BY user_id, pnl > 0 ORDER BY open_time, event_id) AS g FROM ledger),
r AS (SELECT user_id, win, g, count(*) AS n FROM f GROUP BY 1, 2, 3)
SELECT user_id, coalesce(max(CASE WHEN win THEN n END), 0) AS longest_win, coalesce(max(CASE WHEN NOT win THEN n END), 0) AS longest_loss, count(*) AS runs FROM r GROUP BY 1""",
)
def w19_streaks(spark, sf):
    """Longest winning and losing streaks and number of runs."""
    led = V.ledger(spark, sf).withColumn("win", F.col("pnl") > 0)
    g = S.islands(F.col("win"), W.partitionBy("user_id").orderBy("open_time", "event_id"), W.partitionBy("user_id", "win").orderBy("open_time", "event_id"))
    r = led.withColumn("g", g).groupBy("user_id", "win", "g").agg(F.count("*").alias("n"))
    most = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    return r.groupBy("user_id").agg(most(F.col("win")).alias("longest_win"), most(~F.col("win")).alias("longest_loss"), F.count("*").alias("runs"))


@query(
    "w22_ranks",
    WITH + """, s AS (SELECT symbol, date_trunc('day', ts) AS day, ts, round(close, 3) AS score FROM bars_1h), e AS (SELECT *, exp(score - max(score) OVER p) AS e FROM s WINDOW p AS (PARTITION BY symbol, day))
SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol, day ORDER BY score DESC, ts) AS INTEGER) AS first_rank, CAST(rank() OVER (PARTITION BY symbol, day ORDER BY score DESC) AS INTEGER) AS min_rank,
round((count(*) OVER p - rank() OVER (PARTITION BY symbol, day ORDER BY score DESC) + 1) / CAST(count(*) OVER p AS DOUBLE), 9) AS pct, round(e / sum(e) OVER p, 9) AS choice FROM e WINDOW p AS (PARTITION BY symbol, day)""",
)
def w22_ranks(spark, sf):
    """Ranks by two tie rules, percentile in the stratum, softmax choice probability."""
    s = V.bars_1h(spark, sf).select("symbol", F.to_date("ts").alias("day"), "ts", F.round("close", 3).alias("score"))
    p = W.partitionBy("symbol", "day")
    rank = F.rank().over(p.orderBy(F.desc("score")))
    s = s.withColumn("e", F.exp(F.col("score") - F.max("score").over(p)))
    n = F.count("*").over(p)
    return s.select("symbol", "ts", F.row_number().over(p.orderBy(F.desc("score"), "ts")).alias("first_rank"), rank.alias("min_rank"), F.round((n - rank + 1) / n, 9).alias("pct"), F.round(F.col("e") / F.sum("e").over(p), 9).alias("choice"))


@query(
    "w24_crossings",
    WITH + """, x AS (SELECT symbol, ts, close, lag(close) OVER w AS prev, epoch_us(ts) - epoch_us(lag(ts) OVER w) = 3600000000 AS adj FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
f AS (SELECT *, close > 130 AS above FROM x)
SELECT symbol, ts, coalesce(close >= 130 AND prev < 130 AND adj, false) AS crossing, count(*) OVER t = 3 AND coalesce(bool_and(above) OVER t, false) AND coalesce(min(CASE WHEN adj THEN 1 ELSE 0 END) OVER u, 0) = 1 AND count(*) OVER u = 2 AS persists_3 FROM f
WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
)
def w24_crossings(spark, sf):
    """Rising edges and persistence over adjacent bars; a gap resets both."""
    b, w = _bars(spark, sf)
    adj = F.coalesce(A.seconds(F.col("ts"), F.lag("ts").over(w)) == 3600, F.lit(False))
    b = b.withColumns({"adj": adj, "above": F.col("close") > 130})
    t, u = w.rowsBetween(-2, 0), w.rowsBetween(-1, 0)
    persists = (F.count("*").over(t) == 3) & F.bool_and("above").over(t) & (F.count("*").over(u) == 2) & F.bool_and("adj").over(u)
    return b.select("symbol", "ts", (S.crossing("close", 130, w) & F.col("adj")).alias("crossing"), persists.alias("persists_3"))


@query("w26_forward_fill", WITH + "SELECT symbol, ts, max(CASE WHEN k % 10 = 0 THEN ts END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_event FROM ticks")
def w26_forward_fill(spark, sf):
    w = W.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return V.ticks(spark, sf).select("symbol", "ts", F.last(F.when(F.col("k") % 10 == 0, F.col("ts")), ignorenulls=True).over(w).alias("last_event"))


@query(
    "w27_bar_events",
    WITH + f""", x AS (SELECT *, high - low AS rng, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc, lag(open) OVER w AS po, {_full('max(high)', 20, 1)} AS h20, {_full('min(low)', 20, 1)} AS l20, {_full('avg(high - low)', 20, 1)} AS r20 FROM bars_1h{_W})
SELECT symbol, ts + INTERVAL '1 hour' AS seen_at, coalesce(high > h20, false) AS breakout_high, coalesce(low < l20, false) AS breakout_low, coalesce(high > h20 AND close < h20, false) AS false_break, coalesce(high < ph AND low > pl, false) AS inside_bar, coalesce(high > ph AND low < pl, false) AS outside_bar,
coalesce(rng < 0.5 * r20, false) AS compression, coalesce(rng > 1.5 * r20, false) AS expansion, coalesce((close - open) * (pc - po) < 0 AND abs(close - open) > abs(pc - po), false) AS reversal FROM x""",
)
def w27_bar_events(spark, sf):
    """Event flags of completed bars, stamped when the bar is over."""
    b, w = _bars(spark, sf)
    return B.event_flags(b, w)


@query(
    "w28_lagged_features",
    WITH + """, f AS (SELECT symbol, ts, close - open AS body, abs(close - open) / nullif(high - low, 0) AS body_ratio, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, close FROM bars_1h)
SELECT symbol, ts, round(lag(close) OVER w, 6) AS m1_close, round(lag(body) OVER w, 6) AS m1_body, round(lag(body_ratio) OVER w, 6) AS m1_body_ratio, round(lag(upper_wick) OVER w, 6) AS m1_upper_wick, round(lag(lower_wick) OVER w, 6) AS m1_lower_wick FROM f""" + _W,
)
def w28_lagged_features(spark, sf):
    """Candle geometry as known at a bar's start: all of the bar before."""
    b, w = _bars(spark, sf)
    return B.lagged_candle(b, w)


@query(
    "w30_wide_features",
    WITH + """, d AS (SELECT *, abs(close - open) AS body FROM bars_4h), f AS (SELECT symbol, ts + INTERVAL '4 hours' AS seen_at, body, close / lag(close) OVER w - 1 AS ret, high - low AS rng FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT b.symbol, b.ts, f.seen_at, round(f.body, 6) AS h4_body_abs, round(f.ret, 9) AS h4_ret, round(f.rng, 6) AS h4_range FROM bars_1h b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.seen_at""",
)
def w30_wide_features(spark, sf):
    """Features of the last complete wider bar."""
    b, w = _bars(spark, sf)
    f = V.resample(b, "4 hours").select("symbol", (F.col("ts") + F.expr("interval 4 hours")).alias("seen_at"), F.abs(F.col("close") - F.col("open")).alias("body"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), (F.col("high") - F.col("low")).alias("rng"))
    j = A.asof(b.select("symbol", "ts"), f, on="symbol", left_ts="ts", right_ts="seen_at", take=["body", "ret", "rng"])
    return j.select("symbol", "ts", "seen_at", r6("body").alias("h4_body_abs"), F.round("ret", 9).alias("h4_ret"), r6("rng").alias("h4_range"))


@query("w31_resample_day", WITH + "SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars_1d")
def w31_resample_day(spark, sf):
    return V.resample(V.bars_1h(spark, sf), "1 day").select("symbol", "ts", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


_C = "close - open AS body, abs(close - open) / nullif(high - low, 0) AS body_ratio, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick"
_KNOWN = ("body", "body_ratio", "upper_wick", "lower_wick", "tr", "sma_20", "ret_1", "ret_5", "atr_14", "vol_20", "ema_20", "rsi_14")


@query(
    "w32_decision_panel",
    _RECURSIVE + ", " + _ema_sql(2 / 21, name="ye") + f""", rd AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars_1h),
ry AS (SELECT symbol, ts, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM rd WHERE i = 1 UNION ALL SELECT rd.symbol, rd.ts, rd.i, ry.g * (1 - 1 / 14.0) + greatest(rd.d, 0) / 14.0, ry.l * (1 - 1 / 14.0) + greatest(-rd.d, 0) / 14.0 FROM ry JOIN rd ON rd.symbol = ry.symbol AND rd.i = ry.i + 1),
f0 AS (SELECT *, {_C}, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5 FROM bars_1h{_W}),
f1 AS (SELECT *, {_full('avg(close)', 20)} AS sma_20, {_full('avg(tr)', 14)} AS atr_14, {_full('stddev_samp(ret_1)', 20, x='ret_1')} AS vol_20 FROM f0),
f2 AS (SELECT f1.*, ye.y AS ema_20, CASE WHEN ry.i >= 14 THEN 100 - 100 / (1 + ry.g / nullif(ry.l, 0)) END AS rsi_14 FROM f1 JOIN ye USING (symbol, ts) LEFT JOIN ry USING (symbol, ts)),
f3 AS (SELECT symbol, ts, {', '.join(f'lag({c}) OVER w AS {c}' for c in _KNOWN)} FROM f2{_W}),
h4 AS (SELECT symbol, ts + INTERVAL '4 hours' AS seen, close - open AS body, close FROM bars_4h), d1 AS (SELECT symbol, ts + INTERVAL '1 day' AS seen, close - open AS body, close FROM bars_1d),
en AS (SELECT symbol, date_trunc('hour', open_time) AS ts, count(*) AS entries, CASE WHEN sum(CASE WHEN side = 'Buy' THEN 1 ELSE -1 END) >= 0 THEN 'Buy' ELSE 'Sell' END AS side, string_agg(ticket, ';' ORDER BY ticket) AS tickets FROM ledger GROUP BY 1, 2)
SELECT f3.symbol, f3.ts, {', '.join(f'round(f3.{c}, 6) AS {c}' for c in _KNOWN)}, h4.seen AS h4_seen, round(h4.body, 6) AS h4_body, round(h4.close, 6) AS h4_close, d1.seen AS d1_seen, round(d1.body, 6) AS d1_body, round(d1.close, 6) AS d1_close, coalesce(en.entries, 0) AS entries, en.side, en.tickets
FROM f3 ASOF LEFT JOIN h4 ON h4.symbol = f3.symbol AND f3.ts >= h4.seen ASOF LEFT JOIN d1 ON d1.symbol = f3.symbol AND f3.ts >= d1.seen LEFT JOIN en ON en.symbol = f3.symbol AND en.ts = f3.ts""",
)
def w32_decision_panel(spark, sf):
    """The decision panel: indicators, lagged, wider bars and entry labels in one table."""
    from chronoloom.streaming.jobs import shared

    path = shared(spark, "bars")  # the bars are read by every branch of the panel: made once
    V.bars_1h(spark, sf).write.parquet(path)
    p = B.decision_panel(spark.read.parquet(path), V.ledger(spark, sf))
    return p.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in p.schema.fields])


@query(
    "w34_horizon_returns",
    WITH + ", " + "h AS (SELECT unnest([1, 2, 3, 6, 12, 24]) AS h) SELECT b.symbol, b.ts, CAST(h.h AS INTEGER) AS hours, round(b.close / p.close - 1, 9) AS ret FROM bars_1h b CROSS JOIN h LEFT JOIN bars_1h p ON p.symbol = b.symbol AND p.ts = b.ts - to_hours(CAST(h.h AS INTEGER))",
)
def w34_horizon_returns(spark, sf):
    """Returns against the bar exactly so many hours before; null if that bar is missing."""
    b = V.bars_1h(spark, sf)
    grid = b.withColumn("hours", F.explode(F.array(*map(F.lit, (1, 2, 3, 6, 12, 24))))).withColumn("at", F.col("ts") - F.make_dt_interval(F.lit(0), F.col("hours")))
    p = b.select("symbol", F.col("ts").alias("at"), F.col("close").alias("then"))
    return grid.join(p, ["symbol", "at"], "left").select("symbol", "ts", "hours", F.round(F.col("close") / F.col("then") - 1, 9).alias("ret"))
