"""All completed-bar events, cooldown bins, parameter and zone sweeps, sign flips, mixture selection and artifact sniffing (parts of SURVEY W, F, P, A, H, M and S)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import scalars as X
from chronoloom.operators import asof as A
from chronoloom.operators import models as M
from chronoloom.operators import resampling as R
from chronoloom.operators import series as S
from chronoloom.plans import views as V
from chronoloom.plans.queries_windows import _ema_sql
from chronoloom.plans.views import WITH, r6
from chronoloom.registry import query
from chronoloom.sources import coverage as C

#: The seventeen events as conditions on a bar's columns; Spark and SQL read the same text.
EVENTS = {
    "cross_high_10": "close > h10 AND pc <= h10", "cross_low_10": "close < l10 AND pc >= l10", "cross_high_20": "close > h20 AND pc <= h20", "cross_low_20": "close < l20 AND pc >= l20",
    "cross_session_high": "close > sh AND pc <= sh", "cross_session_low": "close < sl AND pc >= sl", "cross_vwap": "above_vwap <> p_above_vwap", "cross_ema20": "above_ema <> p_above_ema",
    "large_body_expansion": "impulse", "compression_to_expansion": "small1 AND small2 AND impulse", "higher_low_break": "low > pl AND close > h10 AND pc <= h10", "lower_high_break": "high < ph AND close < l10 AND pc >= l10",
    "false_break_high": "high > h10 AND close <= h10", "false_break_low": "low < l10 AND close >= l10", "impulse_pullback_up": "dir2 > 0 AND impulse2 AND dir1 < 0 AND close > ph2", "impulse_pullback_down": "dir2 < 0 AND impulse2 AND dir1 > 0 AND close < pl2",
    "immediate_reversal": "dir <> dir1 AND impulse AND impulse1",
}
_BEFORE = lambda agg, n: f"CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n} THEN {agg} OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
_RANGE = lambda q: f"CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 10 THEN quantile_cont(high - low, {q}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"


@query(
    "w27_completed_events",
    WITH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _ema_sql(2 / 21) + f""", d AS (SELECT b.*, y.y AS ema, CAST(b.ts AS DATE) AS day, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(high, 2) OVER w AS ph2, lag(low, 2) OVER w AS pl2 FROM bars_1h b JOIN y USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT *, {_BEFORE('max(high)', 10)} AS h10, {_BEFORE('min(low)', 10)} AS l10, {_BEFORE('max(high)', 20)} AS h20, {_BEFORE('min(low)', 20)} AS l20, max(high) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sh, min(low) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sl, {_RANGE(0.5)} AS med, {_RANGE(0.25)} AS q25,
  close >= sum((high + low + close) / 3 * volume) OVER (s ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (s ROWS UNBOUNDED PRECEDING) AS above_vwap, close >= ema AS above_ema, sign(close - open) AS dir FROM d WINDOW s AS (PARTITION BY symbol, day ORDER BY ts)),
f AS (SELECT *, (high - low) / nullif(med, 0) AS expansion, abs(close - open) / nullif(high - low, 0) AS body_ratio FROM e), g AS (SELECT *, coalesce(expansion >= 1.8 AND body_ratio >= 0.60, false) AS impulse, coalesce(high - low <= q25, false) AS small FROM f),
h AS (SELECT *, lag(above_vwap) OVER w AS p_above_vwap, lag(above_ema) OVER w AS p_above_ema, lag(dir) OVER w AS dir1, lag(dir, 2) OVER w AS dir2, coalesce(lag(impulse) OVER w, false) AS impulse1, coalesce(lag(impulse, 2) OVER w, false) AS impulse2, coalesce(lag(small) OVER w, false) AS small1, coalesce(lag(small, 2) OVER w, false) AS small2 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts + INTERVAL '1 hour' AS seen_at, """ + ", ".join(f"coalesce({c}, false) AS {k}" for k, c in EVENTS.items()) + ", round(expansion, 6) AS expansion, round(body_ratio, 6) AS body_ratio FROM h",
)
def w27_completed_events(spark, sf):
    """The seventeen events of completed bars with strength and body ratio, stamped when the bar is over."""
    w, day = S.over("symbol", order=["ts"]), W.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    b = S.ewm(V.bars_1h(spark, sf), "close", 2 / 21, key="symbol", order="ts", out="ema")
    before = lambda agg, n, least=None: F.when(F.count("close").over(w.rowsBetween(-n, -1)) >= (least or n), agg.over(w.rowsBetween(-n, -1)))
    rng, so_far, session = F.col("high") - F.col("low"), day.rowsBetween(W.unboundedPreceding, 0), day.rowsBetween(W.unboundedPreceding, -1)
    vwap = F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")).over(so_far) / F.sum("volume").over(so_far)
    e = b.withColumns({
        "pc": F.lag("close").over(w), "ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "ph2": F.lag("high", 2).over(w), "pl2": F.lag("low", 2).over(w),
        "h10": before(F.max("high"), 10), "l10": before(F.min("low"), 10), "h20": before(F.max("high"), 20), "l20": before(F.min("low"), 20), "sh": F.max("high").over(session), "sl": F.min("low").over(session),
        "med": before(F.percentile(rng, F.lit(0.5)), 20, 10), "q25": before(F.percentile(rng, F.lit(0.25)), 20, 10), "above_vwap": F.col("close") >= vwap, "above_ema": F.col("close") >= F.col("ema"), "dir": F.signum(F.col("close") - F.col("open")),
    })
    e = e.withColumns({"expansion": rng / F.when(F.col("med") != 0, F.col("med")), "body_ratio": F.abs(F.col("close") - F.col("open")) / F.when(rng != 0, rng)})
    e = e.withColumns({"impulse": F.coalesce((F.col("expansion") >= 1.8) & (F.col("body_ratio") >= 0.60), F.lit(False)), "small": F.coalesce(rng <= F.col("q25"), F.lit(False))})
    no = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(False))
    e = e.withColumns({"p_above_vwap": F.lag("above_vwap").over(w), "p_above_ema": F.lag("above_ema").over(w), "dir1": F.lag("dir").over(w), "dir2": F.lag("dir", 2).over(w), "impulse1": no("impulse", 1), "impulse2": no("impulse", 2), "small1": no("small", 1), "small2": no("small", 2)})
    return e.select("symbol", (F.col("ts") + F.expr("interval 1 hour")).alias("seen_at"), *[F.expr(f"coalesce({c}, false)").alias(k) for k, c in EVENTS.items()], r6("expansion").alias("expansion"), r6("body_ratio").alias("body_ratio"))


#: Right-closed bins of the seconds since the last exit, here of minutes.
_BINS = ([-1e18, 5, 15, 30, 60, 120, 300, 600, 1800, 1e18], ["0-5", "5-15", "15-30", "30-60", "60-120", "120-300", "300-600", "600-1800", ">1800"])


@query(
    "f19_cooldown_bins",
    WITH + ", l AS (SELECT l.ticket, (epoch_us(l.open_time) - epoch_us(p.close_time)) / 6e7 AS since FROM ledger l ASOF LEFT JOIN (SELECT DISTINCT symbol, close_time FROM ledger) p ON p.symbol = l.symbol AND l.open_time >= p.close_time) SELECT ticket, CASE WHEN since IS NULL THEN 'none' " + " ".join(f"WHEN since <= {e} THEN '{n}'" for e, n in zip(_BINS[0][1:-1], _BINS[1])) + f" ELSE '{_BINS[1][-1]}' END AS cooldown FROM l",
)
def f19_cooldown_bins(spark, sf):
    """Time since the symbol's last exit at each entry, in nine right-closed bins."""
    led = V.ledger(spark, sf).select("ticket", "symbol", "open_time", "close_time")
    last = led.select("symbol", F.col("close_time").alias("last_close")).distinct()
    j = A.asof(led.drop("close_time"), last, on="symbol", left_ts="open_time", right_ts="last_close", take=[])
    since = A.seconds(F.col("open_time"), F.col("last_close")) / 60
    return j.select("ticket", F.coalesce(X.buckets(since, *_BINS, right=True), F.lit("none")).alias("cooldown"))


_STOPS, _TRAILS = (20.0, 40.0, 80.0), ((30.0, 10.0), (30.0, 20.0), (60.0, 10.0), (60.0, 20.0))


@query(
    "p19_parameter_grid",
    WITH + """, p AS (SELECT l.ticket, l.side, l.price, b.ts, b.close, CASE WHEN side = 'Buy' THEN high - price ELSE price - low END AS fav, CASE WHEN side = 'Buy' THEN price - low ELSE high - price END AS adv, CASE WHEN side = 'Buy' THEN close - price ELSE price - close END AS cur FROM ledger l JOIN bars_1h b ON b.symbol = l.symbol AND b.ts > l.open_time AND b.ts <= l.close_time),
m AS (SELECT *, max(fav) OVER (PARTITION BY ticket ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM p), s AS (SELECT unnest([20.0, 40.0, 80.0]) AS sl), t AS (SELECT * FROM (VALUES (30.0, 10.0), (30.0, 20.0), (60.0, 10.0), (60.0, 20.0)) v(act, trail)),
es AS (SELECT ticket, sl, min(ts) FILTER (adv >= sl) AS ts FROM m CROSS JOIN s GROUP BY 1, 2), et AS (SELECT ticket, act, trail, min(ts) FILTER (peak >= act AND cur <= peak - trail) AS ts, arg_min(peak, ts) FILTER (peak >= act AND cur <= peak - trail) AS peak, arg_max(cur, ts) AS last FROM m CROSS JOIN t GROUP BY 1, 2, 3)
SELECT es.sl::DOUBLE AS stop, et.act::DOUBLE AS activation, et.trail::DOUBLE AS trail, count(*) AS trades, count(*) FILTER (es.ts IS NOT NULL AND (et.ts IS NULL OR es.ts <= et.ts)) AS stopped, count(*) FILTER (et.ts IS NOT NULL AND (es.ts IS NULL OR et.ts < es.ts)) AS trailed, round(avg(CASE WHEN es.ts IS NOT NULL AND (et.ts IS NULL OR es.ts <= et.ts) THEN -es.sl WHEN et.ts IS NOT NULL THEN et.peak - et.trail ELSE et.last END), 6) AS mean_move FROM es JOIN et ON et.ticket = es.ticket GROUP BY 1, 2, 3""",
)
def p19_parameter_grid(spark, sf):
    """Stop, activation and trail over the bars of all trades' paths: first hits per stop and per trail once, then all twelve pairs from them."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    led = V.ledger(spark, sf).select("ticket", "symbol", "side", "price", "open_time", "close_time")
    # a path's bars meet by hour
    hour = lambda c: F.floor(us(c) / 3_600_000_000).cast("long")
    path = led.withColumn("h", F.explode(F.sequence(hour("open_time"), hour("close_time"))))
    bars = V.bars_1h(spark, sf).withColumn("h", F.floor(us("ts") / 3_600_000_000).cast("long"))
    p = path.join(bars, ["symbol", "h"]).where("ts > open_time and ts <= close_time")
    buy = F.col("side") == "Buy"
    p = p.select("ticket", "ts", F.when(buy, F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low")).alias("fav"), F.when(buy, F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price")).alias("adv"), F.when(buy, F.col("close") - F.col("price")).otherwise(F.col("price") - F.col("close")).alias("cur"))
    m = p.withColumn("peak", F.max("fav").over(W.partitionBy("ticket").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)))
    aggs = [F.min(F.when(F.col("adv") >= s, F.col("ts"))).alias(f"s{i}") for i, s in enumerate(_STOPS)]
    aggs += [F.min(F.when((F.col("peak") >= a) & (F.col("cur") <= F.col("peak") - t), F.struct("ts", "peak"))).alias(f"t{j}") for j, (a, t) in enumerate(_TRAILS)]
    g = m.groupBy("ticket").agg(*aggs, F.max_by("cur", "ts").alias("last"))
    pair = lambda i, j: F.struct(F.lit(_STOPS[i]).alias("stop"), F.lit(_TRAILS[j][0]).alias("activation"), F.lit(_TRAILS[j][1]).alias("trail"), F.col(f"s{i}").alias("s"), F.col(f"t{j}.ts").alias("t"), F.col(f"t{j}.peak").alias("peak"))
    x = g.select("last", F.explode(F.array(*[pair(i, j) for i in range(3) for j in range(4)])).alias("x")).select("last", "x.*")
    stopped, trailed = F.expr("s is not null and (t is null or s <= t)"), F.expr("t is not null and (s is null or t < s)")
    move = F.when(stopped, -F.col("stop")).when(F.col("t").isNotNull(), F.col("peak") - F.col("trail")).otherwise(F.col("last"))
    return x.groupBy("stop", "activation", "trail").agg(F.count("*").alias("trades"), F.count_if(stopped).alias("stopped"), F.count_if(trailed).alias("trailed"), r6(F.avg(move)).alias("mean_move"))


@query(
    "a24_zone_sweep",
    WITH + """, m AS (SELECT o, d FROM (SELECT unnest(range(-8, 8)) AS o) CROSS JOIN (SELECT unnest([0, 1]) AS d)), s AS (SELECT m.o, m.d, l.symbol, l.price, date_trunc('hour', l.open_time) + to_hours(CAST(m.o + CASE WHEN m.d = 1 AND l.open_time >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS INTEGER)) AS ts FROM ledger l CROSS JOIN m)
SELECT CAST(o AS INTEGER) AS offset_hours, d = 1 AS summer_time, count(*) AS n, count(b.ts) AS matched, count(*) FILTER (s.price BETWEEN b.low AND b.high) AS inside, round(quantile_cont(abs(s.price - b.close), 0.5), 6) AS median_error FROM s LEFT JOIN bars_1h b ON b.symbol = s.symbol AND b.ts = s.ts GROUP BY 1, 2""",
)
def a24_zone_sweep(spark, sf):
    """Thirty-two clock hypotheses, each a shift of the entries against the bars, with and without a change of the clock."""
    led = V.ledger(spark, sf).select("symbol", "price", "open_time", F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("h"))
    modes = F.explode(F.array(*[F.struct(F.lit(o).alias("offset_hours"), F.lit(d == 1).alias("summer_time")) for o in range(-8, 8) for d in (0, 1)]))
    s = led.withColumn("m", modes).select("symbol", "price", "open_time", "h", "m.*")
    shift = F.col("offset_hours") + F.when(F.col("summer_time") & (F.col("open_time") >= F.lit("2024-01-15").cast("timestamp_ntz")), 1).otherwise(0)
    s = s.withColumn("ts", F.col("h") + F.make_dt_interval(F.lit(0), shift))
    j = s.join(V.bars_1h(spark, sf).withColumn("found", F.lit(True)), ["symbol", "ts"], "left")
    return j.groupBy("offset_hours", "summer_time").agg(F.count("*").alias("n"), F.count("found").alias("matched"), F.count_if(F.col("price").between(F.col("low"), F.col("high"))).alias("inside"), r6(F.percentile(F.abs(F.col("price") - F.col("close")), F.lit(0.5))).alias("median_error"))


@query(
    "h14_sign_flip",
    WITH + f""", c AS (SELECT symbol, CAST(open_time AS DATE) AS day, sum(pnl) AS s, count(*) AS n FROM ledger GROUP BY 1, 2), u AS (SELECT symbol, r, sum(s * CASE WHEN r = 0 OR {R.uniform_sql("r", "symbol", "day")} < 0.5 THEN 1 ELSE -1 END) / sum(n) AS m FROM c CROSS JOIN (SELECT unnest(range(200)) AS r) GROUP BY 1, 2)
SELECT u.symbol, round(any_value(o.m), 6) AS mean, round((1 + count(*) FILTER (abs(u.m) >= abs(o.m))) / (1.0 + count(*)), 6) AS p_value FROM u JOIN u o ON o.symbol = u.symbol AND o.r = 0 WHERE u.r > 0 GROUP BY 1""",
)
def h14_sign_flip(spark, sf):
    """Mean result against random signs of whole days; the days' sums are what is replicated, as an array in their row."""
    c = V.ledger(spark, sf).groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.sum("pnl").alias("s"), F.count("*").alias("n"))
    r = c.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(199))))
    sign = F.when((F.col("r") == 0) | (R.uniform("r", "symbol", "day") < 0.5), 1).otherwise(-1)
    m = r.groupBy("symbol", "r").agg((F.sum(F.col("s") * sign) / F.sum("n")).alias("m"))
    o = m.where("r = 0").select("symbol", F.col("m").alias("o"))
    return m.where("r > 0").join(o, "symbol").groupBy("symbol").agg(r6(F.max("o")).alias("mean"), r6((1 + F.count_if(F.abs("m") >= F.abs("o"))) / (1 + F.count("*"))).alias("p_value"))


@query("m11_mixture_selection")
def m11_mixture_selection(spark, sf):
    """Gaussian mixtures of one to six parts by their information criterion and the stability of their labels."""
    return M.mixture_selection(V.ledger(spark, sf))


_TEXTS = {
    "ledger.csv": "ticket,side,price\n00012,Buy,1.5\n00013,Sell,1.6\n",
    "bars.txt": "<DATE>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\n2024.01.01\t1\t2\t0.5\t1.5\n",
    "ticks.csv": "Timestamp;Bid;Ask\n2024-01-01 00:00:00;1.0;1.1\n2024-01-01 00:00:01;1.0;1.2\n2024-01-01 00:00:02;1.1;1.2\n",
    "notes.txt": "alpha|beta\n1|2\n",
}


@query(
    "s17_artifact_sniff",
    "SELECT * FROM (VALUES ('ledger.csv', ',', 'ticket,side,price', 3::BIGINT, 'LEDGER_CANDIDATE'), ('bars.txt', chr(9), 'date,open,high,low,close', 2, 'OHLC_BAR_ONLY'), ('ticks.csv', ';', 'timestamp,bid,ask', 4, 'TICK_QUOTE_CANDIDATE'), ('notes.txt', '|', 'alpha,beta', 2, 'UNKNOWN_SCHEMA')) v(name, delimiter, columns, lines, role)",
)
def s17_artifact_sniff(spark, sf):
    """Delimiter, columns and role of four files written for it: a ledger, vendor bars, quotes and something else."""
    from chronoloom.streaming.jobs import shared

    folder = shared(spark, "artifacts")
    for name, text in _TEXTS.items():
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    s = C.text_artifacts(spark, [f"{folder}/{name}/*.txt" for name in _TEXTS], part=-2)
    return s.select("name", "delimiter", F.array_join("columns", ",").alias("columns"), "lines", "role")
