"""Sources and sinks by round trips, audits and composite reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import paths as X
from chronoloom.operators import reconcile as K
from chronoloom.operators import series as S
from chronoloom.operators import splits as D
from chronoloom.plans import views as V
from chronoloom.plans.views import HOURS, WITH, r6
from chronoloom.registry import query
from chronoloom.sources import coverage as C
from chronoloom.sources import locks as L
from chronoloom.sources import readers as R
from chronoloom.streaming.jobs import shared


@query("s01_ledger_round_trip", WITH + "SELECT ticket, side, date_trunc('second', open_time) AS open_time, symbol, round(price, 4) AS observed_price, round(pnl, 4) AS pnl FROM ledger")
def s01_ledger_round_trip(spark, sf):
    """Ledger written as headerless TSV and read back as text with checked casts."""
    led = V.ledger(spark, sf)
    t = lambda c: F.date_format(c, "yyyy.MM.dd HH:mm:ss")
    num = lambda c: F.format_string("%.4f", c)
    path = shared(spark, "ledger")
    led.select(F.concat_ws("\t", "ticket", "side", t("open_time"), t("close_time"), "symbol", num("lot"), num("price"), num("pnl")).alias("value")).write.text(path)
    return R.read_ledger(spark, path).select("ticket", "side", "open_time", "symbol", F.round("observed_price", 4).alias("observed_price"), F.round("pnl", 4).alias("pnl"))


@query("s02_bar_files", WITH + "SELECT ts AS timestamp, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM bars_1h WHERE symbol = 'view'")
def s02_bar_files(spark, sf):
    """Bars in a vendor's layout, compressed, read back with normalised headers."""
    b = V.bars_1h(spark, sf).where("symbol = 'view'")
    num = lambda c: F.format_string("%.4f", c)
    path = shared(spark, "bars")
    cols = {"<DATE>": F.date_format("ts", "yyyy.MM.dd"), "<TIME>": F.date_format("ts", "HH:mm:ss"), "<OPEN>": num(F.col("open")), "<HIGH>": num(F.col("high")), "<LOW>": num(F.col("low")), "<CLOSE>": num(F.col("close")), "<TICKVOL>": F.col("volume").cast("long")}
    b.select(*[c.alias(k) for k, c in cols.items()]).write.csv(path, header=True, compression="gzip")
    return R.read_bars(spark, path)


@query("s04_tick_files", WITH + "SELECT ts, round(bid, 4) AS bid, round(ask, 4) AS ask FROM (SELECT date_trunc('millisecond', ts) AS ts, bid, ask FROM ticks WHERE symbol = 'error')")
def s04_tick_files(spark, sf):
    """Daily JSON files of [ms, ask, bid] lists, read back with quote checks."""
    t = V.ticks(spark, sf).where("symbol = 'error'")
    path = shared(spark, "ticks")
    day = t.groupBy(F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"), F.round("ask", 4).alias("ask"), F.round("bid", 4).alias("bid")))).alias("q"))
    line = F.concat(F.lit("["), F.array_join(F.transform("q", lambda q: F.concat(F.lit("["), F.concat_ws(",", q["ms"].cast("string"), q["ask"].cast("string"), q["bid"].cast("string")), F.lit("]"))), ","), F.lit("]"))
    day.select(line.alias("value"), "day").write.partitionBy("day").text(path)
    return R.read_ticks(spark, f"{path}/*", repeats=True)  # ticks are finer than the files' milliseconds


@query("s15_json_sink", WITH + "SELECT symbol, count(*) AS n, CASE WHEN symbol = 'view' THEN NULL ELSE round(avg(mid), 6) END AS mean FROM ticks GROUP BY 1")
def s15_json_sink(spark, sf):
    """Metrics written as JSON lines with NaN as null."""
    g = V.ticks(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.when(F.col("symbol") == "view", F.lit(float("nan"))).otherwise(r6(F.avg("mid"))).alias("mean"))
    path = shared(spark, "metrics")
    R.write_json_safe(g, path)
    return spark.read.schema("mean double, n long, symbol string").json(path).select("symbol", "n", "mean")


@query("s25_acquisition_plan", WITH + ", g AS (SELECT s.symbol, ts FROM (SELECT DISTINCT symbol FROM ticks) s CROSS JOIN (SELECT unnest(" + HOURS + ") AS ts)) SELECT g.symbol, g.ts AS hour, 'missing' AS reason FROM g WHERE NOT EXISTS (SELECT 1 FROM bars_1h b WHERE b.symbol = g.symbol AND b.ts = g.ts)")
def s25_acquisition_plan(spark, sf):
    t = V.ticks(spark, sf)
    return C.acquisition_plan(C.inventory(t, *V.period(t)))


@query("s31_frozen_model")
def s31_frozen_model(spark, sf):
    """A rule frozen on the first three fifths of the days is scored on the others only if its lock holds (S31, M24): per
    symbol the 99th percentile of the mid and of the spread on the days that teach."""
    t = V.ticks(spark, sf)
    first, days = D.span(t, "ts")
    teaches = D.day_number("ts", first) <= D.cut(days, 0.6)
    path = shared(spark, "frozen")
    t.where(teaches).groupBy("symbol").agg(F.percentile_approx("mid", 0.99, 10_000).alias("mid_at"), F.percentile_approx("spread", 0.99, 10_000).alias("spread_at")).write.parquet(f"{path}/model")
    L.write_lock(spark.read.parquet(f"{path}/model"), f"{path}/lock")
    model = spark.read.parquet(f"{path}/model")
    lock = L.check_lock(model, f"{path}/lock")
    hit = (F.col("mid") >= F.col("mid_at")) | (F.col("spread") > F.col("spread_at"))
    j = t.where(~teaches).join(F.broadcast(model), "symbol")  # a row per symbol
    return j.groupBy("symbol").agg(F.count_if(hit).alias("predicted"), F.count("*").alias("n"), F.lit(lock["sha256"]).alias("model_sha256"))


@query("s27_canonical_lock")
def s27_canonical_lock(spark, sf):
    """Locks of the ledger, the ticks and the bars, written and checked against the tables in another partitioning."""
    rows = []
    for name, df in (("ledger", V.ledger(spark, sf)), ("ticks", V.ticks(spark, sf)), ("bars_1h", V.bars_1h(spark, sf))):
        path = shared(spark, f"lock-{name}")
        L.write_lock(df, path)
        d = L.check_lock(df.repartition(7), path)
        rows.append((name, len(d["columns"]), d["rows"], d["sha256"], "locked"))
    return spark.createDataFrame(rows, "name string, columns int, rows_ long, sha256 string, status string")


@query("s26_two_sources")
def s26_two_sources(spark, sf):
    """All ticks against a second recording of them: a clock 7 seconds late, a tick in 31 lost, one in 47 repeated."""
    t = V.ticks(spark, sf).select("event_id", "symbol", "ts", "bid", "ask")
    late = t.where(F.col("event_id") % 31 != 5).withColumn("ts", (F.col("ts") + F.expr("interval 7 seconds")))
    again = late.where(F.col("event_id") % 47 == 3)
    return K.reconciled(t.drop("event_id"), late.unionByName(again).drop("event_id"))


@query(
    "c10_risk_set_audit",
    WITH + "SELECT count(*) AS n, count(*) - count(DISTINCT ticket) AS duplicates, count(*) FILTER (close_time <= open_time) AS not_causal, count(*) FILTER (isnan(pnl) OR isinf(pnl)) AS not_finite, count(*) FILTER (lot <= 0 OR lot > 1) AS out_of_range FROM ledger",
)
def c10_risk_set_audit(spark, sf):
    """Invariants of a table of cases as one aggregate."""
    bad = F.isnan("pnl") | (F.abs("pnl") == float("inf"))
    return V.ledger(spark, sf).agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("ticket")).alias("duplicates"), F.count_if(F.col("close_time") <= F.col("open_time")).alias("not_causal"), F.count_if(bad).alias("not_finite"), F.count_if((F.col("lot") <= 0) | (F.col("lot") > 1)).alias("out_of_range"))


@query(
    "w10_atr_wilder",
    WITH.replace("WITH ", "WITH RECURSIVE ", 1) + ", t AS (SELECT symbol, ts, row_number() OVER w AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)), y AS (SELECT symbol, ts, i, tr AS y FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.ts, t.i, y.y * (1 - 1 / 14.0) + t.tr / 14.0 FROM y JOIN t ON t.symbol = y.symbol AND t.i = y.i + 1) SELECT symbol, ts, CASE WHEN i >= 14 THEN round(y, 6) END AS atr FROM y",
)
def w10_atr_wilder(spark, sf):
    from chronoloom.operators.bars import true_range

    b = V.bars_1h(spark, sf).withColumn("tr", true_range(S.over("symbol", order=["ts"])))
    return S.ewm(b, "tr", 1 / 14, key="symbol", order="ts", out="atr", least=14).select("symbol", "ts", r6("atr").alias("atr"))


@query(
    "r09_account_state",
    WITH + """, s AS (SELECT l.*, (SELECT max(o.close_time) FROM ledger o WHERE o.user_id = l.user_id AND o.close_time < l.open_time) AS last_close, row_number() OVER (PARTITION BY user_id, CAST(open_time AS DATE) ORDER BY open_time, event_id) AS day_seq FROM ledger l)
SELECT ticket, last_close, round((epoch_us(open_time) - epoch_us(last_close)) / 1e6, 6) AS idle_seconds, CAST(day_seq AS INTEGER) AS day_seq FROM s""",
)
def r09_account_state(spark, sf):
    """Account state strictly before each entry: last close, idle time, number within the day."""
    led = V.ledger(spark, sf)
    j = A.asof(led, led.select("user_id", F.col("close_time").alias("last_close")).distinct(), on="user_id", left_ts="open_time", right_ts="last_close", take=[], exact=False)
    seq = F.row_number().over(W.partitionBy("user_id", F.to_date("open_time")).orderBy("open_time", "event_id"))
    return j.select("ticket", "last_close", r6(A.seconds(F.col("open_time"), F.col("last_close"))).alias("idle_seconds"), seq.alias("day_seq"))


@query(
    "r08_direction_rules",
    WITH + """, f AS (SELECT l.ticket, l.side, l.event_id, t.mid - lag(t.mid) OVER w AS m1, t.mid - lag(t.mid, 3) OVER w AS m3, t.spread FROM ticks t LEFT JOIN ledger l ON l.event_id = t.event_id WINDOW w AS (PARTITION BY t.symbol ORDER BY t.ts, t.event_id)),
r AS (SELECT 'momentum_1' AS rule, (m1 > 0) = (side = 'Buy') AS ok FROM f WHERE ticket IS NOT NULL AND m1 <> 0 UNION ALL SELECT 'contrarian_1', (m1 < 0) = (side = 'Buy') FROM f WHERE ticket IS NOT NULL AND m1 <> 0 UNION ALL SELECT 'momentum_3', (m3 > 0) = (side = 'Buy') FROM f WHERE ticket IS NOT NULL AND m3 <> 0)
SELECT rule, count(*) AS n, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS accuracy FROM r GROUP BY 1""",
)
def r08_direction_rules(spark, sf):
    """Momentum and reversal rules for the side of entries."""
    w = W.partitionBy("symbol").orderBy("ts", "event_id")
    t = V.ticks(spark, sf).select("event_id", (F.col("mid") - F.lag("mid").over(w)).alias("m1"), (F.col("mid") - F.lag("mid", 3).over(w)).alias("m3"))
    f = t.join(V.ledger(spark, sf).select("event_id", (F.col("side") == "Buy").alias("buy")), "event_id")
    rule = lambda name, m, up: F.when(F.col(m) != 0, F.struct(F.lit(name).alias("rule"), ((F.col(m) > 0 if up else F.col(m) < 0) == F.col("buy")).alias("ok")))
    r = f.select(F.explode(F.array(rule("momentum_1", "m1", True), rule("contrarian_1", "m1", False), rule("momentum_3", "m3", True))).alias("r")).where("r is not null").select("r.*")
    return r.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), r6(F.count_if("ok") / F.count("*")).alias("accuracy"))


@query(
    "r03_adjacent_pairs",
    WITH + ", p AS (SELECT symbol, price, lag(price) OVER w AS prev, (epoch_us(open_time) - epoch_us(lag(open_time) OVER w)) / 6e7 AS gap, pnl, lot FROM ledger WINDOW w AS (PARTITION BY symbol ORDER BY open_time, event_id)) SELECT symbol, count(*) AS pairs, round(quantile_cont(abs(price - prev), 0.5), 6) AS median_step, round(corr(price - prev, pnl / lot), 6) AS corr_pnl FROM p WHERE gap <= 60 GROUP BY 1",
)
def r03_adjacent_pairs(spark, sf):
    """Price steps of entries close in time."""
    w = W.partitionBy("symbol").orderBy("open_time", "event_id")
    gap = A.seconds(F.col("open_time"), F.lag("open_time").over(w)) / 60
    p = V.ledger(spark, sf).select("symbol", "price", F.lag("price").over(w).alias("prev"), gap.alias("gap"), "pnl", "lot").where("gap <= 60")
    return p.groupBy("symbol").agg(F.count("*").alias("pairs"), r6(F.percentile(F.abs(F.col("price") - F.col("prev")), F.lit(0.5))).alias("median_step"), r6(F.corr(F.col("price") - F.col("prev"), F.col("pnl") / F.col("lot"))).alias("corr_pnl"))


@query(
    "r05_reconciliation",
    WITH + """, e AS (SELECT l.*, t.bid AS ebid, t.ask AS eask FROM ledger l JOIN ticks t ON l.event_id = t.event_id), x AS (SELECT e.*, t.bid AS xbid, t.ask AS xask FROM e ASOF JOIN (SELECT symbol AS s, ts, bid, ask FROM ticks WHERE symbol = 'purchase') t ON t.s = 'purchase' AND e.close_time >= t.ts)
SELECT side, count(*) AS n, round(quantile_cont(abs(pnl - CASE WHEN side = 'Buy' THEN xbid - eask ELSE ebid - xask END * lot * 100), 0.5), 6) AS median_residual, round(sum(CASE WHEN side = 'Buy' THEN xbid - eask ELSE ebid - xask END * lot * 100), 4) AS executed_pnl FROM x GROUP BY 1""",
)
def r05_reconciliation(spark, sf):
    """Results recomputed at executable prices and the residual by side."""
    t = V.ticks(spark, sf)
    e = V.ledger(spark, sf).drop("symbol").join(t.select("event_id", F.col("bid").alias("ebid"), F.col("ask").alias("eask")), "event_id")
    q = t.where("symbol = 'purchase'").select("user_id", "ts", F.col("bid").alias("xbid"), F.col("ask").alias("xask"))
    # a close is the account's next purchase tick, so the quote standing then is found per account
    x = A.asof(e, q, on="user_id", left_ts="close_time", right_ts="ts", take=["xbid", "xask"])
    pnl = F.when(F.col("side") == "Buy", F.col("xbid") - F.col("eask")).otherwise(F.col("ebid") - F.col("xask")) * F.col("lot") * 100
    return x.groupBy("side").agg(F.count("*").alias("n"), r6(F.percentile(F.abs(F.col("pnl") - pnl), F.lit(0.5))).alias("median_residual"), F.round(F.sum(pnl), 4).alias("executed_pnl"))


@query(
    "r01_test_register",
    WITH + ", d AS (SELECT 'direction' AS family, symbol AS test, count(*) FILTER (side = 'Buy') AS k, count(*) AS n FROM ledger GROUP BY 2 UNION ALL SELECT 'outcome', symbol, count(*) FILTER (pnl > 0), count(*) FROM ledger GROUP BY 2) SELECT family, test, n, round(k / n::DOUBLE - 0.5, 6) AS effect, round((2.0 * k - n) / sqrt(n), 6) AS z, abs((2.0 * k - n) / sqrt(n)) > 1.959963984540054 AS rejected FROM d",
)
def r01_test_register(spark, sf):
    """A register of balance tests of several families."""
    led = V.ledger(spark, sf)
    fam = F.explode(F.array(F.struct(F.lit("direction").alias("family"), (F.col("side") == "Buy").alias("hit")), F.struct(F.lit("outcome").alias("family"), (F.col("pnl") > 0).alias("hit"))))
    g = led.select("symbol", fam.alias("f")).groupBy("f.family", F.col("symbol").alias("test")).agg(F.count("*").alias("n"), F.count_if("f.hit").alias("k"))
    z = (2 * F.col("k") - F.col("n")) / F.sqrt("n")
    return g.select("family", "test", "n", r6(F.col("k") / F.col("n") - 0.5).alias("effect"), r6(z).alias("z"), (F.abs(z) > 1.959963984540054).alias("rejected"))


@query("stars_market_share", "SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def stars_market_share(spark, sf):
    """Wide star aggregate over the relational tables: orders and revenue by nation and year."""
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(V.table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    # revenue per order first: the order key is the large side's only shuffle
    rev = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = rev.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name", "year").agg(F.count("*").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))


@query("j04_containing_bar", WITH + "SELECT l.ticket, b.ts AS bar_ts, coalesce(l.price BETWEEN b.low AND b.high, false) AS inside FROM ledger l LEFT JOIN bars_1h b ON l.symbol = b.symbol AND b.ts = date_trunc('hour', l.open_time)")
def j04_containing_bar(spark, sf):
    """The bar that holds the entry, an equi join on its label."""
    b = V.bars_1h(spark, sf).select("symbol", F.col("ts").alias("bar_ts"), "low", "high")
    led = V.ledger(spark, sf).withColumn("bar_ts", F.date_trunc("hour", "open_time").cast("timestamp_ntz"))
    j = led.join(b.withColumn("found", F.col("bar_ts")), ["symbol", "bar_ts"], "left")
    return j.select("ticket", F.col("found").alias("bar_ts"), F.coalesce(F.col("price").between(F.col("low"), F.col("high")), F.lit(False)).alias("inside"))


@query(
    "j08_nearest_errors",
    WITH + """, p AS (SELECT DISTINCT symbol, p_ts AS ts FROM predictions), b AS (SELECT l.ticket, (epoch_us(l.open_time) - epoch_us(p.ts)) / 1e6 AS d FROM ledger l ASOF LEFT JOIN p ON l.symbol = p.symbol AND l.open_time >= p.ts), f AS (SELECT l.ticket, (epoch_us(p.ts) - epoch_us(l.open_time)) / 1e6 AS d FROM ledger l ASOF LEFT JOIN p ON l.symbol = p.symbol AND l.open_time <= p.ts)
SELECT ticket, round(least(b.d, f.d), 6) AS error_seconds FROM b JOIN f USING (ticket)""",
)
def j08_nearest_errors(spark, sf):
    """Seconds to the nearest prediction."""
    p = V.predictions(spark, sf).select("symbol", "p_ts").distinct()
    j = A.nearest(V.ledger(spark, sf).select("ticket", "symbol", "open_time"), p, on="symbol", left_ts="open_time", right_ts="p_ts", take=[])
    return j.select("ticket", r6(F.abs(A.seconds(F.col("open_time"), F.col("p_ts")))).alias("error_seconds"))


@query(
    "a21_excursions_by_side",
    WITH + """, s AS (SELECT l.ticket, any_value(side) AS side, any_value(pnl) AS pnl, max(CASE WHEN side = 'Buy' THEN t.bid - price ELSE price - t.ask END) AS mfe, min(CASE WHEN side = 'Buy' THEN t.bid - price ELSE price - t.ask END) AS mae FROM ledger l JOIN ticks t ON l.symbol = t.symbol AND t.ts >= l.open_time AND t.ts < l.close_time GROUP BY 1)
SELECT side, count(*) AS n, round(avg(mfe), 6) AS mean_mfe, round(avg(mae), 6) AS mean_mae, round(quantile_cont(mae, 0.05) FILTER (pnl < 0), 6) AS loss_mae_p05, round(quantile_cont(mfe, 0.95) FILTER (pnl > 0), 6) AS win_mfe_p95 FROM s GROUP BY 1""",
)
def a21_excursions_by_side(spark, sf):
    """Excursions over the ticks in [open, close) by side, with tails of the losing and the winning trades."""
    led = V.ledger(spark, sf).select("ticket", "symbol", "side", "price", "pnl", "open_time", "close_time")
    x = X.interval_extremes(V.ticks(spark, sf).select("symbol", "ts", "bid", "ask"), led, on="symbol", key="ticket", start="open_time", end="close_time", high="bid", low="ask", closed_end=False)
    buy = F.col("side") == "Buy"
    best = F.when(buy, F.col("hi") - F.col("price")).otherwise(F.col("price") - F.col("lo"))
    worst = F.when(buy, F.col("hi_low") - F.col("price")).otherwise(F.col("price") - F.col("lo_high"))
    s = led.join(x, "ticket").select("side", "pnl", best.alias("mfe"), worst.alias("mae"))
    q = lambda x, p, c: r6(F.percentile(F.when(c, F.col(x)), F.lit(p)))
    return s.groupBy("side").agg(F.count("*").alias("n"), r6(F.avg("mfe")).alias("mean_mfe"), r6(F.avg("mae")).alias("mean_mae"), q("mae", 0.05, F.col("pnl") < 0).alias("loss_mae_p05"), q("mfe", 0.95, F.col("pnl") > 0).alias("win_mfe_p95"))


@query(
    "a22_split_stability",
    WITH + ", r AS (SELECT pnl, side, (row_number() OVER (PARTITION BY symbol ORDER BY open_time, event_id) - 1) / count(*) OVER (PARTITION BY symbol)::DOUBLE AS f FROM ledger), s AS (SELECT *, CASE WHEN f < 0.6 THEN 'train' WHEN f < 0.8 THEN 'validation' ELSE 'test' END AS part FROM r) SELECT part, count(*) AS n, round(avg(pnl), 6) AS mean, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE, 6) AS win_rate FROM s GROUP BY 1",
)
def a22_split_stability(spark, sf):
    """The same figures on the first 60, next 20 and last 20 % of each symbol's rows."""
    w = W.partitionBy("symbol")
    f = (F.row_number().over(w.orderBy("open_time", "event_id")) - 1) / F.count("*").over(w)
    s = V.ledger(spark, sf).withColumn("f", f).withColumn("part", F.when(F.col("f") < 0.6, "train").when(F.col("f") < 0.8, "validation").otherwise("test"))
    return s.groupBy("part").agg(F.count("*").alias("n"), r6(F.avg("pnl")).alias("mean"), r6(F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"))


@query(
    "a31_capture_grid",
    WITH + ", c AS (SELECT t.*, l.event_id IS NOT NULL AS y FROM ticks t LEFT JOIN ledger l ON t.event_id = l.event_id), g AS (SELECT a.a, b.b FROM (SELECT unnest([110, 130, 150]) AS a) a CROSS JOIN (SELECT unnest([20, 50, 80]) AS b) b) SELECT CAST(a AS INTEGER) AS mid_min, CAST(b AS INTEGER) AS k_min, count(*) FILTER (mid >= a AND k >= b) AS n, count(*) FILTER (mid >= a AND k >= b AND y) AS captured, round(count(*) FILTER (mid >= a AND k >= b AND y) / nullif(count(*) FILTER (y), 0)::DOUBLE, 6) AS capture FROM c CROSS JOIN g GROUP BY 1, 2",
)
def a31_capture_grid(spark, sf):
    """Capture of entries over a grid of conditions, counted from one pre-aggregated table."""
    led = V.ledger(spark, sf).select("event_id", F.lit(1).alias("y"))
    ge = lambda c, xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda x: F.col(c) >= x))
    g = V.ticks(spark, sf).join(led, "event_id", "left").groupBy(ge("mid", (110, 130, 150)).alias("i"), ge("k", (20, 50, 80)).alias("j")).agg(F.count("*").alias("n"), F.count("y").alias("y"))  # 16 rows
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i + 1).alias("i0"), F.lit(j + 1).alias("j0")) for i, a in enumerate((110, 130, 150)) for j, b in enumerate((20, 50, 80))])
    x = g.select("*", F.explode(grid).alias("q"))
    hit = (F.col("i") >= F.col("q.i0")) & (F.col("j") >= F.col("q.j0"))
    s = lambda c: F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0))
    return x.groupBy(F.col("q.a").alias("mid_min"), F.col("q.b").alias("k_min")).agg(s("n").alias("n"), s("y").alias("captured"), r6(s("y") / F.when(F.sum("y") != 0, F.sum("y"))).alias("capture"))


@query(
    "a34_pooled_summary",
    WITH + ", f AS (SELECT day(open_time) // 6 AS fold, count(*) FILTER (side = 'Buy' AND pnl > 0) AS tp, count(*) FILTER (side = 'Buy') AS s FROM ledger GROUP BY 1) SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(s) AS BIGINT) AS signals, round(avg(tp / nullif(s, 0)::DOUBLE), 6) AS mean_precision, round(sum(tp) / nullif(sum(s), 0)::DOUBLE, 6) AS pooled_precision FROM f",
)
def a34_pooled_summary(spark, sf):
    """Summed counts, mean of fold metrics and pooled precision; no signals give null."""
    f = V.ledger(spark, sf).groupBy(F.expr("day(open_time) div 6").alias("fold")).agg(F.count_if((F.col("side") == "Buy") & (F.col("pnl") > 0)).alias("tp"), F.count_if(F.col("side") == "Buy").alias("s"))
    return f.agg(F.sum("tp").alias("tp"), F.sum("s").alias("signals"), r6(F.avg(F.expr("tp / nullif(s, 0)"))).alias("mean_precision"), r6(F.expr("sum(tp) / nullif(sum(s), 0)")).alias("pooled_precision"))


@query(
    "a35_after_outcome",
    WITH + ", s AS (SELECT pnl > 0 AS win, lag(pnl > 0) OVER w AS prev, lot, lag(lot) OVER w AS plot FROM ledger WINDOW w AS (PARTITION BY user_id ORDER BY open_time, event_id)) SELECT prev, count(*) AS n, round(avg(CAST(win AS INTEGER)), 6) AS win_rate, round(avg(CASE WHEN lot > plot THEN 1 ELSE 0 END), 6) AS larger FROM s WHERE prev IS NOT NULL GROUP BY 1",
)
def a35_after_outcome(spark, sf):
    """Win rate and size step after a win and after a loss."""
    w = W.partitionBy("user_id").orderBy("open_time", "event_id")
    win = F.col("pnl") > 0
    s = V.ledger(spark, sf).select(win.alias("win"), F.lag(win).over(w).alias("prev"), "lot", F.lag("lot").over(w).alias("plot")).where("prev is not null")
    return s.groupBy("prev").agg(F.count("*").alias("n"), r6(F.avg(F.col("win").cast("int"))).alias("win_rate"), r6(F.avg(F.when(F.col("lot") > F.col("plot"), 1).otherwise(0))).alias("larger"))


@query("s10_projection", WITH + "SELECT symbol, count(*) AS n, round(avg(spread), 6) AS spread FROM ticks WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def s10_projection(spark, sf):
    """Interval scan with pushed range and pruned columns: both reach the Parquet reader."""
    return V.ticks(spark, sf).where("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'").groupBy("symbol").agg(F.count("*").alias("n"), r6(F.avg("spread")).alias("spread"))


@query("s12_key_lookup", WITH + "SELECT l.event_id, round(t.mid, 6) AS mid FROM ledger l JOIN ticks t ON t.event_id = l.event_id")
def s12_key_lookup(spark, sf):
    """Features written once and looked up by key through a join."""
    path = shared(spark, "features")
    V.ticks(spark, sf).select("event_id", r6("mid").alias("mid")).write.parquet(path, compression="snappy")
    keys = V.ledger(spark, sf).select("event_id")
    return keys.join(spark.read.parquet(path), "event_id").select("event_id", "mid")


@query("st9_missing_is_unknown", WITH + ", g AS (SELECT s.symbol, ts FROM (SELECT DISTINCT symbol FROM ticks) s CROSS JOIN (SELECT unnest(" + HOURS + ") AS ts)) SELECT g.symbol, g.ts, b.close IS NULL AS unknown, round(b.close, 6) AS close FROM g LEFT JOIN bars_1h b ON b.ts = g.ts AND b.symbol = g.symbol")
def st9_missing_is_unknown(spark, sf):
    """Hours without data stay explicit and are never filled (ST9)."""
    t = V.ticks(spark, sf)
    grid = C.inventory(t, *V.period(t)).select("symbol", F.col("hour").alias("ts"))
    j = grid.join(V.bars_1h(spark, sf).select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    return j.select("symbol", "ts", F.col("close").isNull().alias("unknown"), r6("close").alias("close"))


@query("p35_verdicts")
def p35_verdicts(spark, sf):
    """Verdicts per symbol: F1 of the one-to-one matching, the mean F1 of four circular shifts of the predictions, the bits
    that hours with a prediction tell of entries, and coverage (P34, P35)."""
    from chronoloom.operators import matching as M

    obs = V.ledger(spark, sf).select("symbol", "side", F.col("ticket").alias("o_id"), F.col("open_time").alias("o_ts"))
    pred = V.predictions(spark, sf).select("symbol", F.col("p_side").alias("side"), F.col("p_id").cast("string").alias("p_id"), "p_ts")
    ticks = V.ticks(spark, sf)
    first, last = V.period(ticks)
    start, span = F.unix_micros(F.lit(first).cast("timestamp")), D.span(ticks, "ts")[1] * 86400 * 1_000_000
    shifts = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("shift")
    us = F.unix_micros(F.col("p_ts").cast("timestamp"))
    moved = pred.select("*", shifts).withColumn("p_ts", F.timestamp_micros(start + F.pmod(us - start + F.col("shift") * F.lit(span // 5), F.lit(span))).cast("timestamp_ntz"))
    m = M.match_one_to_one(obs.select("*", shifts), moved, on=["symbol", "side", "shift"], tolerance=1800)
    n = m.groupBy("symbol", "shift").agg(F.count_if(F.col("status") == "tp").alias("tp"), F.count_if(F.col("status") != "tp").alias("miss"))
    f1 = F.col("tp") * 2 / (F.col("tp") * 2 + F.col("miss"))
    n = n.groupBy("symbol").agg(F.max(F.when(F.col("shift") == 0, f1)).alias("f1"), F.avg(F.when(F.col("shift") > 0, f1)).alias("placebo"))
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz").alias("hour")
    c = C.inventory(ticks, first, last)
    h = c.join(obs.select("symbol", hour("o_ts")).distinct().withColumn("y", F.lit(1)), ["symbol", "hour"], "left").join(pred.select("symbol", hour("p_ts")).distinct().withColumn("x", F.lit(1)), ["symbol", "hour"], "left")
    y, x = F.coalesce("y", F.lit(0)), F.coalesce("x", F.lit(0))
    k = h.groupBy("symbol").agg(F.avg((F.col("status") == "observed").cast("int")).alias("coverage"), F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(x).alias("n1"), F.sum(x * y).alias("y1"))
    ll = lambda y, n: f"(({y}) * ln((({y}) + 0.5d) / (({n}) + 1)) + (({n}) - ({y})) * ln(1 - (({y}) + 0.5d) / (({n}) + 1)))"
    k = k.withColumn("bits", F.expr(f"({ll('y1', 'n1')} + {ll('y - y1', 'n - n1')} - {ll('y', 'n')}) / ln(2d)"))
    verdict = F.when((F.col("coverage") < 0.5) | F.col("f1").isNull(), "unknown").when(F.col("f1") >= 0.99, "identified").when(F.col("f1") <= F.col("placebo"), "no_better_than_placebo").when(F.col("bits") > 0, "supported").otherwise("not_supported")
    return k.join(n, "symbol", "left").select("symbol", r6("f1").alias("f1"), r6("placebo").alias("placebo"), F.round("bits", 4).alias("bits"), r6("coverage").alias("coverage"), verdict.alias("verdict"))


@query(
    "r07_reference_position",
    WITH + "SELECT l.ticket, round((l.price - b.low) / nullif(b.high - b.low, 0), 6) AS position, CASE WHEN abs(l.price - b.open) <= abs(l.price - b.close) THEN 'open' ELSE 'close' END AS nearer FROM ledger l JOIN bars_1h b ON b.symbol = l.symbol AND b.ts = date_trunc('hour', l.open_time)",
)
def r07_reference_position(spark, sf):
    """Where in its bar an entry's price lies."""
    b = V.bars_1h(spark, sf).select("symbol", F.col("ts").alias("bar_ts"), "open", "high", "low", "close")
    j = V.ledger(spark, sf).withColumn("bar_ts", F.date_trunc("hour", "open_time").cast("timestamp_ntz")).join(b, ["symbol", "bar_ts"])
    near = F.when(F.abs(F.col("price") - F.col("open")) <= F.abs(F.col("price") - F.col("close")), "open").otherwise("close")
    return j.select("ticket", r6((F.col("price") - F.col("low")) / F.expr("nullif(high - low, 0)")).alias("position"), near.alias("nearer"))
