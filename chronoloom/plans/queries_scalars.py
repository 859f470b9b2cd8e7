"""Projections, predicates and scalar functions (SURVEY F)."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import scalars as X
from chronoloom.operators import selection as Q
from chronoloom.plans import views as V
from chronoloom.plans.views import WITH, r6
from chronoloom.registry import query


@query(
    "f01_enrichment",
    WITH + """SELECT ticket, round((epoch_us(close_time) - epoch_us(open_time)) / 1e6, 6) AS seconds, pnl > 0 AS win, round(pnl / (lot / 0.01), 6) AS pnl_per_cent_lot, CASE side WHEN 'Buy' THEN 1 ELSE -1 END AS side_code,
strftime(open_time, '%Y-%m-%d') AS day, CAST(hour(open_time) AS INTEGER) AS hour, CAST(minute(open_time) AS INTEGER) AS minute, CAST(floor(minute(open_time) / 5) * 5 AS INTEGER) AS minute_5, CAST(isodow(open_time) - 1 AS INTEGER) AS weekday, strftime(open_time, '%Y-%m') AS month, concat(year(open_time), 'Q', quarter(open_time)) AS quarter FROM ledger""",
)
def f01_enrichment(spark, sf):
    o = F.col("open_time")
    return V.ledger(spark, sf).select(
        "ticket", r6((F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(o.cast("timestamp"))) / 1e6).alias("seconds"), (F.col("pnl") > 0).alias("win"), r6(F.col("pnl") / (F.col("lot") / 0.01)).alias("pnl_per_cent_lot"),
        F.when(F.col("side") == "Buy", 1).otherwise(-1).alias("side_code"), F.date_format(o, "yyyy-MM-dd").alias("day"), F.hour(o).alias("hour"), F.minute(o).alias("minute"), (F.floor(F.minute(o) / 5) * 5).cast("int").alias("minute_5"),
        F.weekday(o).alias("weekday"), F.date_format(o, "yyyy-MM").alias("month"), F.concat(F.year(o), F.lit("Q"), F.quarter(o)).alias("quarter"),
    )


@query(
    "f02_clock_buckets",
    WITH + """, h AS (SELECT ticket, hour(open_time) AS h, hour(open_time) * 60 + minute(open_time) AS m FROM ledger)
SELECT ticket, CASE WHEN h < 8 THEN 'night' WHEN h < 13 THEN 'europe' WHEN h < 17 THEN 'overlap' WHEN h < 22 THEN 'america' ELSE 'late' END AS bucket, CASE WHEN h <= 6 THEN 'asia' WHEN h <= 12 THEN 'london' WHEN h <= 17 THEN 'newyork' ELSE 'late' END AS session,
CASE WHEN m % 30 = 0 THEN 1 ELSE 0 END AS m30_boundary, CASE WHEN m % 60 = 0 THEN 1 ELSE 0 END AS h1_boundary, CASE WHEN m % 30 < 2 THEN 1 ELSE 0 END AS m30_post120, CAST(least(m % 30, 30 - m % 30) AS INTEGER) AS m30_distance FROM h""",
)
def f02_clock_buckets(spark, sf):
    """Clock and session buckets, boundary flags and distances."""
    h = F.hour("open_time")
    m = h * 60 + F.minute("open_time")
    return V.ledger(spark, sf).select("ticket", X.clock_bucket(h).alias("bucket"), X.session_bucket(h).alias("session"), X.boundary(m, 30).alias("m30_boundary"), X.boundary(m, 60).alias("h1_boundary"), (m % 30 < 2).cast("int").alias("m30_post120"), X.boundary_distance(m, 30).alias("m30_distance"))


@query(
    "f04_cyclic",
    WITH + ", h AS (SELECT ticket, hour(open_time) + minute(open_time) / 60.0 AS h, isodow(open_time) - 1 AS d FROM ledger) SELECT ticket, "
    + ", ".join(f"round({f}(2 * {math.pi!r} * {k} / 24 * h), 6) AS {f}_{k}" for k in range(1, 7) for f in ("sin", "cos")) + ", " + ", ".join(f"CASE WHEN d = {i} THEN 1 ELSE 0 END AS dow_{i}" for i in range(1, 7)) + " FROM h",
)
def f04_cyclic(spark, sf):
    """The 18-column clock design: six harmonics of the hour and weekday flags."""
    h = F.hour("open_time") + F.minute("open_time") / 60
    names = [f"{f}_{k}" for k in range(1, 7) for f in ("sin", "cos")]
    return V.ledger(spark, sf).select("ticket", *[r6(c).alias(n) for c, n in zip(X.cyclic(h, 24, 6), names, strict=True)], *[(F.weekday("open_time") == i).cast("int").alias(f"dow_{i}") for i in range(1, 7)])


@query(
    "f07_bar_geometry",
    WITH + """, g AS (SELECT *, high - low AS rng, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn FROM bars_1h)
SELECT symbol, ts, round(body / nullif(rng, 0), 6) AS body_ratio, round(up / nullif(rng, 0), 6) AS upper_ratio, round(dn / nullif(rng, 0), 6) AS lower_ratio, coalesce(up > 2 * body AND up > dn, false) AS pin_top, coalesce(dn > 2 * body AND dn > up, false) AS pin_bottom, round(abs(close - round_even(close / 5, 0) * 5), 6) AS round_distance FROM g""",
)
def f07_bar_geometry(spark, sf):
    """Candle ratios, pin bars, distance to round prices."""
    g = V.bars_1h(spark, sf).withColumns({"rng": F.col("high") - F.col("low"), "body": F.abs(F.col("close") - F.col("open")), "up": F.col("high") - F.greatest("open", "close"), "dn": F.least("open", "close") - F.col("low")})
    share = lambda c: r6(F.col(c) / F.expr("nullif(rng, 0)"))
    return g.select("symbol", "ts", share("body").alias("body_ratio"), share("up").alias("upper_ratio"), share("dn").alias("lower_ratio"), F.expr("up > 2 * body and up > dn").alias("pin_top"), F.expr("dn > 2 * body and dn > up").alias("pin_bottom"), r6(X.round_distance(F.col("close"), 5.0)).alias("round_distance"))


@query(
    "f10_execution",
    WITH + """SELECT l.ticket, round(CASE WHEN side = 'Buy' THEN price + pnl / (lot * 100) ELSE price - pnl / (lot * 100) END, 6) AS implied_exit, round(CASE WHEN side = 'Buy' THEN t.ask ELSE t.bid END, 6) AS entry_exec,
round(CASE WHEN side = 'Buy' THEN t.ask - price ELSE price - t.bid END, 6) AS slip, abs(t.ask - price) <= 0.02 AS within_002, abs(t.ask - price) <= 0.04 AS within_004, CASE WHEN abs(t.ask - price) <= 0.01 THEN 'exact' WHEN abs(t.ask - price) <= 0.03 THEN 'near' ELSE 'residual' END AS status FROM ledger l JOIN ticks t ON l.event_id = t.event_id""",
)
def f10_execution(spark, sf):
    """Exit price implied by the result, execution on the adverse side, tolerance ladder and status."""
    t = V.ticks(spark, sf).select("event_id", "bid", "ask")
    buy, d = F.col("side") == "Buy", F.abs(F.col("ask") - F.col("price"))
    return V.ledger(spark, sf).join(t, "event_id").select(
        "ticket", r6(X.implied_exit(F.col("side"), F.col("price"), F.col("pnl"), F.col("lot"), 100)).alias("implied_exit"), r6(F.when(buy, F.col("ask")).otherwise(F.col("bid"))).alias("entry_exec"), r6(F.when(buy, F.col("ask") - F.col("price")).otherwise(F.col("price") - F.col("bid"))).alias("slip"),
        (d <= 0.02).alias("within_002"), (d <= 0.04).alias("within_004"), F.when(d <= 0.01, "exact").when(d <= 0.03, "near").otherwise("residual").alias("status"),
    )


@query(
    "f12_path_price",
    WITH + """, s AS (SELECT *, CAST(event AS DOUBLE) AS s FROM bars_1h CROSS JOIN (SELECT unnest([0, 10, 15, 30, 45, 52, 59]) AS event)), p AS (SELECT *, CASE WHEN close >= open THEN low ELSE high END AS a, CASE WHEN close >= open THEN high ELSE low END AS b FROM s)
SELECT symbol, ts, CAST(s AS INTEGER) AS second, round(CASE WHEN s <= 15 THEN open + (a - open) * s / 15 WHEN s <= 45 THEN a + (b - a) * (s - 15) / 30 ELSE b + (close - b) * (s - 45) / 14 END, 6) AS price FROM p""",
)
def f12_path_price(spark, sf):
    b = V.bars_1h(spark, sf).withColumn("second", F.explode(F.array(*map(F.lit, (0, 10, 15, 30, 45, 52, 59)))))
    return b.select("symbol", "ts", "second", r6(X.path_price(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("second").cast("double"))).alias("price"))


_SUN = "(last_day(make_date(year(ts), {m}, 1)) - CAST(isodow(last_day(make_date(year(ts), {m}, 1))) % 7 AS INTEGER))"
_NTH = "(make_date(year(ts), {m}, 1) + CAST((7 - isodow(make_date(year(ts), {m}, 1))) % 7 + 7 * ({n} - 1) AS INTEGER))"


@query(
    "f13_time_zones",
    "WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS ts FROM orders), h AS (SELECT *, "
    f"CASE WHEN ts >= {_SUN.format(m=3)} + INTERVAL '1 hour' AND ts < {_SUN.format(m=10)} + INTERVAL '1 hour' THEN 3 ELSE 2 END AS eu_hours, CASE WHEN CAST(ts AS DATE) >= {_NTH.format(m=3, n=2)} AND CAST(ts AS DATE) < {_NTH.format(m=11, n=1)} THEN 3 ELSE 2 END AS us_hours FROM o) "
    "SELECT o_orderkey, eu_hours, us_hours, us_hours - 7 AS eastern_hours, ts + to_hours(eu_hours) AS broker_time FROM h",
)
def f13_time_zones(spark, sf):
    """Offsets under three rules for summer time, and the local time."""
    o = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))).alias("ts"))
    eu = X.offset_hours(F.col("ts"), "eu")
    return o.select("o_orderkey", eu.alias("eu_hours"), X.offset_hours(F.col("ts"), "us_dates").alias("us_hours"), X.offset_hours(F.col("ts"), "eastern").alias("eastern_hours"), (F.col("ts") + F.make_dt_interval(hours=eu)).alias("broker_time"))


@query(
    "f16_state_labels",
    WITH + """, g AS (SELECT event_id, symbol, ts, k, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id))) / 6e7 AS gap FROM ticks)
SELECT event_id, CASE WHEN gap IS NULL THEN 'first' WHEN gap <= 2 AND k > 50 THEN 'burst' WHEN gap <= 10 THEN 'active' WHEN hour(ts) BETWEEN 0 AND 5 THEN 'overnight' WHEN gap > 60 THEN 'quiet' ELSE 'normal' END AS state,
CASE WHEN gap > 0 AND gap <= 1 THEN '(0,1]' WHEN gap > 1 AND gap <= 5 THEN '(1,5]' WHEN gap > 5 AND gap <= 15 THEN '(5,15]' WHEN gap > 15 AND gap <= 60 THEN '(15,60]' WHEN gap > 60 AND gap <= 1e9 THEN '(60,)' END AS cooldown FROM g""",
)
def f16_state_labels(spark, sf):
    """Ordered state rules and right-closed cooldown bins."""
    w = W.partitionBy("symbol").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = V.ticks(spark, sf).withColumn("gap", (us - F.lag(us).over(w)) / 6e7)
    gap = F.col("gap")
    state = F.when(gap.isNull(), "first").when((gap <= 2) & (F.col("k") > 50), "burst").when(gap <= 10, "active").when(F.hour("ts").between(0, 5), "overnight").when(gap > 60, "quiet").otherwise("normal")
    return g.select("event_id", state.alias("state"), X.buckets(gap, [0, 1, 5, 15, 60, 1e9], ["(0,1]", "(1,5]", "(5,15]", "(15,60]", "(60,)"], right=True).alias("cooldown"))


@query(
    "f20_quartiles",
    WITH + """, q AS (SELECT quantile_cont(pnl, 0.25) AS a, quantile_cont(pnl, 0.5) AS b, quantile_cont(pnl, 0.75) AS c FROM ledger)
SELECT ticket, CASE WHEN pnl <= a THEN 1 WHEN pnl <= b THEN 2 WHEN pnl <= c THEN 3 ELSE 4 END AS quartile FROM ledger CROSS JOIN q""",
)
def f20_quartiles(spark, sf):
    """Quartile by interpolated cut points."""
    led = V.ledger(spark, sf)
    a, b, c = (F.lit(v).cast("double") for v in Q.quantiles(led, "pnl", [0.25, 0.5, 0.75]))
    p = F.col("pnl")
    return led.select("ticket", F.when(p <= a, 1).when(p <= b, 2).when(p <= c, 3).otherwise(4).alias("quartile"))


@query(
    "f21_text_rules",
    WITH + """SELECT ticket, CASE WHEN regexp_replace(ticket, '^0+', '') = '' THEN '0' ELSE regexp_replace(ticket, '^0+', '') END AS key, regexp_matches(ticket, '^0') AS leading_zero, concat_ws('|', CASE WHEN side = 'Buy' THEN 'buy' END, CASE WHEN pnl > 0 THEN 'win' END, CASE WHEN lot > 0.015 THEN 'large' END, CASE WHEN hour(open_time) < 8 THEN 'early' END) AS signature,
length(regexp_extract(CAST(round(price, 2) AS VARCHAR), '\\.([0-9]+)$', 1)) AS digits FROM ledger""",
)
def f21_text_rules(spark, sf):
    """Ticket keys, zero flags, signatures of set flags, decimal digits."""
    flags = F.array(F.when(F.col("side") == "Buy", "buy"), F.when(F.col("pnl") > 0, "win"), F.when(F.col("lot") > 0.015, "large"), F.when(F.hour("open_time") < 8, "early"))
    digits = F.length(F.regexp_extract(F.round("price", 2).cast("string"), r"\.([0-9]+)$", 1)).cast("long")
    return V.ledger(spark, sf).select("ticket", X.normal_ticket(F.col("ticket")).alias("key"), F.col("ticket").rlike("^0").alias("leading_zero"), F.array_join(F.filter(flags, lambda x: x.isNotNull()), "|").alias("signature"), digits.alias("digits"))


@query(
    "f23_weights_rules",
    WITH + """, s AS (SELECT symbol, date_trunc('hour', ts) AS h, count(*) AS n FROM ticks GROUP BY 1, 2)
SELECT t.event_id, round(1.0 / n, 9) AS inclusion, n AS ht_weight, spread > 0.05 AND k > 20 AS wide_rule, NOT (spread > 0.05 AND k > 20) AS not_wide, isodow(ts) >= 6 AS weekend, CASE WHEN hour(ts) BETWEEN 13 AND 20 THEN 1 ELSE 0 END AS is_ny_session, CASE WHEN hour(ts) BETWEEN 7 AND 15 THEN 1 ELSE 0 END AS is_london_session, CAST((k > 20) AS INTEGER) + CAST((k > 40) AS INTEGER) + CAST((k > 60) AS INTEGER) + CAST((k > 80) AS INTEGER) AS gate_level FROM ticks t JOIN s ON t.symbol = s.symbol AND date_trunc('hour', t.ts) = s.h""",
)
def f23_weights_rules(spark, sf):
    """Inverse-probability weights, named rules as predicates, session flags, gating levels."""
    t = V.ticks(spark, sf)
    n = F.count("*").over(W.partitionBy("symbol", F.date_trunc("hour", "ts")))
    rules = {"wide_rule": (F.col("spread") > 0.05) & (F.col("k") > 20)}
    return t.select(
        "event_id", F.round(1 / n, 9).alias("inclusion"), n.alias("ht_weight"), *[r.alias(k) for k, r in rules.items()], (~rules["wide_rule"]).alias("not_wide"), (F.weekday("ts") >= 5).alias("weekend"), F.hour("ts").between(13, 20).cast("int").alias("is_ny_session"),
        F.hour("ts").between(7, 15).cast("int").alias("is_london_session"), sum(((F.col("k") > x).cast("int") for x in (40, 60, 80)), (F.col("k") > 20).cast("int")).alias("gate_level"),
    )


@query("f28_zone_map", WITH + "SELECT ticket, " + ", ".join(f"strftime(open_time + to_hours({h}), '%Y-%m-%d %H:%M') AS {n}" for n, h in (("utc", 0), ("cet", 1), ("eet", 2), ("msk", 3), ("est", -5))) + " FROM ledger")
def f28_zone_map(spark, sf):
    zones = {"utc": 0, "cet": 1, "eet": 2, "msk": 3, "est": -5}
    m = F.create_map(*[x for n, h in zones.items() for x in (F.lit(n), F.date_format(F.col("open_time") + F.make_dt_interval(hours=F.lit(h)), "yyyy-MM-dd HH:mm"))])
    return V.ledger(spark, sf).select("ticket", m.alias("z")).select("ticket", *[F.col("z")[n].alias(n) for n in zones])


@query("f29_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def f29_json_fields(spark, sf):
    j = F.from_json("props", "k int, missing string")
    return V.table(spark, sf, "events").select("event_id", j["k"].alias("k"), j["missing"].alias("missing"))
