"""Matched controls, round-minute and three-moment nulls, block shuffles, exposure cells, archetypes and rule registries (parts of SURVEY J, H, SM, A and F).

The survey's minutes are hours here, as the tables' ticks are minutes apart: its 30-minute phase is the hour within four.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import bars as B
from chronoloom.operators import selection as Q
from chronoloom.operators import series as S
from chronoloom.operators import windows_at as T
from chronoloom.plans import views as V
from chronoloom.plans.queries_ticks import _SCALE, _units
from chronoloom.plans.queries_windows import _ema_sql
from chronoloom.plans.views import WITH, r6
from chronoloom.registry import ORACLE_SQL, query
from chronoloom.streaming.jobs import shared

_STATE = """, s0 AS (SELECT *, close / lag(close) OVER w - 1 AS ret1, close / lag(close, 5) OVER w - 1 AS ret5, high - low AS rng FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s1 AS (SELECT symbol, ts, CAST(ts AS DATE) AS day, CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 17 THEN 2 ELSE 3 END AS session, hour(ts) % 4 AS phase, ret1, ret5, rng, volume,
  CASE WHEN count(ret1) OVER f >= 20 THEN stddev_samp(ret1) OVER f END AS vol, CASE WHEN count(close) OVER f >= 20 THEN (close - min(low) OVER f) / nullif(max(high) OVER f - min(low) OVER f, 0) END AS loc FROM s0 WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
en AS (SELECT symbol, date_trunc('hour', open_time) AS ts, min(ticket) AS ticket, min(open_time) AS open_time FROM ledger GROUP BY 1, 2),
st AS (SELECT s1.*, en.ts IS NOT NULL AS entry FROM s1 LEFT JOIN en ON en.symbol = s1.symbol AND en.ts = s1.ts),
ca AS (SELECT en.ticket, en.open_time, st.* FROM en JOIN st ON st.symbol = en.symbol AND st.ts = en.ts)"""


def _states(spark, sf):
    """Bars with what is known at their end, whether an entry falls in them, and (as second table) the first entry of each such bar with its state."""
    w = S.over("symbol", order=["ts"])
    s = V.bars_1h(spark, sf).withColumns({"ret1": F.col("close") / F.lag("close").over(w) - 1, "ret5": F.col("close") / F.lag("close", 5).over(w) - 1, "rng": F.col("high") - F.col("low")})
    top, low = F.max("high").over(w.rowsBetween(-19, 0)), F.min("low").over(w.rowsBetween(-19, 0))
    h = F.hour("ts")
    s = s.withColumns({"vol": S.rolling(F.stddev_samp("ret1"), "ret1", w, 20), "loc": F.when(F.count("close").over(w.rowsBetween(-19, 0)) >= 20, (F.col("close") - low) / F.when(top != low, top - low))})
    s = s.select("symbol", "ts", F.to_date("ts").alias("day"), F.when(h <= 6, 0).when(h <= 12, 1).when(h <= 17, 2).otherwise(3).alias("session"), (h % 4).alias("phase"), "ret1", "ret5", "rng", "volume", "vol", "loc")
    at = F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("ts")
    en = V.ledger(spark, sf).groupBy("symbol", at).agg(F.min("ticket").alias("ticket"), F.min("open_time").alias("open_time"))
    st = s.join(en, ["symbol", "ts"], "left").withColumn("entry", F.col("ticket").isNotNull())
    return st.drop("ticket", "open_time"), st.where("entry")


def _beside(cases, controls, keys: list[str]):
    """Pairs of a case (c.*) and a control (x.*) that agree in ``keys``."""
    c = cases.select(*keys, F.struct(*cases.columns).alias("c"))
    return c.join(controls.where(~F.col("entry")).select(*keys, F.struct(*controls.columns).alias("x")), keys)


_Z = ("ret1", "ret5", "rng", "volume")
_Z_SQL = ", z AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _Z) + " FROM st)"
_Z_DIST = "round(sqrt((" + " + ".join(f"pow((coalesce(x.{c}, m_{c}) - coalesce(c.{c}, m_{c})) / CASE WHEN s_{c} > 1e-10 THEN s_{c} ELSE 1 END, 2)" for c in _Z) + f") / {len(_Z)}), 9)"


def _distance(pairs, states):
    """Adds the root mean square of the standardised differences; a missing value stands at the mean."""
    z = states.agg(*[x for c in _Z for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    p = pairs.crossJoin(F.broadcast(z))  # one row of eight numbers
    term = lambda c: F.pow((F.coalesce(f"x.{c}", f"m_{c}") - F.coalesce(f"c.{c}", f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-10, F.col(f"s_{c}")).otherwise(1), 2)
    return p.withColumn("d", F.round(F.sqrt(sum((term(c) for c in _Z[1:]), term(_Z[0])) / len(_Z)), 9))


_DT = "abs(epoch_us(x.ts) - epoch_us(c.ts)) / 1e6"


def _apart():
    return F.abs(A.seconds(F.col("x.ts"), F.col("c.ts")))


_NEAR = f"(x.session = c.session AND {_DT} BETWEEN 3600 AND 28800)"


@query(
    "j23_state_controls",
    WITH + _STATE + _Z_SQL + f""", p AS (SELECT c.ticket, x.ts, x.ts > c.ts AS later, {_Z_DIST} AS d, {_NEAR} AS near FROM ca c JOIN st x ON x.symbol = c.symbol AND x.day = c.day AND NOT x.entry CROSS JOIN z WHERE {_DT} BETWEEN 3600 AND 57600),
b AS (SELECT *, max(CASE WHEN near THEN 1 ELSE 0 END) OVER (PARTITION BY ticket) = 0 AS widened FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY ticket, later ORDER BY d, ts) AS r FROM b WHERE near OR widened)
SELECT c.ticket, bool_or(widened) AS widened, max(CASE WHEN NOT later THEN r.ts END) AS before_ts, round(max(CASE WHEN NOT later THEN d END), 6) AS before_distance, max(CASE WHEN later THEN r.ts END) AS after_ts, round(max(CASE WHEN later THEN d END), 6) AS after_distance FROM ca c LEFT JOIN r ON r.ticket = c.ticket AND r.r = 1 GROUP BY 1""",
)
def j23_state_controls(spark, sf):
    """The control before and the one after a trade that are most like its bar, by the root mean square of standardised differences:
    of its day and session within eight hours, or, if there is none on either side, of its day within sixteen (J23). A trade
    without any has nulls; of equals the earlier one is taken."""
    st, cases = _states(spark, sf)
    p = _distance(_beside(cases, st, ["symbol", "day"]).where(_apart().between(3600, 57600)), st)
    near = (F.col("x.session") == F.col("c.session")) & _apart().between(3600, 28800)
    later = F.col("x.ts") > F.col("c.ts")
    best = lambda c: F.min(F.when(c, F.struct("d", F.col("x.ts").alias("ts"))))
    g = p.groupBy(F.col("c.ticket").alias("ticket")).agg((F.count_if(near) == 0).alias("widened"), best(near & ~later).alias("nb"), best(near & later).alias("na"), best(~later).alias("wb"), best(later).alias("wa"))
    g = g.withColumns({"b": F.when(F.col("widened"), F.col("wb")).otherwise(F.col("nb")), "a": F.when(F.col("widened"), F.col("wa")).otherwise(F.col("na"))})
    out = g.select("ticket", "widened", F.col("b.ts").alias("before_ts"), r6("b.d").alias("before_distance"), F.col("a.ts").alias("after_ts"), r6("a.d").alias("after_distance"))
    return cases.select("ticket").join(out, "ticket", "left")


@query(
    "j24_phase_matched",
    WITH + _STATE + _Z_SQL + f""", p AS (SELECT c.ticket, x.ts, {_Z_DIST} AS d, NOT (x.session = c.session AND {_DT} BETWEEN 3600 AND 28800) AS relaxed FROM ca c JOIN st x ON x.symbol = c.symbol AND x.day = c.day AND x.phase = c.phase AND NOT x.entry CROSS JOIN z),
r AS (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY relaxed, d, ts) AS r FROM p) SELECT ticket, ts AS control_ts, relaxed, round(d, 6) AS distance FROM r WHERE r = 1""",
)
def j24_phase_matched(spark, sf):
    """The nearest control of the same clock phase: same day and session within eight hours, else the same day."""
    st, ca = _states(spark, sf)
    p = _distance(_beside(ca, st, ["symbol", "day", "phase"]), st)
    near = (F.col("x.session") == F.col("c.session")) & _apart().between(3600, 28800)
    best = p.groupBy("c.ticket").agg(F.min(F.struct((~near).alias("relaxed"), "d", "x.ts")).alias("b"))
    return best.select("ticket", F.col("b.ts").alias("control_ts"), "b.relaxed", r6("b.d").alias("distance"))


_LEVELS = {
    "A_phase": "true",
    "B_session": "x.session = c.session",
    "C_volatility": "abs(x.vol - c.vol) <= greatest(abs(c.vol) * 0.35, 1e-8)",
    "D_location": "abs(x.loc - c.loc) <= 0.20",
    "E_momentum": "abs(x.ret5 - c.ret5) <= greatest(abs(c.ret5) * 0.50, 2e-5)",
}
_SPACE = "round(abs((x.vol - c.vol) / (abs(c.vol) + 1e-8)) + abs(x.loc - c.loc) + abs((x.ret5 - c.ret5) / (abs(c.ret5) + 2e-5)), 9)"


@query(
    "j25_negative_space",
    WITH + _STATE + f""", p AS (SELECT c.ticket, x.ts, {_SPACE} AS d, {_DT} AS t, {', '.join(f"coalesce({' AND '.join(list(_LEVELS.values())[: i + 1])}, false) AS f{i}" for i in range(5))}
  FROM ca c JOIN st x ON x.symbol = c.symbol AND x.phase = c.phase AND date_trunc('week', x.ts) = date_trunc('week', c.ts) AND NOT x.entry WHERE x.vol IS NOT NULL AND x.loc IS NOT NULL AND x.ret5 IS NOT NULL AND c.vol IS NOT NULL AND c.loc IS NOT NULL AND c.ret5 IS NOT NULL),
l AS (SELECT * FROM (VALUES ('A_phase', 0), ('B_session', 1), ('C_volatility', 2), ('D_location', 3), ('E_momentum', 4), ('F_temporal', 4)) v(level, k)),
q AS (SELECT p.ticket, l.level, p.ts, d, t, NOT (CASE k WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END) AS relaxed FROM p CROSS JOIN l),
r AS (SELECT *, row_number() OVER (PARTITION BY ticket, level ORDER BY relaxed, CASE WHEN level = 'F_temporal' THEN t ELSE d END, CASE WHEN level = 'F_temporal' THEN d ELSE t END, ts) AS r FROM q)
SELECT ticket, level, ts AS control_ts, CASE WHEN relaxed THEN 'relaxed_to_A' ELSE 'none' END AS fallback, round(d, 6) AS distance, round(t / 60, 6) AS minutes FROM r WHERE r = 1""",
)
def j25_negative_space(spark, sf):
    """Controls of the trade's week by a hierarchy of conditions, each on top of the last, relaxed to the first where none is left; F turns the order round."""
    st, ca = _states(spark, sf)
    known = "vol is not null and loc is not null and ret5 is not null"
    week = F.date_trunc("week", "ts").alias("week")
    p = _beside(ca.where(known).select("*", week), st.where(known).select("*", week), ["symbol", "phase", "week"])
    conditions = list(_LEVELS.values())
    p = p.withColumns({"d": F.expr(_SPACE), "t": _apart(), **{f"f{i}": F.expr(f"coalesce({' and '.join(conditions[: i + 1])}, false)") for i in range(5)}})
    names = [*_LEVELS, "F_temporal"]
    order = lambda i: [~F.col(f"f{min(i, 4)}"), *(["t", "d"] if i == 5 else ["d", "t"]), "x.ts"]
    best = [F.min(F.struct(order(i)[0].alias("relaxed"), F.col(order(i)[1]).alias("o1"), F.col(order(i)[2]).alias("o2"), "x.ts")).alias(f"b{i}") for i in range(6)]
    g = p.groupBy("c.ticket").agg(*best)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"b{i}.ts").alias("control_ts"), F.when(F.col(f"b{i}.relaxed"), "relaxed_to_A").otherwise("none").alias("fallback"), r6(f"b{i}.{'o2' if i == 5 else 'o1'}").alias("distance"), r6(F.col(f"b{i}.{'o1' if i == 5 else 'o2'}") / 60).alias("minutes")) for i, n in enumerate(names)]))
    return g.select("ticket", rows.alias("r")).select("ticket", "r.*")


@query(
    "j26_near_misses",
    WITH + _STATE + _Z_SQL + f""", p AS (SELECT c.ticket, x.ts, {_Z_DIST} AS d, {_DT} AS t FROM ca c JOIN st x ON x.symbol = c.symbol AND x.day = c.day AND NOT x.entry AND {_DT} <= 21600 CROSS JOIN z),
r AS (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY d, ts) AS r FROM p) SELECT ticket, CAST(r AS INTEGER) AS rank, ts AS near_miss_ts, round(d, 6) AS distance, round(t / 60, 6) AS minutes FROM r WHERE r <= 3""",
)
def j26_near_misses(spark, sf):
    """The three most similar states of the same day within six hours that saw no entry."""
    st, ca = _states(spark, sf)
    p = _distance(_beside(ca, st, ["symbol", "day"]).withColumn("t", _apart()).where("t <= 21600"), st)
    w = W.partitionBy("c.ticket").orderBy("d", "x.ts")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c.ticket", "rank", F.col("x.ts").alias("near_miss_ts"), r6("d").alias("distance"), r6(F.col("t") / 60).alias("minutes"))


@query(
    "a32_exposure_cells",
    WITH + _STATE + ", c AS (SELECT isodow(ts) - 1 AS dow, hour(ts) AS hour, sum(entry::INTEGER) AS events, count(*) AS exposure FROM st GROUP BY 1, 2) SELECT CAST(i // 24 AS INTEGER) AS dow, CAST(i % 24 AS INTEGER) AS hour, CAST(coalesce(events, 0) AS BIGINT) AS events, coalesce(exposure, 0) AS exposure FROM range(168) r(i) LEFT JOIN c ON c.dow = i // 24 AND c.hour = i % 24",
)
def a32_exposure_cells(spark, sf):
    """Entries and exposed bars in each of the 168 hours of the week."""
    st, _ = _states(spark, sf)
    c = st.groupBy(F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(F.sum(F.col("entry").cast("long")).alias("events"), F.count("*").alias("exposure"))
    cells = spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    return cells.join(c, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("exposure", F.lit(0)).alias("exposure"))


@query(
    "h12_round_minutes",
    WITH + """, m AS (SELECT DISTINCT date_trunc('minute', ts) AS ts FROM ticks), b AS (SELECT unnest([5, 15, 30, 60]) AS b), e AS (SELECT b.b, date_trunc('hour', m.ts) AS h, avg((minute(m.ts) % b.b = 0)::INTEGER) AS p FROM m CROSS JOIN b GROUP BY 1, 2)
SELECT CAST(e.b AS INTEGER) AS boundary, count(*) AS n, CAST(sum((minute(l.open_time) % e.b = 0)::INTEGER) AS BIGINT) AS observed, round(sum(p), 6) AS null_mean, round(sqrt(sum(p * (1 - p))), 6) AS null_sd, round((sum((minute(l.open_time) % e.b = 0)::INTEGER) - sum(p)) / nullif(sqrt(sum(p * (1 - p))), 0), 6) AS z FROM ledger l JOIN e ON e.h = date_trunc('hour', l.open_time) GROUP BY 1""",
)
def h12_round_minutes(spark, sf):
    """Entries on round minutes against the null that an entry's minute is any quoted one of its day and hour: the count is
    Poisson-binomial, so its mean and deviation are exact without draws (H12)."""
    bounds = (5, 15, 30, 60)
    m = V.ticks(spark, sf).select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    rounds = lambda c, b: (F.minute(c) % b == 0).cast("int")
    e = m.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(*[F.avg(rounds("ts", b)).alias(f"p{b}") for b in bounds])
    j = V.ledger(spark, sf).select("open_time", F.date_trunc("hour", "open_time").alias("h")).join(e, "h")
    g = j.agg(F.count("*").alias("n"), *[x for b in bounds for x in (F.sum(rounds("open_time", b)).alias(f"o{b}"), F.sum(f"p{b}").alias(f"m{b}"), F.sqrt(F.sum(F.col(f"p{b}") * (1 - F.col(f"p{b}")))).alias(f"s{b}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("boundary"), F.col(f"o{b}").alias("observed"), F.col(f"m{b}").alias("m"), F.col(f"s{b}").alias("s")) for b in bounds]))
    return g.select("n", rows.alias("r")).select("r.boundary", "n", "r.observed", r6("r.m").alias("null_mean"), r6("r.s").alias("null_sd"), r6((F.col("r.observed") - F.col("r.m")) / F.when(F.col("r.s") != 0, F.col("r.s"))).alias("z"))


_FLAGS = ("up", "wide", "busy")
_FLAG_SQL = "CAST(coalesce(ret1 > 0, false) AS INTEGER) AS up, CAST(rng > 100 AS INTEGER) AS wide, CAST(volume >= 3 AS INTEGER) AS busy"


@query(
    "h13_three_moments",
    WITH + _STATE + f""", f AS (SELECT symbol, day, ts, entry, {_FLAG_SQL} FROM st), k AS (SELECT c.ticket, c.symbol, c.ts, max(x.ts) FILTER (x.ts < c.ts) AS b, min(x.ts) FILTER (x.ts > c.ts) AS a FROM ca c JOIN f x ON x.symbol = c.symbol AND x.day = c.day AND NOT x.entry GROUP BY 1, 2, 3),
m AS (SELECT o.up AS o_up, b.up + a.up AS s_up, o.wide AS o_wide, b.wide + a.wide AS s_wide, o.busy AS o_busy, b.busy + a.busy AS s_busy FROM k JOIN f o ON o.symbol = k.symbol AND o.ts = k.ts JOIN f b ON b.symbol = k.symbol AND b.ts = k.b JOIN f a ON a.symbol = k.symbol AND a.ts = k.a),
l AS (SELECT 'up' AS flag, o_up AS o, s_up AS s FROM m UNION ALL SELECT 'wide', o_wide, s_wide FROM m UNION ALL SELECT 'busy', o_busy, s_busy FROM m)
SELECT flag, count(*) AS n, round(avg(o), 6) AS trade_rate, round(avg(s / 2.0), 6) AS control_rate, round(avg(o - s / 2.0), 6) AS difference, round(sqrt(sum(2.25 * (o + s) / 3.0 * (1 - (o + s) / 3.0))) / count(*), 6) AS null_sd, round(avg(o - s / 2.0) / nullif(sqrt(sum(2.25 * (o + s) / 3.0 * (1 - (o + s) / 3.0))) / count(*), 0), 6) AS z FROM l GROUP BY 1""",
)
def h13_three_moments(spark, sf):
    """Flags of trades against the control before and the one after, under the null that any of the three moments is the
    trade: with s flags among the three, the picked one is set with probability s / 3, so the permutations' mean is 0 and
    their deviation exact (H13)."""
    st, ca = _states(spark, sf)
    flags = {"up": F.coalesce((F.col("ret1") > 0).cast("int"), F.lit(0)), "wide": (F.col("rng") > 100).cast("int"), "busy": (F.col("volume") >= 3).cast("int")}
    f, c = (x.withColumns(flags) for x in (st, ca))
    p = _beside(c, f, ["symbol", "day"])
    own = F.struct("x.ts", *[f"x.{k}" for k in _FLAGS])
    g = p.groupBy("c.ticket").agg(F.first("c").alias("c"), F.max(F.when(F.col("x.ts") < F.col("c.ts"), own)).alias("b"), F.min(F.when(F.col("x.ts") > F.col("c.ts"), own)).alias("a")).where("a is not null and b is not null")
    l = g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), F.col(f"c.{k}").alias("o"), (F.col(f"a.{k}") + F.col(f"b.{k}")).alias("s")) for k in _FLAGS])).alias("l")).select("l.*")
    share = (F.col("o") + F.col("s")) / 3
    sd = F.sqrt(F.sum(2.25 * share * (1 - share))) / F.count("*")
    diff = F.avg(F.col("o") - F.col("s") / 2)
    return l.groupBy("flag").agg(F.count("*").alias("n"), r6(F.avg("o")).alias("trade_rate"), r6(F.avg(F.col("s") / 2)).alias("control_rate"), r6(diff).alias("difference"), r6(sd).alias("null_sd"), r6(diff / F.when(sd != 0, sd)).alias("z"))


@query(
    "sm3_block_shuffle",
    WITH + """, o AS (SELECT symbol, CAST(pnl > 0 AS INTEGER) AS y, row_number() OVER (PARTITION BY symbol ORDER BY open_time, event_id) - 1 AS i FROM ledger), r AS (SELECT unnest(range(5)) AS rep),
b AS (SELECT symbol, i // 10 AS block, rep, count(*) AS size, md5(concat(symbol, ':', i // 10, ':', rep)) AS h FROM o CROSS JOIN r GROUP BY 1, 2, 3),
s AS (SELECT *, sum(size) OVER (PARTITION BY symbol, rep ORDER BY h, block) - size AS start FROM b), p AS (SELECT o.symbol, s.rep, s.start + o.i % 10 AS i, o.y FROM o JOIN s ON s.symbol = o.symbol AND s.block = o.i // 10),
n AS (SELECT *, lead(y) OVER (PARTITION BY symbol, rep ORDER BY i) AS next FROM p)
SELECT symbol, CAST(rep AS INTEGER) AS rep, count(*) AS n, CAST(sum(y) AS BIGINT) AS wins, CAST(sum(y * next) AS BIGINT) AS adjacent_wins FROM n GROUP BY 1, 2""",
)
def sm3_block_shuffle(spark, sf):
    """Outcomes in blocks of ten, the blocks in a hashed order per replicate: what is left of runs (SM3). Only blocks are replicated before the join."""
    o = V.ledger(spark, sf).select("symbol", (F.col("pnl") > 0).cast("int").alias("y"), (F.row_number().over(W.partitionBy("symbol").orderBy("open_time", "event_id")) - 1).alias("i")).withColumn("block", F.floor(F.col("i") / 10).cast("int"))
    b = o.groupBy("symbol", "block").agg(F.count("*").alias("size")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4))))
    h = F.md5(F.concat_ws(":", "symbol", F.col("block").cast("string"), F.col("rep").cast("string")))
    start = F.sum("size").over(W.partitionBy("symbol", "rep").orderBy(h, "block").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    p = o.join(b.withColumn("start", start).drop("size"), ["symbol", "block"]).withColumn("at", F.col("start") + F.col("i") % 10)
    n = p.withColumn("next", F.lead("y").over(W.partitionBy("symbol", "rep").orderBy("at")))
    return n.groupBy("symbol", "rep").agg(F.count("*").alias("n"), F.sum("y").alias("wins"), F.sum(F.col("y") * F.col("next")).alias("adjacent_wins"))


@query(
    "sm3_stratum_shuffle",
    WITH + """, r AS (SELECT unnest(range(5)) AS rep), a AS (SELECT CAST(open_time AS DATE) AS day, symbol, rep, side, row_number() OVER (PARTITION BY symbol, CAST(open_time AS DATE), rep ORDER BY ticket) AS i FROM ledger CROSS JOIN r),
b AS (SELECT CAST(open_time AS DATE) AS day, symbol, rep, pnl > 0 AS win, row_number() OVER (PARTITION BY symbol, CAST(open_time AS DATE), rep ORDER BY md5(concat(ticket, ':', rep)), ticket) AS i FROM ledger CROSS JOIN r)
SELECT CAST(rep AS INTEGER) AS rep, count(*) AS n, count(*) FILTER (side = 'Buy' AND win) AS buy_wins FROM a JOIN b USING (day, symbol, rep, i) GROUP BY 1""",
)
def sm3_stratum_shuffle(spark, sf):
    """Outcomes shuffled among the trades of a symbol and day (SM3): a stratum's rows are one array that each replicate sorts anew."""
    row = F.struct("ticket", "side", (F.col("pnl") > 0).alias("win"))
    g = V.ledger(spark, sf).groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.sort_array(F.collect_list(row)).alias("a")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4))))
    drawn = F.sort_array(F.transform("a", lambda x: F.struct(F.md5(F.concat_ws(":", x["ticket"], F.col("rep").cast("string"))).alias("h"), x["ticket"], x["win"])))
    hits = F.filter(F.zip_with("a", drawn, lambda x, y: (x["side"] == "Buy") & y["win"]), lambda x: x)
    return g.groupBy("rep").agg(F.sum(F.size("a")).alias("n"), F.sum(F.size(hits)).alias("buy_wins"))


#: Cents that stand for one unit of the thresholds below, which are the survey's.
_UNIT = 10_000.0
_ARCHETYPES = """CASE WHEN spread_change_5 / 100.0 >= 0.15 OR spread_5 / 100.0 >= 1.05 THEN 'F'
WHEN vol_60 > 0 AND vol_5 / (vol_60 + 1e-6) >= 1.4 AND vol_5 >= 0.10 THEN 'A'
WHEN (side = 'Buy' AND high_60 <= 0.08 AND ret_60 >= 0.50) OR (side = 'Sell' AND low_60 <= 0.08 AND ret_60 <= -0.50) THEN 'B'
WHEN accel_10 * dir >= 0.20 AND ret_10 * dir >= 0.20 THEN 'D'
WHEN ret_30 * dir >= 0.40 AND ret_5 * dir <= -0.05 AND ret_1 * dir >= 0 THEN 'C'
WHEN ret_30 * dir <= -0.35 AND ret_5 * dir >= 0.10 THEN 'E'
WHEN abs(ret_60 - ret_5) <= 0.20 AND abs(ret_5) >= 0.25 AND count_60 <= 40 THEN 'G' ELSE 'H' END"""
_NEEDS = [("vol", "volatility", 60), ("vol", "volatility", 5), *(("ret", "ret_mid", w) for w in (1, 5, 10, 30, 60)), ("accel", "acceleration", 10), ("high", "below_high", 60), ("low", "above_low", 60)]


@query(
    "f17_archetypes",
    WITH + ", t9 AS (" + ORACLE_SQL["t09_multi_window"] + "), p AS (SELECT ticket, " + ", ".join(f"max({c}) FILTER (seconds = {w * _SCALE}) / {_UNIT} AS {n}_{w}" for n, c, w in _NEEDS)
    + f", max(spread_change) FILTER (seconds = {5 * _SCALE}) AS spread_change_5, max(spread) FILTER (seconds = {5 * _SCALE}) AS spread_5, max(tick_count) FILTER (seconds = {60 * _SCALE}) AS count_60 FROM t9 GROUP BY 1) SELECT p.ticket, {_ARCHETYPES} AS archetype FROM p JOIN (SELECT *, CASE WHEN side = 'Buy' THEN 1 ELSE -1 END AS dir FROM ledger) l ON l.ticket = p.ticket",
)
def f17_archetypes(spark, sf):
    """Eight archetypes of what went before an entry, by ordered rules over the window figures."""
    led = V.ledger(spark, sf)
    b = T.window_bundle(led.select("ticket", "symbol", "open_time"), _units(spark, sf), on="symbol", key="ticket", at="open_time", windows=tuple(w * _SCALE for w in (1, 5, 10, 30, 60)))
    at = lambda c, w: F.max(F.when(F.col("seconds") == w * _SCALE, F.col(c)))
    vol = b.withColumn("volatility", r6("volatility"))
    p = vol.groupBy("ticket").agg(*[(at(c, w) / _UNIT).alias(f"{n}_{w}") for n, c, w in _NEEDS], at("spread_change", 5).alias("spread_change_5"), at("spread", 5).alias("spread_5"), at("tick_count", 60).alias("count_60"))
    p = p.join(led.select("ticket", "side", F.when(F.col("side") == "Buy", 1).otherwise(-1).alias("dir")), "ticket")
    return p.select("ticket", F.expr(_ARCHETYPES).alias("archetype"))


_ROWS = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
_PANEL = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _ema_sql(2 / 22) + f""", d AS (SELECT b.*, y.y AS ema_21, close - lag(close) OVER w AS d, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, close / lag(close) OVER w - 1 AS ret1, close / lag(close, 5) OVER w - 1 AS ret5, high - low AS rng FROM bars_1h b JOIN y USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
f AS (SELECT *, avg(greatest(d, 0)) OVER {_ROWS(14)} AS g, avg(greatest(-d, 0)) OVER {_ROWS(14)} AS l, count(d) OVER {_ROWS(14)} AS n14, avg(tr) OVER {_ROWS(14)} AS atr, avg(close) OVER {_ROWS(20)} AS m20, stddev_samp(close) OVER {_ROWS(20)} AS s20, avg(rng) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS r20, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h20, stddev_samp(ret1) OVER {_ROWS(20)} AS v20, count(close) OVER {_ROWS(21)} AS n21 FROM d),
panel AS (SELECT f.symbol, f.ts, hour(f.ts) AS hour, CASE WHEN n14 >= 14 THEN 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi, CASE WHEN n21 >= 21 THEN 100 * atr / close END AS atr_pct, CASE WHEN n21 >= 21 THEN (close - (m20 - 2 * s20)) / nullif(4 * s20, 0) END AS pct_b, close - ema_21 AS ema_dist, 10 * ret1 AS return_1, ret5 AS return_5, (greatest(open, close) * -1 + high) / nullif(rng, 0) AS upper_wick, (least(open, close) - low) / nullif(rng, 0) AS lower_wick,
  CASE WHEN n21 >= 21 THEN rng / nullif(r20, 0) END AS expansion, CASE WHEN n21 >= 21 THEN f.close - h20 END AS breakout, CASE WHEN n21 >= 21 THEN v20 END AS vol, e.ts IS NOT NULL AS entry FROM f LEFT JOIN (SELECT DISTINCT symbol, date_trunc('hour', open_time) AS ts FROM ledger) e ON e.symbol = f.symbol AND e.ts = f.ts)"""


def _panel(spark, sf):
    w = S.over("symbol", order=["ts"])
    rows = lambda n: w.rowsBetween(-(n - 1), 0)
    before = w.rowsBetween(-20, -1)
    b = S.ewm(V.bars_1h(spark, sf), "close", 2 / 22, key="symbol", order="ts", out="ema_21")
    b = b.withColumns({"d": F.col("close") - F.lag("close").over(w), "tr": B.true_range(w), "ret1": F.col("close") / F.lag("close").over(w) - 1, "ret5": F.col("close") / F.lag("close", 5).over(w) - 1, "rng": F.col("high") - F.col("low")})
    b = b.withColumns({"g": F.avg(F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0)))).over(rows(14)), "l": F.avg(F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0)))).over(rows(14)), "n14": F.count("d").over(rows(14)), "atr": F.avg("tr").over(rows(14)), "m20": F.avg("close").over(rows(20)), "s20": F.stddev_samp("close").over(rows(20)), "r20": F.avg("rng").over(before), "h20": F.max("high").over(before), "v20": F.stddev_samp("ret1").over(rows(20)), "n21": F.count("close").over(rows(21))})
    full = lambda c: F.when(F.col("n21") >= 21, F.expr(c))
    p = b.select(
        "symbol", "ts", F.hour("ts").alias("hour"), F.when(F.col("n14") >= 14, F.expr("100 - 100 / (1 + g / nullif(l, 0))")).alias("rsi"), full("100 * atr / close").alias("atr_pct"), full("(close - (m20 - 2 * s20)) / nullif(4 * s20, 0)").alias("pct_b"), F.expr("close - ema_21").alias("ema_dist"), F.expr("10 * ret1").alias("return_1"), F.col("ret5").alias("return_5"),
        F.expr("(high - greatest(open, close)) / nullif(rng, 0)").alias("upper_wick"), F.expr("(least(open, close) - low) / nullif(rng, 0)").alias("lower_wick"), full("rng / nullif(r20, 0)").alias("expansion"), full("close - h20").alias("breakout"), full("v20").alias("vol"),
    )
    e = V.ledger(spark, sf).select("symbol", F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("ts")).distinct().withColumn("entry", F.lit(True))
    return p.join(e, ["symbol", "ts"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))


#: The families' conditions; the limits for ranges and returns are in units of these tables.
FAMILIES = {
    "trend_continuation": "abs(ema_dist) > 2.0",
    "momentum_breakout": "atr_pct > 33 and abs(return_1) > 3.0",
    "mean_reversion": "rsi > 70 or rsi < 30",
    "volatility_expansion": "atr_pct > 40",
    "band_breakout": "pct_b > 1.0 or pct_b < 0.0",
    "candle_reversal": "lower_wick > 0.60 or upper_wick > 0.60",
    "impulse": "abs(return_1) > 2.0",
    "time_window": "true",
}


def _scored(p, rules: dict[str, str]):
    """Bars, entries among them, precision and recall of every rule, in one aggregate."""
    hit = {k: F.coalesce(F.expr(f"({c})"), F.lit(False)) for k, c in rules.items()}
    g = p.agg(F.count_if("entry").alias("entries"), *[x for k, c in hit.items() for x in (F.count_if(c).alias(f"n_{k}"), F.count_if(c & F.col("entry")).alias(f"t_{k}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"n_{k}").alias("signals"), F.col(f"t_{k}").alias("captured")) for k in rules]))
    return g.select("entries", rows.alias("r")).select("r.*", r6(F.expr("r.captured / nullif(r.signals, 0)")).alias("precision"), r6(F.expr("r.captured / nullif(entries, 0)")).alias("recall"))


def _scored_sql(rules: dict[str, str], panel: str = "panel") -> str:
    one = lambda k, c: f"SELECT '{k}' AS rule, count(*) FILTER ({c}) AS signals, count(*) FILTER (({c}) AND entry) AS captured, round(count(*) FILTER (({c}) AND entry) / nullif(count(*) FILTER ({c}), 0), 6) AS precision, round(count(*) FILTER (({c}) AND entry) / nullif(count(*) FILTER (entry), 0), 6) AS recall FROM {panel}"
    return " UNION ALL ".join(one(k, c) for k, c in rules.items())


_IN_HOURS = {k: f"hour between 7 and 16 and ({c})" for k, c in FAMILIES.items()}


@query("f25_families", _PANEL + " " + _scored_sql(_IN_HOURS))
def f25_families(spark, sf):
    """Eight candidate families within trading hours, scored together."""
    return _scored(_panel(spark, sf), _IN_HOURS)


#: The registry of symbolic rules; two compare with the upper quartile of the whole panel (q_vol, q_ret).
SYMBOLIC = {
    "boundary": "hour % 4 = 0",
    "boundary_positive": "hour % 4 = 0 and return_5 > 0",
    "boundary_negative": "hour % 4 = 0 and return_5 < 0",
    "boundary_rsi_high": "hour % 4 = 0 and rsi > 55",
    "boundary_rsi_low": "hour % 4 = 0 and rsi < 45",
    "boundary_expansion": "hour % 4 = 0 and expansion > 1.25",
    "local_breakout": "breakout > 0",
    "volatile_momentum": "vol > q_vol and abs(return_5) > q_ret",
}


@query("f26_symbolic_rules", _PANEL + ", q AS (SELECT quantile_cont(vol, 0.75) AS q_vol, quantile_cont(abs(return_5), 0.75) AS q_ret FROM panel), pq AS (SELECT * FROM panel CROSS JOIN q) " + _scored_sql(SYMBOLIC, "pq"))
def f26_symbolic_rules(spark, sf):
    """Eight symbolic rules, two of them against quartiles of the whole panel, which are two numbers."""
    p = _panel(spark, sf)
    path = shared(spark, "panel")  # read by the counts, the quartiles and the scores: made once
    p.write.parquet(path)
    p = spark.read.parquet(path)
    (vol,), (ret,) = Q.quantiles(p, "vol", [0.75]), Q.quantiles(p.select(F.abs("return_5").alias("ret")), "ret", [0.75])
    return _scored(p.withColumns({"q_vol": F.lit(vol).cast("double"), "q_ret": F.lit(ret).cast("double")}), SYMBOLIC)
