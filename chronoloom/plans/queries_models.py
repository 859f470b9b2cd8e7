"""Trajectory and conditional rule searches, weighted event models, exit hazards, model ladder, padded ranges and the precondition audit (parts of SURVEY P, M, S and R)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import models as M
from chronoloom.operators import paths as X
from chronoloom.operators import splits as S
from chronoloom.plans import views as V
from chronoloom.plans.queries_controls import _PANEL, _panel
from chronoloom.plans.views import DAYS, FIRST, WITH, r6
from chronoloom.registry import query

_FEATURES = ("rsi", "return_1", "expansion")
#: Days before it teach, later ones test.
_CUT = f"({FIRST} + to_days(CAST(ceil({DAYS} * 0.6) AS INTEGER)))"


def _cut(spark, sf):
    """Where the first three fifths of the days end, as a column."""
    first, days = S.span(V.ticks(spark, sf), "ts")
    return F.lit(str(first + timedelta(days=S.cut(days, 0.6)))).cast("timestamp_ntz")


_PREDICATES = _PANEL + f""", tr AS (SELECT * FROM panel WHERE ts < {_CUT}), th AS ({' UNION ALL '.join(f"SELECT {i} AS f, {j} AS q, quantile_cont({c}, {v}) AS t FROM tr" for i, c in enumerate(_FEATURES) for j, v in enumerate((0.25, 0.75)))}),
pr AS (SELECT p.symbol, p.ts, p.entry::INTEGER AS y, p.ts < {_CUT} AS train, th.f * 4 + th.q * 2 + d.d AS id, th.f, coalesce(CASE WHEN d.d = 0 THEN x > t ELSE x <= t END, false) AS hit, coalesce(CASE WHEN d.d = 0 THEN x <= t ELSE x > t END, false) AS reset
  FROM panel p CROSS JOIN th CROSS JOIN (SELECT unnest([0, 1]) AS d) d CROSS JOIN LATERAL (SELECT CASE th.f WHEN 0 THEN p.rsi WHEN 1 THEN p.return_1 ELSE p.expansion END AS x)),
ev AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER w, true) AS cross_, hit AND coalesce(lag(hit) OVER w, false) AND coalesce(lag(hit, 2) OVER w, false) AS persist, hit AND coalesce(max(CASE WHEN reset THEN ts END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > coalesce(max(CASE WHEN hit THEN ts END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '1970-01-01'), false) AS armed FROM pr WINDOW w AS (PARTITION BY symbol, id ORDER BY ts)),
ru AS (SELECT 'single' AS kind, id, NULL::INTEGER AS id2, symbol, ts, y, train, hit FROM ev UNION ALL SELECT 'crossing', id, NULL, symbol, ts, y, train, cross_ FROM ev UNION ALL SELECT 'persistence', id, NULL, symbol, ts, y, train, persist FROM ev UNION ALL SELECT 'armed', id, NULL, symbol, ts, y, train, armed FROM ev
  UNION ALL SELECT 'and', a.id, b.id, a.symbol, a.ts, a.y, a.train, a.hit AND b.hit FROM ev a JOIN ev b ON b.symbol = a.symbol AND b.ts = a.ts AND b.f > a.f)"""


def _rules(spark, sf):
    """A row per bar with its outcome and the flags of all rules: (kind, id, id2, hit) as an array; every rule in one pass over the bars."""
    p = _panel(spark, sf).withColumn("train", F.col("ts") < _cut(spark, sf))
    t = p.where("train").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"t_{c}") for c in _FEATURES])
    p = p.crossJoin(F.broadcast(t))  # six numbers
    w = W.partitionBy("symbol").orderBy("ts")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    ids, flags = [], {}
    for i, c in enumerate(_FEATURES):
        for q in (0, 1):
            for d in (0, 1):
                k = i * 4 + q * 2 + d
                up, down = F.col(c) > F.col(f"t_{c}")[q], F.col(c) <= F.col(f"t_{c}")[q]
                flags |= {f"h{k}": F.coalesce(up if d == 0 else down, F.lit(False)), f"r{k}": F.coalesce(down if d == 0 else up, F.lit(False))}
                ids.append((k, i))
    p = p.withColumns(flags)
    made = []
    for k, _ in ids:
        h = F.col(f"h{k}")
        last = lambda c: F.max(F.when(F.col(c), F.col("ts"))).over(before)
        armed = h & F.coalesce(last(f"r{k}") > F.coalesce(last(f"h{k}"), F.lit("1970-01-01").cast("timestamp_ntz")), F.lit(False))
        crossing = h & ~F.coalesce(F.lag(h).over(w), F.lit(True))
        persists = h & F.coalesce(F.lag(h).over(w), F.lit(False)) & F.coalesce(F.lag(h, 2).over(w), F.lit(False))
        made += [("single", k, None, h), ("crossing", k, None, crossing), ("persistence", k, None, persists), ("armed", k, None, armed)]
    made += [("and", a, b, F.col(f"h{a}") & F.col(f"h{b}")) for a, fa in ids for b, fb in ids if fb > fa]
    one = lambda kind, a, b, hit: F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("id"), F.lit(b).cast("int").alias("id2"), hit.alias("hit"))
    return p.select("symbol", "ts", F.col("entry").cast("int").alias("y"), "train", F.array(*[one(*m) for m in made]).alias("rules"))


@query(
    "p28_trajectory_search",
    _PREDICATES + """, g AS (SELECT kind, id, id2, count(*) FILTER (train AND hit) AS n1, sum(y) FILTER (train AND hit) AS y1, count(*) FILTER (train) AS n, sum(y) FILTER (train) AS y0, count(*) FILTER (NOT train AND hit) AS tn1, coalesce(sum(y) FILTER (NOT train AND hit), 0) AS ty1, count(*) FILTER (NOT train) AS tn, sum(y) FILTER (NOT train) AS ty FROM ru GROUP BY 1, 2, 3),
r AS (SELECT *, (coalesce(y1, 0) + 0.5) / (n1 + 1) AS p1, (y0 - coalesce(y1, 0) + 0.5) / (n - n1 + 1) AS p0, (y0 + 0.5) / (n + 1) AS p FROM g)
SELECT kind, CAST(id AS INTEGER) AS id, id2, n1 AS train_hits, CAST(coalesce(y1, 0) AS BIGINT) AS train_captured, tn1 AS test_hits, CAST(ty1 AS BIGINT) AS test_captured, round((ty1 * ln(p1) + (tn1 - ty1) * ln(1 - p1) + (ty - ty1) * ln(p0) + (tn - tn1 - ty + ty1) * ln(1 - p0) - ty * ln(p) - (tn - ty) * ln(1 - p)) / ln(2), 4) AS test_gain_bits FROM r""",
)
def p28_trajectory_search(spark, sf):
    """Conjunctions, crossings, persistence and armed triggers over the panel, rates fitted before the cut and scored after it."""
    x = _rules(spark, sf).select("y", "train", F.explode("rules").alias("r")).select("y", "train", "r.*")
    n = lambda c: F.count_if(F.expr(c))
    g = x.groupBy("kind", "id", "id2").agg(n("train and hit").alias("n1"), n("train and hit and y = 1").alias("y1"), n("train").alias("n"), n("train and y = 1").alias("y0"), n("not train and hit").alias("tn1"), n("not train and hit and y = 1").alias("ty1"), n("not train").alias("tn"), n("not train and y = 1").alias("ty"))
    g = g.withColumns({"p1": F.expr("(y1 + 0.5d) / (n1 + 1)"), "p0": F.expr("(y0 - y1 + 0.5d) / (n - n1 + 1)"), "p": F.expr("(y0 + 0.5d) / (n + 1)")})
    gain = F.expr("(ty1 * ln(p1) + (tn1 - ty1) * ln(1 - p1) + (ty - ty1) * ln(p0) + (tn - tn1 - ty + ty1) * ln(1 - p0) - ty * ln(p) - (tn - ty) * ln(1 - p)) / ln(2d)")
    return g.select("kind", "id", "id2", F.col("n1").alias("train_hits"), F.col("y1").alias("train_captured"), F.col("tn1").alias("test_hits"), F.col("ty1").alias("test_captured"), F.round(gain, 4).alias("test_gain_bits"))


_NEWTON = """, b{k} AS (SELECT kind, id, id2, b + CASE WHEN v > 0 THEN greatest(-2.0, least(2.0, (u - 0.01 * b) / (v + 0.01))) ELSE 0 END AS b FROM (SELECT s.kind, s.id, s.id2, any_value(o.b) AS b, sum(c1 - c * n1 * exp(o.b) / (n1 * exp(o.b) + n0)) AS u, sum(c * n1 * exp(o.b) / (n1 * exp(o.b) + n0) * n0 / (n1 * exp(o.b) + n0)) AS v FROM s JOIN b{j} o ON o.kind = s.kind AND o.id = s.id AND o.id2 IS NOT DISTINCT FROM s.id2 GROUP BY 1, 2, 3))"""


@query(
    "p29_conditional_search",
    _PREDICATES + """, s AS (SELECT kind, id, id2, symbol, CAST(ts AS DATE) AS day, count(*) FILTER (hit)::DOUBLE AS n1, count(*) FILTER (NOT hit)::DOUBLE AS n0, sum(y)::DOUBLE AS c, coalesce(sum(y) FILTER (hit), 0)::DOUBLE AS c1 FROM ru WHERE train GROUP BY 1, 2, 3, 4, 5), b0 AS (SELECT DISTINCT kind, id, id2, 0.0::DOUBLE AS b FROM s)"""
    + "".join(_NEWTON.replace("{k}", str(k)).replace("{j}", str(k - 1)) for k in (1, 2, 3, 4))
    + """ SELECT s.kind, CAST(s.id AS INTEGER) AS id, s.id2, count(*) AS strata, CAST(sum(c) AS BIGINT) AS cases, round(any_value(o.b), 4) AS beta, round(sum(c1 * o.b - c * ln((n1 * exp(o.b) + n0) / (n1 + n0))), 4) AS gain FROM s JOIN b4 o ON o.kind = s.kind AND o.id = s.id AND o.id2 IS NOT DISTINCT FROM s.id2 GROUP BY 1, 2, 3""",
)
def p29_conditional_search(spark, sf):
    """Every rule as one indicator in a conditional logit within the strata of a symbol's day: four Newton steps over counts
    per stratum, for all rules at once, and the likelihood gained over the uniform choice (P29)."""
    x = _rules(spark, sf).where("train").select("symbol", F.to_date("ts").alias("day"), "y", F.explode("rules").alias("r")).select("symbol", "day", "y", "r.*")
    d = lambda c: F.count_if(F.expr(c)).cast("double")
    s = x.groupBy("kind", "id", "id2", "symbol", "day").agg(d("hit").alias("n1"), d("not hit").alias("n0"), d("y = 1").alias("c"), d("hit and y = 1").alias("c1"))
    # a rule's strata, a few numbers for each day, are one array that the steps walk over
    rule = s.groupBy("kind", "id", "id2").agg(F.collect_list(F.struct("n1", "n0", "c", "c1")).alias("s")).withColumn("b", F.lit(0.0))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    e = F.exp("b")
    share = lambda x: x["n1"] * e / (x["n1"] * e + x["n0"])
    for _ in range(4):
        u, v = total(lambda x: x["c1"] - x["c"] * share(x)), total(lambda x: x["c"] * share(x) * x["n0"] / (x["n1"] * e + x["n0"]))
        rule = rule.withColumns({"u": u, "v": v})
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("u") - 0.01 * F.col("b")) / (F.col("v") + 0.01)))
        rule = rule.withColumn("b", F.col("b") + F.when(F.col("v") > 0, step).otherwise(0.0)).drop("u", "v")
    gain = total(lambda x: x["c1"] * F.col("b") - x["c"] * F.log((x["n1"] * e + x["n0"]) / (x["n1"] + x["n0"])))
    return rule.select("kind", "id", "id2", F.size("s").cast("long").alias("strata"), total(lambda x: x["c"]).cast("long").alias("cases"), F.round("b", 4).alias("beta"), F.round(gain, 4).alias("gain"))


_WEIGHTED = WITH + """, q AS (SELECT t.*, l.event_id IS NOT NULL AS y FROM ticks t LEFT JOIN ledger l ON l.event_id = t.event_id), c AS (SELECT symbol, ts, 0 AS y, count(*) OVER (PARTITION BY symbol, date_trunc('hour', ts)) AS w, row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY md5(concat('7:', event_id))) AS r FROM q WHERE NOT y),
s AS (SELECT symbol, ts, y, w::DOUBLE AS w FROM c WHERE r = 1 UNION ALL SELECT symbol, ts, 1, 1.0 FROM q WHERE y), d AS (SELECT symbol, y, w, hour(ts) AS h, isodow(ts) AS dow, date_diff('day', (SELECT min(ts) FROM ticks)::DATE, ts::DATE) + 1 AS day FROM s), n AS (SELECT max(day) AS n FROM d)"""


@query(
    "m04_weighted_folds",
    _WEIGHTED + """, k AS (SELECT k, ceil(n * (2 + k) / 5.0) AS cut, ceil(n * (3 + k) / 5.0) AS till FROM n, (SELECT unnest(range(3)) AS k)), b0 AS (SELECT k, sum(w * y) AS wy, sum(w) AS w FROM d JOIN k ON d.day <= cut GROUP BY 1), b1 AS (SELECT k, h, sum(w * y) AS wy, sum(w) AS w FROM d JOIN k ON d.day <= cut GROUP BY 1, 2), b2 AS (SELECT k, h, dow, sum(w * y) AS wy, sum(w) AS w FROM d JOIN k ON d.day <= cut GROUP BY 1, 2, 3), b3 AS (SELECT k, symbol, h, sum(w * y) AS wy, sum(w) AS w FROM d JOIN k ON d.day <= cut GROUP BY 1, 2, 3),
t AS (SELECT d.*, k.k, b0.wy / b0.w AS p0, (coalesce(b1.wy, 0) + 20 * b0.wy / b0.w) / (coalesce(b1.w, 0) + 20) AS p1, (coalesce(b2.wy, 0) + 20 * b0.wy / b0.w) / (coalesce(b2.w, 0) + 20) AS p2, (coalesce(b3.wy, 0) + 20 * b0.wy / b0.w) / (coalesce(b3.w, 0) + 20) AS p3 FROM d JOIN k ON d.day > cut AND d.day <= till JOIN b0 ON b0.k = k.k LEFT JOIN b1 ON b1.k = k.k AND b1.h = d.h LEFT JOIN b2 ON b2.k = k.k AND b2.h = d.h AND b2.dow = d.dow LEFT JOIN b3 ON b3.k = k.k AND b3.h = d.h AND b3.symbol = d.symbol)
SELECT CAST(k AS INTEGER) AS fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS cases, round(sum(w), 6) AS weight, """ + ", ".join(f"round(sum(w * (y * ln(p{i}) + (1 - y) * ln(1 - p{i}))) / sum(w * y) / ln(2), 6) AS bits_b{i}" for i in range(4)) + " FROM t GROUP BY 1",
)
def m04_weighted_folds(spark, sf):
    """Event models on sampled controls with their inverse chances as weights (Horvitz-Thompson): constant rate, clock, week
    and symbol cells shrunk to the rate, in bits per event on expanding folds (M03, M04)."""
    t = V.ticks(spark, sf).join(V.ledger(spark, sf).select("event_id", F.lit(1).alias("y")), "event_id", "left")
    c = t.where("y is null").groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").cast("double").alias("w"), F.min_by("ts", F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")))).alias("ts"))
    s = c.select("symbol", "ts", F.lit(0).alias("y"), "w").unionByName(t.where("y = 1").select("symbol", "ts", "y", F.lit(1.0).alias("w")))
    first, _ = S.span(t, "ts")
    d = s.select("symbol", "y", "w", F.hour("ts").alias("h"), F.weekday("ts").alias("dow"), S.day_number("ts", first).alias("day"))
    # sums per cell once; a fold adds up the days before it
    day = d.groupBy("symbol", "h", "dow", "day").agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"), F.count("*").alias("n"), F.sum("y").alias("y"))
    days = day.agg(F.max("day")).first()[0] or 0
    cuts = [S.cut(days, (2 + i) / 5) for i in range(4)]
    k = F.explode(F.array_compact(F.array(*[F.when(F.col("day") <= cuts[i], F.lit(i)) for i in range(3)]))).alias("k")
    past = day.select("*", k)
    cell = lambda *keys: past.groupBy("k", *keys).agg(F.sum("wy").alias("cy"), F.sum("w").alias("cw"))
    fold = F.coalesce(*[F.when((F.col("day") > cuts[i]) & (F.col("day") <= cuts[i + 1]), F.lit(i)) for i in range(3)])
    test = day.withColumn("k", fold).where("k is not null")
    test = test.join(F.broadcast(cell().withColumnsRenamed({"cy": "y0", "cw": "w0"})), "k")  # three rows
    p = {"p0": F.col("y0") / F.col("w0")}
    for i, keys in enumerate((["h"], ["h", "dow"], ["h", "symbol"]), start=1):
        test = test.join(cell(*keys).withColumnsRenamed({"cy": f"y{i}", "cw": f"w{i}"}), ["k", *keys], "left")
        p[f"p{i}"] = (F.coalesce(f"y{i}", F.lit(0.0)) + 20 * F.col("y0") / F.col("w0")) / (F.coalesce(f"w{i}", F.lit(0.0)) + 20)
    test = test.withColumns(p)
    bits = lambda i: r6(F.sum(F.col("wy") * F.log(f"p{i}") + (F.col("w") - F.col("wy")) * F.log(1 - F.col(f"p{i}"))) / F.sum("wy") / F.log(F.lit(2.0))).alias(f"bits_b{i}")
    return test.groupBy(F.col("k").alias("fold")).agg(F.sum("n").alias("n"), F.sum("y").alias("cases"), r6(F.sum("w")).alias("weight"), *[bits(i) for i in range(4)])


@query("m04_weighted_logistic")
def m04_weighted_logistic(spark, sf):
    """Logistic event models with inverse-chance weights and three penalties on the same folds (M01, M04): bits per event and coefficients that are not zero."""
    t = V.ticks(spark, sf).join(V.ledger(spark, sf).select("event_id", F.lit(1.0).alias("y")), "event_id", "left").withColumn("h", F.date_trunc("hour", "ts"))
    n = t.where("y is null").groupBy("symbol", "h").agg(F.count("*").cast("double").alias("w"), F.min_by("event_id", F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")))).alias("event_id")).select("event_id", "w")
    d = t.join(n, "event_id", "left").where("y = 1 or w is not null").withColumns({"w": F.when(F.col("y") == 1, 1.0).otherwise(F.col("w")), "label": F.coalesce("y", F.lit(0.0))})
    first, _ = S.span(t, "ts")
    return M.weighted_logistic(d.select("label", "w", S.day_number("ts", first).alias("day"), "mid", "spread", F.hour("ts").alias("hour")))


_RISK = WITH + """, t AS (SELECT ticket, side, least(CAST(floor((epoch_us(close_time) - epoch_us(open_time)) / 7.2e9) AS BIGINT), 60) AS last FROM ledger)"""


@query(
    "m08_exit_risk",
    _RISK + ", r AS (SELECT side, unnest(range(last + 1)) AS age, last FROM t) SELECT side, CAST(age AS INTEGER) AS age, count(*) AS at_risk, count(*) FILTER (age = last AND last < 60) AS exits, round(count(*) FILTER (age = last AND last < 60) / count(*), 9) AS hazard FROM r GROUP BY 1, 2",
)
def m08_exit_risk(spark, sf):
    """Trades at risk and exits by two-hour age, capped at 120 hours, which censors."""
    return M.exit_risk(V.ledger(spark, sf)).groupBy("side", "age").agg(F.sum("at_risk").alias("at_risk"), F.sum("exits").alias("exits"), F.round(F.sum("exits") / F.sum("at_risk"), 9).alias("hazard"))


@query("m08_exit_hazard")
def m08_exit_hazard(spark, sf):
    """Logistic exit hazard (penalty chosen on an inner split) and spline Poisson hazard against the constant one, in bits per exit on later days."""
    return M.exit_hazard(M.exit_risk(V.ledger(spark, sf)))


@query("m22_model_ladder")
def m22_model_ladder(spark, sf):
    """Five nested conditional logits: penalty chosen on the days before the test, baselines from the training days alone."""
    panel = _panel(spark, sf)
    first, _ = S.span(panel, "ts")
    p = panel.select("symbol", F.to_date("ts").alias("day"), S.day_number("ts", first).alias("d"), F.col("entry").cast("double").alias("y"), "return_1", "expansion", F.col("rsi"), F.sin(F.col("hour") * 0.2617993877991494).alias("hs"), F.cos(F.col("hour") * 0.2617993877991494).alias("hc"), "atr_pct")
    return M.ladder(p.dropna(), [[], ["hs", "hc"], ["hs", "hc", "expansion"], ["hs", "hc", "expansion", "return_1"], ["hs", "hc", "expansion", "return_1", "rsi", "atr_pct"]])


@query(
    "s08_padded_range",
    WITH + """, r AS (SELECT ticket, symbol, open_time - INTERVAL '2 seconds' AS a, close_time + INTERVAL '2 seconds' AS b FROM ledger), h AS (SELECT r.ticket, count(x.ts) AS present, CAST((epoch_us(date_trunc('hour', any_value(b))) - epoch_us(date_trunc('hour', any_value(a)))) // 3600000000 + 1 AS BIGINT) AS expected FROM r LEFT JOIN bars_1h x ON x.symbol = r.symbol AND x.ts >= date_trunc('hour', a) AND x.ts <= date_trunc('hour', b) GROUP BY 1),
n AS (SELECT r.ticket, count(t.ts) AS n FROM r LEFT JOIN ticks t ON t.symbol = r.symbol AND t.ts >= a AND t.ts <= b GROUP BY 1) SELECT ticket, expected, present, CASE WHEN present = expected THEN 'complete' ELSE 'rejected' END AS status, CASE WHEN present = expected THEN n END AS ticks FROM h JOIN n USING (ticket)""",
)
def s08_padded_range(spark, sf):
    """Ticks of a trade's range, two seconds wider on both sides, rejected if any of its hours has no file."""
    pad = F.expr("interval 2 seconds")
    r = V.ledger(spark, sf).select("ticket", "symbol", (F.col("open_time") - pad).alias("a"), (F.col("close_time") + pad).alias("b"))
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    r = r.withColumns({"ha": hour("a"), "hb": hour("b")})
    count = lambda rows, s, e, name: X.interval_extremes(rows, r, on="symbol", key="ticket", start=s, end=e, high="x", low="x").select("ticket", F.col("n").alias(name))
    present = count(V.bars_1h(spark, sf).select("symbol", "ts", F.col("close").alias("x")), "ha", "hb", "present")
    n = count(V.ticks(spark, sf).select("symbol", "ts", F.col("mid").alias("x")), "a", "b", "n")
    j = r.join(present, "ticket", "left").join(n, "ticket", "left").withColumns({"present": F.coalesce("present", F.lit(0)), "expected": F.round(A.seconds(F.col("hb"), F.col("ha")) / 3600 + 1).cast("long")})
    whole = F.col("present") == F.col("expected")
    return j.select("ticket", "expected", "present", F.when(whole, "complete").otherwise("rejected").alias("status"), F.when(whole, F.coalesce("n", F.lit(0))).alias("ticks"))


_AUDIT = {
    "A_unique_tickets": ("SELECT count(*) AS n, count(*) - count(DISTINCT ticket) AS bad FROM ledger",),
    "B_times_ordered": ("SELECT count(*) AS n, count(*) FILTER (WHERE close_time < open_time) AS bad FROM ledger",),
    "C_quotes_not_crossed": ("SELECT count(*) AS n, count(*) FILTER (WHERE bid > ask OR bid <= 0) AS bad FROM ticks",),
    "D_tick_keys_unique": ("SELECT count(*) AS n, count(*) - count(DISTINCT event_id) AS bad FROM ticks",),
    "E_bars_consistent": ("SELECT count(*) AS n, count(*) FILTER (WHERE high < greatest(open, close) OR low > least(open, close)) AS bad FROM bars_1h",),
    "F_entries_covered": ("SELECT count(*) AS n, count(*) FILTER (WHERE b.ts IS NULL) AS bad FROM ledger l LEFT JOIN bars_1h b ON b.symbol = l.symbol AND b.ts = date_trunc('hour', l.open_time)",),
    "G_finite_results": ("SELECT count(*) AS n, count(*) FILTER (WHERE pnl IS NULL OR isnan(pnl)) AS bad FROM ledger",),
    "H_train_closed_before_test": (f"SELECT count(*) AS n, count(*) FILTER (WHERE close_time >= {_CUT}) AS bad FROM ledger WHERE open_time < {_CUT}",),
    "I_known_sides": ("SELECT count(*) AS n, count(*) FILTER (WHERE side NOT IN ('Buy', 'Sell')) AS bad FROM ledger",),
}


@query("r16_precondition_audit", WITH + " UNION ALL ".join(f"SELECT '{k}' AS part, n AS checked, bad AS violations, bad = 0 AS passed FROM ({q[0]})" for k, q in _AUDIT.items()))
def r16_precondition_audit(spark, sf):
    """The nine preconditions of the audit, each with what was checked and what fails it."""
    led, ticks, bars = V.ledger(spark, sf), V.ticks(spark, sf), V.bars_1h(spark, sf)
    n = lambda df, bad: df.agg(F.count("*").alias("n"), bad.alias("bad"))
    cut = _cut(spark, sf)
    covered = led.select("symbol", F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("ts")).join(bars.select("symbol", "ts", F.lit(True).alias("found")), ["symbol", "ts"], "left")
    parts = {
        "A_unique_tickets": n(led, F.count("*") - F.countDistinct("ticket")),
        "B_times_ordered": n(led, F.count_if(F.col("close_time") < F.col("open_time"))),
        "C_quotes_not_crossed": n(ticks, F.count_if((F.col("bid") > F.col("ask")) | (F.col("bid") <= 0))),
        "D_tick_keys_unique": n(ticks, F.count("*") - F.countDistinct("event_id")),
        "E_bars_consistent": n(bars, F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")))),
        "F_entries_covered": n(covered, F.count_if(F.col("found").isNull())),
        "G_finite_results": n(led, F.count_if(F.col("pnl").isNull() | F.isnan("pnl"))),
        "H_train_closed_before_test": n(led.where(F.col("open_time") < cut), F.count_if(F.col("close_time") >= cut)),
        "I_known_sides": n(led, F.count_if(~F.col("side").isin("Buy", "Sell"))),
    }
    out = None
    for k, df in parts.items():
        one = df.select(F.lit(k).alias("part"), F.col("n").alias("checked"), F.col("bad").alias("violations"), (F.col("bad") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
