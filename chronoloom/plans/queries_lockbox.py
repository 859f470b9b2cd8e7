"""Grouped validation, frozen scores, capture and identity."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import lockbox as L
from chronoloom.operators import selection as Q
from chronoloom.operators import splits as P
from chronoloom.plans import views as V
from chronoloom.plans.views import DAYS, FIRST, WITH, r6
from chronoloom.registry import query

#: Share of the days that discovery takes; a day of buffer follows, then the lockbox.
DISCOVERY = 0.75
FEATURES = ["mid", "spread", "minute"]
#: A fixed score, for the queries that judge one without fitting.
FIXED = L.Frozen(("mid", "spread", "minute"), (150.0, 0.055, 30.0), (40.0, 0.03, 17.0), 1.0, (0.1, 0.9, -0.05))


def _strata(spark, sf):
    """Ticks in strata of a symbol's day, the busiest tick as case, and the partition of the day."""
    t = V.ticks(spark, sf)
    first, days = P.span(t, "ts")
    n = P.day_number("ts", first)
    cut = P.cut(days, DISCOVERY)
    w = W.partitionBy("symbol", F.to_date("ts")).orderBy(F.desc("k"), "event_id")
    part = F.when(n <= cut, "discovery").when(n == cut + 1, "buffer").otherwise("lockbox")
    return t.withColumns({"day": F.to_date("ts"), "minute": F.minute("ts").cast("double"), "part": part, "y": (F.row_number().over(w) == 1).cast("int")})


_STRATA_SQL = WITH + f""", s AS (SELECT symbol, ts::DATE AS day, event_id, 0.0 + (mid - 150.0) / 40.0 * 0.1 + (spread - 0.055) / 0.03 * 0.9 + (minute(ts) - 30.0) / 17.0 * -0.05 AS eta,
CASE WHEN date_diff('day', {FIRST}, ts) + 1 <= ceil({DAYS} * {DISCOVERY} - 1e-9) THEN 'discovery' WHEN date_diff('day', {FIRST}, ts) + 1 = ceil({DAYS} * {DISCOVERY} - 1e-9) + 1 THEN 'buffer' ELSE 'lockbox' END AS part,
CASE WHEN row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY k DESC, event_id) = 1 THEN 1 ELSE 0 END AS y FROM ticks)"""


@query("m05_grouped_penalty")
def m05_grouped_penalty(spark, sf):
    """The penalty of a conditional logit by five grouped folds of the discovery strata, and the coefficients of each."""
    d = _strata(spark, sf).where("part = 'discovery'")
    frozen, fits = L.freeze(d, ["symbol", "day"], "y", FEATURES, "ts")
    _, score = L.choose(fits)
    rows = [(f["penalty"], f["penalty"] == frozen.penalty, f["train_n"], round(score[f["penalty"]], 6), round(f["train_ll"], 4), *[round(float(b), 4) for b in f["beta"]]) for f in fits if f["fold"] == -1]
    return spark.createDataFrame(rows, "penalty double, chosen boolean, strata long, held_out_ll double, ll double, " + ", ".join(f"b_{c} double" for c in FEATURES))


def _rounded(df):
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema.fields])


@query("m23_lockbox")
def m23_lockbox(spark, sf):
    """A model frozen on discovery, judged once on buffer and lockbox: likelihood against chance and captured cases by symbol."""
    s = _strata(spark, sf)
    frozen, _ = L.freeze(s.where("part = 'discovery'"), ["symbol", "day"], "y", FEATURES, "ts")
    return L.capture(s.where("part <> 'discovery'"), ["symbol", "day"], "y", frozen.eta(), by=["part", "symbol"]).transform(lambda d: d.select(*[F.round(f.name, 4).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in d.schema.fields]))


@query(
    "m23_capture",
    _STRATA_SQL + """, t AS (SELECT part, symbol, day, max(eta) AS top, max(CASE WHEN y = 1 THEN eta END) AS c, sum(y) AS cases, count(*) AS n FROM s GROUP BY 1, 2, 3),
z AS (SELECT t.part, t.symbol, t.day, any_value(t.c) AS c, any_value(t.top) AS top, any_value(t.n) AS n, any_value(t.cases) AS cases, sum(exp(s.eta - t.top)) AS z, 1 + count(*) FILTER (s.eta > t.c) AS r FROM s JOIN t USING (part, symbol, day) GROUP BY 1, 2, 3),
g AS (SELECT *, cases = 1 AND n - 1 >= 5 AS good FROM z)
SELECT part, symbol, count(*) FILTER (good) AS strata, count(*) FILTER (NOT good) AS excluded, round(avg(c - top - ln(z)) FILTER (good), 6) AS ll_per_case, round(avg(-ln(n)) FILTER (good), 6) AS null_per_case, round(avg(c - top - ln(z)) FILTER (good) - avg(-ln(n)) FILTER (good), 6) AS improvement,
round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) FILTER (good), 6) AS top_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END) FILTER (good), 6) AS top_5, round(avg(CASE WHEN r <= ceil(n * 0.1) THEN 1.0 ELSE 0.0 END) FILTER (good), 6) AS top_decile, round(avg((n - r + 1) / n) FILTER (good), 6) AS mean_percentile FROM g GROUP BY 1, 2""",
)
def m23_capture(spark, sf):
    """Likelihood and captured cases of a fixed score by partition and symbol."""
    return _rounded(L.capture(_strata(spark, sf), ["symbol", "day"], "y", FIXED.eta(), by=["part", "symbol"]))


@query(
    "m24_identity_audit",
    _STRATA_SQL + """, q AS (SELECT quantile_cont(eta, 0.99) AS tau FROM s WHERE part = 'discovery' AND y = 0), f AS (SELECT part, y, CASE WHEN eta >= tau THEN 1 ELSE 0 END AS r, tau FROM s, q),
g AS (SELECT coalesce(part, 'ALL') AS part, any_value(tau) AS tau, sum(y * r) AS tp, sum((1 - y) * r) AS fp, sum(y * (1 - r)) AS fn, sum((1 - y) * (1 - r)) AS tn FROM f GROUP BY GROUPING SETS ((part), ())),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM g)
SELECT part, round(tau, 6) AS tau, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m""",
)
def m24_identity_audit(spark, sf):
    """Does a frozen rule, scores from the 99th percentile of discovery's controls on, name the cases? By partition and over all."""
    s = _strata(spark, sf).withColumn("eta", FIXED.eta())
    tau = Q.quantile(s.where("part = 'discovery' and y = 0"), "eta", 0.99)
    d = L.identity(s, "y", F.col("eta") >= F.lit(tau), "part")
    return _rounded(d.withColumn("tau", F.lit(tau).cast("double")))


@query(
    "c07_epoch_partitions",
    WITH + f""", r AS (SELECT symbol, date_trunc('hour', open_time) AS epoch, row_number() OVER (ORDER BY open_time, ticket) - 1 AS i, floor(count(*) OVER () * {DISCOVERY}) AS cut FROM ledger)
SELECT symbol, epoch, count(*) AS records, arg_min(CASE WHEN i < cut THEN 'discovery' WHEN i >= cut + 1 THEN 'lockbox' ELSE 'buffer' END, i) AS partition FROM r GROUP BY 1, 2""",
)
def c07_epoch_partitions(spark, sf):
    """Epochs (a symbol's hour with entries) by the partition of their first record."""
    led = V.ledger(spark, sf).withColumn("epoch", F.date_trunc("hour", "open_time").cast("timestamp_ntz"))
    cut = math.floor(led.count() * DISCOVERY)
    return L.epoch_partitions(led, "open_time", "ticket", ["symbol", "epoch"], cut, cut + 1)
