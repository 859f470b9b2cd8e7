"""Hypothesis tests, likelihoods, resampling and fitted models (SURVEY H, M, SM)."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import tails as X
from chronoloom.operators import models as M
from chronoloom.operators import resampling as R
from chronoloom.operators import splits as S
from chronoloom.plans import views as V
from chronoloom.plans.views import WITH, r6
from chronoloom.registry import query

_P = ", p AS (SELECT user_id, count(*) AS n, least(1.0, exp(-abs(sum(pnl)) / 100)) AS p FROM ledger GROUP BY 1)"


def _pvalues(spark, sf):
    return V.ledger(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.exp(-F.abs(F.sum("pnl")) / 100)).alias("p"))


@query(
    "h04_multiple_testing",
    WITH + _P + ", r AS (SELECT *, row_number() OVER (ORDER BY p, user_id) AS r, count(*) OVER () AS m FROM p) SELECT user_id, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS bh, round(least(1, max(p * (m - r + 1)) OVER (ORDER BY r)), 6) AS holm, p * m <= 0.05 AS bonferroni FROM r",
)
def h04_multiple_testing(spark, sf):
    """Benjamini-Hochberg, Holm and Bonferroni over a register of tests (H04-H06, H18). One row per test, so one order."""
    p = _pvalues(spark, sf).select("user_id", "p", F.row_number().over(W.orderBy("p", "user_id")).alias("r"), F.count("*").over(W.partitionBy()).alias("m"))
    bh = F.min(F.col("p") * F.col("m") / F.col("r")).over(W.orderBy(F.desc("r")))
    holm = F.max(F.col("p") * (F.col("m") - F.col("r") + 1)).over(W.orderBy("r"))
    return p.select("user_id", r6(F.least(F.lit(1.0), bh)).alias("bh"), r6(F.least(F.lit(1.0), holm)).alias("holm"), (F.col("p") * F.col("m") <= 0.05).alias("bonferroni"))


@query(
    "h03_wilson",
    WITH + ", w AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl > 0) / count(*)::DOUBLE AS p, 1.959963984540054 AS z FROM ledger GROUP BY 1) SELECT symbol, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high FROM w",
)
def h03_wilson(spark, sf):
    w = V.ledger(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("p")).withColumn("z", F.lit(1.959963984540054))
    side = lambda s: r6(F.expr(f"(p + z * z / (2 * n) {s} z * sqrt(p * (1 - p) / n + z * z / (4d * n * n))) / (1 + z * z / n)"))
    return w.select("symbol", "n", side("-").alias("low"), side("+").alias("high"))


@query(
    "h07_runs_test",
    WITH + ", s AS (SELECT symbol, pnl > 0 AS w, lag(pnl > 0) OVER (PARTITION BY symbol ORDER BY open_time, event_id) AS pw FROM ledger), g AS (SELECT symbol, count(*) FILTER (w) AS n1, count(*) FILTER (NOT w) AS n0, 1 + count(*) FILTER (w <> pw) AS runs FROM s GROUP BY 1) SELECT symbol, runs, round((runs - (2.0 * n1 * n0 / (n1 + n0) + 1)) / sqrt(2.0 * n1 * n0 * (2.0 * n1 * n0 - n1 - n0) / ((n1 + n0) * (n1 + n0) * (n1 + n0 - 1.0))), 6) AS z FROM g",
)
def h07_runs_test(spark, sf):
    w = W.partitionBy("symbol").orderBy("open_time", "event_id")
    win = F.col("pnl") > 0
    s = V.ledger(spark, sf).select("symbol", win.alias("w"), F.lag(win).over(w).alias("pw"))
    g = s.groupBy("symbol").agg(F.count_if("w").alias("n1"), F.count_if(~F.col("w")).alias("n0"), (1 + F.count_if(F.col("w") != F.col("pw"))).alias("runs"))
    z = F.expr("(runs - (2d * n1 * n0 / (n1 + n0) + 1)) / sqrt(2d * n1 * n0 * (2d * n1 * n0 - n1 - n0) / ((n1 + n0) * (n1 + n0) * (n1 + n0 - 1d)))")
    return g.select("symbol", "runs", r6(z).alias("z"))


@query(
    "h08_chi_square",
    WITH + ", c AS (SELECT symbol, side, count(*) AS o FROM ledger GROUP BY 1, 2), e AS (SELECT o, sum(o) OVER (PARTITION BY symbol) * sum(o) OVER (PARTITION BY side) / CAST(sum(o) OVER () AS DOUBLE) AS e, sum(o) OVER () AS n FROM c), d AS (SELECT (SELECT count(DISTINCT symbol) FROM c) AS r, (SELECT count(DISTINCT side) FROM c) AS k) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, CAST(any_value((r - 1) * (k - 1)) AS BIGINT) AS dof, round(sqrt(sum((o - e) * (o - e) / e) / any_value(n) / least(any_value(r) - 1, any_value(k) - 1)), 6) AS cramers_v FROM e CROSS JOIN d",
)
def h08_chi_square(spark, sf):
    """Chi-square of a contingency table and Cramér's V; the tail is in ``functions.tails``."""
    c = V.ledger(spark, sf).groupBy("symbol", "side").agg(F.count("*").alias("o"))
    e = c.withColumn("n", F.sum("o").over(W.partitionBy())).withColumn("e", F.sum("o").over(W.partitionBy("symbol")) * F.sum("o").over(W.partitionBy("side")) / F.col("n"))
    x = F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e"))
    r, k = F.countDistinct("symbol"), F.countDistinct("side")
    return e.agg(r6(x).alias("chi2"), ((r - 1) * (k - 1)).alias("dof"), r6(F.sqrt(x / F.max("n") / F.least(r - 1, k - 1))).alias("cramers_v"))


@query("h08_p_values")
def h08_p_values(spark, sf):
    """Tails of the chi-square, normal and exact binomial tests per symbol."""
    g = V.ledger(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("k"))
    g = g.withColumn("z", (2 * F.col("k") - F.col("n")) / F.sqrt("n"))
    return g.select("symbol", X.normal_sf("z").alias("p_normal"), X.chi2_sf(F.col("z") ** 2, F.lit(1)).alias("p_chi2"), X.binomial_sf("k", "n", F.lit(0.5)).alias("p_binomial"))


_RANKS = ", c AS (SELECT l.side = 'Buy' AS y, round(pnl, 3) AS x FROM ledger l), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM c)"


@query(
    "h10_rank_tests",
    WITH + ", c AS (SELECT symbol, side = 'Buy' AS y, round(pnl, 3) AS x FROM ledger), r AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS r FROM c), g AS (SELECT symbol, count(*) FILTER (y) AS m, count(*) FILTER (NOT y) AS n, sum(r) FILTER (y) AS s FROM r GROUP BY 1) SELECT symbol, m, n, round(s - m * (m + 1) / 2.0, 3) AS u, round((s - m * (m + 1) / 2.0) / (m * n), 6) AS auc, round(2 * (s - m * (m + 1) / 2.0) / (m * n) - 1, 6) AS cliffs_delta FROM g",
)
def h10_rank_tests(spark, sf):
    """Mann-Whitney U, AUC and Cliff's delta from ranks with ties at their mean."""
    c = V.ledger(spark, sf).select("symbol", (F.col("side") == "Buy").alias("y"), F.round("pnl", 3).alias("x"))
    r = F.rank().over(W.partitionBy("symbol").orderBy("x")) + (F.count("*").over(W.partitionBy("symbol", "x")) - 1) / 2
    g = c.withColumn("r", r).groupBy("symbol").agg(F.count_if("y").alias("m"), F.count_if(~F.col("y")).alias("n"), F.sum(F.when(F.col("y"), F.col("r"))).alias("s"))
    u = F.expr("s - m * (m + 1) / 2d")
    return g.select("symbol", "m", "n", F.round(u, 3).alias("u"), r6(u / (F.col("m") * F.col("n"))).alias("auc"), r6(2 * u / (F.col("m") * F.col("n")) - 1).alias("cliffs_delta"))


@query(
    "h10_correlations",
    WITH + ", c AS (SELECT symbol, mid AS x, spread AS y, CAST(k AS DOUBLE) AS k FROM ticks), r AS (SELECT symbol, x, y, k, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol ORDER BY k) + (count(*) OVER (PARTITION BY symbol, k) - 1) / 2.0 AS rk FROM c) SELECT symbol, round(corr(x, k), 6) AS pearson, round(corr(rx, rk), 6) AS spearman FROM r GROUP BY 1",
)
def h10_correlations(spark, sf):
    c = V.ticks(spark, sf).select("symbol", F.col("mid").alias("x"), F.col("k").cast("double").alias("k"))
    rank = lambda x: F.rank().over(W.partitionBy("symbol").orderBy(x)) + (F.count("*").over(W.partitionBy("symbol", x)) - 1) / 2
    return c.withColumns({"rx": rank("x"), "rk": rank("k")}).groupBy("symbol").agg(r6(F.corr("x", "k")).alias("pearson"), r6(F.corr("rx", "rk")).alias("spearman"))


@query(
    "h10_welch",
    WITH + ", g AS (SELECT symbol, count(*) FILTER (side = 'Buy') AS n1, count(*) FILTER (side = 'Sell') AS n0, avg(pnl) FILTER (side = 'Buy') AS m1, avg(pnl) FILTER (side = 'Sell') AS m0, var_samp(pnl) FILTER (side = 'Buy') AS v1, var_samp(pnl) FILTER (side = 'Sell') AS v0 FROM ledger GROUP BY 1) SELECT symbol, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 4) AS dof FROM g",
)
def h10_welch(spark, sf):
    b, s = F.when(F.col("side") == "Buy", F.col("pnl")), F.when(F.col("side") == "Sell", F.col("pnl"))
    g = V.ledger(spark, sf).groupBy("symbol").agg(F.count(b).alias("n1"), F.count(s).alias("n0"), F.avg(b).alias("m1"), F.avg(s).alias("m0"), F.var_samp(b).alias("v1"), F.var_samp(s).alias("v0"))
    return g.select("symbol", r6(F.expr("(m1 - m0) / sqrt(v1 / n1 + v0 / n0)")).alias("t"), F.round(F.expr("pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1))"), 4).alias("dof"))


@query(
    "h15_rescaling_ks",
    WITH + ", g AS (SELECT symbol, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id))) / 1e6 AS gap, event_id FROM ticks), u AS (SELECT symbol, 1 - exp(-gap / avg(gap) OVER (PARTITION BY symbol)) AS u, event_id FROM g WHERE gap IS NOT NULL), r AS (SELECT symbol, u, row_number() OVER (PARTITION BY symbol ORDER BY u, event_id) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM u) SELECT symbol, round(max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)), 6) AS ks FROM r GROUP BY 1",
)
def h15_rescaling_ks(spark, sf):
    """Kolmogorov-Smirnov distance of rescaled gaps from uniform."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = V.ticks(spark, sf).withColumn("gap", (us - F.lag(us).over(W.partitionBy("symbol").orderBy("ts", "event_id"))) / 1e6).where("gap is not null")
    p = W.partitionBy("symbol")
    u = g.withColumn("u", 1 - F.exp(-F.col("gap") / F.avg("gap").over(p)))
    r = u.select("symbol", "u", F.row_number().over(p.orderBy("u", "event_id")).alias("i"), F.count("*").over(p).alias("n"))
    return r.groupBy("symbol").agg(r6(F.max(F.greatest(F.expr("i / n - u"), F.expr("u - (i - 1) / n")))).alias("ks"))


@query(
    "h19_discordant_pairs",
    WITH + ", c AS (SELECT l.ticket, t1.spread > 0.05 AS case_hit, t2.spread > 0.05 AS control_hit FROM ledger l JOIN ticks t1 ON l.event_id = t1.event_id JOIN ticks t2 ON t2.event_id = l.event_id + 1) SELECT count(*) FILTER (case_hit AND NOT control_hit) AS b, count(*) FILTER (control_hit AND NOT case_hit) AS c, count(*) AS pairs FROM c",
)
def h19_discordant_pairs(spark, sf):
    """Discordant counts of case-control pairs, the input of the exact test."""
    t = V.ticks(spark, sf).select("event_id", (F.col("spread") > 0.05).alias("hit"))
    led = V.ledger(spark, sf).select("event_id")
    c = led.join(t.withColumnRenamed("hit", "a"), "event_id").join(t.select((F.col("event_id") - 1).alias("event_id"), F.col("hit").alias("b")), "event_id")
    return c.agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(F.col("b") & ~F.col("a")).alias("c"), F.count("*").alias("pairs"))


_CDF = [0.36787944117144233 * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]


@query(
    "h01_bootstrap",
    WITH + f""", c AS (SELECT symbol, CAST(open_time AS DATE) AS day, sum(pnl) AS s, count(pnl) AS n FROM ledger GROUP BY 1, 2), u AS (SELECT c.*, r, {R.uniform_sql("r", "symbol", "day")} AS u FROM c CROSS JOIN (SELECT unnest(range(1, 201)) AS r)),
m AS (SELECT symbol, r, sum(s * w) / sum(n * w) AS m FROM (SELECT *, {' + '.join(f'(u > {x!r})::INTEGER' for x in _CDF)} AS w FROM u) GROUP BY 1, 2),
q AS (SELECT symbol, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) SELECT symbol, round(sum(s) / sum(n), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM c JOIN q USING (symbol) GROUP BY 1""",
)
def h01_bootstrap(spark, sf):
    """Day-cluster bootstrap interval of the mean result (H01): Poisson weights by hash, one pass for all replicates."""
    m = R.bootstrap_mean(V.ledger(spark, sf).withColumn("day", F.to_date("open_time")), "symbol", "day", "pnl", 200)
    return m.select("symbol", r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


@query(
    "h02_permutation",
    WITH + f""", d AS (SELECT symbol, event_id, (side = 'Buy')::INTEGER AS y, pnl AS x, avg((side = 'Buy')::INTEGER) OVER (PARTITION BY symbol) AS share FROM ledger), u AS (SELECT symbol, r, x, CASE WHEN r = 0 THEN y ELSE ({R.uniform_sql("r", "event_id")} < share)::INTEGER END AS y FROM d CROSS JOIN (SELECT unnest(range(200)) AS r)),
m AS (SELECT symbol, r, avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0) AS d FROM u GROUP BY 1, 2) SELECT m.symbol, round(any_value(o.d), 6) AS difference, round((1 + count(*) FILTER (abs(m.d) >= abs(o.d))) / (1.0 + count(m.d)), 6) AS p_value FROM m JOIN m o ON o.symbol = m.symbol AND o.r = 0 WHERE m.r > 0 GROUP BY 1""",
)
def h02_permutation(spark, sf):
    """Permutation p-value of the difference of means, labels shuffled within symbols (H02, H13, H14, SM3)."""
    m = R.permutation_difference(V.ledger(spark, sf), "symbol", F.col("side") == "Buy", "pnl", "event_id", 199)
    return m.select("symbol", r6("difference").alias("difference"), r6("p_value").alias("p_value"))


@query(
    "m09_likelihood",
    WITH + ", c AS (SELECT t.symbol, CASE WHEN l.event_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS y, greatest(1e-9, least(1 - 1e-9, 0.1 + t.k / 250.0)) AS p FROM ticks t LEFT JOIN ledger l ON t.event_id = l.event_id), g AS (SELECT symbol, sum(y) AS events, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, avg(y) AS r, count(*) AS n FROM c GROUP BY 1) SELECT symbol, events, round(ll, 4) AS ll, round(CASE WHEN events > 0 THEN (ll - (events * ln(nullif(r, 0)) + (n - events) * ln(1 - r))) / events / ln(2) ELSE 0 END, 6) AS bits_per_event FROM g",
)
def m09_likelihood(spark, sf):
    """Bernoulli log-likelihood against the constant rate, in bits per event."""
    led = V.ledger(spark, sf).select("event_id", F.lit(1.0).alias("y"))
    c = V.ticks(spark, sf).join(led, "event_id", "left").select("symbol", F.coalesce("y", F.lit(0.0)).alias("y"), F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), 0.1 + F.col("k") / 250.0)).alias("p"))
    g = c.groupBy("symbol").agg(F.sum("y").alias("events"), F.sum(F.expr("y * ln(p) + (1 - y) * ln(1 - p)")).alias("ll"), F.avg("y").alias("r"), F.count("*").alias("n"))
    bits = F.when(F.col("events") > 0, F.expr("(ll - (events * ln(nullif(r, 0)) + (n - events) * ln(1 - r))) / events / ln(2)")).otherwise(0.0)
    return g.select("symbol", "events", F.round("ll", 4).alias("ll"), r6(bits).alias("bits_per_event"))


@query(
    "m05_conditional_score",
    WITH + ", s AS (SELECT symbol, date_trunc('day', ts) AS day, event_id, 0.5 * spread - 0.01 * mid AS eta, k = max(k) OVER (PARTITION BY symbol, date_trunc('day', ts)) AS y FROM ticks), g AS (SELECT symbol, day, ln(sum(exp(eta))) AS lse, sum(CASE WHEN y THEN eta END) AS e, count(*) FILTER (y) AS cases, count(*) AS n FROM s GROUP BY 1, 2) SELECT symbol, count(*) AS strata, round(sum(e / cases - lse), 4) AS ll, round(sum(-ln(n)), 4) AS null_ll FROM g GROUP BY 1",
)
def m05_conditional_score(spark, sf):
    """Conditional likelihood of strata (softmax within a day) against the uniform choice."""
    p = W.partitionBy("symbol", "day")
    s = V.ticks(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    s = s.withColumns({"eta": 0.5 * F.col("spread") - 0.01 * F.col("mid"), "y": F.col("k") == F.max("k").over(p)})
    g = s.groupBy("symbol", "day").agg(F.log(F.sum(F.exp("eta"))).alias("lse"), F.sum(F.when(F.col("y"), F.col("eta"))).alias("e"), F.count_if("y").alias("cases"), F.count("*").alias("n"))
    return g.groupBy("symbol").agg(F.count("*").alias("strata"), F.round(F.sum(F.col("e") / F.col("cases") - F.col("lse")), 4).alias("ll"), F.round(F.sum(-F.log("n")), 4).alias("null_ll"))


@query(
    "m14_best_split",
    WITH + ", s AS (SELECT symbol, ts, pnl, row_number() OVER w AS i, sum(pnl) OVER w AS c, sum(pnl) OVER (PARTITION BY symbol) AS t, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, open_time AS ts, event_id, pnl FROM ledger) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), g AS (SELECT symbol, i, c * c / i + (t - c) * (t - c) / (n - i) - t * t / n AS gain FROM s WHERE i < n) SELECT symbol, round(max(gain), 4) AS gain, CAST(arg_max(i, gain) AS INTEGER) AS split_at FROM g GROUP BY 1",
)
def m14_best_split(spark, sf):
    """The split in time that explains most, by prefix sums."""
    w = W.partitionBy("symbol").orderBy("open_time", "event_id").rowsBetween(W.unboundedPreceding, 0)
    p = W.partitionBy("symbol")
    s = V.ledger(spark, sf).select("symbol", F.count("*").over(w).cast("int").alias("i"), F.sum("pnl").over(w).alias("c"), F.sum("pnl").over(p).alias("t"), F.count("*").over(p).alias("n")).where("i < n")
    g = s.withColumn("gain", F.expr("c * c / i + (t - c) * (t - c) / (n - i) - t * t / n"))
    return g.groupBy("symbol").agg(F.round(F.max("gain"), 4).alias("gain"), F.max_by("i", "gain").alias("split_at"))


@query(
    "m15_duration_fits",
    WITH + ", d AS (SELECT symbol, (epoch_us(close_time) - epoch_us(open_time)) / 3.6e9 AS x FROM ledger), g AS (SELECT symbol, count(*) AS n, avg(x) AS m, avg(ln(x)) AS ml, stddev_pop(ln(x)) AS sl, sum(ln(x)) AS l FROM d GROUP BY 1) SELECT symbol, round(1 / m, 6) AS rate, round(2 - 2 * (-n * ln(m) - n), 3) AS aic_exponential, round(4 - 2 * (-l - n * ln(sl) - n / 2.0 * ln(2 * pi()) - n / 2.0), 3) AS aic_lognormal FROM g",
)
def m15_duration_fits(spark, sf):
    """Exponential and lognormal fits from sufficient statistics."""
    x = (F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(F.col("open_time").cast("timestamp"))) / 3.6e9
    d = V.ledger(spark, sf).select("symbol", x.alias("x"))
    g = d.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop(F.log("x")).alias("sl"), F.sum(F.log("x")).alias("l"))
    return g.select("symbol", r6(1 / F.col("m")).alias("rate"), F.round(F.expr("2 - 2 * (-n * ln(m) - n)"), 3).alias("aic_exponential"), F.round(F.expr("4 - 2 * (-l - n * ln(sl) - n / 2d * ln(2 * pi()) - n / 2d)"), 3).alias("aic_lognormal"))


@query(
    "m16_markov_order",
    WITH + ", s AS (SELECT symbol, side AS c, lag(side) OVER w AS b, lag(side, 2) OVER w AS a FROM ledger WINDOW w AS (PARTITION BY symbol ORDER BY open_time, event_id)), f AS (SELECT * FROM s WHERE a IS NOT NULL), l AS (SELECT ln(count(*) OVER (PARTITION BY c) / CAST(count(*) OVER () AS DOUBLE)) AS l0, ln(count(*) OVER (PARTITION BY b, c) / CAST(count(*) OVER (PARTITION BY b) AS DOUBLE)) AS l1, ln(count(*) OVER (PARTITION BY a, b, c) / CAST(count(*) OVER (PARTITION BY a, b) AS DOUBLE)) AS l2 FROM f) SELECT count(*) AS n, round(sum(l0), 4) AS ll0, round(sum(l1), 4) AS ll1, round(sum(l2), 4) AS ll2, round(2 * (sum(l1) - sum(l0)), 4) AS lr_01, round(2 * (sum(l2) - sum(l1)), 4) AS lr_12 FROM l",
)
def m16_markov_order(spark, sf):
    """Likelihoods of Markov chains of order 0 to 2, from counts."""
    w = W.partitionBy("symbol").orderBy("open_time", "event_id")
    f = V.ledger(spark, sf).select(F.col("side").alias("c"), F.lag("side").over(w).alias("b"), F.lag("side", 2).over(w).alias("a")).where("a is not null")
    g = f.groupBy("a", "b", "c").agg(F.count("*").alias("k"))  # eight rows
    t = lambda *keys: F.sum("k").over(W.partitionBy(*keys))
    ll = lambda x, y: F.sum(F.col("k") * F.log(F.col(x) / F.col(y)))
    g = g.withColumns({"n": t(), "nc": t("c"), "nbc": t("b", "c"), "nb": t("b"), "nab": t("a", "b"), "nabc": t("a", "b", "c")})
    a = g.agg(F.sum("k").alias("n"), ll("nc", "n").alias("x0"), ll("nbc", "nb").alias("x1"), ll("nabc", "nab").alias("x2"))
    r4 = lambda e: F.round(F.expr(e), 4)
    return a.select("n", r4("x0").alias("ll0"), r4("x1").alias("ll1"), r4("x2").alias("ll2"), r4("2 * (x1 - x0)").alias("lr_01"), r4("2 * (x2 - x1)").alias("lr_12"))


@query(
    "m17_partial_correlation",
    WITH + ", d AS (SELECT symbol, mid - avg(mid) OVER p AS x, k - avg(k) OVER p AS y FROM ticks WINDOW p AS (PARTITION BY symbol, hour(ts))) SELECT symbol, round(corr(x, y), 6) AS partial FROM d GROUP BY 1",
)
def m17_partial_correlation(spark, sf):
    """Correlation given the hour: residuals from hourly means."""
    p = W.partitionBy("symbol", F.hour("ts"))
    d = V.ticks(spark, sf).select("symbol", (F.col("mid") - F.avg("mid").over(p)).alias("x"), (F.col("k") - F.avg("k").over(p)).alias("y"))
    return d.groupBy("symbol").agg(r6(F.corr("x", "y")).alias("partial"))


@query(
    "m19_sizing_rules",
    WITH + ", s AS (SELECT user_id, lot > 0.015 AS big, lag(pnl < 0) OVER w AS after_loss FROM ledger WINDOW w AS (PARTITION BY user_id ORDER BY open_time, event_id)) SELECT count(*) FILTER (big AND after_loss) AS tp, count(*) FILTER (NOT big AND after_loss) AS fp, count(*) FILTER (big AND NOT coalesce(after_loss, false)) AS fn, round(count(*) FILTER (big AND after_loss) / nullif(count(*) FILTER (after_loss), 0)::DOUBLE, 6) AS precision FROM s",
)
def m19_sizing_rules(spark, sf):
    """Does size follow a loss (M19)?"""
    w = W.partitionBy("user_id").orderBy("open_time", "event_id")
    s = V.ledger(spark, sf).select((F.col("lot") > 0.015).alias("big"), F.coalesce(F.lag(F.col("pnl") < 0).over(w), F.lit(False)).alias("al"))
    tp, hit = F.count_if(F.col("big") & F.col("al")), F.count_if("al")
    return s.agg(tp.alias("tp"), F.count_if(~F.col("big") & F.col("al")).alias("fp"), F.count_if(F.col("big") & ~F.col("al")).alias("fn"), r6(tp / F.when(hit != 0, hit)).alias("precision"))


@query("m01_logistic_folds")
def m01_logistic_folds(spark, sf):
    """Logistic regression on expanding folds, scored out of sample."""
    return M.walk_forward(M.panel(V.ticks(spark, sf), V.ledger(spark, sf)), "logistic")


@query("m02_forest_folds")
def m02_forest_folds(spark, sf):
    """Random forest on the same folds."""
    return M.walk_forward(M.panel(V.ticks(spark, sf), V.ledger(spark, sf)), "forest")


@query("m05_conditional_logit")
def m05_conditional_logit(spark, sf):
    """Conditional logit fitted by Newton steps; each step is one aggregate over the strata."""
    return M.conditional_logit(V.ticks(spark, sf).select("symbol", F.date_trunc("day", "ts").alias("day"), F.col("spread").alias("x0"), (F.col("mid") / 100).alias("x1"), "k"), ["x0", "x1"])


@query("m07_poisson_clock")
def m07_poisson_clock(spark, sf):
    """Poisson regression of counts on the clock's harmonics over hour cells."""
    return M.poisson_clock(V.ticks(spark, sf))


@query("m11_mixture")
def m11_mixture(spark, sf):
    """Gaussian mixture of log durations and results."""
    return M.mixture(V.ledger(spark, sf), 2)


@query(
    "m03_self_exciting",
    WITH + ", x AS (SELECT event_id, symbol, epoch_us(ts) AS us FROM ticks) SELECT a.event_id, round(coalesce(sum(exp(-0.0005 * (a.us - b.us) / 1e6)), 0), 6) AS excitation FROM x a LEFT JOIN x b ON b.symbol = a.symbol AND b.us < a.us GROUP BY 1",
)
def m03_self_exciting(spark, sf):
    """Decaying excitation by all earlier events, the state of self-exciting models."""
    return M.self_exciting(V.ticks(spark, sf).select("event_id", "symbol", "ts"), "symbol", 0.0005).select("event_id", r6("excitation").alias("excitation"))


@query(
    "m12_outliers",
    WITH + """, l AS (SELECT ticket, symbol, pnl, ln((epoch_us(close_time) - epoch_us(open_time)) / 1e6) AS d FROM ledger), m AS (SELECT symbol, quantile_cont(pnl, 0.5) AS mp, quantile_cont(d, 0.5) AS md FROM l GROUP BY 1),
a AS (SELECT symbol, quantile_cont(abs(pnl - mp), 0.5) AS ap, quantile_cont(abs(d - md), 0.5) AS ad FROM l JOIN m USING (symbol) GROUP BY 1), s AS (SELECT l.*, greatest(abs(pnl - mp) / (1.4826 * nullif(ap, 0)), abs(d - md) / (1.4826 * nullif(ad, 0)), 0) AS score FROM l JOIN m USING (symbol) JOIN a USING (symbol)),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, ticket) AS r FROM s) SELECT ticket, symbol, round(pnl, 6) AS pnl, round(d, 6) AS d, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 15""",
)
def m12_outliers(spark, sf):
    """Fifteen most unusual trades per symbol by robust z-scores."""
    led = V.ledger(spark, sf).select("ticket", "symbol", "pnl", F.log((F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(F.col("open_time").cast("timestamp"))) / 1e6).alias("d"))
    return M.robust_outliers(led, "symbol", ["pnl", "d"], 15).select("ticket", "symbol", r6("pnl").alias("pnl"), r6("d").alias("d"), r6("score").alias("score"), "rank")


@query("m13_segments")
def m13_segments(spark, sf):
    """Change points of the daily result by recursive splits."""
    daily = V.ledger(spark, sf).groupBy(F.to_date("open_time").alias("day")).agg(F.avg("pnl").alias("x"))
    return M.segments(daily, 3)


@query("m18_holding_ridge")
def m18_holding_ridge(spark, sf):
    """Ridge regression of the log holding time on expanding folds."""
    h = F.hour("open_time") * 0.2617993877991494
    y = F.log((F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(F.col("open_time").cast("timestamp"))) / 1e6)
    led = V.ledger(spark, sf)
    first, _ = S.span(led, "open_time")
    return M.ridge_folds(led.select(y.alias("y"), "lot", F.sin(h).alias("hs"), F.cos(h).alias("hc"), S.day_number("open_time", first).alias("day")))


@query(
    "m21_power_curve",
    f"""WITH g AS (SELECT n, r, unnest(range(1, n + 1)) AS i FROM (SELECT unnest([50, 100, 200, 400, 800]) AS n) CROSS JOIN (SELECT unnest(range(1, 201)) AS r)), x AS (SELECT n, r, sqrt(-2 * ln({R.uniform_sql("1", "n", "r", "i")})) * cos(6.283185307179586 * {R.uniform_sql("2", "n", "r", "i")}) + 0.15 AS x FROM g),
t AS (SELECT n, r, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM x GROUP BY 1, 2) SELECT CAST(n AS INTEGER) AS n, round(avg((t > 1.96)::INTEGER), 6) AS power FROM t GROUP BY 1""",
)
def m21_power_curve(spark, sf):
    """Share of replicates in which a planted effect passes, by sample size."""
    return R.power_curve(spark, [50, 100, 200, 400, 800], 0.15, 200).withColumn("power", r6("power"))


@query("sm2_weighted_sample", WITH + f", r AS (SELECT ticket, symbol, lot, row_number() OVER (PARTITION BY symbol ORDER BY -ln({R.uniform_sql('9', 'ticket')}) / lot, ticket) AS r FROM ledger) SELECT ticket, symbol, round(lot, 6) AS lot FROM r WHERE r <= 50")
def sm2_weighted_sample(spark, sf):
    """Fifty trades per symbol without replacement, chances by size: exponential keys by hash (SM2)."""
    return R.weighted_sample(V.ledger(spark, sf).select("ticket", "symbol", "lot"), "symbol", "lot", "ticket", 50).withColumn("lot", r6("lot"))


@query(
    "sm1_downsample",
    WITH + ", c AS (SELECT symbol, count(*) AS n FROM ledger GROUP BY 1), r AS (SELECT t.symbol, t.event_id, row_number() OVER (PARTITION BY t.symbol ORDER BY md5(concat('5:', t.event_id))) AS r FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.event_id = t.event_id)) SELECT r.symbol, r.event_id FROM r JOIN c ON c.symbol = r.symbol WHERE r.r <= greatest(2 * c.n, 20)",
)
def sm1_downsample(spark, sf):
    """Controls thinned to twice the cases, at least twenty, by hash order: the operator is a sample (SM1)."""
    led = V.ledger(spark, sf)
    n = led.groupBy("symbol").agg(F.greatest(2 * F.count("*"), F.lit(20)).alias("most"))
    t = V.ticks(spark, sf).join(led.select("event_id"), "event_id", "left_anti").select("symbol", "event_id")
    r = F.row_number().over(W.partitionBy("symbol").orderBy(F.md5(F.concat(F.lit("5:"), F.col("event_id").cast("string")))))
    return t.withColumn("r", r).join(F.broadcast(n), "symbol").where("r <= most").select("symbol", "event_id")


@query(
    "h16_burst_null",
    WITH + f""", t AS (SELECT symbol, event_id, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) % 86400000000 AS at0 FROM ticks), r AS (SELECT symbol, event_id, day, r, CASE WHEN r = 0 THEN at0 ELSE CAST(floor({R.uniform_sql("r", "event_id")} * 86400000000) AS BIGINT) END AS at1 FROM t CROSS JOIN (SELECT unnest(range(51)) AS r)),
n AS (SELECT *, coalesce(at1 - lag(at1) OVER (PARTITION BY symbol, day, r ORDER BY at1, event_id) > 1800000000, true) AS new FROM r), b AS (SELECT symbol, r, count(*) FILTER (new) / count(DISTINCT day)::DOUBLE AS b FROM n GROUP BY 1, 2)
SELECT b.symbol, round(any_value(o.b), 6) AS bursts_per_day, round(avg(b.b), 6) AS expected, round((1 + count(*) FILTER (b.b <= o.b)) / (1.0 + count(*)), 6) AS p_value FROM b JOIN b o ON o.symbol = b.symbol AND o.r = 0 WHERE b.r > 0 GROUP BY 1""",
)
def h16_burst_null(spark, sf):
    """Bursts per day against random clocks of the same counts."""
    b = R.burst_null(V.ticks(spark, sf), 1800, 50)
    return b.select("symbol", *[r6(c).alias(c) for c in b.columns if c != "symbol"])
