"""Sequence models, unusual rows, change points, tree rules and folds (parts of SURVEY M and C)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import conditional as C
from chronoloom.operators import detection as D
from chronoloom.operators import placebo as P
from chronoloom.operators import sequences as Q
from chronoloom.operators import splits as S
from chronoloom.plans import views as V
from chronoloom.plans.views import WITH, r6
from chronoloom.registry import query


def _trades(spark, sf):
    """Trades with the features of the latent models: log duration, result per lot, log time since the user's last entry, clock."""
    led = V.ledger(spark, sf)
    w = W.partitionBy("symbol").orderBy("open_time", "event_id")
    gap = (S.micros("open_time") - F.lag(S.micros("open_time")).over(w)) / 6e7
    h = (F.hour("open_time") + F.minute("open_time") / 60) * (2 * np.pi / 24)
    minutes = (S.micros("close_time") - S.micros("open_time")) / 6e7
    return led.select("event_id", "ticket", "symbol", "side", "lot", "open_time", F.log1p(minutes).alias("log_duration"), (F.col("pnl") / (F.col("lot") * 100)).alias("result"), F.log1p(F.greatest(gap, F.lit(0.0))).alias("log_gap"), F.sin(h).alias("hs"), F.cos(h).alias("hc"))


_LATENT = ["log_duration", "result", "log_gap"]


@query("m11_hidden_states")
def m11_hidden_states(spark, sf):
    """Hidden Markov models of one to six states over each symbol's trades in order: likelihood, AIC, BIC, state shares."""
    fits = Q.fit_hidden(_trades(spark, sf), "symbol", "open_time", "event_id", _LATENT, most=6, rounds=15)
    return Q.hidden_selection(spark, fits, len(_LATENT))


@query("m11_state_of_trade")
def m11_state_of_trade(spark, sf):
    """Every trade's most likely state in a hidden Markov model of two states, by its symbol's whole sequence."""
    t = _trades(spark, sf)
    h, *_ = Q.fit_hidden(t, "symbol", "open_time", "event_id", _LATENT, most=2, rounds=15)[-1]
    return Q.hidden_labels(t, h, "symbol", "open_time", "event_id", _LATENT)


@query("m12_isolation_forest")
def m12_isolation_forest(spark, sf):
    """The fifteen trades that a forest of random trees isolates soonest; all trades are scored."""
    t = D.isolation_forest(_trades(spark, sf), "event_id", ["hs", "hc", *_LATENT, "lot"], trees=100)
    return t.select("ticket", "symbol", "side", *_LATENT, "score").orderBy(F.desc_nulls_last("score"), "ticket").limit(15)


@query("m13_change_points")
def m13_change_points(spark, sf):
    """Segments between change points of each symbol's hourly trading under a kernel cost, cheapest segmentation, for four penalties."""
    t = _trades(spark, sf).groupBy("symbol", F.date_trunc("hour", "open_time").alias("hour"))
    hourly = t.agg(F.avg("log_duration").alias("log_duration"), F.avg("result").alias("result"), F.count("*").cast("double").alias("trades"))
    return D.change_points(hourly, "symbol", "hour", ["log_duration", "result", "trades"], least=30)


def _epochs(spark, sf):
    """Decision epochs: all ticks, with whether a trade of the symbol opens before its next one."""
    t = V.ticks(spark, sf).select("event_id", "symbol", "ts", "mid", "spread", F.col("k").cast("double").alias("k"))
    led = V.ledger(spark, sf).select("symbol", "open_time")
    hit = A.asof(led, t.select("symbol", F.col("ts").alias("_ts"), F.col("event_id").alias("_id")), on="symbol", left_ts="open_time", right_ts="_ts", take=["_id"])
    hit = hit.select("_id").where("_id is not null").distinct()
    h = F.hour("ts") * (2 * np.pi / 24)
    out = t.join(hit, F.col("event_id") == F.col("_id"), "left").withColumn("label", F.col("_id").isNotNull().cast("int")).drop("_id")
    return out.withColumns({"one": F.lit(1.0), "hs": F.sin(h), "hc": F.cos(h)})


@query("m03_joint_excitation")
def m03_joint_excitation(spark, sf):
    """Event models on expanding folds: constant rate, clock, and clock with self-excitation whose weights, jump and decay are fitted together."""
    e = _epochs(spark, sf)
    first, days = S.span(e, "ts")
    rows = []
    for i in range(3):
        last, test = S.cut(days, (2 + i) / 5), S.cut(days, (3 + i) / 5)
        d = e.withColumn("day", S.day_number("ts", first)).where(F.col("day") <= test).withColumn("part", (F.col("day") > last).cast("int"))
        n = {r["part"]: (r["n"], r["y"]) for r in d.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()}
        y = n.get(1, (0, 0))[1]
        base = None
        for name, features, decays in (("rate", ["one"], ()), ("clock", ["one", "hs", "hc"], ()), ("clock_excited", ["one", "hs", "hc"], (0.01, 0.0003))):
            v, ll = Q.fit_excitation(d, "symbol", "ts", "event_id", "label", features, "part", decays=decays, rounds=12)
            base = ll if base is None else base
            jump, decay = (float(np.exp(x)) for x in v[-2:]) if decays else (None, None)
            bits = lambda k: round(float((ll[k] - base[k]) / np.log(2) / max(1, n.get(k, (0, 0))[1])), 6)  # noqa: B023, E731
            rows.append((i, name, n.get(1, (0, 0))[0], y, round(float(ll[0]), 4), round(float(ll[1]), 4), bits(0), bits(1), jump, decay))
    return spark.createDataFrame(rows, "fold int, model string, test_n long, test_events long, train_ll double, test_ll double, train_bits double, test_bits double, jump double, decay_per_second double")


@query("m02_tree_rules")
def m02_tree_rules(spark, sf):
    """Boosted trees as rules, with support and lift on the last two fifths of the days; ``differs`` counts rows on which rules and trees disagree."""
    e = _epochs(spark, sf)
    first, days = S.span(e, "ts")
    rules, scored = D.boosted_rules(e, "label", ["mid", "spread", "k", "hs", "hc"], S.day_number("ts", first) <= S.cut(days, 0.6))
    differs = scored.agg(F.count_if(F.abs(F.col("model_p") - F.col("rules_p")) > 1e-9).alias("differs"))
    return rules.join(F.broadcast(differs))  # one row


_ROLE = "CASE WHEN x <= train_end AND (until >= test_start OR x >= test_start - {embargo}) THEN 'purged' WHEN x <= train_end THEN 'train' WHEN x BETWEEN test_start AND test_end THEN 'test' ELSE 'excluded' END AS role"
_COUNT = "SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n, round(avg(pnl), 6) AS mean_pnl FROM a GROUP BY 1, 2"


def _counted(d):
    return d.groupBy("fold", "role").agg(F.count("*").alias("n"), r6(F.avg("pnl")).alias("mean_pnl"))


@query(
    "c11_event_folds",
    WITH + ", u AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT epoch_us(open_time) AS us FROM ledger)), k AS (SELECT DISTINCT n, n * 2 // 5 AS m, greatest(1, (n - n * 2 // 5) // 4) AS size FROM u), f AS (SELECT i + 1 AS fold, m + i * size - 1 AS a, m + i * size AS b, CASE WHEN i = 3 THEN n - 1 ELSE m + (i + 1) * size - 1 END AS c FROM k, range(4) r(i)), "
    "b AS (SELECT fold, p.us AS train_end, q.us AS test_start, w.us AS test_end FROM f JOIN u p ON p.r = a JOIN u q ON q.r = b JOIN u w ON w.r = c), l AS (SELECT epoch_us(open_time) AS x, epoch_us(close_time) AS until, pnl FROM ledger), a AS (SELECT fold, pnl, " + _ROLE.format(embargo=900_000_000) + " FROM l, b) " + _COUNT,
)
def c11_event_folds(spark, sf):
    """Four expanding folds of equal numbers of event times after the first two fifths, purged and with fifteen minutes of embargo."""
    led = V.ledger(spark, sf)
    least = led.select("open_time").distinct().count() * 2 // 5
    borders = S.event_borders(led, "open_time", least, 4)
    return _counted(S.roles(led, S.micros("open_time"), borders, S.micros("close_time"), 900_000_000))


@query(
    "c11_row_folds",
    WITH + ", l AS (SELECT row_number() OVER (ORDER BY open_time, event_id) - 1 AS x, NULL::BIGINT AS until, pnl FROM ledger), k AS (SELECT count(*) AS n, count(*) // 6 AS size FROM l), b AS (SELECT i AS fold, size * i - 1 AS train_end, size * i + 10 AS test_start, CASE WHEN i < 5 THEN size * (i + 1) ELSE n END - 1 AS test_end FROM k, range(1, 6) r(i)), a AS (SELECT fold, pnl, " + _ROLE.format(embargo=0) + " FROM l, b) " + _COUNT,
)
def c11_row_folds(spark, sf):
    """Five expanding folds of equal numbers of rows, ten rows between train and test left out (C11)."""
    led = S.exact_ranks(V.ledger(spark, sf), "open_time", "event_id")
    return _counted(S.roles(led, F.col("rank"), S.row_borders(led.count(), 5, 10)))


@query(
    "c11_time_folds",
    WITH + ", l AS (SELECT epoch_us(open_time) AS x, epoch_us(close_time) AS until, pnl FROM ledger), k AS (SELECT min(x) AS lo, max(x) AS hi FROM l), c AS (SELECT i, lo + CAST(floor((hi - lo) * s) AS BIGINT) AS c, hi FROM k, (VALUES (1, 0.5::DOUBLE), (2, 0.7::DOUBLE), (3, 0.85::DOUBLE)) v(i, s)), b AS (SELECT i AS fold, c AS train_end, c + 1 AS test_start, coalesce(lead(c) OVER (ORDER BY i), hi) AS test_end FROM c), a AS (SELECT fold, pnl, " + _ROLE.format(embargo=0) + " FROM l, b) " + _COUNT,
)
def c11_time_folds(spark, sf):
    """Expanding folds at shares of the time, purged."""
    led = V.ledger(spark, sf)
    return _counted(S.roles(led, S.micros("open_time"), S.share_borders(led, "open_time", (0.5, 0.7, 0.85)), S.micros("close_time")))


@query("m06_single_features")
def m06_single_features(spark, sf):
    """Each feature's conditional fit beside the clock's offset, strata of a symbol's day with its busiest tick as case, and
    the gain's chance under cases drawn by the clock alone (M06)."""
    t = V.ticks(spark, sf)
    rate = t.groupBy("symbol", F.hour("ts").alias("h")).agg(F.log(F.count("*")).alias("clock"))
    t = t.withColumn("h", F.hour("ts")).join(F.broadcast(rate), ["symbol", "h"])  # 24 rows a symbol
    w = W.partitionBy("symbol", F.to_date("ts"))
    t = t.withColumns({"day": F.to_date("ts"), "y": (F.row_number().over(w.orderBy(F.desc("k"), "event_id")) == 1).cast("int"), "minute": F.minute("ts").cast("double")})
    features = ["mid", "spread", "minute"]
    scale = t.agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    t = t.select("symbol", "day", "y", "clock", *[((F.col(c) - scale[f"m_{c}"]) / (scale[f"s_{c}"] or 1.0)).alias(c) for c in features])
    fits = C.fit_single_features(t, ["symbol", "day"], "y", "clock", features, within=1e-5)
    tested = C.randomized_gain(t, ["symbol", "day"], "y", "clock", {r["feature"]: r["beta"] for r in fits.collect()}, replicates=1999)
    return fits.join(tested.select("feature", "p_value"), "feature").select("feature", F.round("beta", 4).alias("beta"), F.round("ll", 4).alias("ll"), F.round("gain", 4).alias("gain"), "p_value")


@query("h14_clock_placebos")
def h14_clock_placebos(spark, sf):
    """How often entries go against the last 1, 2, 4 or 8 ticks' move, against entries redrawn at the same clock, uniformly over
    the symbol's ticks, and corrected for the best of the four windows (H14)."""
    e = _epochs(spark, sf).join(V.ticks(spark, sf).select("event_id", "user_id"), "event_id")
    w = W.partitionBy("symbol").orderBy("ts", "event_id")
    side = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    windows = {f"against_{n}": (F.signum(F.col("mid") - F.lag("mid", n).over(w)) * side < 0).cast("int") for n in (1, 2, 4, 8)}
    e = e.withColumns(windows).withColumns({"hit": F.col("label") == 1, "hour": F.hour("ts")})
    same = P.stratum_placebo(e, ["symbol", "hour"], list(windows), "hit").withColumn("placebo", F.lit("same_clock"))
    uniform = P.stratum_placebo(e, ["symbol"], list(windows), "hit", replace=True).withColumn("placebo", F.lit("uniform_clock"))
    return same.unionByName(uniform).select("placebo", "score", "n", *[r6(c).alias(c) for c in ("observed", "null_mean", "null_q95", "p_value", "max_p_value")])


@query("h17_uniform_seconds")
def h17_uniform_seconds(spark, sf):
    """Seconds of the minute at which trades open and close, against equal chances by 19,999 multinomial draws."""
    led = V.ledger(spark, sf)
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.second(c).alias("second")) for n, c in (("open", "open_time"), ("close", "close_time"))])).alias("b")
    return P.uniform_cells(led.select("symbol", both).select("symbol", "b.*"), ["symbol", "what"], "second", 60).withColumn("chi_square", r6("chi_square"))
