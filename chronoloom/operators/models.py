"""Fitted models: folds of classifiers, conditional logit, Poisson clock, mixtures. Data stay distributed; only parameters reach the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import splits as S


def _folds(data: DataFrame, folds: int) -> list[tuple[int, int]]:
    """(last training day, last test day) of expanding folds: two fifths of the days of ``data``, then a fifth more each."""
    days = data.agg(F.max("day")).first()[0] or 0
    return [(S.cut(days, (2 + i) / 5), S.cut(days, (3 + i) / 5)) for i in range(folds)]


def panel(ticks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Event panel: label and features of every tick, with the day since the first one for folds."""
    first, _ = S.span(ticks, "ts")
    y = ledger.select("event_id", F.lit(1.0).alias("label"))
    h = F.hour("ts") * (2 * np.pi / 24)
    p = ticks.join(y, "event_id", "left").select(F.coalesce("label", F.lit(0.0)).alias("label"), S.day_number("ts", first).alias("day"), "mid", "spread", F.col("k").cast("double").alias("k"), F.sin(h).alias("hs"), F.cos(h).alias("hc"))
    return VectorAssembler(inputCols=["mid", "spread", "k", "hs", "hc"], outputCol="features").transform(p)


def walk_forward(data: DataFrame, kind: str, folds: int = 3) -> DataFrame:
    """(fold, n, positives, auc, ll) of models fitted on all days before each fold's test days."""
    out = None
    for i, (cut, end) in enumerate(_folds(data, folds)):
        train, test = data.where(F.col("day") <= cut), data.where((F.col("day") > cut) & (F.col("day") <= end))
        model = LogisticRegression(regParam=0.01, elasticNetParam=0.0, maxIter=50) if kind == "logistic" else RandomForestClassifier(numTrees=20, maxDepth=5, seed=1)
        s = model.fit(train).transform(test).select("label", vector_to_array("probability")[1].alias("p"))
        g = s.groupBy(F.round("p", 6).alias("p")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))  # ties together
        from pyspark.sql import Window as W

        w = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        g = g.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("y")).over(w), F.lit(0.0)))
        clip = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
        a = g.agg(F.sum("n").alias("n"), F.sum("y").alias("positives"), (F.sum(F.col("y") * (F.col("below") + (F.col("n") - F.col("y")) / 2)) / (F.sum("y") * F.sum(F.col("n") - F.col("y")))).alias("auc"), F.sum(F.col("y") * F.log(clip) + (F.col("n") - F.col("y")) * F.log(1 - clip)).alias("ll"))
        a = a.select(F.lit(i).alias("fold"), "*")
        out = a if out is None else out.unionByName(a)
    return out


def conditional_logit(rows: DataFrame, features: list[str], steps: int = 6, l2: float = 1e-3) -> DataFrame:
    """Coefficients and likelihood of choosing the case (largest k, first by features) within each (symbol, day) stratum."""
    from pyspark.sql import Window as W

    case = F.row_number().over(W.partitionBy("symbol", "day").orderBy(F.desc("k"), *features)) == 1
    d = rows.withColumn("y", case.cast("double")).cache()
    beta = np.zeros(len(features))
    ll = 0.0
    for _ in range(steps):
        eta = sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, features, strict=True)), F.lit(0.0))
        e = d.withColumn("eta", eta).withColumn("e", F.exp(eta))
        m = [F.sum(F.col("e") * F.col(x)).alias(f"m_{x}") for x in features]
        c = [F.sum(F.col("e") * F.col(x) * F.col(z)).alias(f"c_{i}_{j}") for i, x in enumerate(features) for j, z in enumerate(features) if j >= i]
        s = e.groupBy("symbol", "day").agg(F.sum("e").alias("z"), F.sum(F.col("y") * F.col("eta")).alias("case_eta"), *m, *c, *[F.sum(F.col("y") * F.col(x)).alias(f"y_{x}") for x in features])
        g = [F.sum(F.col(f"y_{x}") - F.col(f"m_{x}") / F.col("z")).alias(f"g_{x}") for x in features]
        h = [F.sum(F.col(f"c_{i}_{j}") / F.col("z") - F.col(f"m_{x}") * F.col(f"m_{z}") / (F.col("z") * F.col("z"))).alias(f"h_{i}_{j}") for i, x in enumerate(features) for j, z in enumerate(features) if j >= i]
        r = s.agg(F.sum(F.col("case_eta") - F.log("z")).alias("ll"), *g, *h).first()  # one row of sums
        grad = np.array([r[f"g_{x}"] for x in features]) - l2 * beta
        hess = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(len(features))] for i in range(len(features))]) + l2 * np.eye(len(features))
        ll = r["ll"]
        beta = beta + np.linalg.solve(hess, grad)
    d.unpersist()
    return rows.sparkSession.createDataFrame([(x, float(b), float(ll)) for x, b in zip(features, beta, strict=True)], "feature string, beta double, ll double")


def poisson_clock(ticks: DataFrame) -> DataFrame:
    h = F.col("h") * (2 * np.pi / 24)
    cells = ticks.groupBy("symbol", F.hour("ts").alias("h")).agg(F.count("*").cast("double").alias("label"))
    cells = cells.withColumns({f"{f.__name__}_{k}": f(h * k) for k in (1, 2) for f in (F.sin, F.cos)})
    x = VectorAssembler(inputCols=[f"{f}_{k}" for k in (1, 2) for f in ("sin", "cos")], outputCol="features").transform(cells)
    m = GeneralizedLinearRegression(family="poisson", link="log", regParam=0.01).fit(x)
    return m.transform(x).select("symbol", "h", "label", F.round("prediction", 6).alias("expected"))


def mixture(ledger: DataFrame, k: int) -> DataFrame:
    d = ledger.select(F.log(F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(F.col("open_time").cast("timestamp"))).alias("d"), "pnl")
    x = VectorAssembler(inputCols=["d", "pnl"], outputCol="features").transform(d)
    m = GaussianMixture(k=k, seed=3, maxIter=20).fit(x)
    return m.transform(x).groupBy("prediction").agg(F.count("*").alias("n"), F.avg("d").alias("mean_log_duration"), F.avg("pnl").alias("mean_pnl"))


def self_exciting(events: DataFrame, key: str, decay_per_second: float) -> DataFrame:
    """Adds ``excitation``: the sum of exp(-decay * age) over the key's earlier events, an affine recurrence solved in blocks."""
    from chronoloom.operators import series

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = series.lagged(events.withColumn("_us", us), "_us", key=key, order="ts", out="_before")
    d = d.withColumn("_a", F.coalesce(F.exp(-decay_per_second * (F.col("_us") - F.col("_before")) / 1e6), F.lit(0.0))).drop("_us", "_before")
    # y = a * (y + 1) with y before the first event 0: an event counts one at its own time and decays from there
    return series.affine(d, key=key, order="ts", a=F.col("_a"), b=F.col("_a"), out="excitation").drop("_a")


def robust_outliers(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """The ``k`` rows per key furthest from the medians, by the largest robust z-score (stands in for an isolation forest)."""
    from pyspark.sql import Window as W

    med = df.groupBy(key).agg(*[F.percentile(x, F.lit(0.5)).alias(f"m_{x}") for x in features])
    d = df.join(F.broadcast(med), key)  # a row per key
    mad = d.groupBy(key).agg(*[F.percentile(F.abs(F.col(x) - F.col(f"m_{x}")), F.lit(0.5)).alias(f"d_{x}") for x in features])
    z = [F.abs(F.col(x) - F.col(f"m_{x}")) / F.when(F.col(f"d_{x}") != 0, 1.4826 * F.col(f"d_{x}")) for x in features]
    s = d.join(F.broadcast(mad), key).withColumn("score", F.greatest(*z, F.lit(0.0)))
    return s.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), *df.columns[:1]))).where(F.col("r") <= k).select(*df.columns, "score", F.col("r").alias("rank"))


def segments(daily: DataFrame, depth: int, least: int = 3) -> DataFrame:
    """Recursive splits of a daily series where they explain most; each level is one windowed pass over all segments."""
    from pyspark.sql import Window as W

    d = daily.select("day", "x", F.lit(0).alias("seg"))
    for level in range(depth):
        p = W.partitionBy("seg")
        w = p.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
        s = d.withColumns({"i": F.count("*").over(w), "c": F.sum("x").over(w), "n": F.count("*").over(p), "t": F.sum("x").over(p)})
        gain = F.when((F.col("i") >= least) & (F.col("n") - F.col("i") >= least), F.expr("c * c / i + (t - c) * (t - c) / (n - i) - t * t / n"))
        s = s.withColumn("gain", gain).withColumn("cut", F.max(F.struct("gain", "i")).over(p)["i"]).withColumn("top", F.max("gain").over(p))
        d = s.select("day", "x", F.when(F.col("top").isNotNull() & (F.col("i") > F.col("cut")), F.col("seg") + F.lit(1 << (depth - 1 - level))).otherwise(F.col("seg")).alias("seg"))
    return d


def ridge_folds(rows: DataFrame, folds: int = 3) -> DataFrame:
    """Mean absolute error of ridge regression of the log holding time against the training median, per fold."""
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=["lot", "hs", "hc"], outputCol="features").transform(rows)
    out = None
    for i, (cut, end) in enumerate(_folds(x, folds)):
        train, test = x.where(F.col("day") <= cut), x.where((F.col("day") > cut) & (F.col("day") <= end))
        m = LinearRegression(labelCol="y", regParam=1.0, elasticNetParam=0.0).fit(train)
        med = train.agg(F.percentile("y", F.lit(0.5)).alias("m")).first()["m"]
        a = m.transform(test).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"), F.avg(F.abs(F.col("y") - F.lit(med))).alias("mae_median")).select(F.lit(i).alias("fold"), "*")
        out = a if out is None else out.unionByName(a)
    return out


def weighted_logistic(rows: DataFrame, folds: int = 3) -> DataFrame:
    """(fold, penalty, bits, used): logistic models of label with weights ``w`` on expanding folds, for L2, elastic-net and
    L1 penalties; features are scaled by the fit, ``bits`` are per weighted event and against none."""
    h = F.col("hour") * (2 * np.pi / 24)
    x = VectorAssembler(inputCols=["mid", "spread", "hs", "hc"], outputCol="features").transform(rows.withColumns({"hs": F.sin(h), "hc": F.cos(h)}))
    out = []
    for i, (cut, end) in enumerate(_folds(x, folds)):
        train, test = x.where(F.col("day") <= cut), x.where((F.col("day") > cut) & (F.col("day") <= end))
        for name, net in (("l2", 0.0), ("elastic_net", 0.5), ("l1", 1.0)):
            m = LogisticRegression(weightCol="w", regParam=0.001, elasticNetParam=net, maxIter=40, standardization=True).fit(train)
            s = m.transform(test).select("label", "w", vector_to_array("probability")[1].alias("p"))
            p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
            bits = s.agg((F.sum(F.col("w") * (F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))) / F.sum(F.col("w") * F.col("label")) / np.log(2)).alias("bits"))
            out.append(bits.select(F.lit(i).alias("fold"), F.lit(name).alias("penalty"), F.round("bits", 4).alias("bits"), F.lit(int(np.count_nonzero(np.abs(m.coefficients.toArray()) > 1e-9))).alias("used")))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def exit_risk(ledger: DataFrame, cap: int = 60, width_us: int = 7_200_000_000) -> DataFrame:
    """(day, side, age, at_risk, exits): trades by day of entry (from the first one on), still open at each age of ``width_us``; the last age is censored.

    A trade is one number, its last age; at risk at an age are all whose last age is as great, so trades are counted by
    last age first and only those counts are spread over the ages before.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last = F.least(F.floor((us("close_time") - us("open_time")) / width_us).cast("int"), F.lit(cap))
    first, _ = S.span(ledger, "open_time")
    n = ledger.groupBy(S.day_number("open_time", first).alias("day"), "side", last.alias("last")).agg(F.count("*").alias("n"))
    a = n.withColumn("age", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return a.groupBy("day", "side", "age").agg(F.sum("n").alias("at_risk"), F.sum(F.when((F.col("age") == F.col("last")) & (F.col("last") < cap), F.col("n")).otherwise(0)).alias("exits"))


def exit_hazard(risk: DataFrame, train_share: float = 0.5, inner_share: float = 1 / 3) -> DataFrame:
    """(model, setting, n, exits, expected, bits) on the days after ``train_share`` of them: constant, logistic and spline Poisson hazards of exit by age.

    The logistic penalty is the one that is best on the days after ``inner_share`` when fitted before; knots of the natural
    spline are quantiles of the training exits' ages. The cells are few, so the fits read counts, not trades.
    """
    days = risk.agg(F.max("day")).first()[0] or 0
    train_to, inner_to = S.cut(days, train_share), S.cut(days, inner_share)
    cells = risk.groupBy("day", "side", "age").agg(F.sum("at_risk").alias("at_risk"), F.sum("exits").alias("exits"))
    sum_of = lambda d: d.groupBy("side", "age").agg(F.sum("at_risk").cast("double").alias("at_risk"), F.sum("exits").cast("double").alias("exits"))
    train, test, inner, outer = (sum_of(cells.where(c)) for c in (F.col("day") <= train_to, F.col("day") > train_to, F.col("day") <= inner_to, (F.col("day") > inner_to) & (F.col("day") <= train_to)))
    q = train.select(F.percentile("age", F.array(*map(F.lit, (0.05, 0.35, 0.65, 0.95))), F.col("exits").cast("int")).alias("q")).first()["q"]  # four numbers
    x = F.col("age").cast("double")
    cube = lambda k: F.pow(F.greatest(x - float(k), F.lit(0.0)), 3) / float(q[-1] - q[0] + 1e-9) ** 2
    tail = lambda k: (cube(k) - cube(q[-1])) / float(q[-1] - k + 1e-9)
    spline = {f"s{i}": tail(k) - tail(q[-2]) for i, k in enumerate(q[:-2])}
    made = VectorAssembler(inputCols=["la", "buy", *spline], outputCol="features")
    with_x = lambda d: made.transform(d.withColumns({"la": F.log1p(x), "buy": (F.col("side") == "Buy").cast("double"), **spline}))

    def bits(d: DataFrame, p) -> DataFrame:
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        ll = F.sum(F.col("exits") * F.log(p) + (F.col("at_risk") - F.col("exits")) * F.log(1 - p))
        return d.agg(F.sum("at_risk").alias("n"), F.sum("exits").alias("exits"), F.sum(F.col("at_risk") * p).alias("expected"), (ll / F.sum("exits") / np.log(2)).alias("bits"))

    def logistic(d: DataFrame, c: float):
        hit = with_x(d).withColumn("l", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("exits").alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("at_risk") - F.col("exits")).alias("w")))))
        return LogisticRegression(weightCol="w", regParam=c, maxIter=50).fit(hit.select("features", "l.*").where("w > 0"))

    score = lambda m, d: bits(m.transform(with_x(d)), vector_to_array("probability")[1])
    grid = {c: score(logistic(inner, c), outer).first()["bits"] for c in (1e-4, 1e-3, 1e-2)}
    best = max(grid, key=lambda c: (grid[c] is not None, grid[c]))
    rate = train.agg(F.sum("exits") / F.sum("at_risk")).first()[0]
    g = GeneralizedLinearRegression(family="poisson", link="log", offsetCol="o", labelCol="exits", maxIter=50).fit(with_x(train).withColumn("o", F.log("at_risk")))
    poisson = bits(g.transform(with_x(test).withColumn("o", F.log("at_risk"))), F.col("prediction") / F.col("at_risk"))
    rows = [("constant", "", bits(test, F.lit(float(rate)))), ("logistic", f"penalty {best:g}", score(logistic(train, best), test)), ("spline_poisson", f"knots {', '.join(f'{k:g}' for k in q)}", poisson)]
    out = None
    for model, setting, d in rows:
        d = d.select(F.lit(model).alias("model"), F.lit(setting).alias("setting"), "n", "exits", F.round("expected", 4).alias("expected"), F.round("bits", 4).alias("bits"))
        out = d if out is None else out.unionByName(d)
    return out


def stratified_fit(d: DataFrame, features: list[str], l2: float, steps: int = 4) -> np.ndarray:
    """Coefficients of a conditional logit of ``y`` within (symbol, day); strata may hold several cases. Each Newton step is one aggregate."""
    beta = np.zeros(len(features))
    for _ in range(steps if features else 0):
        s = _stratum_sums(d, features, beta)
        n = len(features)
        g = [F.sum(F.col(f"y{i}") - F.col("c") * F.col(f"m{i}") / F.col("z")).alias(f"g{i}") for i in range(n)]
        h = [F.sum(F.col("c") * (F.col(f"m{i}_{j}") / F.col("z") - F.col(f"m{i}") * F.col(f"m{j}") / (F.col("z") * F.col("z")))).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
        r = s.agg(*g, *h).first()  # one row of sums
        grad = np.array([r[f"g{i}"] or 0.0 for i in range(n)]) - l2 * beta
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)]) + l2 * np.eye(n)
        beta = beta + np.linalg.solve(hess, grad)
    return beta


def _stratum_sums(d: DataFrame, features: list[str], beta: np.ndarray) -> DataFrame:
    eta = F.lit(0.0)
    for b, x in zip(beta, features, strict=True):
        eta = eta + F.lit(float(b)) * F.col(x)
    e = d.withColumn("e", F.exp(eta)).withColumn("eta", eta)
    n = range(len(features))
    sums = [F.sum(F.col("e") * F.col(features[i])).alias(f"m{i}") for i in n] + [F.sum(F.col("e") * F.col(features[i]) * F.col(features[j])).alias(f"m{i}_{j}") for i in n for j in n if j >= i]
    return e.groupBy("symbol", "day").agg(F.sum("e").alias("z"), F.sum("y").alias("c"), F.sum(F.col("y") * F.col("eta")).alias("ye"), F.count("*").alias("k"), *sums, *[F.sum(F.col("y") * F.col(features[i])).alias(f"y{i}") for i in n])


def ladder(rows: DataFrame, models: list[list[str]], *, train_share: float = 0.6, inner_share: float = 0.4, grid: tuple[float, ...] = (0.1, 10.0)) -> DataFrame:
    """(model, features, penalty, cases, ll, gain) of nested conditional logits on the days after ``train_share`` of them.

    Features are standardised by the days that teach; the penalty is the one that does best after ``inner_share`` when
    fitted before it, later days never choosing for earlier ones. Rows: symbol, day, d (day number), y and the features.
    """
    days = rows.agg(F.max("d")).first()[0] or 0
    train_to, inner_to = S.cut(days, train_share), S.cut(days, inner_share)
    names = sorted({x for m in models for x in m})

    def scaled(data: DataFrame, by: DataFrame) -> DataFrame:
        z = by.agg(*[x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()  # two numbers a feature
        return data.withColumns({c: (F.col(c) - float(z[f"m_{c}"])) / float(z[f"s_{c}"] or 1.0) for c in names})

    def ll(d: DataFrame, features: list[str], beta: np.ndarray):
        return _stratum_sums(d, features, beta).agg(F.sum(F.col("ye") - F.col("c") * F.log("z")).alias("ll"), F.sum(-F.col("c") * F.log("k")).alias("null_ll"), F.sum("c").alias("cases")).first()

    first, second, train, test = (rows.where(c) for c in (F.col("d") <= inner_to, (F.col("d") > inner_to) & (F.col("d") <= train_to), F.col("d") <= train_to, F.col("d") > train_to))
    a, b = scaled(first, first).cache(), scaled(second, first).cache()
    c, e = scaled(train, train).cache(), scaled(test, train).cache()
    out = []
    for i, features in enumerate(models):
        best = max(grid, key=lambda g: ll(b, features, stratified_fit(a, features, g))["ll"]) if features else 0.0
        r = ll(e, features, stratified_fit(c, features, best))
        out.append((f"M{i}", ",".join(features), float(best), int(r["cases"]), round(r["ll"] / r["cases"], 6), round((r["ll"] - r["null_ll"]) / r["cases"], 6)))
    for d in (a, b, c, e):
        d.unpersist()
    return rows.sparkSession.createDataFrame(out, "model string, features string, penalty double, cases long, ll double, gain double")


def _spread_starts(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the rows, each drawn with chances by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    picked = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in picked], axis=0)
        picked.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
    return np.array(picked)


def _log_densities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - mean
    return np.log(weight) - 0.5 * (np.log(np.linalg.det(cov)) + np.einsum("nki,kij,nkj->nk", d, np.linalg.inv(cov), d)) - np.log(2 * np.pi)


def mixture_selection(ledger: DataFrame, most: int = 6, rounds: int = 25) -> DataFrame:
    """(parts, ll, bic, chosen, stability) of Gaussian mixtures of log durations and results: the least BIC is chosen, and
    stability is the adjusted Rand index of two fits from different starts, from their table of joint labels.

    Starts come from 2,000 rows; each round of expectation and maximisation is one pass over all rows for all mixtures at
    once, in which tasks give sums and the driver gets six numbers a part.
    """
    d = ledger.select(F.log(F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(F.col("open_time").cast("timestamp"))).alias("d"), "pnl").where("d is not null and pnl is not null")
    z = d.agg(F.avg("d").alias("md"), F.stddev_pop("d").alias("sd"), F.avg("pnl").alias("mp"), F.stddev_pop("pnl").alias("sp"), F.count("*").alias("n")).first()
    scale = [float(z["sd"] or 1), float(z["sp"] or 1)]
    x = d.select(((F.col("d") - float(z["md"])) / scale[0]).alias("a"), ((F.col("pnl") - float(z["mp"])) / scale[1]).alias("b")).cache()
    sample = np.array([[r["a"], r["b"]] for r in x.orderBy(F.xxhash64("a", "b")).limit(2000).collect()])
    fits = {(k, s): (np.full(k, 1 / k), _spread_starts(sample, k, s), np.array([np.eye(2) / k] * k)) for k in range(1, most + 1) for s in ((3, 11) if k > 1 else (3,))}

    def sums(batches):
        total = {m: np.zeros((m[0], 7)) for m in fits}
        for pdf in batches:
            v = pdf[["a", "b"]].to_numpy()
            terms = np.column_stack([np.ones(len(v)), v, v[:, 0] ** 2, v[:, 0] * v[:, 1], v[:, 1] ** 2])
            for m, f in fits.items():
                logs = _log_densities(v, *f)
                top = logs.max(axis=1, keepdims=True)
                norm = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
                total[m][:, :6] += np.exp(logs - norm).T @ terms
                total[m][0, 6] += norm.sum()
        yield pd.DataFrame([(*m, i, float(t)) for m, s in total.items() for i, t in enumerate(s.ravel())], columns=["k", "s", "i", "v"])

    ll: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        got: dict[tuple[int, int], np.ndarray] = {m: np.zeros(m[0] * 7) for m in fits}
        for r in x.mapInPandas(sums, "k int, s int, i int, v double").groupBy("k", "s", "i").agg(F.sum("v").alias("v")).collect():
            got[r["k"], r["s"]][r["i"]] = r["v"]
        for m, t in got.items():
            t = t.reshape(m[0], 7)
            ll[m] = t[0, 6]
            n = np.maximum(t[:, 0], 1e-9)
            mean = t[:, 1:3] / n[:, None]
            second = np.stack([t[:, 3] / n, t[:, 4] / n, t[:, 4] / n, t[:, 5] / n], axis=1).reshape(-1, 2, 2)
            fits[m] = (n / n.sum(), mean, second - mean[:, :, None] * mean[:, None, :] + 1e-4 * np.eye(2))

    def labels(batches):
        for pdf in batches:
            v = pdf[["a", "b"]].to_numpy()
            for k in range(2, most + 1):
                p, q = (_log_densities(v, *fits[k, s]).argmax(axis=1) for s in (3, 11))
                pair, count = np.unique(p * k + q, return_counts=True)
                yield pd.DataFrame({"k": k, "i": pair.astype(int), "n": count.astype(int)})

    tables = {k: np.zeros((k, k)) for k in range(2, most + 1)}
    for r in x.mapInPandas(labels, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        tables[r["k"]].ravel()[r["i"]] = r["n"]
    x.unpersist()
    n = z["n"]
    pairs = lambda t: float((t * (t - 1) / 2).sum())
    rows = []
    for k in range(1, most + 1):
        best = max(ll[m] for m in fits if m[0] == k) - n * np.log(scale[0] * scale[1])
        stability = 1.0
        if k > 1:
            both, p, q, total = pairs(tables[k]), pairs(tables[k].sum(axis=1)), pairs(tables[k].sum(axis=0)), n * (n - 1) / 2
            stability = (both - p * q / total) / ((p + q) / 2 - p * q / total) if (p + q) / 2 != p * q / total else 1.0
        rows.append((k, round(float(best), 3), round(float(-2 * best + (6 * k - 1) * np.log(n)), 3), round(float(stability), 6)))
    chosen = min(rows, key=lambda r: r[2])[0]
    return ledger.sparkSession.createDataFrame([(k, l, bic, k == chosen, s) for k, l, bic, s in rows], "parts int, ll double, bic double, chosen boolean, stability double")
