"""Penalised conditional logit chosen by grouped folds, frozen, and judged once on strata that nothing was learnt from.

Rows are (stratum columns, y, features); a stratum has exactly one row with y = 1, the case. All penalties and folds are
fitted together: each row meets every model's coefficients, sums by stratum and model are combined before the shuffle
(so a stratum may hold any share of the rows), and one pass gives all likelihoods, gradients and curvatures. Only these
sums, a few numbers a model, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.splits import exact_ranks

PENALTIES = (1e-4, 1e-3, 5e-3, 1e-2, 5e-2, 1e-1, 5e-1, 1.0)


@dataclass(frozen=True)
class Frozen:
    """What is fixed before the lockbox is opened."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    penalty: float
    beta: tuple[float, ...]

    def eta(self) -> Column:
        """The score of a row of raw features; null if any is missing."""
        one = lambda c, m, s, b: (F.col(c) - F.lit(m)) / F.lit(s) * F.lit(b)
        return sum((one(*t) for t in zip(self.features, self.mean, self.sd, self.beta, strict=True)), F.lit(0.0))


def scaling(rows: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Means and standard deviations (of the population; below 1e-8: 1)."""
    r = rows.agg(*[f(c).alias(f"{p}_{c}") for c in features for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    sd = [r[f"s_{c}"] for c in features]
    return [r[f"m_{c}"] or 0.0 for c in features], [s if s is not None and s >= 1e-8 else 1.0 for s in sd]


def stratum_folds(rows: DataFrame, strata: list[str], at: str, folds: int) -> DataFrame:
    """(strata, fold): strata in the order of their first ``at``, cut to equal numbers, the first folds taking one more if there is a rest."""
    s = rows.groupBy(*strata).agg(F.min(F.col(at).cast("timestamp")).alias("_at"))
    n = s.count()
    k = max(1, min(folds, n))
    size, rest = divmod(n, k)
    r = exact_ranks(s, "_at", *strata, out="_rank", stretch=86400)
    big = (size + 1) * rest
    fold = F.when(F.col("_rank") < big, F.floor(F.col("_rank") / (size + 1))).otherwise(rest + F.floor((F.col("_rank") - big) / max(size, 1)))
    return r.select(*strata, fold.cast("int").alias("fold"))


def _sums(rows: DataFrame, strata: int, features: int, models: list[tuple[int, np.ndarray]]):
    """(cases, log-likelihood, gradient, curvature) by model number and side (held out or not), of columns _g0.., _x0.., _y and _fold."""
    pairs = [(i, j) for i in range(features) for j in range(i, features)]
    model = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.lit(out).alias("out"), F.array(*[F.lit(float(b)) for b in beta]).alias("b")) for i, (out, beta) in enumerate(models)]))
    d = rows.withColumn("_m", model).select("*", "_m.m", "_m.out", "_m.b")
    x = [F.col(f"_x{i}") for i in range(features)]
    d = d.withColumn("_e", sum((F.get("b", F.lit(i)) * c for i, c in enumerate(x)), F.lit(0.0))).withColumn("_w", F.exp("_e"))
    g = d.groupBy(*[f"_g{i}" for i in range(strata)], "m", (F.col("_fold") == F.col("out")).alias("held")).agg(
        F.count_if("_y").alias("cases"), F.sum("_w").alias("z"), F.sum(F.when(F.col("_y"), F.col("_e"))).alias("ce"),
        *[F.sum(F.col("_w") * c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(F.when(F.col("_y"), c)).alias(f"c{i}") for i, c in enumerate(x)],
        *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs],
    )
    grad = [F.sum(F.col(f"c{i}") - F.col(f"s{i}") / F.col("z")).alias(f"g{i}") for i in range(len(x))]
    curve = [F.sum(F.col(f"s{i}_{j}") / F.col("z") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("z") * F.col("z"))).alias(f"h{i}_{j}") for i, j in pairs]
    r = g.groupBy("m", "held").agg(F.count_if(F.col("cases") != 1).alias("bad"), F.count("*").alias("n"), F.sum(F.col("ce") - F.log("z")).alias("ll"), *grad, *curve).collect()
    if any(t["bad"] for t in r):
        raise ValueError("a stratum does not have exactly one case")
    out = {}
    for t in r:
        h = np.zeros((len(x), len(x)))
        for i, j in pairs:
            h[i, j] = h[j, i] = t[f"h{i}_{j}"]
        out[t["m"], t["held"]] = t["n"], t["ll"], np.array([t[f"g{i}"] for i in range(len(x))]), h
    return out


def fit_all(rows: DataFrame, strata: list[str], y: str, features: list[str], penalties: tuple[float, ...] = PENALTIES, *, passes: int = 50, within: float = 1e-9) -> list[dict]:
    """Fits every penalty on all strata and, for each ``fold`` of the rows, without that fold.

    Returns one dict a model: penalty, fold (-1: none left out), beta, train_ll, train_n, held_ll, held_n, passes. Newton steps,
    halved while they do not raise the penalised likelihood; a model is done when its step promises less than ``within``.
    Features should be standardised. Rows with a null feature are left out; a stratum without exactly one case is an
    error, as is a score beyond what exp can hold.
    """
    clean = rows.dropna(subset=[*strata, *features]).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(strata)], F.col("fold").alias("_fold"), (F.col(y) == 1).alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]).cache()
    folds = sorted(r["_fold"] for r in clean.select("_fold").distinct().collect())
    models = [(p, f) for p in penalties for f in (-1, *(folds if len(folds) > 1 else []))]
    k = len(features)
    base, trial = [np.zeros(k) for _ in models], [np.zeros(k) for _ in models]
    best: list[tuple | None] = [None] * len(models)
    open_, done_at = set(range(len(models))), [0] * len(models)
    for step in range(1, passes + 1):
        now = sorted(open_)
        s = _sums(clean, len(strata), k, [(models[i][1], trial[i]) for i in now])
        for place, i in enumerate(now):
            n, ll, g, h = s.get((place, False), (0, 0.0, np.zeros(k), np.zeros((k, k))))
            held = s.get((place, True), (0, 0.0))[:2]
            value = ll - 0.5 * models[i][0] * trial[i] @ trial[i]
            if not np.isfinite(value):
                raise ValueError("a score is beyond the range of exp: standardise the features")
            if best[i] is None or value >= best[i][0] - 1e-12 * max(1.0, abs(best[i][0])):
                gain, h = g - models[i][0] * trial[i], h + models[i][0] * np.eye(k)
                move = np.linalg.solve(h, gain) if k else gain
                base[i], best[i], done_at[i] = trial[i], (value, n, ll, *held), step
                if gain @ move < within:
                    open_.discard(i)
                trial[i] = base[i] + move
            else:
                trial[i] = (trial[i] + base[i]) / 2
                if np.abs(trial[i] - base[i]).max() < 1e-12:
                    open_.discard(i)
        if not open_:
            break
    clean.unpersist()
    return [{"penalty": p, "fold": f, "beta": base[i], "train_n": best[i][1], "train_ll": best[i][2], "held_n": best[i][3], "held_ll": best[i][4], "passes": done_at[i]} for i, (p, f) in enumerate(models)]


def choose(fits: list[dict]) -> tuple[float, dict[float, float]]:
    """(the penalty with the greatest held-out likelihood a case, the first of equals; that likelihood by penalty)."""
    score = {}
    for p in dict.fromkeys(f["penalty"] for f in fits):
        held = [f for f in fits if f["penalty"] == p and f["fold"] >= 0]
        n = sum(f["held_n"] for f in held)
        score[p] = sum(f["held_ll"] for f in held) / n if n else 0.0
    return max(score, key=score.get), score


def freeze(rows: DataFrame, strata: list[str], y: str, features: list[str], at: str, *, penalties: tuple[float, ...] = PENALTIES, folds: int = 5) -> tuple[Frozen, list[dict]]:
    """Scaling, penalty and coefficients from these rows alone, and all fits behind them."""
    clean = rows.dropna(subset=[*strata, *features])
    mean, sd = scaling(clean, features)
    z = clean.select(*strata, y, *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(features, mean, sd, strict=True)])
    fold = stratum_folds(clean, strata, at, folds)
    same = [F.col(f"_l.{c}") == F.col(f"_r.{c}") for c in strata]
    z = z.alias("_l").join(fold.alias("_r"), same).select("_l.*", "_r.fold")
    fits = fit_all(z, strata, y, features, penalties)
    penalty, _ = choose(fits)
    beta = next(f["beta"] for f in fits if f["penalty"] == penalty and f["fold"] == -1)
    return Frozen(tuple(features), tuple(mean), tuple(sd), penalty, tuple(map(float, beta))), fits


def capture(rows: DataFrame, strata: list[str], y: str, eta: Column, *, by: list[str], least_controls: int = 5) -> DataFrame:
    """How a fixed score finds the case of its stratum, by the columns ``by`` (each constant within a stratum).

    Rows with a null score are left out; a stratum without one case or with fewer than ``least_controls`` controls is
    excluded and counted. rank is 1 + the controls that score higher, so ties favour the case. Columns: strata, excluded,
    ll_per_case, null_per_case, improvement, top_1, top_5, top_decile (shares of cases) and mean_percentile, which is
    (n - rank + 1) / n.
    """
    d = rows.withColumns({"_eta": eta, "_y": F.coalesce(F.col(y) == 1, F.lit(False))})
    keys = list(dict.fromkeys([*by, *strata]))
    seen = F.col("_eta").isNotNull()
    # the shift by the stratum's greatest score keeps exp in range; both sums combine before the shuffle
    top = d.groupBy(*keys).agg(F.max("_eta").alias("_top"), F.max(F.when(F.col("_y"), F.col("_eta"))).alias("_case"), F.count_if(seen & F.col("_y")).alias("_cases"), F.count_if(seen).alias("_n"))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]
    j = d.where(seen).alias("_l").join(top.alias("_r"), same).select(*[F.col(f"_l.{c}").alias(c) for c in keys], "_eta", "_top", "_case")
    z = j.groupBy(*keys).agg(F.sum(F.exp(F.col("_eta") - F.col("_top"))).alias("_z"), (1 + F.count_if(F.col("_eta") > F.col("_case"))).alias("_rank"))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]
    s = top.alias("_l").join(z.alias("_r"), same, "left").select("_l.*", "_r._z", "_r._rank")
    good = (F.col("_cases") == 1) & (F.col("_n") - 1 >= least_controls)
    s = s.withColumns({"_ll": F.when(good, F.col("_case") - F.col("_top") - F.log("_z")), "_null": F.when(good, -F.log("_n")), "_share": F.when(good, (F.col("_n") - F.col("_rank") + 1) / F.col("_n"))})
    hit = lambda c: F.avg(F.when(good, c.cast("double")))
    return s.groupBy(*by).agg(
        F.count_if(good).alias("strata"), F.count_if(~good).alias("excluded"), F.avg("_ll").alias("ll_per_case"), F.avg("_null").alias("null_per_case"), (F.avg("_ll") - F.avg("_null")).alias("improvement"),
        hit(F.col("_rank") <= 1).alias("top_1"), hit(F.col("_rank") <= 5).alias("top_5"), hit(F.col("_rank") <= F.ceil(F.col("_n") * 0.1)).alias("top_decile"), F.avg("_share").alias("mean_percentile"),
    )


def identity(rows: DataFrame, y: str, flag: Column, part: str) -> DataFrame:
    """Confusion of a fixed rule with the cases by partition and over all (part ALL): tp, fp, fn, tn, precision, recall, f1 (0 where undefined)."""
    d = rows.select(F.col(part).alias("part"), F.coalesce(F.col(y) == 1, F.lit(False)).alias("c"), F.coalesce(flag, F.lit(False)).alias("r"))
    n = {"tp": "c and r", "fp": "not c and r", "fn": "c and not r", "tn": "not c and not r"}
    g = d.groupBy("part").agg(*[F.count_if(F.expr(e)).alias(k) for k, e in n.items()])
    total = g.agg(F.lit("ALL").alias("part"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in n])
    u = g.unionByName(total)
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(a) + F.col(b) > 0, F.col(a) + F.col(b)), F.lit(0.0))
    u = u.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    both = F.col("precision") + F.col("recall")
    return u.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.when(both > 0, both), F.lit(0.0)))


def epoch_partitions(records: DataFrame, at: str, tie: str, epoch: list[str], discovery: int, lockbox: int) -> DataFrame:
    """(epoch columns, records, partition): records in order are discovery (the first ``discovery``), lockbox (from place ``lockbox`` on, from 0) or buffer; an epoch is where its first record is."""
    r = exact_ranks(records, at, tie, out="_place")
    part = F.when(F.col("_place") < discovery, "discovery").when(F.col("_place") >= lockbox, "lockbox").otherwise("buffer")
    return r.groupBy(*epoch).agg(F.count("*").alias("records"), F.min_by(part, "_place").alias("partition"))
