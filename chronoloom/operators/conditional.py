"""One-feature conditional fits: within a stratum, exp(offset + beta * z) over its sum is the chance of the one case."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _likelihoods(rows: DataFrame, strata: list[str], y: str, offset: str, tries: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Log-likelihoods of all features at all their tries: one aggregate over the strata, then one over their logarithms."""
    eta = {f: F.array(*[F.col(offset) + F.lit(float(b)) * F.col(f) for b in v]) for f, v in tries.items()}
    sums, logs = [], []
    for f, v in tries.items():
        for i in range(len(v)):
            e = F.get(F.col(f"_{f}"), F.lit(i))
            sums += [F.sum(F.exp(e)).alias(f"z_{f}_{i}"), F.sum(F.when(F.col(y) == 1, e)).alias(f"c_{f}_{i}")]
            logs.append(F.sum(F.col(f"c_{f}_{i}") - F.log(F.col(f"z_{f}_{i}"))).alias(f"{f}_{i}"))
    g = rows.withColumns({f"_{f}": e for f, e in eta.items()}).groupBy(*strata).agg(F.count_if(F.col(y) == 1).alias("_cases"), *sums)
    r = g.agg(F.count_if(F.col("_cases") != 1).alias("_bad"), *logs).first()
    if r["_bad"]:
        raise ValueError(f"{r['_bad']} strata do not have exactly one case")
    return {f: np.array([r[f"{f}_{i}"] if r[f"{f}_{i}"] is not None else 0.0 for i in range(len(v))]) for f, v in tries.items()}


def fit_single_features(rows: DataFrame, strata: list[str], y: str, offset: str, features: list[str], *, bounds: tuple[float, float] = (-8.0, 8.0), within: float = 1e-8, points: int = 7) -> DataFrame:
    """(feature, beta, ll, null_ll, gain) of every feature by itself, beside the offset.

    The likelihood is concave in beta, so the best of ``points`` inside a bracket tells the next bracket: all features'
    brackets shrink together, four-fold a pass, until they are ``within``. Features should be standardised; rows with a
    null are left out. A stratum without exactly one case is an error.
    """
    clean = rows.dropna(subset=[*strata, y, offset, *features]).select(*strata, y, offset, *features).cache()
    low, high = ({f: b for f in features} for b in bounds)
    null = _likelihoods(clean, strata, y, offset, {f: np.zeros(1) for f in features})
    best: dict[str, tuple[float, float]] = {f: (0.0, float(null[f][0])) for f in features}
    while max(high[f] - low[f] for f in features) > within:
        tries = {f: np.linspace(low[f], high[f], points + 2)[1:-1] for f in features}
        for f, ll in _likelihoods(clean, strata, y, offset, tries).items():
            i = int(ll.argmax())
            step = (high[f] - low[f]) / (points + 1)
            if ll[i] > best[f][1]:
                best[f] = float(tries[f][i]), float(ll[i])
            low[f], high[f] = float(tries[f][i] - step), float(tries[f][i] + step)
    clean.unpersist()
    out = [(f, best[f][0], best[f][1], float(null[f][0]), best[f][1] - float(null[f][0])) for f in features]
    return rows.sparkSession.createDataFrame(out, "feature string, beta double, ll double, null_ll double, gain double")


def randomized_gain(rows: DataFrame, strata: list[str], y: str, offset: str, betas: dict[str, float], *, replicates: int = 1999, seed: int = 1) -> DataFrame:
    """(feature, gain, p_value): the likelihood that a feature adds to the offset against cases drawn anew by the offset alone.

    Each stratum is one row with its candidates; it draws its case once per replicate for all features. Tasks give sums by
    replicate, so ``replicates`` rows reach the driver. Reruns agree.
    """
    features = list(betas)
    clean = rows.dropna(subset=[*strata, y, offset, *features])
    one = F.struct(F.col(offset).cast("double").alias("o"), F.array(*[F.col(f).cast("double") for f in features]).alias("z"), F.col(y).cast("int").alias("y"))
    packed = clean.groupBy(F.to_json(F.struct(*strata)).alias("stratum")).agg(F.sort_array(F.collect_list(one)).alias("c"))
    b = np.array([betas[f] for f in features])

    def drawn(batches):
        total, seen = np.zeros((replicates, len(features))), np.zeros(len(features))
        for pdf in batches:
            for name, c in zip(pdf["stratum"], pdf["c"], strict=True):
                o, z, case = np.array([v["o"] for v in c]), np.array([v["z"] for v in c]), np.array([v["y"] for v in c])
                p = np.exp(o - o.max())
                eta = o[:, None] + z * b
                top = eta.max(axis=0)
                delta = (eta - top - np.log(np.exp(eta - top).sum(axis=0))) - (o - o.max() - np.log(p.sum()))[:, None]
                total += delta[np.random.default_rng([seed, zlib.crc32(name.encode())]).choice(len(o), size=replicates, p=p / p.sum())]
                seen += delta[case == 1].sum(axis=0)
        yield pd.DataFrame({"r": np.arange(-1, replicates), "x": [seen, *total]})

    add = F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(len(features))])
    v = np.array([r["x"] for r in packed.mapInPandas(drawn, "r int, x array<double>").groupBy("r").agg(add.alias("x")).orderBy("r").collect()]).reshape(-1, len(features))
    out = [(f, float(v[0, i]), (1 + int((v[1:, i] >= v[0, i] - 1e-12).sum())) / (replicates + 1)) for i, f in enumerate(features)] if len(v) else []
    return rows.sparkSession.createDataFrame(out, "feature string, gain double, p_value double")
