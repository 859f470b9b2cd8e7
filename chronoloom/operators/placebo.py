"""Placebos by redrawing labels within strata, from counts: replicates never copy rows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stratum_counts(rows: DataFrame, strata: list[str], scores: list[str], drawn: str) -> DataFrame:
    """(stratum, cells): per stratum the different tuples of scores, each with its rows and its drawn rows.

    Scores should take few values: a stratum is one row with its cells. Rows with a null score or label count in none.
    """
    clean = rows.dropna(subset=[*scores, drawn])
    cells = clean.groupBy(*strata, *scores).agg(F.count("*").alias("n"), F.count_if(drawn).alias("m"))
    cell = F.struct(F.array(*[F.col(s).cast("double") for s in scores]).alias("x"), "n", "m")
    return cells.groupBy(F.to_json(F.struct(*strata)).alias("stratum")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def stratum_placebo(rows: DataFrame, strata: list[str], scores: list[str], drawn: str, *, replicates: int = 1999, seed: int = 1, replace: bool = False) -> DataFrame:
    """(score, n, observed, null_mean, null_q95, p_value, max_p_value): mean scores of the drawn rows against redrawn labels.

    In each stratum as many rows are drawn anew as were drawn, without replacement (multivariate hypergeometric counts) or
    with (``replace``: multinomial). p-values are one-sided with one added; ``max_p_value`` compares the largest observed
    excess over the null mean with the largest of each replicate, which corrects for the choice among the scores. Tasks
    give sums by replicate; ``replicates`` rows reach the driver. Reruns agree.
    """
    counts = stratum_counts(rows, strata, scores, drawn)

    def redrawn(batches):
        total = np.zeros((replicates, len(scores)))
        for pdf in batches:
            for name, cells in zip(pdf["stratum"], pdf["cells"], strict=True):
                x, n, m = np.array([c["x"] for c in cells]), np.array([c["n"] for c in cells]), int(sum(c["m"] for c in cells))
                if not m:
                    continue
                rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
                got = rng.multinomial(m, n / n.sum(), size=replicates) if replace else rng.multivariate_hypergeometric(n, m, size=replicates, method="marginals")
                total += got @ x
        yield pd.DataFrame({"r": np.arange(replicates), "x": list(total)})

    add = F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(len(scores))])
    null = np.array([r["x"] for r in counts.mapInPandas(redrawn, "r int, x array<double>").groupBy("r").agg(add.alias("x")).orderBy("r").collect()]).reshape(-1, len(scores))
    c = F.explode("cells").alias("c")
    seen = counts.select(c).agg(F.sum("c.m").alias("m"), *[F.sum(F.col("c.m") * F.get("c.x", F.lit(i))).alias(f"s{i}") for i in range(len(scores))]).first()
    m = int(seen["m"] or 0)
    observed = np.array([seen[f"s{i}"] or 0.0 for i in range(len(scores))])
    out = []
    if m:
        center = null.mean(axis=0)
        largest, top = (null - center).max(axis=1), (observed - center).max()
        for i, s in enumerate(scores):
            p = (1 + int((null[:, i] >= observed[i] - 1e-9).sum())) / (replicates + 1)
            out.append((s, m, observed[i] / m, center[i] / m, float(np.quantile(null[:, i], 0.95)) / m, p, (1 + int((largest >= top - 1e-9).sum())) / (replicates + 1)))
    return rows.sparkSession.createDataFrame([(a, b, *map(float, v)) for a, b, *v in out], "score string, n long, observed double, null_mean double, null_q95 double, p_value double, max_p_value double")


def uniform_cells(rows: DataFrame, groups: list[str], cell: str, cells: int, *, replicates: int = 19_999, seed: int = 1) -> DataFrame:
    """(groups, n, chi_square, p_value): counts of ``cell`` (0 to ``cells`` - 1) against equal chances, by multinomial draws.

    The draws know a group's number of rows alone. Values outside of the cells and nulls are left out.
    """
    n = rows.where(F.col(cell).between(0, cells - 1)).groupBy(*groups, cell).agg(F.count("*").alias("k"))
    g = n.groupBy(*groups).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
    g = g.withColumn("chi_square", F.col("q") * F.lit(float(cells)) / F.col("n") - F.col("n"))
    parts = 16
    work = g.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("key", F.concat_ws("|", *[F.col(c).cast("string") for c in groups]))

    @F.pandas_udf("long")
    def as_large(key: pd.Series, n: pd.Series, chi: pd.Series, part: pd.Series) -> pd.Series:
        out = []
        for k, m, x, p in zip(key, n, chi, part, strict=True):
            size = len(range(p, replicates, parts))
            draws = np.random.default_rng([seed, zlib.crc32(k.encode()), p]).multinomial(m, np.full(cells, 1 / cells), size=size)
            out.append(int((((draws - m / cells) ** 2).sum(axis=1) * cells / m >= x - 1e-9).sum()))
        return pd.Series(out)

    hits = work.repartition(parts, "key", "part").withColumn("hits", as_large("key", "n", "chi_square", "part"))
    return hits.groupBy(*groups).agg(F.first("n").alias("n"), F.first("chi_square").alias("chi_square"), ((1 + F.sum("hits")) / (replicates + 1)).alias("p_value"))
