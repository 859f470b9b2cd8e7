"""Frames and recurrences of long keys in blocks of rows, so that one key is the work of many tasks.

Rows get their place within the key from counts by stretch of time (a row per stretch is added up, rows are numbered
within their stretch). A block takes a fixed number of places, and the last ``halo`` rows of a block are also dealt to the
next one: every lag and every frame of up to ``halo`` rows is then exact inside of a block. Exponential means are
running sums within a block, and a row per block is folded per key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.splits import micros


def places(df: DataFrame, key: str, order: str, *ties: str, out: str = "place", stretch: int = 7 * 86400) -> DataFrame:
    """Adds each row's place (from 0) within its key by ``order``, then ``ties``; null keys are one key, null times come first.

    ``stretch`` seconds of one key are sorted by one task. Equal rows get different places in no stated order.
    """
    d = df.withColumn("_s", F.floor(micros(order) / (stretch * 1_000_000)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_key").orderBy(F.col("_t").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = d.groupBy(F.col(key).alias("_key"), F.col("_s").alias("_t")).agg(F.count("*").alias("n")).withColumn("_before", before).drop("n")
    own = F.row_number().over(W.partitionBy(key, "_s").orderBy(F.col(order).asc_nulls_first(), *ties)) - 1
    j = d.withColumn("_own_place", own).join(counts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_t")))
    return j.withColumn(out, F.col("_before") + F.col("_own_place")).drop("_s", "_t", "_key", "_before", "_own_place")


def with_halo(df: DataFrame, place: str, *, rows: int, halo: int) -> DataFrame:
    """Deals rows to blocks of ``rows`` places (``block``), each with the ``halo`` rows before it (``own`` is false for these)."""
    if not 0 <= halo <= rows:
        raise ValueError("a halo is part of the block before: 0 <= halo <= rows")
    at, last = F.floor(F.col(place) / rows), F.col(place) % rows >= rows - halo
    one = lambda b, own: F.struct(b.alias("block"), F.lit(own).alias("own"))
    d = df.withColumn("_b", F.explode(F.when(last, F.array(one(at, True), one(at + 1, False))).otherwise(F.array(one(at, True)))))
    return d.select(*df.columns, "_b.block", "_b.own")


def exponential_means(df: DataFrame, means: dict[str, tuple[str, float]], *, key: str, place: str, least: dict[str, int] | None = None, within: tuple[str, ...] = (), rows: int = 200) -> DataFrame:
    """Adds ``means``: name -> (column, alpha), y = (1 - alpha) * y_before + alpha * x, seeded with the key's first non-null x.

    A null x keeps the state; a mean is null before its ``least`` non-null values (default 1). All means take one pass:
    with c the non-null values so far in the block, y = (1 - alpha)^c * carry + the block's own running sum, and only one
    row per ``rows`` places, with all means, is folded per key. ``within`` names columns that the rows are already dealt
    by (a block of places each), so that no other exchange is needed.
    """
    if not all(0 < a < 1 for _, a in means.values()):
        raise ValueError("alpha is between 0 and 1")
    rows = max(1, min(rows, int(200 / -math.log10(1 - max(a for _, a in means.values())))))  # powers stay below 1e200
    inputs, names = list(dict.fromkeys(x for x, _ in means.values())), list(means)
    cut = [*within, "_k"]
    d = df.withColumn("_k", F.floor(F.col(place) / rows))
    run = W.partitionBy(key, *cut).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({f"_c{i}": F.count(x).over(run) for i, x in enumerate(inputs)})
    seen = {x: F.col(f"_c{i}") for i, x in enumerate(inputs)}
    d = d.withColumns({f"_y{i}": F.coalesce(F.sum(F.col(x) * a * F.pow(F.lit(1 - a), -seen[x])).over(run), F.lit(0.0)) for i, (x, a) in enumerate(means.values())})
    own = {n: F.col(f"_y{i}") * F.pow(F.lit(1 - a), seen[x]) for i, (n, (x, a)) in enumerate(means.items())}
    ends = d.groupBy(key, *cut).agg(
        F.max_by(F.array(*own.values()), place).alias("y"),
        F.max_by(F.array(*[seen[x].cast("double") for x in inputs]), place).alias("c"),
        F.array(*[F.min_by(F.col(x).cast("double"), F.when(F.col(x).isNotNull(), F.col(place))) for x in inputs]).alias("x"),
    )
    which = np.array([inputs.index(x) for x, _ in means.values()])
    decay = np.array([1 - a for _, a in means.values()])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        c = np.array(pdf["c"].tolist())
        first = np.array(pdf["x"].tolist(), float)[:, which]
        y, n = np.array(pdf["y"].tolist()), c[:, which]
        state, before = np.full(len(which), np.nan), np.empty(y.shape)
        for i in range(len(y)):
            state = np.where(np.isnan(state), first[i], state)  # as if the first value had been there before
            before[i] = state
            state = decay ** n[i] * state + y[i]
        out = pdf[[key, *cut]].copy()
        out["_before"] = [[None if math.isnan(v) else v for v in r] for r in before]
        out["_seen"] = (np.cumsum(c, axis=0) - c).tolist()
        return out

    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *cut]) + ", _before array<double>, _seen array<double>"
    carried = ends.groupBy(key).applyInPandas(carry, schema).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in cut], "_before", "_seen")
    same = F.col(key).eqNullSafe(F.col("_key"))
    for c in cut:
        same = same & (F.col(c) == F.col(f"_r_{c}"))
    d = d.join(carried, same)
    out = []
    for i, (n, (x, a)) in enumerate(means.items()):
        y = F.pow(F.lit(1 - a), seen[x]) * F.get("_before", F.lit(i)) + F.col(f"_y{i}") * F.pow(F.lit(1 - a), seen[x])
        enough = seen[x] + F.get("_seen", F.lit(inputs.index(x))) >= (least or {}).get(n, 1)
        out.append(F.when(enough, y).alias(n))
    return d.select(*df.columns, *out)


def mean_of_mean(inner: Column, a: float, outer: Column, b: float) -> Column:
    """The exponential mean (alpha ``b``) of an exponential mean (``a``) of x, from both means of x itself; a and b differ.

    Both are seeded with the first x, so the weights (1 - a)^n and (1 - b)^n of the two add up to those of the mean of the mean.
    """
    p, q = 1 - a, 1 - b
    return (b * p * inner - a * q * outer) / (p - q)
