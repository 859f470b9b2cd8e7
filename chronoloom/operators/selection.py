"""Exact order statistics of columns too large for one aggregate's buffer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, x: str, ranks: list[int], *, fit: int = 100_000) -> dict[int, float]:
    """The values at these ranks (from 0) of the non-null, non-NaN ``x`` in ascending order; a rank beyond the data is an error.

    The rank's interval of values is narrowed by approximate quantiles, one aggregate a pass and some hundredfold each,
    until it is one value or holds at most ``fit`` rows, which are then sorted: the driver sees two numbers a pass.
    """
    v = df.select(F.col(x).cast("double").alias("x")).where("x is not null and not isnan(x)")
    r0 = v.agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).first()
    out = {}
    for rank in ranks:
        if not 0 <= rank < r0["n"]:
            raise ValueError(f"no rank {rank} among {r0['n']} values")
        low, high, below, inside = r0["a"], r0["b"], 0, r0["n"]  # low <= the value <= high; so many are below low
        while low < high and inside > fit:
            part = v.where(F.col("x").between(low, high))
            p = (rank - below + 0.5) / inside
            qs = part.agg(F.percentile_approx("x", [max(0.0, p - 2e-3), p, min(1.0, p + 2e-3)], 10_000).alias("q")).first()["q"]
            a, m, b = qs
            c = part.agg(F.count_if(F.col("x") < a).alias("a"), F.count_if(F.col("x") <= a).alias("aa"), F.count_if(F.col("x") < m).alias("m"), F.count_if(F.col("x") <= m).alias("mm"), F.count_if(F.col("x") <= b).alias("b")).first()
            at = rank - below
            if c["m"] <= at < c["mm"]:
                low = high = m
            elif at < c["a"]:
                high, inside = a, c["aa"]
            elif at < c["b"]:
                low, high, below, inside = a, b, below + c["a"], c["b"] - c["a"]
            else:
                low, below, inside = b, below + c["b"], inside - c["b"]
                low = part.where(F.col("x") > b).agg(F.min("x").alias("x")).first()["x"]
        if low < high:
            low = v.where(F.col("x").between(low, high)).orderBy("x").limit(rank - below + 1).agg(F.max("x").alias("x")).first()["x"]
        out[rank] = low
    return out


def quantiles(df: DataFrame, x: str, qs: list[float], *, fit: int = 100_000) -> list[float | None]:
    """The exact quantiles, linear between the two nearest values; None without values. Nulls and NaN are no values.

    Up to ``fit`` values are one aggregate's buffer; of more, each quantile's two values are searched for. Results agree.
    """
    v = df.select(F.col(x).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = v.count()
    if n <= fit:
        return v.agg(F.percentile("x", F.array(*map(F.lit, qs))).alias("q")).first()["q"] or [None] * len(qs)
    at = [q * (n - 1) for q in qs]
    s = order_statistics(v, "x", sorted({r for a in at for r in (math.floor(a), math.ceil(a))}), fit=fit)
    return [s[math.floor(a)] + (s[math.ceil(a)] - s[math.floor(a)]) * (a - math.floor(a)) for a in at]


def quantile(df: DataFrame, x: str, q: float, *, fit: int = 100_000) -> float | None:
    return quantiles(df, x, [q], fit=fit)[0]
