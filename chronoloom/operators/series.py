"""Time-series operators: rolling frames, affine recurrences (EMA, Wilder), streaks, drawdown, crossings.

All work per key along a total order. Recurrences are solved in blocks: a window gives each block's own solution, a
small table of block ends is folded once per key, and the carry is joined back, so no task runs a whole key's rows in
a loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over(*keys: str, order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def rolling(agg: Column, x: str | Column, w, n: int, least: int | None = None, shift: int = 0) -> Column:
    """``agg`` over the last n rows (ending ``shift`` rows ago); null below ``least`` (default n) non-null values."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg.over(frame))


def percentile_rank(x: str, w, n: int, least: int) -> Column:
    """Rank of the value among the last n, ties at their mean, as share."""
    values = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    less = F.size(F.filter(values, lambda v: v < F.col(x)))
    same = F.size(F.filter(values, lambda v: v == F.col(x)))
    return F.when(F.size(values) >= least, (less + (same + 1) / 2) / F.size(values))


def affine(df: DataFrame, *, key: str, order: str, a: Column, b: Column, out: str, block: Column | None = None, rows: int = 200) -> DataFrame:
    """Adds y with y[t] = a[t] * y[t-1] + b[t] and y before the first row 0; the coefficients are in [0, 1] and non-null.

    Blocks are ``rows`` rows of one ``block`` value (by default the day of ``order``) and key.
    """
    day = F.to_date(order) if block is None else block
    d = df.withColumns({"_a": a, "_b": b, "_d": day})
    d = d.withColumn("_n", F.row_number().over(W.partitionBy(key, "_d").orderBy(order)) - 1)
    d = d.withColumn("_k", F.floor(F.col("_n") / rows))
    w = W.partitionBy(key, "_d", "_k").orderBy("_n")
    pairs = F.collect_list(F.struct("_a", "_b")).over(w.rowsBetween(W.unboundedPreceding, 0))
    fold = lambda s, p: F.struct((s["A"] * p["_a"]).alias("A"), (s["B"] * p["_a"] + p["_b"]).alias("B"))
    d = d.withColumn("_s", F.aggregate(pairs, F.struct(F.lit(1.0).alias("A"), F.lit(0.0).alias("B")), fold))
    ends = d.groupBy(key, "_d", "_k").agg(F.max_by("_s", "_n").alias("e")).select(key, "_d", "_k", "e.A", "e.B")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_d", "_k"])
        y, before = 0.0, np.empty(len(pdf))
        for i, (p, q) in enumerate(zip(pdf.A.to_numpy(), pdf.B.to_numpy(), strict=True)):
            before[i] = y
            y = p * y + q
        return pdf.assign(_y=before)[[key, "_d", "_k", "_y"]]

    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    carried = ends.groupBy(key).applyInPandas(carry, f"{key} {kinds[key]}, _d {kinds['_d']}, _k long, _y double")  # a row per block
    d = d.join(carried, [key, "_d", "_k"]).withColumn(out, F.col("_s.A") * F.col("_y") + F.col("_s.B"))
    return d.select(*df.columns, out)


def lagged(df: DataFrame, x: str, *, key: str, order: str, out: str) -> DataFrame:
    """Adds the value that ``x`` has in the key's row before, in order: within a day by a window, over days by the last value of the day before."""
    d = df.withColumn("_ld", F.to_date(order))
    last = d.groupBy(key, "_ld").agg(F.max_by(F.struct(x), order)[x].alias("_last"))
    before = F.lag("_last").over(W.partitionBy(key).orderBy("_ld"))  # a row per day
    d = d.join(last.select(key, "_ld", before.alias("_lb")), [key, "_ld"])
    w = W.partitionBy(key, "_ld").orderBy(order)
    return d.withColumn(out, F.when(F.row_number().over(w) == 1, F.col("_lb")).otherwise(F.lag(x).over(w))).select(*df.columns, out)


def ewm(df: DataFrame, x: str, alpha: float, *, key: str, order: str, out: str, least: int = 1) -> DataFrame:
    """Exponential mean (not adjusted) seeded with the first non-null value; null values keep the state; null below ``least`` values."""
    w = W.partitionBy(key).orderBy(order)
    seen = F.count(x).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = df.withColumn("_seen", seen)
    has = F.col(x).isNotNull()
    a = F.when(has & (F.col("_seen") == 1), 0.0).when(has, 1.0 - alpha).otherwise(1.0)
    b = F.when(has & (F.col("_seen") == 1), F.col(x)).when(has, alpha * F.col(x)).otherwise(0.0)
    d = affine(d, key=key, order=order, a=a, b=b.cast("double"), out="_y")
    return d.withColumn(out, F.when(F.col("_seen") >= least, F.col("_y"))).drop("_seen", "_y")


def rsi_wilder(df: DataFrame, x: str, n: int, *, key: str, order: str, out: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(w))
    d = d.withColumns({"_g": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), "_l": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))}).drop("_d")
    d = ewm(d, "_g", 1 / n, key=key, order=order, out="_ag", least=n)
    d = ewm(d, "_l", 1 / n, key=key, order=order, out="_al", least=n)
    return d.withColumn(out, 100 - 100 / (1 + F.col("_ag") / F.when(F.col("_al") != 0, F.col("_al")))).drop("_g", "_l", "_ag", "_al")


def islands(flag: Column, w_all, w_group) -> Column:
    """Number of the run of equal flags that a row is in (gaps and islands)."""
    return F.row_number().over(w_all) - F.row_number().over(w_group)


def crossing(x: str, level: float, w) -> Column:
    return F.coalesce((F.col(x) >= level) & (F.lag(x).over(w) < level), F.lit(False))
