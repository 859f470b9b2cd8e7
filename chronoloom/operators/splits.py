"""Folds in time: by days, by numbers of events, by rows and by shares of the time, with embargo and purge.

Borders come from the data's own span and from exact ranks. Ranks need no window over all rows: rows are counted by
stretch of time, the counts are added up (a row per stretch), and rows are numbered within their stretch.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def span(df: DataFrame, ts: str) -> tuple[dt.date | None, int]:
    """(first day, number of days up to the last one) of a table; (None, 0) of an empty one."""
    r = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b")).first()
    return (r["a"], (r["b"] - r["a"]).days + 1) if r["a"] else (None, 0)


def day_number(ts: str | Column, first: dt.date | None) -> Column:
    """Days since ``first``, which is 1."""
    return F.datediff(F.to_date(ts), F.lit(first)) + 1


def cut(days: int, share: float) -> int:
    """The last day of the first ``share`` of so many days."""
    return math.ceil(days * share - 1e-9)


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def exact_ranks(df: DataFrame, ts: str, *ties: str, out: str = "rank", stretch: int = 3600) -> DataFrame:
    """Adds the place (from 0) of each row in the order of ``ts``, then ``ties``. Rows with a null ``ts`` come first.

    ``stretch`` seconds of rows are sorted by one task: choose it so that they fit. Offsets take a row per stretch.
    """
    d = df.withColumn("_s", F.floor(micros(ts) / (stretch * 1_000_000)))
    n = d.groupBy("_s").agg(F.count("*").alias("n"))
    before = n.select(F.col("_s").alias("_t"), F.coalesce(F.sum("n").over(W.orderBy(F.col("_s").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_s").orderBy(ts, *ties)) - 1
    j = d.withColumn("_own", own).join(F.broadcast(before), F.col("_s").eqNullSafe(F.col("_t")))
    return j.withColumn(out, F.col("_before") + F.col("_own")).drop("_s", "_t", "_own", "_before")


def event_borders(df: DataFrame, ts: str, least_train: int, blocks: int = 4, stretch: int = 3600) -> list[tuple[int, int, int, int]]:
    """(fold, train_end, test_start, test_end), in microseconds, all included, of expanding folds over the different times.

    The first fold teaches by ``least_train`` times; what follows is tested in ``blocks`` of equal numbers, the last one
    with the remainder. Only the borders' times reach the driver. Fewer times than ``least_train`` + ``blocks``: an error.
    """
    times = df.where(F.col(ts).isNotNull()).select(micros(ts).alias("us")).distinct()
    n = times.count()
    if n < least_train + blocks:
        raise ValueError(f"{n} different event times are too few for {blocks} folds after {least_train}")
    size = max(1, (n - least_train) // blocks)
    starts = [least_train + i * size for i in range(blocks)]
    ends = [*[s - 1 for s in starts[1:]], n - 1]
    wanted = sorted({x for s, e in zip(starts, ends, strict=True) for x in (s - 1, s, e)})
    ranked = exact_ranks(times.select(F.timestamp_micros("us").alias("ts")), "ts", stretch=stretch)
    at = {r["rank"]: r["us"] for r in ranked.where(F.col("rank").isin(wanted)).select("rank", F.unix_micros("ts").alias("us")).collect()}
    return [(i + 1, at[s - 1], at[s], at[e]) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def row_borders(n: int, splits: int = 5, gap: int = 60) -> list[tuple[int, int, int, int]]:
    """(fold, train_end, test_start, test_end) in ranks of ``n`` rows: expanding, ``gap`` rows between train and test belong to neither."""
    size = n // (splits + 1)
    return [(i, size * i - 1, size * i + gap, (size * (i + 1) if i < splits else n) - 1) for i in range(1, splits + 1)]


def share_borders(df: DataFrame, ts: str, shares: tuple[float, ...]) -> list[tuple[int, int, int, int]]:
    """The same in microseconds, with train up to each share of the time from first to last, and test up to the next (the last: to the end)."""
    r = df.agg(F.min(micros(ts)).alias("a"), F.max(micros(ts)).alias("b")).first()
    if r["a"] is None:
        return []
    at = [r["a"] + math.floor((r["b"] - r["a"]) * s) for s in shares] + [r["b"]]
    return [(i + 1, at[i], at[i] + 1, at[i + 1]) for i in range(len(shares))]


def roles(df: DataFrame, at: Column, borders: list[tuple[int, int, int, int]], until: Column | None = None, embargo: int = 0) -> DataFrame:
    """A row per row and fold: ``fold`` and ``role``, by ``at`` (in the borders' unit).

    train: up to the fold's train_end; test: from test_start to test_end; excluded: else. With ``until`` (when the row's
    outcome is known) a train row is purged if that is not before test_start, and with ``embargo`` if it lies within so
    many units before test_start. Null ``at`` is excluded; null ``until`` counts as never known.
    """
    fold = F.explode(F.array(*[F.struct(*[F.lit(int(v)).cast("long").alias(n) for n, v in zip(("fold", "train_end", "test_start", "test_end"), b, strict=True)]) for b in borders]))
    d = df.withColumns({"_at": at, "_until": F.lit(None).cast("long") if until is None else until}).withColumn("_f", fold)
    late = F.lit(False) if until is None else F.coalesce(F.col("_until") >= F.col("_f.test_start"), F.lit(True))
    near = F.col("_at") >= F.col("_f.test_start") - embargo
    train, test = F.col("_at") <= F.col("_f.train_end"), F.col("_at").between(F.col("_f.test_start"), F.col("_f.test_end"))
    role = F.when(train & (late | near), "purged").when(train, "train").when(test, "test").otherwise("excluded")
    return d.select(*df.columns, F.col("_f.fold").alias("fold"), role.alias("role"))
