"""Two recordings of one quote stream set against each other: clock drift, one-to-one pairs, losses, repeats and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators.splits import micros


def aligned(a: DataFrame, b: DataFrame, *, tolerance: float = 0.5, reach: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, drift) of two tick tables (symbol, ts, bid, ask).

    Repeated ticks of a source (same symbol, time and quote) are one. drift: per symbol the median time by which b's
    nearest tick of the same quote within ``reach`` seconds lies after a's. pairs: (symbol, a_ts, b_ts, shift), one-to-one:
    ticks of one quote that are each other's nearest within ``tolerance`` seconds once b is set back by the drift; of
    equally near ones the earlier. Null quotes pair with nothing. The sides are equal but for the sign of the drift.
    """
    quote = F.concat_ws("|", "symbol", F.col("bid").cast("string"), F.col("ask").cast("string"))

    def once(df: DataFrame, name: str) -> DataFrame:
        return df.where("bid is not null and ask is not null and ts is not null").select("symbol", quote.alias("q"), F.col("ts").alias(name)).distinct()

    x, y = once(a, "a_ts"), once(b, "b_ts")
    near = A.nearest(x, y.drop("symbol"), on="q", left_ts="a_ts", right_ts="b_ts", take=[], tolerance=reach).where("b_ts is not null")
    drift = near.groupBy("symbol").agg(F.percentile_approx(micros("b_ts") - micros("a_ts"), 0.5, 100_000).alias("drift_us"))
    y = y.join(F.broadcast(drift), "symbol").withColumn("at", F.timestamp_micros(micros("b_ts") - F.col("drift_us")).cast("timestamp_ntz")).drop("drift_us")
    to_b = A.nearest(x, y.drop("symbol"), on="q", left_ts="a_ts", right_ts="at", take=["b_ts"], tolerance=tolerance).where("b_ts is not null")
    to_a = A.nearest(y, x.drop("symbol"), on="q", left_ts="at", right_ts="a_ts", take=[], tolerance=tolerance).where("a_ts is not null")
    pairs = to_b.select("symbol", "q", "a_ts", "b_ts").join(to_a.select("q", "a_ts", "b_ts"), ["q", "a_ts", "b_ts"], "left_semi")
    return pairs.select("symbol", "a_ts", "b_ts", ((micros("b_ts") - micros("a_ts")) / 1e6).alias("shift")), drift


def reconciled(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """Per symbol: rows and repeats of both sources, pairs, ticks in only one of them, drift in seconds, and hours with
    ticks in either, in both, and in neither between the first and the last of any."""
    pairs, drift = aligned(a, b, **options)

    def counted(df: DataFrame, name: str) -> DataFrame:
        g = df.groupBy("symbol", "ts", "bid", "ask").agg(F.count("*").alias("n")).groupBy("symbol")
        return g.agg(F.sum("n").alias(f"rows_{name}"), F.sum(F.col("n") - 1).alias(f"repeated_{name}"))

    hour = lambda df, name: df.select("symbol", F.floor(micros("ts") / 3_600_000_000).alias("h"), F.lit(1).alias(name)).distinct()
    hours = hour(a, "in_a").join(hour(b, "in_b"), ["symbol", "h"], "full").groupBy("symbol")
    hours = hours.agg(F.count("*").alias("hours_any"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("hours_both"), (F.max("h") - F.min("h") + 1 - F.count("*")).alias("hours_neither"))
    out = hours.join(counted(a, "a"), "symbol", "left").join(counted(b, "b"), "symbol", "left")
    out = out.join(pairs.groupBy("symbol").agg(F.count("*").alias("pairs")), "symbol", "left").join(drift, "symbol", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("symbol", *[zero(c) for c in ("rows_a", "repeated_a", "rows_b", "repeated_b", "pairs")], (F.col("drift_us") / 1e6).alias("drift_seconds"), "hours_any", "hours_both", "hours_neither")
    return out.withColumns({f"only_{s}": F.col(f"rows_{s}") - F.col(f"repeated_{s}") - F.col("pairs") for s in "ab"})
