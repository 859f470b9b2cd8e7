"""Bars and what is known of them: geometry, event flags, indicators, decision panels. Everything is stamped when it is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import asof as A
from chronoloom.operators import series as S


def true_range(w) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def candle() -> dict[str, Column]:
    """Body, ratio and wicks; a bar without range has no ratio."""
    rng = F.col("high") - F.col("low")
    return {
        "body": F.col("close") - F.col("open"),
        "body_ratio": F.abs(F.col("close") - F.col("open")) / F.when(rng != 0, rng),
        "upper_wick": F.col("high") - F.greatest("open", "close"),
        "lower_wick": F.least("open", "close") - F.col("low"),
    }


def lagged_candle(bars: DataFrame, w) -> DataFrame:
    f = bars.withColumns(candle())
    return f.select("symbol", "ts", F.round(F.lag("close").over(w), 6).alias("m1_close"), *[F.round(F.lag(c).over(w), 6).alias(f"m1_{c}") for c in candle()])


def event_flags(bars: DataFrame, w, width: str = "1 hour") -> DataFrame:
    """Breakouts, false break, inside and outside bars, compression, expansion and reversal against the 20 bars before."""
    rng = F.col("high") - F.col("low")
    b = bars.withColumns({"rng": rng, "ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "pb": F.lag(F.col("close") - F.col("open")).over(w), "body": F.col("close") - F.col("open")})
    b = b.withColumns({"h20": S.rolling(F.max("high"), "close", w, 20, shift=1), "l20": S.rolling(F.min("low"), "close", w, 20, shift=1), "r20": S.rolling(F.avg("rng"), "close", w, 20, shift=1)})
    flags = {
        "breakout_high": "high > h20", "breakout_low": "low < l20", "false_break": "high > h20 and close < h20", "inside_bar": "high < ph and low > pl", "outside_bar": "high > ph and low < pl",
        "compression": "rng < 0.5 * r20", "expansion": "rng > 1.5 * r20", "reversal": "body * pb < 0 and abs(body) > abs(pb)",
    }
    return b.select("symbol", (F.col("ts") + F.expr(f"interval {width}")).alias("seen_at"), *[F.expr(f"coalesce({e}, false)").alias(k) for k, e in flags.items()])


def decision_panel(bars: DataFrame, ledger: DataFrame) -> DataFrame:
    """A row per bar with indicators of the bars before, the last complete 4-hour and day bars, and the entries in the bar."""
    from chronoloom.plans.views import resample

    w = S.over("symbol", order=["ts"])
    f = bars.withColumns(candle()).withColumns({"tr": true_range(w), "sma_20": S.rolling(F.avg("close"), "close", w, 20), "ret_1": F.col("close") / F.lag("close").over(w) - 1, "ret_5": F.col("close") / F.lag("close", 5).over(w) - 1})
    f = f.withColumn("atr_14", S.rolling(F.avg("tr"), "close", w, 14)).withColumn("vol_20", S.rolling(F.stddev_samp("ret_1"), "ret_1", w, 20))
    f = S.ewm(f, "close", 2 / 21, key="symbol", order="ts", out="ema_20")
    f = S.rsi_wilder(f, "close", 14, key="symbol", order="ts", out="rsi_14")
    known = [c for c in f.columns if c not in ("symbol", "ts", "open", "high", "low", "close", "volume")]
    f = f.select("symbol", "ts", *[F.lag(c).over(w).alias(c) for c in known])
    for label, width in (("h4", "4 hours"), ("d1", "1 day")):
        wide = resample(bars, width).withColumns(candle()).select("symbol", (F.col("ts") + F.expr(f"interval {width}")).alias("seen"), "body", "close")
        f = A.asof(f, wide, on="symbol", left_ts="ts", right_ts="seen", take=["body", "close"], prefix=f"{label}_", bucket=None)
    at = F.date_trunc("hour", "open_time").cast("timestamp_ntz").alias("ts")
    sign = F.sum(F.when(F.col("side") == "Buy", 1).otherwise(-1))
    labels = ledger.groupBy("symbol", at).agg(F.count("*").alias("entries"), F.when(sign >= 0, "Buy").otherwise("Sell").alias("side"), F.array_join(F.sort_array(F.collect_list("ticket")), ";").alias("tickets"))
    return f.join(labels, ["symbol", "ts"], "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
