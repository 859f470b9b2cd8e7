"""Full sets of bar indicators: a row per bar, all figures known when the bar is over.

Both sets take bars (symbol, ts, open, high, low, close, volume; one per symbol and ts) and work in blocks of bars with
the bars before them: frames and lags see a block only, exponential means carry a row per block. A symbol's first bars
have null where a figure needs more bars than there are. Further columns of the bars stay as they are unless a figure has their name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import blocks as K
from chronoloom.operators import series as S
from chronoloom.operators.bars import true_range

#: Spans, lengths and horizons of the two sets.
MARKET_EMA = (9, 20, 50, 100, 200)
MARKET_RETURNS = (1, 3, 5, 10, 15, 30, 60)
MARKET_RSI = (7, 14, 21)
MARKET_EXTREMES = (10, 20, 50)
PANEL_EMA = (8, 14, 21, 50, 100, 200)
PANEL_RETURNS = (1, 3, 5, 10, 15, 30)
PANEL_RSI = (7, 14, 21)
PANEL_ATR = (7, 14)
MACD = (12, 26, 9)
_HALO = 240  # more than the longest frame and lag


def _span(n: int) -> float:
    return 2 / (n + 1)


def _positive(c: Column) -> Column:
    return F.when(c != 0, c)


def _blocked(bars: DataFrame, rows: int):
    d = K.with_halo(K.places(bars, "symbol", "ts", out="_place"), "_place", rows=rows, halo=_HALO)
    return d, W.partitionBy("symbol", "block").orderBy("_place")


def _add(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    return reduce(lambda d, s: d.withColumns(s), steps, df)


def _macd(d: DataFrame) -> DataFrame:
    """From e12, e26 and e9 of the close: the line, its mean of nine and their difference."""
    fast, slow, signal = map(_span, MACD)
    line = K.mean_of_mean(F.col("_e12"), fast, F.col("_e9"), signal) - K.mean_of_mean(F.col("_e26"), slow, F.col("_e9"), signal)
    return _add(d, {"macd": F.col("_e12") - F.col("_e26"), "macd_signal": line}, {"macd_hist": F.col("macd") - F.col("macd_signal")})


def session_vwap(bars: DataFrame) -> DataFrame:
    """Adds ``vwap_session``: the day's mean typical price by volume up to the bar; null while there is no volume."""
    day = W.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("vwap_session", F.sum(typical * F.col("volume")).over(day) / _positive(F.sum("volume").over(day)))


def market_features(bars: DataFrame, rows: int = 4800) -> DataFrame:
    """Returns, means and distances, Wilder RSI, MACD, stochastic, Wilder ATR, bands, candle shape, extremes and session VWAP."""
    d, w = _blocked(session_vwap(bars), rows)
    c, h, lo, o = map(F.col, ("close", "high", "low", "open"))
    span = _positive(h - lo)
    d = _add(
        d,
        {f"return_{n}": c / F.lag("close", n).over(w) - 1 for n in MARKET_RETURNS},
        {f"sma_{n}": S.rolling(F.avg("close"), "close", w, n) for n in MARKET_EMA},
        {"_d": c - F.lag("close").over(w), "_tr": true_range(w), "_sd": S.rolling(F.stddev_samp("close"), "close", w, 20)},
        {"_l14": S.rolling(F.min("low"), "low", w, 14), "_h14": S.rolling(F.max("high"), "high", w, 14)},
        {"_gain": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), "_loss": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))},
        {"stochastic_k_14": 100 * (c - F.col("_l14")) / _positive(F.col("_h14") - F.col("_l14"))},
        {"stochastic_d_14": S.rolling(F.avg("stochastic_k_14"), "stochastic_k_14", w, 3)},
        {"bollinger_upper_20": F.col("sma_20") + 2 * F.col("_sd"), "bollinger_lower_20": F.col("sma_20") - 2 * F.col("_sd"), "bollinger_z_20": (c - F.col("sma_20")) / _positive(F.col("_sd"))},
        {"bollinger_bandwidth_20": (F.col("bollinger_upper_20") - F.col("bollinger_lower_20")) / F.col("sma_20"), "candle_body": c - o, "candle_body_abs": F.abs(c - o)},
        {"candle_body_ratio": F.col("candle_body_abs") / span, "upper_wick_ratio": (h - F.greatest("open", "close")) / span, "lower_wick_ratio": (F.least("open", "close") - lo) / span},
        {f"distance_high_{n}": c / S.rolling(F.max("high"), "high", w, n, shift=1) - 1 for n in MARKET_EXTREMES},
        {f"distance_low_{n}": c / S.rolling(F.min("low"), "low", w, n, shift=1) - 1 for n in MARKET_EXTREMES},
        {"distance_vwap": (c - F.col("vwap_session")) / F.col("vwap_session")},
    ).where("own")
    means = {f"ema_{n}": ("close", _span(n)) for n in MARKET_EMA} | {"_e12": ("close", _span(12)), "_e26": ("close", _span(26)), "_e9": ("close", _span(9)), "atr_14": ("_tr", 1 / 14)}
    means |= {f"_{side}{n}": (f"_{side}", 1 / n) for n in MARKET_RSI for side in ("gain", "loss")}
    least = {"atr_14": 14} | {f"_{side}{n}": n for n in MARKET_RSI for side in ("gain", "loss")}
    d = K.exponential_means(d, means, key="symbol", place="_place", least=least, within=("block",))
    d = _add(
        d,
        {f"distance_ema_{n}": (c - F.col(f"ema_{n}")) / F.col(f"ema_{n}") for n in MARKET_EMA},
        {"ema_9_20_diff": F.col("ema_9") - F.col("ema_20"), "ema_20_50_diff": F.col("ema_20") - F.col("ema_50"), "atr_ratio": F.col("atr_14") / c},
        {f"rsi_{n}": 100 - 100 / (1 + F.col(f"_gain{n}") / _positive(F.col(f"_loss{n}"))) for n in MARKET_RSI},
    )
    return _public(_macd(d))


def indicator_set(bars: DataFrame, rows: int = 4800) -> DataFrame:
    """The decision panel's own set: distances and returns in basis points, rolling RSI and ATR, bands, MACD, candle flags, breakouts."""
    d, w = _blocked(bars, rows)
    c, h, lo, o = map(F.col, ("close", "high", "low", "open"))
    tiny = 1e-9
    up, down = F.when(F.coalesce(F.col("_d") > 0, F.lit(False)), F.col("_d")).otherwise(0.0), F.when(F.coalesce(F.col("_d") < 0, F.lit(False)), -F.col("_d")).otherwise(0.0)
    mean = lambda x, n: S.rolling(F.avg(x), x, w, n)
    rng = h - lo + tiny
    d = _add(
        d,
        {"_d": c - F.lag("close").over(w), "_tr": true_range(w), "_sma": mean("close", 20), "_sd": S.rolling(F.stddev_samp("close"), "close", w, 20)},
        {"_up": up, "_down": down, "_l14": S.rolling(F.min("low"), "low", w, 14), "_h14": S.rolling(F.max("high"), "high", w, 14)},
        {f"rsi_{n}": 100 - 100 / (1 + mean("_up", n) / (mean("_down", n) + tiny)) for n in PANEL_RSI},
        {f"atr_{n}": mean("_tr", n) for n in PANEL_ATR},
        {f"atr_pct_{n}": F.col(f"atr_{n}") / c * 100 for n in PANEL_ATR},
        {"bb_upper": F.col("_sma") + 2 * F.col("_sd"), "bb_lower": F.col("_sma") - 2 * F.col("_sd")},
        {"bb_pct_b": (c - F.col("bb_lower")) / (F.col("bb_upper") - F.col("bb_lower") + tiny), "bb_bandwidth": (F.col("bb_upper") - F.col("bb_lower")) / F.col("_sma") * 100},
        {"stoch_k": 100 * (c - F.col("_l14")) / (F.col("_h14") - F.col("_l14") + tiny)},
        {"stoch_d": mean("stoch_k", 3), "candle_body_ratio": F.abs(c - o) / rng, "candle_dir": F.signum(c - o), "upper_wick_ratio": (h - F.greatest("open", "close")) / rng, "lower_wick_ratio": (F.least("open", "close") - lo) / rng},
        {"is_pinbar_bull": F.expr("lower_wick_ratio > 0.6 and candle_body_ratio < 0.25"), "is_pinbar_bear": F.expr("upper_wick_ratio > 0.6 and candle_body_ratio < 0.25")},
        {"donchian_high_20": S.rolling(F.max("high"), "high", w, 20, shift=1), "donchian_low_20": S.rolling(F.min("low"), "low", w, 20, shift=1)},
        {"is_breakout_high_20": F.expr("coalesce(close > donchian_high_20, false)"), "is_breakout_low_20": F.expr("coalesce(close < donchian_low_20, false)")},
        {f"return_{n}": (c / F.lag("close", n).over(w) - 1) * 10000 for n in PANEL_RETURNS},
    ).where("own")
    means = {f"ema_{n}": ("close", _span(n)) for n in PANEL_EMA} | {f"_e{n}": ("close", _span(n)) for n in MACD}
    d = K.exponential_means(d, means, key="symbol", place="_place", within=("block",))
    d = _add(d, {f"dist_ema_{n}": (c - F.col(f"ema_{n}")) / F.col(f"ema_{n}") * 10000 for n in PANEL_EMA}, {"ema_8_21_cross": F.col("ema_8") - F.col("ema_21"), "ema_21_50_cross": F.col("ema_21") - F.col("ema_50")})
    return _public(_macd(d))


def _public(d: DataFrame) -> DataFrame:
    return d.select(*[c for c in d.columns if not c.startswith("_") and c not in ("block", "own")])
