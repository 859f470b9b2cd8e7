"""Full indicator sets."""

from __future__ import annotations

from chronoloom.operators import features as E
from chronoloom.plans import views as V
from chronoloom.plans.queries_windows import _RECURSIVE, _full
from chronoloom.plans.views import r6
from chronoloom.registry import query
from chronoloom.streaming.jobs import shared


def _step(alpha: float, x: str, y: str) -> str:
    return f"{1 - alpha!r} * {y} + {alpha!r} * {x}"


def _recursion(emas, rsi=(), atr=False):
    """SQL: all recurrences bar by bar; n holds the bars with their number, r the states after bar i."""
    spans = sorted({*emas, *E.MACD})
    a = {n: 2 / (n + 1) for n in spans}
    first = [f"close AS e{n}" for n in spans] + ["0.0::DOUBLE AS sig"] + [f"NULL::DOUBLE AS {s}{n}" for n in rsi for s in "gl"] + (["tr AS atr"] if atr else [])
    new = {n: _step(a[n], "n.close", f"r.e{n}") for n in spans}
    then = [*new.values(), _step(a[9], f"(({new[12]}) - ({new[26]}))", "r.sig")]
    then += [f"CASE WHEN r.i = 1 THEN greatest({d}, 0) ELSE {_step(1 / n, f'greatest({d}, 0)', f'r.{s}{n}')} END" for n in rsi for s, d in (("g", "n.d"), ("l", "-n.d"))]
    then += [_step(1 / 14, "n.tr", "r.atr")] if atr else []
    return f""", n AS (SELECT *, close - lag(close) OVER w AS d, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w AS i FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r AS (SELECT symbol, i, {', '.join(first)} FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, {', '.join(then)} FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)"""


def _all_rounded(df, keep=("symbol", "ts")):
    return df.select(*keep, *[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema.fields if f.name not in keep])


def _bars_once(spark, sf):
    """The bars are read by counts, ranks and rows: made once."""
    path = shared(spark, "bars")
    V.bars_1h(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


_lag = lambda n: f"lag(close, {n}) OVER (PARTITION BY symbol ORDER BY ts)"

_MARKET = {
    **{f"return_{n}": f"close / {_lag(n)} - 1" for n in E.MARKET_RETURNS},
    **{f"ema_{n}": f"e{n}" for n in E.MARKET_EMA}, **{f"sma_{n}": _full("avg(close)", n) for n in E.MARKET_EMA}, **{f"distance_ema_{n}": f"(close - e{n}) / e{n}" for n in E.MARKET_EMA},
    "ema_9_20_diff": "e9 - e20", "ema_20_50_diff": "e20 - e50", **{f"rsi_{n}": f"CASE WHEN i > {n} THEN 100 - 100 / (1 + g{n} / nullif(l{n}, 0)) END" for n in E.MARKET_RSI},
    "macd": "e12 - e26", "macd_signal": "sig", "macd_hist": "e12 - e26 - sig", "stochastic_k_14": "sk", "stochastic_d_14": _full("avg(sk)", 3, x="sk"),
    "atr_14": "CASE WHEN i >= 14 THEN atr END", "atr_ratio": "CASE WHEN i >= 14 THEN atr END / close",
    "bollinger_upper_20": "m20 + 2 * s20", "bollinger_lower_20": "m20 - 2 * s20", "bollinger_z_20": "(close - m20) / nullif(s20, 0)", "bollinger_bandwidth_20": "4 * s20 / m20",
    "candle_body": "close - open", "candle_body_abs": "abs(close - open)", "candle_body_ratio": "abs(close - open) / nullif(high - low, 0)",
    "upper_wick_ratio": "(high - greatest(open, close)) / nullif(high - low, 0)", "lower_wick_ratio": "(least(open, close) - low) / nullif(high - low, 0)",
    **{f"distance_high_{n}": f"close / {_full('max(high)', n, 1, x='high')} - 1" for n in E.MARKET_EXTREMES}, **{f"distance_low_{n}": f"close / {_full('min(low)', n, 1, x='low')} - 1" for n in E.MARKET_EXTREMES},
    "vwap_session": "vw", "distance_vwap": "(close - vw) / vw",
}
_FRAMES = f"""f AS (SELECT n.*, r.* EXCLUDE (symbol, i), {_full('avg(close)', 20)} AS m20, {_full('stddev_samp(close)', 20)} AS s20, {_full('min(low)', 14, x='low')} AS lo14, {_full('max(high)', 14, x='high')} AS hi14,
sum((high + low + close) / 3 * volume) OVER v / nullif(sum(volume) OVER v, 0) AS vw FROM n JOIN r USING (symbol, i) WINDOW v AS (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


def _select(figures: dict[str, str], flags=()) -> str:
    return ", ".join(f"{e} AS {n}" if n in flags else f"round({e}, 6) AS {n}" for n, e in figures.items())


@query(
    "w33_market_features",
    _RECURSIVE + _recursion(E.MARKET_EMA, E.MARKET_RSI, True) + ", " + _FRAMES + ", g AS (SELECT *, 100 * (close - lo14) / nullif(hi14 - lo14, 0) AS sk FROM f) SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, " + _select(_MARKET) + " FROM g",
)
def w33_market_features(spark, sf):
    """All figures of the base feature set for every bar."""
    return _all_rounded(E.market_features(_bars_once(spark, sf)))


def _rolling_rsi(n):
    mean = lambda x: _full(f"avg(CASE WHEN {x} > 0 THEN {x} ELSE 0 END)", n)
    return f"100 - 100 / (1 + {mean('d')} / ({mean('-d')} + 1e-9))"


_PANEL = {
    **{f"ema_{n}": f"e{n}" for n in E.PANEL_EMA}, **{f"dist_ema_{n}": f"(close - e{n}) / e{n} * 10000" for n in E.PANEL_EMA}, "ema_8_21_cross": "e8 - e21", "ema_21_50_cross": "e21 - e50",
    **{f"rsi_{n}": _rolling_rsi(n) for n in E.PANEL_RSI}, **{f"atr_{n}": _full("avg(tr)", n) for n in E.PANEL_ATR}, **{f"atr_pct_{n}": f"{_full('avg(tr)', n)} / close * 100" for n in E.PANEL_ATR},
    "bb_upper": "m20 + 2 * s20", "bb_lower": "m20 - 2 * s20", "bb_pct_b": "(close - (m20 - 2 * s20)) / (m20 + 2 * s20 - (m20 - 2 * s20) + 1e-9)", "bb_bandwidth": "4 * s20 / m20 * 100",
    "macd": "e12 - e26", "macd_signal": "sig", "macd_hist": "e12 - e26 - sig", "stoch_k": "sk", "stoch_d": _full("avg(sk)", 3, x="sk"),
    "candle_body_ratio": "abs(close - open) / (high - low + 1e-9)", "candle_dir": "CAST(sign(close - open) AS DOUBLE)",
    "upper_wick_ratio": "(high - greatest(open, close)) / (high - low + 1e-9)", "lower_wick_ratio": "(least(open, close) - low) / (high - low + 1e-9)",
    "is_pinbar_bull": "(least(open, close) - low) / (high - low + 1e-9) > 0.6 AND abs(close - open) / (high - low + 1e-9) < 0.25",
    "is_pinbar_bear": "(high - greatest(open, close)) / (high - low + 1e-9) > 0.6 AND abs(close - open) / (high - low + 1e-9) < 0.25",
    "donchian_high_20": _full("max(high)", 20, 1, x="high"), "donchian_low_20": _full("min(low)", 20, 1, x="low"),
    "is_breakout_high_20": f"coalesce(close > {_full('max(high)', 20, 1, x='high')}, false)", "is_breakout_low_20": f"coalesce(close < {_full('min(low)', 20, 1, x='low')}, false)",
    **{f"return_{n}": f"(close / {_lag(n)} - 1) * 10000" for n in E.PANEL_RETURNS},
}
_FLAGS = ("is_pinbar_bull", "is_pinbar_bear", "is_breakout_high_20", "is_breakout_low_20")


@query(
    "w32_indicator_set",
    _RECURSIVE + _recursion(E.PANEL_EMA) + ", " + _FRAMES + ", g AS (SELECT *, 100 * (close - lo14) / (hi14 - lo14 + 1e-9) AS sk FROM f) SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, " + _select(_PANEL, _FLAGS) + " FROM g",
)
def w32_indicator_set(spark, sf):
    """All figures of the decision panel's indicator set for every bar."""
    return _all_rounded(E.indicator_set(_bars_once(spark, sf)))
