"""Market-event views over the tables of a data folder, in Spark and as the SQL that defines the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The views in SQL; queries' SQL begins with them.
WITH = """WITH ticks AS (
  SELECT event_id, ts, event_type AS symbol, user_id, k, 100 + value AS mid, 0.01 * (1 + k % 10) AS spread,
    100 + value - 0.01 * (1 + k % 10) / 2 AS bid, 100 + value + 0.01 * (1 + k % 10) / 2 AS ask
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)),
bars_1h AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(mid, event_id) AS open, max(mid) AS high, min(mid) AS low,
    arg_max(mid, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2),
bars_4h AS (
  SELECT symbol, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) AS close, sum(volume) AS volume FROM bars_1h GROUP BY 1, 2),
bars_1d AS (
  SELECT symbol, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) AS close, sum(volume) AS volume FROM bars_1h GROUP BY 1, 2),
ledger AS (
  SELECT * FROM (
    SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') AS ticket, user_id, CASE WHEN user_id % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side,
      CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS symbol,
      ts AS open_time, lead(ts) OVER w AS close_time, 0.01 * (1 + k % 3) AS lot, mid AS price,
      CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END * (lead(mid) OVER w - mid) * (0.01 * (1 + k % 3)) * 100 AS pnl
    FROM ticks WHERE symbol = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE close_time IS NOT NULL),
predictions AS (
  SELECT event_id AS p_id, CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS symbol,
    ts AS p_ts, CASE WHEN user_id % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS p_side FROM ticks WHERE symbol = 'signup')
"""

#: The period of the data in SQL: its first day, its number of days, and all its hours.
FIRST = "(SELECT min(ts)::DATE::TIMESTAMP FROM ticks)"
DAYS = "(SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 FROM ticks)"
HOURS = f"generate_series({FIRST}, (SELECT date_trunc('hour', max(ts)) FROM ticks), INTERVAL '1 hour')"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    half = F.lit(0.01) * (1 + F.col("k") % 10) / 2
    mid = F.lit(100) + F.col("value")
    return e.select("event_id", "ts", F.col("event_type").alias("symbol"), "user_id", "k", mid.alias("mid"), (F.lit(0.01) * (1 + F.col("k") % 10)).alias("spread"), (mid - half).alias("bid"), (mid + half).alias("ask"))


def period(ticks: DataFrame) -> tuple[str, str]:
    """Midnight of the first day and the last hour with ticks; of an empty table both are the epoch."""
    r = ticks.agg(F.min(F.to_date("ts")).cast("string").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:00:00").alias("b")).first()
    return f"{r['a'] or '1970-01-01'} 00:00:00", r["b"] or "1970-01-01 00:00:00"


def bars(df: DataFrame, width: str) -> DataFrame:
    """OHLCV bars of ticks (symbol, ts, mid, event_id), labelled by their start; empty ones do not exist."""
    g = df.groupBy("symbol", F.window(F.col("ts").cast("timestamp"), width)["start"].cast("timestamp_ntz").alias("ts"))
    return g.agg(
        F.min_by("mid", "event_id").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"),
        F.max_by("mid", "event_id").alias("close"), F.count("*").cast("double").alias("volume"),
    )


def resample(df: DataFrame, width: str) -> DataFrame:
    """Wider bars from bars."""
    g = df.groupBy("symbol", F.window(F.col("ts").cast("timestamp"), width)["start"].cast("timestamp_ntz").alias("ts_"))
    out = g.agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )
    return out.withColumnRenamed("ts_", "ts")


def bars_1h(spark, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir), "1 hour")


def _traded():
    return F.element_at(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), (F.col("user_id") % 5 + 1).cast("int"))


def predictions(spark, sf_dir: str) -> DataFrame:
    """A model's signals: p_id, symbol, p_ts, p_side."""
    t = ticks(spark, sf_dir).where("symbol = 'signup'")
    return t.select(F.col("event_id").alias("p_id"), _traded().alias("symbol"), F.col("ts").alias("p_ts"), F.when(F.col("user_id") % 2 == 0, "Buy").otherwise("Sell").alias("p_side"))


def ledger(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = ticks(spark, sf_dir).where("symbol = 'purchase'")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    lot = F.lit(0.01) * (1 + F.col("k") % 3)
    sign = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    out = t.select(
        "event_id", F.lpad(F.col("event_id").cast("string"), 8, "0").alias("ticket"), "user_id", F.when(F.col("user_id") % 2 == 0, "Buy").otherwise("Sell").alias("side"),
        _traded().alias("symbol"), F.col("ts").alias("open_time"), F.lead("ts").over(w).alias("close_time"), lot.alias("lot"), F.col("mid").alias("price"),
        (sign * (F.lead("mid").over(w) - F.col("mid")) * lot * 100).alias("pnl"),
    )
    return out.where("close_time is not null")


def r6(c):
    """Rounded to six places, for results that both engines compute in floating point."""
    return F.round(c if not isinstance(c, str) else F.col(c), 6)
