"""Readers and writers: trade ledgers, bar files of vendors, hourly tick files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The ledger's columns, in order.
LEDGER = ("ticket", "side", "open_time", "close_time", "symbol", "lot_size", "observed_price", "pnl")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated ledger. All columns are read as text (identifiers keep their zeros), then cast; a value
    that does not cast, another side than Buy or Sell or another number of columns fails the job."""
    raw = spark.read.text(path).select(F.split("value", "\t", -1).alias("f")).where("size(f) > 1 or f[0] <> ''")
    ok = F.assert_true(F.size("f") == len(LEDGER), F.lit("a ledger row must have 8 columns"))
    t = raw.withColumn("ok", ok).where("ok is null").select(*[F.col("f")[i].alias(c) for i, c in enumerate(LEDGER)])
    side = F.assert_true(F.col("side").isin("Buy", "Sell"), F.lit("side must be Buy or Sell"))
    t = t.withColumn("ok", side).where("ok is null").drop("ok")
    time = lambda c: F.to_timestamp_ntz(F.regexp_replace(c, r"\.", "-"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return t.select("ticket", "side", time("open_time").alias("open_time"), time("close_time").alias("close_time"), "symbol", *[F.col(c).cast("double").alias(c) for c in LEDGER[5:]])


def normalise_bar_columns(df: DataFrame) -> DataFrame:
    """Vendor headers to timestamp, open, high, low, close, volume: brackets off, lower case, date and time joined."""
    d = df.toDF(*[c.strip().strip("<>").lower() for c in df.columns])
    if "timestamp" not in d.columns:
        if {"date", "time"} <= set(d.columns):
            d = d.withColumn("timestamp", F.concat_ws(" ", "date", "time"))
        else:
            d = d.withColumnRenamed(next(c for c in ("datetime", "time", "date") if c in d.columns), "timestamp")
    volume = next((c for c in ("volume", "vol", "tickvol", "tick_volume") if c in d.columns), None)
    missing = {"open", "high", "low", "close"} - set(d.columns)
    if missing:
        raise ValueError(f"bars lack {sorted(missing)}")
    return d.select("timestamp", "open", "high", "low", "close", (F.col(volume) if volume else F.lit(None)).alias("volume"))


def read_bars(spark: SparkSession, path: str, *, sep: str = ",", shift_hours: int = 0) -> DataFrame:
    """Bars of a vendor's text file: rows with an unreadable time or price go, the last of equal times stays."""
    raw = normalise_bar_columns(spark.read.csv(path, header=True, sep=sep)).withColumn("_n", F.monotonically_increasing_id())
    text = F.regexp_replace("timestamp", "[./]", "-")
    t = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")])
    num = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    b = raw.select((t.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(shift_hours))).alias("timestamp"), *[num(c) for c in ("open", "high", "low", "close", "volume")], "_n")
    b = b.na.drop(subset=["timestamp", "open", "high", "low", "close"])
    w = W.partitionBy("timestamp").orderBy(F.desc("_n"))
    return b.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_n", "_r")


def read_ticks(spark: SparkSession, path: str, *, repeats: bool = False) -> DataFrame:
    """Hourly JSON files of [ms, ask, bid, ...] lists or of objects; quotes must be positive and not crossed.

    Of equal times the last stays; equal times with other prices fail the job. ``repeats``: a millisecond may have
    several quotes and all of them stay.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    lists = F.from_json("value", "array<array<double>>")
    objects = F.from_json("value", "array<struct<timestamp: bigint, askPrice: double, bidPrice: double>>")
    is_list = F.col("value").rlike(r"^\s*\[\s*(\[|\])")
    rows = raw.select("file", F.when(is_list, F.transform(lists, lambda x: F.struct(x[0].cast("long").alias("ms"), x[1].alias("ask"), x[2].alias("bid")))).otherwise(F.transform(objects, lambda x: F.struct(x["timestamp"].alias("ms"), x["askPrice"].alias("ask"), x["bidPrice"].alias("bid")))).alias("r"))
    t = rows.select("file", F.posexplode("r").alias("n", "q")).select("file", "n", "q.ms", "q.bid", "q.ask").where("bid > 0 and bid <= ask")
    if repeats:
        return t.select(F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "bid", "ask")
    g = t.groupBy("ms").agg(F.max_by(F.struct("bid", "ask"), F.struct("file", "n")).alias("q"), F.count_distinct("bid", "ask").alias("k"))
    g = g.withColumn("ok", F.assert_true(F.col("k") == 1, F.lit("equal times with different quotes"))).where("ok is null")
    return g.select(F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "q.bid", "q.ask")


def write_json_safe(df: DataFrame, path: str) -> None:
    """JSON lines with NaN and infinities as null, keys in order."""
    safe = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    df.select(*safe).write.json(path)


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Appends a batch under its key; a second append of the same key is refused."""
    df.write.mode("errorifexists").parquet(f"{path}/batch={key}")
