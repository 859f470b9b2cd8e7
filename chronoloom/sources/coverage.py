"""Inventories and checks of inputs: coverage grids, tick inspection, folds, file hashes, table differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timer_grid(spark: SparkSession, start: str, end: str, every: int, phase: int = 0) -> DataFrame:
    """Times phase + n * every seconds since the epoch within [start, end]."""
    us = lambda s: f"unix_micros(cast(timestamp_ntz'{s}' as timestamp))"
    first = F.expr(f"cast(ceil(({us(start)} - {phase * 1_000_000}) / {every * 1_000_000}d) * {every * 1_000_000} + {phase * 1_000_000} as bigint)")
    return spark.range(1).select(F.explode(F.sequence(first, F.expr(us(end)), F.lit(every * 1_000_000).cast("long"))).alias("us")).select(F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


def inventory(ticks: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, hour, ticks, status) for every expected hour; hours without ticks are ``unknown``."""
    grid = ticks.select("symbol").distinct().withColumn("hour", F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval 1 hour)")))
    seen = ticks.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("ticks"))
    j = grid.join(seen, ["symbol", "hour"], "left")
    return j.select("symbol", "hour", F.coalesce("ticks", F.lit(0)).alias("ticks"), F.when(F.col("ticks") > 0, "observed").otherwise("unknown").alias("status"))


def acquisition_plan(coverage: DataFrame) -> DataFrame:
    """Hours to fetch; which ones depends on coverage alone, never on labels."""
    return coverage.where("status <> 'observed'").select("symbol", "hour", F.lit("missing").alias("reason"))


def inspect(ticks: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = ticks.withColumn("gap", us - F.lag(us).over(w))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("gap") < 0).alias("backwards"), F.count_if(F.col("gap") == 0).alias("duplicates"), F.count_if((F.col("bid") > F.col("ask")) | (F.col("bid") <= 0)).alias("crossed"),
        F.round(F.max("gap") / 1e6, 3).alias("largest_gap"), F.min("ts").alias("first_tick"), F.max("ts").alias("last_tick"),
    )


def folds(ledger: DataFrame, start: str, cuts: list[int], embargo: int) -> DataFrame:
    """Ledger rows once per expanding fold with their role: train (closed before the test and outside the embargo), test or excluded. Fold i tests the days from ``cuts[i]`` up to ``cuts[i + 1]`` after ``start``."""
    day = lambda k: F.expr(f"timestamp_ntz'{start} 00:00:00'") + F.make_dt_interval(days=k)
    d = ledger.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(cuts) - 2).cast("long"))))
    at = lambda i: F.element_at(F.array(*map(F.lit, cuts)), (F.col("fold") + i).cast("int"))
    begin, stop = day(at(1)), day(at(2))
    train = (F.col("open_time") < begin - F.make_dt_interval(secs=F.lit(embargo))) & (F.col("close_time") < begin)
    test = (F.col("open_time") >= begin) & (F.col("open_time") < stop)
    return d.withColumn("role", F.when(train, "train").when(test, "test").otherwise("excluded"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in one of two tables, as multisets, and the number of rows of the first."""
    g = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_d").alias("d"), F.count_if(F.col("_d") > 0).alias("n"))
    return g.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_right"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_"))


def header_role(columns: Column) -> Column:
    """Role of a table by its (lower-case) column names."""
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(columns, n))
    time = F.arrays_overlap(columns, F.array(*map(F.lit, ("timestamp", "time", "date", "datetime"))))
    return F.when(time & has("bid", "ask"), "TICK_QUOTE_CANDIDATE").when(time & has("open", "high", "low", "close"), "OHLC_BAR_ONLY").when(has("ticket", "side"), "LEDGER_CANDIDATE").otherwise("UNKNOWN_SCHEMA")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and upper-case SHA-256 of files. Each is one row, so this is for inputs of at most some MB."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", F.upper(F.sha2("content", 256)).alias("sha256"))


def text_artifacts(spark: SparkSession, path: str | list[str], part: int = -1) -> DataFrame:
    """Role, columns, delimiter and number of lines of text files, by their first line. ``part``: the piece of the path that names a file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    g = lines.groupBy("file").agg(F.min_by("value", "n").alias("head"), F.count("*").alias("lines"))
    best = F.array_max(F.array(*[F.struct(F.size(F.split("head", f"[{d}]")).alias("k"), F.lit(d).alias("d")) for d in (",", ";", "\t", "|")]))
    g = g.withColumn("delimiter", best["d"]).withColumn("columns", F.transform(F.split(F.lower("head"), F.concat(F.lit("["), F.col("delimiter"), F.lit("]"))), lambda c: F.regexp_replace(F.trim(c), "[<>\"]", "")))
    return g.select(F.element_at(F.split("file", "/"), part).alias("name"), "delimiter", "columns", "lines", header_role(F.col("columns")).alias("role"))
