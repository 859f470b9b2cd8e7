"""Structured Streaming twins of the batch operators: tumbling bars, sessions, windows with carry-over, armed triggers.

Each batch is written under its number, so a repeated batch overwrites itself and results are exactly once. Late rows
beyond the watermark are dropped by the engine; missing hours stay missing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators.folds import fold


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or below a temporary one where that is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), (F.lit(100) + F.col("value")).alias("mid"))


def drained(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over what is there and returns its rows; with ``keys`` the last update of each."""
    spark = stream.sparkSession
    out = shared(spark, name)

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/rows/{batch:06d}")

    q = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    if not keys:
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*")


def tumbling_bars(stream: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    return g.agg(F.min_by("mid", "event_id").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", "event_id").alias("close"), F.count("*").cast("double").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_counts(stream: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step).alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg("mid").alias("mean")).select("symbol", F.col("w.start").alias("ts"), "n", "mean")


def carried_counts(stream: DataFrame, lookback_seconds: int) -> DataFrame:
    """For every tick the number of its symbol's ticks in the closed window that ends at its time, all of that time in the
    batch included. The state holds just that window."""
    span = lookback_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        us = rows.us.to_numpy()
        times = np.sort(np.concatenate([np.array(held, us.dtype), us]))
        n = np.searchsorted(times, us, "right") - np.searchsorted(times, us - span)
        state.update((times[times >= times[-1] - span].tolist(),))
        yield pd.DataFrame({"event_id": rows.event_id.to_numpy(), "n": n})

    s = stream.withColumn("us", F.unix_micros("ts"))
    return s.groupBy("symbol").applyInPandasWithState(step, "event_id long, n long", "times array<long>", "update", GroupStateTimeout.NoTimeout)


def arm(us: list[int], hit: list[bool], armed: bool, last: int | None, free: int | None, cooldown: int, gap: int) -> tuple[list[bool], bool, int | None, int | None]:
    """Fires on a hit while armed and out of cooldown; firing disarms, a miss arms again, a gap in time disarms."""
    fired = []
    for t, h in zip(us, hit, strict=True):
        if last is not None and t - last > gap:
            armed = False
        fire = bool(h and armed and (free is None or t >= free))
        fired.append(fire)
        if fire:
            armed, free = False, t + cooldown
        elif not h:
            armed = True
        last = t
    return fired, armed, last, free


def armed_trigger(stream: DataFrame, condition: str, cooldown_seconds: int, gap_seconds: int) -> DataFrame:
    """Ticks at which an armed trigger fires, per symbol."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, last, free = state.get if state.exists else (False, None, None)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        fired, armed, last, free = arm(rows.us.tolist(), rows.hit.tolist(), armed, last, free, cooldown_seconds * 1_000_000, gap_seconds * 1_000_000)
        state.update((armed, last, free))
        yield rows[fired][["event_id", "symbol"]]

    s = stream.select("event_id", "symbol", F.unix_micros("ts").alias("us"), F.expr(condition).alias("hit"))
    return s.groupBy("symbol").applyInPandasWithState(step, "event_id long, symbol string", "armed boolean, last long, free long", "update", GroupStateTimeout.NoTimeout)


def armed_batch(df: DataFrame, condition: str, cooldown_seconds: int, gap_seconds: int) -> DataFrame:
    """The same over bounded data: one state per symbol along its ticks, read in order."""

    def step(s: dict, row) -> list[tuple]:
        fired, s["armed"], s["last"], s["free"] = arm([row.us], [row.hit], s["armed"], s["last"], s["free"], cooldown_seconds * 1_000_000, gap_seconds * 1_000_000)
        return [(row.event_id, row.symbol)] if fired[0] else []

    s = df.select("event_id", "symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.expr(condition).alias("hit"))
    return fold(s, key="symbol", order=["us", "event_id"], start=lambda: {"armed": False, "last": None, "free": None}, step=step, schema="event_id long, symbol string")


def locked_out(df: DataFrame, key: str, condition: str, hold_seconds: int) -> DataFrame:
    """Signals that count when each one taken locks out those of the next ``hold_seconds`` (lockout scenarios)."""

    def step(s: dict, row) -> list[tuple]:
        if s["free"] is not None and row.us < s["free"]:
            return []
        s["free"] = row.us + hold_seconds * 1_000_000
        return [(row.event_id, getattr(row, key))]

    s = df.where(condition).select("event_id", key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return fold(s, key=key, order=["us", "event_id"], start=lambda: {"free": None}, step=step, schema=f"event_id long, {key} string")


