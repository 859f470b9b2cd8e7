"""Streaming twins and stateful folds (SURVEY ST)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.plans import views as V
from chronoloom.plans.views import WITH, r6
from chronoloom.registry import query
from chronoloom.streaming import jobs as J
from chronoloom.streaming import sinks as K


@query("st3_tumbling_bars", WITH + "SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars_1h")
def st3_tumbling_bars(spark, sf):
    """Hourly bars from the stream, with watermark (ST3)."""
    b = J.drained(J.tumbling_bars(J.ticks(spark, sf), "1 hour"), "bars", ["symbol", "ts"])
    return b.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(
    "st4_sliding_counts",
    WITH + ", s AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - to_hours(i) AS ts, mid FROM ticks CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)) SELECT symbol, ts, count(*) AS n, round(avg(mid), 6) AS mean FROM s GROUP BY 1, 2",
)
def st4_sliding_counts(spark, sf):
    """Three-hour windows every hour, from the stream (ST4)."""
    b = J.drained(J.sliding_counts(J.ticks(spark, sf), "3 hours", "1 hour"), "sliding", ["symbol", "ts"])
    return b.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "n", r6("mean").alias("mean"))


@query("st1_carry_over", WITH + "SELECT event_id, count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS n FROM ticks")
def st1_carry_over(spark, sf):
    """Windows across batch borders from carried state (ST1, ST2)."""
    return J.drained(J.carried_counts(J.ticks(spark, sf), 7200), "carry")


_ARMED = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, x AS (SELECT event_id, symbol, epoch_us(ts) AS us, mid > 150 AS hit, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i FROM ticks),
r AS (SELECT event_id, symbol, us, i, NOT hit AS armed, NULL::BIGINT AS free, false AS fired FROM x WHERE i = 1 UNION ALL SELECT event_id, symbol, us, i, CASE WHEN fire THEN false WHEN NOT hit THEN true ELSE armed0 END, CASE WHEN fire THEN us + 3600000000 ELSE free END, fire FROM (
  SELECT *, hit AND armed0 AND (free IS NULL OR us >= free) AS fire FROM (SELECT x.*, r.free, r.armed AND x.us - r.us <= 21600000000 AS armed0 FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1)))
SELECT event_id, symbol FROM r WHERE fired"""


@query("st5_armed_stream", _ARMED)
def st5_armed_stream(spark, sf):
    """Armed trigger on the stream (ST5, ST7)."""
    return J.drained(J.armed_trigger(J.ticks(spark, sf), "mid > 150", 3600, 6 * 3600), "armed")


@query("st5_armed_batch", _ARMED)
def st5_armed_batch(spark, sf):
    """The same fold in batch, for bounded data."""
    return J.armed_batch(V.ticks(spark, sf), "mid > 150", 3600, 6 * 3600)


@query(
    "st6_debounce",
    WITH + ", x AS (SELECT event_id, symbol, ts, sign(mid - 130) AS s FROM ticks WHERE mid <> 130), p AS (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS ps FROM x) SELECT event_id, symbol FROM p WHERE s > 0 AND coalesce(ps, -1) < 0",
)
def st6_debounce(spark, sf):
    """A signal counts once until the sign flips: a lag over the non-zero signs (ST6)."""
    w = W.partitionBy("symbol").orderBy("ts", "event_id")
    x = V.ticks(spark, sf).where("mid <> 130").withColumn("s", F.signum(F.col("mid") - 130))
    return x.withColumn("ps", F.lag("s").over(w)).where((F.col("s") > 0) & (F.coalesce("ps", F.lit(-1.0)) < 0)).select("event_id", "symbol")


@query(
    "st8_lockout",
    WITH.replace("WITH ", "WITH RECURSIVE ", 1) + ", s AS (SELECT event_id, symbol, ts FROM ticks WHERE mid > 150), r AS (SELECT symbol, min(ts) AS ts FROM s GROUP BY 1 UNION ALL SELECT r.symbol, (SELECT min(s.ts) FROM s WHERE s.symbol = r.symbol AND s.ts >= r.ts + INTERVAL '12 hours') FROM r WHERE r.ts IS NOT NULL) SELECT s.event_id, s.symbol FROM s JOIN r ON s.symbol = r.symbol AND s.ts = r.ts",
)
def st8_lockout(spark, sf):
    """Each signal taken locks out the next twelve hours (ST8)."""
    return J.locked_out(V.ticks(spark, sf), "symbol", "mid > 150", 12 * 3600)


@query("s14_hourly_append", WITH + "SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(max(mid), 6) AS top, true AS second_run_refused FROM ticks GROUP BY 1")
def s14_hourly_append(spark, sf):
    """The stream appended to hourly CSV files and read back; a run of another owner is refused, the same one adds nothing."""
    stream = J.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder, state = J.shared(spark, "hours"), J.shared(spark, "hours-state")
    for _ in range(2):
        K.append_by_hour(stream, folder, "ts", state)
    try:
        K.append_by_hour(stream, folder, "ts", J.shared(spark, "other-state"))
        refused = False
    except FileExistsError:
        refused = True
    g = K.read_hours(spark, folder, stream.schema).groupBy("hour").agg(F.count("*").alias("n"), F.sum("event_id").cast("long").alias("ids"), r6(F.max("mid")).alias("top"))
    return g.withColumn("second_run_refused", F.lit(refused))
