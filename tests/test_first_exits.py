"""First exits over stretches, against the SQL on wandering prices with gaps longer than two stretches."""

import datetime as dt
import json
import random
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent))
import oracle

from chronoloom import registry


def test_first_exits_equal_sql(spark, tmp_path):
    rng, rows, at, value = random.Random(3), [], dt.datetime(2024, 1, 1), 100.0
    for i in range(1500):
        at += dt.timedelta(seconds=rng.choice((60, 300, 900)) if rng.random() < 0.995 else rng.choice((30_000, 90_000)))
        value = round(value + rng.choice((-5, -1, 0, 1, 5)) * rng.choice((0.01, 0.5, 1)), 2)
        rows.append((i, at, rng.choice((2, 4, 7, 9, 12)), rng.choice(("purchase", "view", "view", "error")), value, json.dumps({"k": rng.randrange(9)})))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = registry.QUERIES["p09_first_exit"](spark, str(tmp_path))
    assert oracle.compare(df, con, registry.ORACLE_SQL["p09_first_exit"]) == ""
    assert {"stop_loss", "trailing", "time"} <= {r.reason for r in df.collect()}
    # entries and ticks meet in stretches, not in pairs
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
