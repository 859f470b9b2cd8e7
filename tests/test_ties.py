"""Rows at equal times, and orders in which one column outweighs another, as in the SQL."""

import datetime as dt
import json

import duckdb
import pytest

from chronoloom import registry
from chronoloom.streaming import jobs as J

START = dt.datetime(2024, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


def test_first_part_where_parts_outweigh_lines(spark, tmp_path):
    rows = [(1, 2_000_005, 1), (1, 7, 2), (1, 9, 3), (2, 5, 1), (2, 3, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["o05_dedup"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["o05_dedup"](spark, str(tmp_path)).select("l_orderkey", "first_part", "last_part").collect()) == want


def test_carried_counts_hold_all_of_a_time(spark, tmp_path):
    rows = [(i, at(s), 1, "view", 1.0, json.dumps({"k": 1})) for i, s in enumerate((0, 5, 5, 5, 7300, 7300))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/x")
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = {r.event_id: r.n for r in J.drained(J.carried_counts(J.ticks(spark, str(tmp_path)), 7200), "carry").collect()}
    assert got == {0: 1, 1: 4, 2: 4, 3: 4, 4: 2, 5: 2}


def test_tick_files_keep_all_quotes_of_a_millisecond(spark, tmp_path):
    rows = [(i, START + dt.timedelta(microseconds=us), 1, "error", v, json.dumps({"k": 1})) for i, (us, v) in enumerate(((1000, 1.0), (1400, 2.0), (1900, 2.0), (2000, 3.0)))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["s04_tick_files"]).fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES["s04_tick_files"](spark, str(tmp_path)).select("ts", "bid", "ask").collect())
    assert len(got) == 4 and [r[0] for r in got] == [r[0] for r in want] and [x for r in got for x in r[1:]] == pytest.approx([x for r in want for x in r[1:]])
