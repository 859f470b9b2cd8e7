"""Queries that need the nearest partner only: no pairs within the tolerance, and rows for what has no partner."""

import datetime as dt
import json

import duckdb

from chronoloom import registry

START = dt.datetime(2024, 1, 1)


def events(spark, folder, rows):
    """Rows (second, user, type) as an event table, and a connection that sees it."""
    data = [(i, START + dt.timedelta(seconds=s), u, k, 1.0 + i, json.dumps({"k": 1})) for i, (s, u, k) in enumerate(rows)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


#: Two trades of user 4 (symbol view, Buy); predictions an hour away, at the same distance on both sides, and two at one time.
ROWS = [(90_000, 4, "purchase"), (86_400, 4, "signup"), (93_600, 4, "signup"), (93_600, 9, "signup"), (300_000, 4, "purchase"), (306_000, 9, "signup"), (306_000, 4, "signup"), (306_000, 4, "signup"), (500_000, 4, "purchase")]


def test_shifts_without_a_match_have_a_row(spark, tmp_path):
    con = events(spark, tmp_path, ROWS)
    got = sorted(tuple(r) for r in registry.QUERIES["p34_shift_placebo"](spark, str(tmp_path)).select("shift", "matched").collect())
    assert len(got) == 20 and got == sorted(con.execute(registry.ORACLE_SQL["p34_shift_placebo"]).fetchall())


def test_bands_without_a_match_have_a_row(spark, tmp_path):
    con = events(spark, tmp_path, ROWS)
    got = sorted(tuple(r) for r in registry.QUERIES["j14_tolerance_bands"](spark, str(tmp_path)).select("band", "trades", "predictions", "same_side").collect())
    assert len(got) == 4 and got == sorted(con.execute(registry.ORACLE_SQL["j14_tolerance_bands"]).fetchall())


def test_best_match_without_pairs(spark, tmp_path):
    con = events(spark, tmp_path, ROWS)
    df = registry.QUERIES["j15_best_match"](spark, str(tmp_path))
    want = sorted(con.execute(registry.ORACLE_SQL["j15_best_match"]).fetchall())
    assert sorted(tuple(r) for r in df.select("ticket", "p_id", "distance", "grade", "within_30").collect()) == want and len(want) == 2
    # no rows multiplied over neighbouring buckets, which a join of pairs needs
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
