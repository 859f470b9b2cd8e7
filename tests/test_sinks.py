"""The hourly sink: whole rows, whatever they hold, once each over restarts and repeated batches; foreign folders refused."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoloom.streaming import sinks as K

SCHEMA = "id long, ts timestamp_ntz, text string, x double"
T = dt.datetime(2024, 1, 1, 23, 59, 59, 123456)
ROWS = [(1, T, 'a,"b"\nc', 0.1), (2, T + dt.timedelta(seconds=1), "", None), (3, None, None, 1e-300), (4, T, "é\\", -0.0), (4, T, "é\\", -0.0), (5, T, "\\N", 5.0), (6, T, None, 6.0), (7, T, "\\", 7.0)]


def key(r):
    return (r[0], str(r[1:]))


def back(spark, folder):
    rows = K.read_hours(spark, folder, spark.createDataFrame([], SCHEMA).schema).collect()
    return sorted([(r.id, r.ts, r.text, r.x) for r in rows], key=key), {(r.id, r.hour) for r in rows}


def test_restarts_append_and_other_runs_are_refused(spark, tmp_path):
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    K.append_by_hour(stream, folder, "ts", state)
    rows, hours = back(spark, folder)
    assert rows == sorted(ROWS, key=key)
    assert hours == {(1, "2024-01-01-23"), (2, "2024-01-02-00"), (3, None), *((i, "2024-01-01-23") for i in (4, 5, 6, 7))}
    more = [(9, T, "late", 2.0)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    K.append_by_hour(stream, folder, "ts", state)  # the hour gets a second file
    K.append_by_hour(stream, folder, "ts", state)  # nothing new
    assert back(spark, folder)[0] == sorted(ROWS + more, key=key)
    with pytest.raises(FileExistsError):
        K.append_by_hour(stream, folder, "ts", str(tmp_path / "other"))
    assert back(spark, folder)[0] == sorted(ROWS + more, key=key)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    folder, write = str(tmp_path / "out"), K.hourly_writer(str(tmp_path / "out"), "ts")
    df = spark.createDataFrame(ROWS, SCHEMA)
    write(df.where("id < 3"), 0)  # as if it had broken off
    write(df, 0)
    write(df.limit(0), 1)
    assert back(spark, folder)[0] == sorted(ROWS, key=key)
    files = [p.read_text() for p in (tmp_path / "out").rglob("*.csv")]
    assert files and all(f.startswith("id,ts,text,x\n") and f.count("id,ts,text,x") == 1 for f in files)


def test_a_folder_with_other_things_and_clashing_columns_are_refused(spark, tmp_path):
    (tmp_path / "out").mkdir()
    with pytest.raises(FileExistsError):
        K.claim(spark, str(tmp_path / "out"), "me")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withColumn("hour", F.lit(1))
    with pytest.raises(ValueError):
        K.append_by_hour(stream, str(tmp_path / "new"), "ts", str(tmp_path / "state"))
