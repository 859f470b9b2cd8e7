"""Locks of tables and models: a digest that does not depend on the order of rows, written as a manifest and checked later."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row's SHA-256 is cut in lanes of 12 hexadecimal digits (48 bits); sums of a lane stay exact to 10**23 rows.
LANES, DIGITS = 5, 12


class LockError(ValueError):
    """What differs between a table and its lock."""


def digest(df: DataFrame) -> dict:
    """{columns, rows, sha256} of a table as a multiset of rows: columns by name, rows in any order and partitioning.

    A row is its JSON with nulls; its hash is added up in wide lanes, map-side first, so one row of sums is shuffled a
    task. Repeated rows count. Columns of one type and name are the same whatever their order.
    """
    columns = sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}), 256)
    lane = lambda i: F.sum(F.conv(F.substring(row, 1 + i * DIGITS, DIGITS), 16, 10).cast("decimal(15,0)")).cast("string").alias(f"l{i}")
    r = df.agg(F.count("*").alias("n"), *[lane(i) for i in range(LANES)]).first()
    text = json.dumps([columns, r["n"], *[r[f"l{i}"] for i in range(LANES)]])
    return {"columns": columns, "rows": r["n"], "sha256": hashlib.sha256(text.encode()).hexdigest()}


def write_lock(df: DataFrame, path: str) -> dict:
    """Writes the table's digest as a manifest to a new folder; an existing one is an error, as a lock is made once."""
    d = digest(df)
    df.sparkSession.createDataFrame([(json.dumps(d, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return d


def read_lock(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def check_lock(df: DataFrame, path: str) -> dict:
    """The table's digest, if it is the one of its lock; else a ``LockError`` that names what differs."""
    want, got = read_lock(df.sparkSession, path), digest(df)
    wrong = [k for k in ("columns", "rows", "sha256") if want[k] != got[k]]
    if wrong:
        raise LockError("; ".join(f"{k}: locked {want[k]}, found {got[k]}" for k in wrong))
    return got
