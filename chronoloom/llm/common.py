"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of up to so many rows are broadcast where ``by_count`` joins them (some 10 MB).
FEW_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside a lambda, a column is otherwise computed for each element."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder.

    ``spark.checkpoint.dir`` names the folder. Where it is unset and all runs on one machine (tests), a temporary one is
    set; on a cluster that is an error, as executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_count(table: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """A side of a join as its rows call for it: broadcast up to ``most`` (``FEW_ROWS``) of them, else sorted and merged.

    Without it Spark judges by the size of the files, which for well packed columns is a small part of what the driver then
    has to hold. ``rows``: how many there are at most, where that is known.
    """
    n = table.count() if rows is None else rows
    return F.broadcast(table) if n <= (FEW_ROWS if most is None else most) else table.hint("merge")


def same_row(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with what ``other`` knows of them: they agree in doc_id (null to null) and text_hash."""
    named = other.withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("text_hash", "_text_hash")
    joined = rows.join(named, rows["doc_id"].eqNullSafe(named["_doc_id"]) & (rows["text_hash"] == named["_text_hash"]), how)
    return joined.drop("_doc_id", "_text_hash")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that a Python worker holds the objects of a few rows only; at the end its free memory goes back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
