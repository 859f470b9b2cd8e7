"""Sinks that append by hour and can be run again after any failure without losing or repeating a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CSV = {"header": "true", "escape": '"', "nullValue": "\\N", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _strings(df: DataFrame, change) -> DataFrame:
    """Nulls are written as \\N, so a text that begins with a backslash gets one more on its way out and loses it on its way back."""
    return df.withColumns({f.name: F.when(F.col(f.name).startswith("\\"), change(F.col(f.name))).otherwise(F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != "hour"})


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def claim(spark: SparkSession, folder: str, owner: str) -> None:
    """Takes an unused ``folder`` for ``owner``, or goes on with the owner's own; a folder with anything else in it is an error."""
    mark = f"{folder}/_owner"
    if _exists(spark, mark):
        held = [r["value"] for r in spark.read.text(mark).limit(2).collect()]
        if held == [owner]:
            return
        raise FileExistsError(f"{folder} belongs to another run")
    if _exists(spark, folder):
        raise FileExistsError(f"{folder} exists")
    spark.createDataFrame([(owner,)], "value string").coalesce(1).write.text(mark)


def hourly_writer(folder: str, ts: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's rows as CSV files with one header each, under its number and the hour of ``ts``.

    A batch that comes again replaces what it wrote. Rows are dealt by hour; an hour of many rows is cut to several files
    and small ones are put together. Rows without a time have an hour of their own (null).
    """

    def write(df: DataFrame, batch: int) -> None:
        hour = F.date_format(F.col(ts), "yyyy-MM-dd-HH")
        _strings(df, lambda c: F.concat(F.lit("\\"), c)).withColumn("hour", hour).hint("rebalance", "hour").write.mode("overwrite").partitionBy("hour").options(**_CSV).csv(f"{folder}/rows/batch={batch:08d}")

    return write


def append_by_hour(stream: DataFrame, folder: str, ts: str, checkpoint: str) -> None:
    """Appends what the stream holds now. The first run takes ``folder``, which must not exist; later runs with the same
    ``checkpoint`` go on where it ended; any other run is refused. ``stream`` must not have columns hour and batch."""
    if {"hour", "batch"} & set(stream.columns):
        raise ValueError("hour and batch are columns of the files")
    claim(stream.sparkSession, folder, checkpoint)
    q = stream.writeStream.foreachBatch(hourly_writer(folder, ts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_hours(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The appended rows with their ``hour`` (yyyy-MM-dd-HH) and ``batch``; a filter on hour reads only its files."""
    full = StructType(list(schema.fields)).add("batch", "integer").add("hour", "string")
    return _strings(spark.read.schema(full).options(**_CSV, multiLine="true").csv(f"{folder}/rows"), lambda c: F.substr(c, F.lit(2)))
