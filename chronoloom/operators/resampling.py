"""Resampling tests whose draws are hashes: reruns agree, replicates are columns of one pass, not jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*cols: Column | str) -> Column:
    """A number in (0, 1) drawn by the columns, from an MD5 digest that any engine can make."""
    h = F.md5(F.concat_ws(":", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)


def uniform_sql(*cols: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(cols)})), 1, 13))::BIGINT + 0.5) * {2.0**-52!r})"


def bootstrap_mean(df: DataFrame, key: str, cluster: str, x: str, replicates: int) -> DataFrame:
    """Mean of ``x`` per key with a percentile interval over Poisson(1) weights of the clusters."""
    c = df.groupBy(key, cluster).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    r = c.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = uniform(F.col("r"), F.col(key), F.col(cluster).cast("string"))
    # inverse of the Poisson(1) distribution function
    cdf, p, k = 0.0, 0.36787944117144233, 0
    weight = F.lit(0)
    for k in range(8):
        cdf += p
        weight = weight + (u > cdf).cast("int")
        p /= k + 1
    m = r.withColumn("w", weight).groupBy(key, "r").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    ci = m.groupBy(key).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    mean = c.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("mean"))
    return mean.join(ci, key).select(key, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def permutation_difference(df: DataFrame, key: str, label: Column, x: str, row: str, replicates: int) -> DataFrame:
    """Difference of means of labelled and other rows per key, with the add-one p-value of random labels of the same number.

    A replicate gives labels to each row by a hash against the share of labelled rows, so it needs no sort.
    """
    d = df.select(key, label.cast("int").alias("y"), F.col(x).alias("x"), F.col(row).alias("row"))
    share = d.groupBy(key).agg(F.avg("y").alias("share"))
    d = d.join(F.broadcast(share), key)  # a row per key
    r = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    y = F.when(F.col("r") == 0, F.col("y")).otherwise((uniform(F.col("r"), F.col("row")) < F.col("share")).cast("int"))
    m = r.withColumn("y", y).groupBy(key, "r").agg((F.avg(F.when(F.col("y") == 1, F.col("x"))) - F.avg(F.when(F.col("y") == 0, F.col("x")))).alias("d"))
    obs = m.where("r = 0").select(key, F.col("d").alias("observed"))
    j = m.where("r > 0").join(obs, key)
    return j.groupBy(key).agg(F.max("observed").alias("difference"), ((1 + F.count_if(F.abs("d") >= F.abs("observed"))) / (1 + F.count("d"))).alias("p_value"))


def power_curve(spark, sizes: list[int], effect: float, replicates: int) -> DataFrame:
    """Share of replicates whose mean of n noisy gains exceeds 1.96 standard errors, per n; noise by hashed normal draws."""
    grid = spark.createDataFrame([(n,) for n in sizes], "n int").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    z = F.sqrt(-2 * F.log(uniform(F.lit(1), "n", "r", "i"))) * F.cos(6.283185307179586 * uniform(F.lit(2), "n", "r", "i"))
    g = grid.withColumn("x", z + effect).groupBy("n", "r").agg((F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count("x")))).alias("t"))
    return g.groupBy("n").agg(F.avg((F.col("t") > 1.96).cast("int")).alias("power"))


def weighted_sample(df: DataFrame, key: str, weight: str, row: str, n: int) -> DataFrame:
    """``n`` rows per key without replacement with chances proportional to weight."""
    from pyspark.sql import Window as W

    draw = -F.log(uniform(F.lit(9), F.col(row))) / F.col(weight)
    return df.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(draw, row))).where(F.col("r") <= n).drop("r")


def burst_null(ticks: DataFrame, gap_seconds: int, replicates: int) -> DataFrame:
    """Per symbol the mean number of bursts a day, and the share of random clocks with as few."""
    from pyspark.sql import Window as W

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    day = 86_400_000_000
    t = ticks.select("symbol", "event_id", F.floor(us / day).alias("day"), F.pmod(us, F.lit(day)).alias("at"))
    r = t.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    r = r.withColumn("at", F.when(F.col("r") == 0, F.col("at")).otherwise((uniform("r", "event_id") * day).cast("long")))
    w = W.partitionBy("symbol", "day", "r").orderBy("at", "event_id")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > gap_seconds * 1_000_000, F.lit(True))
    b = r.withColumn("new", new).groupBy("symbol", "r").agg((F.count_if("new") / F.countDistinct("day")).alias("b"))
    obs = b.where("r = 0").select("symbol", F.col("b").alias("bursts_per_day"))
    return b.where("r > 0").join(obs, "symbol").groupBy("symbol").agg(F.max("bursts_per_day").alias("bursts_per_day"), F.avg("b").alias("expected"), ((1 + F.count_if(F.col("b") <= F.col("bursts_per_day"))) / (1 + F.count("*"))).alias("p_value"))
