"""Table locks, and two recordings of one stream with planted losses, repeats and drift."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import reconcile as K
from chronoloom.sources import locks as L

T0 = datetime(2024, 1, 1)


def test_a_lock_holds_for_the_same_rows_only(spark, tmp_path):
    rows = [(i, f"v{i % 7}", i / 3, None if i % 5 else T0 + timedelta(seconds=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b string, c double, d timestamp_ntz")
    d = L.write_lock(df, f"{tmp_path}/lock")
    assert d["rows"] == 300 and L.read_lock(spark, f"{tmp_path}/lock") == d
    for same in (df.repartition(5), df.orderBy(F.desc("a")), df.select("d", "b", "a", "c")):
        assert L.check_lock(same, f"{tmp_path}/lock") == d
    changed = rows[:]
    changed[17] = (17, "other", *rows[17][2:])
    swapped = rows[:]
    swapped[3], swapped[4] = (rows[3][0], *rows[4][1:]), (rows[4][0], *rows[3][1:])
    nulled = [(*rows[0][:3], None), *rows[1:]]
    for other in (changed, swapped, nulled, rows[1:], rows + rows[:1]):
        with pytest.raises(L.LockError):
            L.check_lock(spark.createDataFrame(other, df.schema), f"{tmp_path}/lock")
    for other in (df.withColumn("a", F.col("a").cast("int")), df.withColumnRenamed("b", "e"), df.limit(0)):
        with pytest.raises(L.LockError):
            L.check_lock(other, f"{tmp_path}/lock")
    with pytest.raises(Exception, match="(?i)exist"):
        L.write_lock(df, f"{tmp_path}/lock")
    assert L.digest(df.limit(0)) == L.digest(df.where("a < 0"))


def test_planted_differences_are_counted(spark):
    rng = random.Random(2)
    a, b = [], []
    lost = repeated = extra = 0
    for s, drift in (("x", 2.0), ("y", -5.0)):
        t = T0
        for i in range(400):
            t += timedelta(seconds=rng.choice([0.4, 3, 20, 4000 if rng.random() < 0.05 else 1]))
            quote = (s, 100 + rng.randrange(40) / 10, 101 + rng.randrange(40) / 10)
            a.append((s, t, *quote[1:]))
            if rng.random() < 0.05:
                lost += 1
                continue
            b.append((s, t + timedelta(seconds=drift + rng.uniform(-0.1, 0.1)), *quote[1:]))
            if rng.random() < 0.04:
                repeated += 1
                b.append(b[-1])
        for _ in range(6):
            extra += 1
            b.append((s, T0 + timedelta(days=rng.randrange(300, 400)), 50.0 + rng.random(), 60.0))
    a += [("z", T0, None, 1.0)]
    schema = "symbol string, ts timestamp_ntz, bid double, ask double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {r.symbol: r for r in K.reconciled(left, right).collect()}
    x, y = got["x"], got["y"]
    assert abs(x.drift_seconds - 2.0) < 0.05 and abs(y.drift_seconds + 5.0) < 0.05
    assert x.repeated_b + y.repeated_b == repeated and x.repeated_a + y.repeated_a == 0
    assert x.pairs + y.pairs == 800 - lost and x.only_a + y.only_a == lost and x.only_b + y.only_b == extra
    assert got["z"].pairs == 0 and got["z"].rows_a == 1 and got["z"].hours_both == 0
    back = {r.symbol: r for r in K.reconciled(right, left).collect()}
    assert all((back[s].pairs, back[s].only_a, back[s].only_b) == (got[s].pairs, got[s].only_b, got[s].only_a) for s in "xy")
    pairs, _ = K.aligned(left, right)
    pairs = pairs.collect()
    assert len({(r.symbol, r.a_ts, r.b_ts) for r in pairs}) == len(pairs)
