"""Folds and ranks against plain twins, over several months."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import splits as S

T0 = datetime(2024, 1, 20)
EPOCH = datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(500):
        t = T0 + timedelta(seconds=rng.choice([rng.randrange(75 * 86400), 40 * 86400]))
        out.append((i, t, t + timedelta(hours=rng.randrange(1, 200))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([*rows, (900, None, None)], "id int, t timestamp_ntz, until timestamp_ntz")


def test_ranks_equal_a_sort(df, rows):
    for stretch in (3600, 10**7):
        got = {r.id: r["rank"] for r in S.exact_ranks(df, "t", "id", stretch=stretch).collect()}
        want = [900] + [i for i, *_ in sorted(rows, key=lambda r: (r[1], r[0]))]
        assert got == {i: n for n, i in enumerate(want)}


def test_event_folds_equal_a_twin(df, rows):
    times = sorted({us(t) for _, t, _ in rows})
    borders = S.event_borders(df, "t", 160, 4)
    size = (len(times) - 160) // 4
    assert [b[0] for b in borders] == [1, 2, 3, 4]
    for i, (_, a, b, c) in enumerate(borders):
        assert (a, b) == (times[160 + i * size - 1], times[160 + i * size])
        assert c == (times[-1] if i == 3 else times[160 + (i + 1) * size - 1])
    embargo = 3 * 86400 * 1_000_000
    got = {(r.id, r.fold): r.role for r in S.roles(df, S.micros("t"), borders, S.micros("until"), embargo).collect()}
    assert len(got) == 4 * 501
    for i, t, until in rows:
        for k, a, b, c in borders:
            role = "purged" if us(t) <= a and (us(until) >= b or us(t) >= b - embargo) else "train" if us(t) <= a else "test" if b <= us(t) <= c else "excluded"
            assert got[i, k] == role
    assert all(got[900, k] == "excluded" for k in (1, 2, 3, 4)) and {*got.values()} == {"train", "test", "purged", "excluded"}
    with pytest.raises(ValueError):
        S.event_borders(df.limit(50), "t", 160, 4)


def test_row_and_time_folds(spark, df, rows):
    assert S.row_borders(600, 5, 60) == [(1, 99, 160, 199), (2, 199, 260, 299), (3, 299, 360, 399), (4, 399, 460, 499), (5, 499, 560, 599)]
    low, high = min(us(t) for _, t, _ in rows), max(us(t) for _, t, _ in rows)
    (_, a, b, c), (_, d, _, e) = S.share_borders(df, "t", (0.5, 0.8))
    assert a == low + (high - low) // 2 and b == a + 1 and c == d and e == high
    assert S.share_borders(df.limit(0), "t", (0.5,)) == []


def test_days_go_on_over_months(spark, df):
    first, days = S.span(df, "t")
    got = [r.d for r in df.where("t is not null").select(S.day_number("t", first).alias("d")).collect()]
    assert min(got) == 1 and max(got) == days > 70
    assert [S.cut(30, (2 + i) / 5) for i in range(4)] == [12, 18, 24, 30] and S.cut(31, 0.4) == 13
    assert S.span(df.limit(0), "t") == (None, 0)
