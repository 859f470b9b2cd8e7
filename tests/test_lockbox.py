"""Grouped validation, capture, identity and exact quantiles against plain twins."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import lockbox as L
from chronoloom.operators import selection as Q

SCHEMA = "g int, ts timestamp_ntz, y int, a double, b double"


def made(groups=40, seed=2, beta=(1.2, -0.7)):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        n = int(r.integers(6, 15))
        x = r.normal(size=(n, 2))
        p = np.exp(x @ beta)
        case = r.choice(n, p=p / p.sum())
        rows += [(g, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * g, minutes=i), int(i == case), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return rows


def plain_ll(rows, beta):
    by = {}
    for g, _, y, a, b in rows:
        by.setdefault(g, []).append((y, a * beta[0] + b * beta[1]))
    return sum(next(e for y, e in v if y) - math.log(sum(math.exp(e) for _, e in v)) for v in by.values())


def plain_fit(rows, lam):
    """Ascent by numerical curvature: slow and plain."""
    beta = np.zeros(2)
    value = lambda b: plain_ll(rows, b) - 0.5 * lam * b @ b
    eye, h = np.eye(2), 1e-4
    for _ in range(30):
        g = np.array([(value(beta + h * e) - value(beta - h * e)) / (2 * h) for e in eye])
        c = np.array([[(value(beta + h * (p + q)) - value(beta + h * (p - q)) - value(beta - h * (p - q)) + value(beta - h * (p + q))) / (4 * h * h) for q in eye] for p in eye])
        beta = beta - np.linalg.solve(c, g)
    return beta


def test_folds_are_equal_blocks_of_strata_in_time(spark):
    rows = made(groups=23)
    got = {r["g"]: r["fold"] for r in L.stratum_folds(spark.createDataFrame(rows, SCHEMA), ["g"], "ts", 5).collect()}
    assert got == {int(g): i for i, part in enumerate(np.array_split(np.arange(23), 5)) for g in part}
    few = L.stratum_folds(spark.createDataFrame(made(groups=3), SCHEMA), ["g"], "ts", 5)
    assert sorted(r["fold"] for r in few.collect()) == [0, 1, 2]


def test_all_fits_equal_plain_fits(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    fold = {r["g"]: r["fold"] for r in L.stratum_folds(df, ["g"], "ts", 3).collect()}
    fits = L.fit_all(df.join(L.stratum_folds(df, ["g"], "ts", 3), "g"), ["g"], "y", ["a", "b"], (0.01, 1.0, 30.0))
    assert len(fits) == 12
    for f in fits:
        train = [r for r in rows if fold[r[0]] != f["fold"]]
        want = plain_fit(train, f["penalty"])
        assert np.allclose(f["beta"], want, atol=1e-5)
        assert math.isclose(f["train_ll"], plain_ll(train, f["beta"]), rel_tol=1e-9) and f["train_n"] == len({r[0] for r in train})
        if f["fold"] >= 0:
            held = [r for r in rows if fold[r[0]] == f["fold"]]
            assert math.isclose(f["held_ll"], plain_ll(held, f["beta"]), rel_tol=1e-9) and f["held_n"] == len({r[0] for r in held})
    best, score = L.choose(fits)
    want = {p: sum(f["held_ll"] for f in fits if f["penalty"] == p and f["fold"] >= 0) / 40 for p in (0.01, 1.0, 30.0)}
    assert score == pytest.approx(want) and best == max(want, key=want.get)


def test_steps_are_halved_where_a_full_one_overshoots(spark):
    rows = [(0, dt.datetime(2024, 1, 1), int(i == 0), 6.0 if i == 0 else float(-i % 3), 0.1 * i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fold", F.lit(0))
    (f,) = L.fit_all(df, ["g"], "y", ["a", "b"], (0.01,))
    assert np.isfinite(f["beta"]).all() and f["train_ll"] > -0.1  # one stratum, separable: the penalty holds it
    value = lambda b: plain_ll(rows, b) - 0.005 * b @ b
    assert all(value(f["beta"]) >= value(f["beta"] + d) - 1e-9 for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]))


def test_what_is_learnt_comes_from_the_given_rows_and_finds_the_planted_weights(spark):
    rows = [(g, t, y, 100 + 5 * a, b) for g, t, y, a, b in made(groups=400)]
    with_nulls = rows + [(0, dt.datetime(2024, 1, 1), 0, None, 1.0)]
    frozen, fits = L.freeze(spark.createDataFrame(with_nulls, SCHEMA), ["g"], "y", ["a", "b"], "ts", penalties=(1e-3, 1.0))
    a = np.array([r[3] for r in rows])
    assert frozen.mean[0] == pytest.approx(a.mean()) and frozen.sd[0] == pytest.approx(a.std())
    assert frozen.beta[0] / frozen.sd[0] * 5 == pytest.approx(1.2, abs=0.25) and frozen.beta[1] / frozen.sd[1] == pytest.approx(-0.7, abs=0.25)
    assert len(fits) == 12 and frozen.penalty in (1e-3, 1.0)


def test_a_stratum_without_its_one_case_is_an_error(spark):
    rows = made(groups=3) + [(9, dt.datetime(2024, 1, 9), 0, 1.0, 1.0)]
    with pytest.raises(ValueError, match="exactly one case"):
        L.fit_all(spark.createDataFrame(rows, SCHEMA).withColumn("fold", F.lit(0)), ["g"], "y", ["a", "b"], (1.0,))


def test_capture_equals_a_loop(spark):
    rows = made(groups=30) + [(90, dt.datetime(2024, 2, 1), 1, 0.1, 0.1), (91, dt.datetime(2024, 2, 1), 0, None, 0.1)]  # few controls; nothing to score
    rows += [(92, dt.datetime(2024, 2, 2), int(i == 4), 1.0, 1.0) for i in range(10)]  # ties
    df = spark.createDataFrame(rows, SCHEMA).withColumn("half", F.col("g") % 2)
    got = {r["half"]: r for r in L.capture(df, ["g"], "y", F.col("a") - F.col("b"), by=["half"]).collect()}
    want = {0: [], 1: []}
    for g in {r[0] for r in rows}:
        s = [(y, a - b) for gg, _, y, a, b in rows if gg == g and a is not None]
        if len(s) < 6:
            continue
        case = next(e for y, e in s if y)
        rank = 1 + sum(e > case for _, e in s)
        want[g % 2].append((case - math.log(sum(math.exp(e) for _, e in s)), -math.log(len(s)), rank == 1, rank <= 5, rank <= math.ceil(len(s) * 0.1), (len(s) - rank + 1) / len(s)))
    for h, v in want.items():
        m = np.array(v, float).mean(axis=0)
        r = got[h]
        assert r.strata == len(v) and r.excluded == 1
        assert np.allclose([r.ll_per_case, r.null_per_case, r.top_1, r.top_5, r.top_decile, r.mean_percentile], m) and r.improvement == pytest.approx(m[0] - m[1])


def test_identity_by_part_and_over_all(spark):
    df = spark.createDataFrame([("d", 1, 1.0), ("d", 0, 2.0), ("d", 0, None), ("l", 1, 0.0), (None, None, 3.0)], "part string, y int, eta double")
    got = {r["part"]: r for r in L.identity(df, "y", F.col("eta") >= 1, "part").collect()}
    assert (got["d"].tp, got["d"].fp, got["d"].fn, got["d"].tn) == (1, 1, 0, 1) and got["d"].f1 == pytest.approx(2 / 3)
    assert (got["l"].precision, got["l"].recall, got["l"].f1) == (0, 0, 0) and got[None].fp == 1
    assert (got["ALL"].tp, got["ALL"].fp, got["ALL"].fn, got["ALL"].tn) == (1, 2, 1, 1)
    empty = L.identity(df.where("false"), "y", F.col("eta") >= 1, "part").collect()
    assert [(r["part"], r["tp"], r["f1"]) for r in empty] == [("ALL", 0, 0.0)]


@pytest.mark.parametrize("values", [list(np.random.default_rng(0).normal(size=3000)), [1.0] * 900 + [2.0] * 100, list(map(float, range(1000))), [5.0], [0.0, -0.0, 7.0]])
@pytest.mark.parametrize("fit", [1, 50, 100_000])
def test_quantiles_are_exact_however_few_rows_are_sorted(spark, values, fit):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "x double")
    for q in (0.0, 0.31, 0.99, 1.0):
        assert Q.quantile(df, "x", q, fit=fit) == pytest.approx(float(np.quantile(values, q)))


def test_quantile_of_nothing_and_ranks_beyond_the_data(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.quantile(df, "x", 0.5) is None
    with pytest.raises(ValueError):
        Q.order_statistics(df, "x", [0])


def test_an_epoch_is_where_its_first_record_is(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(e, t + dt.timedelta(hours=h), f"{h}") for h, e in enumerate("aabbcbd")], "e string, at timestamp_ntz, id string")
    got = {r["e"]: (r["records"], r["partition"]) for r in L.epoch_partitions(df, "at", "id", ["e"], 3, 4).collect()}
    assert got == {"a": (2, "discovery"), "b": (3, "discovery"), "c": (1, "lockbox"), "d": (1, "lockbox")}
