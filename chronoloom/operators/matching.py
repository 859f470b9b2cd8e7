"""Matching: one-to-one assignment within tolerance, uniqueness checks and exact nearest vectors."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, which fails at run time if a key occurs twice."""
    n = F.count("*").over(W.partitionBy(*keys))
    ok = F.assert_true(n == 1, F.lit(f"{keys} must be unique"))
    return df.withColumn("_ok", ok).where("_ok is null").drop("_ok")


def aligned(o: list[int], p: list[int], tolerance: int) -> list[tuple[int, int]]:
    """Most pairs of ascending times within ``tolerance``, and among these the least total distance.

    On a line, matches that cross can be uncrossed at no cost, so both sides are walked in order: the best of the first
    i and j is that without the one, without the other, or with the two as a pair. Only j within the tolerance of i are
    looked at, so memory and time are the number of such pairs.
    """
    pair = (min(len(o), len(p)) + 1) * tolerance + 1  # one more pair outweighs all distances
    best, ranges, taken = [0], [], []
    lo = hi = 0
    for x in o:
        while lo < len(p) and p[lo] < x - tolerance:
            lo += 1
        while hi < len(p) and p[hi] <= x + tolerance:
            hi += 1
        best += [best[-1]] * (max(lo, hi) + 1 - len(best))
        how, before = bytearray(hi - lo), best[lo]
        for j in range(lo, hi):
            old, both = best[j + 1], before + pair - abs(x - p[j])
            how[j - lo] = 2 if both >= old and both >= best[j] else 1 if best[j] > old else 0
            best[j + 1], before = max(old, best[j], both), old
        ranges.append((lo, hi))
        taken.append(how)
    out, j = [], len(p)
    for i in range(len(o) - 1, -1, -1):
        lo, hi = ranges[i]
        j = min(j, hi)
        while j > lo and taken[i][j - 1 - lo] == 1:
            j -= 1
        if j > lo and taken[i][j - 1 - lo] == 2:
            j -= 1
            out.append((i, j))
    return out[::-1]


def _find(link: list[int], i: int) -> int:
    while link[i] != i:
        link[i] = link[link[i]]
        i = link[i]
    return i


def nearest_left(o: list[int], p: list[int], tolerance: int) -> list[tuple[int, int]]:
    """Each of ``o`` in order takes the nearest of ``p`` that is left, within ``tolerance``; the earlier at equal distance."""
    later, earlier = list(range(len(p) + 1)), list(range(len(p) + 1))  # links over those that are gone; earlier[i] is p[i - 1]
    out = []
    for i, x in enumerate(o):
        at = bisect_left(p, x)
        near = [j for j in (_find(earlier, at) - 1, _find(later, at)) if 0 <= j < len(p) and abs(p[j] - x) <= tolerance]
        if near:
            j = min(near, key=lambda j: (abs(p[j] - x), j))
            j = _find(later, bisect_left(p, p[j]))  # the first of equal times
            out.append((i, j))
            later[j], earlier[j + 1] = j + 1, j
    return out


def match_one_to_one(observed: DataFrame, predicted: DataFrame, *, on: list[str], tolerance: float, greedy: bool = False) -> DataFrame:
    """Rows of status tp, fn or fp: o_id, p_id, ``on`` columns, seconds between a matched pair.

    Observed (o_id, o_ts) and predicted (p_id, p_ts) with equal ``on`` may match within ``tolerance`` seconds. The best
    matching has the most pairs and among these the least total time; greedy takes observed in order of time. Events
    of a key further apart than the tolerance cannot compete, so the time line is cut at such gaps and each stretch is
    matched on its own, in parallel.
    """
    null = lambda t: F.lit(None).cast(t)
    o = observed.select(*on, F.col("o_ts").alias("ts"), "o_id", null("string").alias("p_id"))
    p = predicted.select(*on, F.col("p_ts").alias("ts"), null("string").alias("o_id"), "p_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy(*on).orderBy("ts", F.coalesce("o_id", "p_id"))
    gap = F.coalesce((micros - F.lag(micros).over(w)) > tolerance * 1e6, F.lit(True)).cast("int")
    cut = o.unionByName(p).withColumn("us", micros).withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(w))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stretch", "us"], kind="stable")
        o_ids, p_ids, us = pdf.o_id.to_numpy(dtype=object), pdf.p_id.to_numpy(dtype=object), pdf.us.to_numpy()
        edges = np.flatnonzero(np.diff(pdf.stretch.to_numpy(), prepend=-1, append=-1))
        seen = np.array([x is not None for x in o_ids], dtype=bool)
        rows: list[tuple] = []
        for s, e in zip(edges, edges[1:]):
            a, b = s + np.flatnonzero(seen[s:e]), s + np.flatnonzero(~seen[s:e])
            pairs = (nearest_left if greedy else aligned)(us[a].tolist(), us[b].tolist(), int(tolerance * 1e6))
            rows += [("tp", o_ids[a[i]], p_ids[b[j]], abs(int(us[a[i]] - us[b[j]])) / 1e6) for i, j in pairs]
            rows += [("fn", o_ids[a[i]], None, None) for i in sorted(set(range(len(a))) - {i for i, _ in pairs})]
            rows += [("fp", None, p_ids[b[j]], None) for j in sorted(set(range(len(b))) - {j for _, j in pairs})]
        out = pd.DataFrame(rows, columns=["status", "o_id", "p_id", "seconds"])
        for i, k in enumerate(on):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    keys = ", ".join(f"{k} {observed.schema[k].dataType.simpleString()}" for k in on)
    return cut.groupBy(*on, F.floor(F.col("stretch") / 256)).applyInPandas(solve, f"{keys}, status string, o_id string, p_id string, seconds double")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` by Euclidean distance (ties by id), without itself.

    The stated query set goes to all rows in blocks of ``block`` broadcast queries; each task keeps its best ``k`` per
    query, so what is shuffled is k rows per query and task.
    """
    q = queries.select("vec_id", "label", "embedding")
    blocks = -(-q.count() // block)
    out = None
    for b in range(max(1, blocks)):
        rows = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))) == b).collect()  # about ``block`` rows
        some = vectors.select("vec_id", "embedding", "label").mapInPandas(_best_of(rows, k), "q_id long, n_id long, dist double, same boolean")
        out = some if out is None else out.unionByName(some)
    w = W.partitionBy("q_id").orderBy("dist", "n_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "n_id", "rank", F.round("dist", 6).alias("dist"), "same")


def _best_of(rows, k: int):
    q_ids, q_labels = [r["vec_id"] for r in rows], [r["label"] for r in rows]
    y = np.array([r["embedding"] for r in rows], dtype=np.float64)

    def run(batches):
        best: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf) or not len(q_ids):
                continue
            x = np.stack(pdf.embedding.to_list()).astype(np.float64)
            ids, labels = pdf.vec_id.to_numpy(), pdf.label.to_numpy()
            for i, (q, label) in enumerate(zip(q_ids, q_labels, strict=True)):
                d = np.sqrt(((x - y[i]) ** 2).sum(axis=1))
                d[ids == q] = np.inf
                near = np.lexsort((ids, d))[: k + 1]
                got = [(float(d[j]), int(ids[j]), bool(labels[j] == label)) for j in near if np.isfinite(d[j])]
                best[q] = sorted(best.get(q, []) + got)[:k]
        yield pd.DataFrame([(q, n, d, s) for q, b in best.items() for d, n, s in b], columns=["q_id", "n_id", "dist", "same"])

    return run
