"""Periodic runs of words in a text, found in linear time by Lyndon words.

A run is a stretch that repeats with its smallest period and that no neighbouring word extends. For one of the two
orders of the words (first seen first, and its reverse) some place in a run's first period starts a longest Lyndon word
that is exactly one period long (the root). So the next smaller suffix of every place, for both orders, gives all runs:
the root's end is the next smaller suffix, and how far the two suffixes agree is how far the run goes on.

The next smaller suffixes come from one pass with a stack of suffixes that rise. A suffix is compared from where the
last comparison ended, and the stretch matched farthest to the right is kept: comparisons inside it are read off its
earlier twin, so that a word is matched again only beyond its end. What a run has before its root is matched to the left
in the same way. Neither suffix arrays nor hashes of stretches are used.

A word of a run of three periods occurs at least three times in it. Words that occur less often in their stretch are
therefore in no such run and cut the text first; the stretches left are searched by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import let, slices


def lyndon(w: list[int], seen: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Of every place, where the next smaller suffix starts (the end if none does) and how many words the two share.

    The end of ``w`` is less than any word. ``seen``, if given, gets the number of words that were matched.
    """
    n = len(w)
    same = [0] * (n + 1)  # what a suffix shares with the next one
    for i in range(n - 2, -1, -1):
        if w[i] == w[i + 1]:
            same[i] = same[i + 1] + 1
    later, shared = [n] * n, [0] * n
    before, ahead = [-1] * n, [0] * n  # the last smaller suffix to the left, and what it shares
    start = end = shift = matched = 0  # w[start:end] is w[start - shift:end - shift]
    for r in range(1, n):
        t, k = r - 1, same[r - 1]
        while r + k == n or w[r + k] < w[t + k]:
            later[t], shared[t] = r, k
            below, t = ahead[t], before[t]
            if t < 0:
                break
            if below < k:
                k = below
                break
            if below > k:
                continue
            if r < end and t >= start:
                u, v = t - shift, r - shift
                known = shared[u] if later[u] == v else ahead[v] if before[v] == u else -1
                if 0 <= known < end - r:
                    k = known
                    continue
                if known >= 0:
                    k = max(k, end - r)
            a, b = t + k, r + k
            while b < n and w[a] == w[b]:
                a += 1
                b += 1
            matched += b - r - k
            k = b - r
            if b >= end:
                start, end, shift = r, b, r - t
        else:
            before[r], ahead[r] = t, k
            continue
        before[r], ahead[r] = t, k if t >= 0 else 0
    if seen is not None:
        seen.append(matched)
    return later, shared


def stretch_runs(w: list[int], min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``min_length`` words and ``min_exponent`` periods (two or more)."""
    n, out = len(w), set()
    for order in (w, [-x for x in w]):
        later, shared = lyndon(order)
        left: dict[int, int] = {}
        low = high = shift = n  # w[low:high] is w[low + shift:high + shift]
        for i in range(n - 1, -1, -1):
            j = later[i]
            p, more = j - i, shared[i]
            if j == n or 2 * p + more - 1 < max(min_length, min_exponent * p) or (i >= p and later[i - p] == i and shared[i - p] >= p):
                continue  # too short even with most of a period before it, or not the first root of its run
            k = 0
            if low < i and j <= high:
                twin = left.get(i + shift, -1) if later[i + shift] == j + shift else -1
                k = twin if 0 <= twin < i - low else i - low if twin >= 0 else 0
            while k < i and order[i - 1 - k] == order[j - 1 - k]:
                k += 1
            left[i] = k
            if i - k <= low:
                low, high, shift = i - k, i, p
            if k + p + more >= max(min_length, min_exponent * p):
                out.add((i - k, k + p + more, p))
    return out


def stretches(ids: np.ndarray, min_length: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``min_length`` words that can hold runs in which each word occurs ``least`` times."""
    alive, before = np.ones(len(ids), dtype=bool), len(ids) + 1
    while True:
        edge = np.diff(np.concatenate(([False], alive, [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= min_length
        starts, ends = starts[long], ends[long]
        size = int((ends - starts).sum())
        if not size or 8 * size > 7 * before:  # nothing left, or another round would hardly cut
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        before = size
        at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
        _, which, n = np.unique(np.repeat(np.arange(len(starts)), ends - starts) * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        alive = np.zeros(len(ids), dtype=bool)
        alive[at] = n[which] >= least


def runs(words: list, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    if len(words) < min_length:
        return []
    number: dict = {}
    ids = [number.setdefault(x, len(number)) for x in words]
    out = []
    for a, b in stretches(np.array(ids), min_length, min_exponent):
        out += [(a + start, length, p) for start, length, p in stretch_runs(ids[a:b], min_length, min_exponent)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def find(docs: DataFrame, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """A row per document: doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Input: doc_id, text and any other columns, which are not carried. Words are longest runs of other characters than
    ASCII white space; places count from 0. The collapsed text has each run's first period only, its words joined by one
    space; where runs overlap, a word that any of them drops is gone. A null text counts as empty and has no run; rows
    with a null or repeated doc_id each give a row; an empty table gives none. Very long texts take memory and time in
    proportion to their words.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches):
            n_words, found, collapsed = [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = (raw or b"").split()  # of bytes: ASCII white space only
                own = runs(words, min_length, min_exponent)
                n_words.append(len(words))
                found.append([{"start": a, "length": length, "period": p} for a, length, p in own])
                if own:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for a, length, p in own:
                        gone[a + p] += 1
                        gone[a + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, kinds), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The documents with texts that repeat where the hash of the doc_id says so: the query's input by its contract.

    With h the crc32 of the doc_id's digits, g = h div 10 and n words, a text with h mod 10 = 0 repeats, from word
    a = g mod n on, its next 1 + (n - a) div (3 + g mod 8) words up to its length. A null doc_id has no digits: its text
    stays as it is, like an empty or null text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def edited(words: Column) -> Column:
        n = F.size(words).cast("long")

        def repeated(v: Column) -> Column:
            more = F.transform(F.sequence(F.lit(0).cast("long"), v["n"] - v["a"] - 1), lambda i: F.get(v["w"], (v["a"] + i % v["p"]).cast("int")))
            return F.array_join(F.concat(F.slice(v["w"], F.lit(1), v["a"].cast("int")), more), " ")

        g = F.floor(h / 10)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, let(F.struct(words.alias("w"), n.alias("n"), a.alias("a"), p.alias("p")), repeated)).otherwise(F.lit(""))

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, edited)).otherwise(F.col("text")).alias("text"))


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of words in every document, that with the most periods, and digests of all runs and of the collapsed text."""
    found = find(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)  # of equal ones the first stays

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
