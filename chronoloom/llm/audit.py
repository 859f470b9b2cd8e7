"""How the filters of a corpus interact: what each removes in every order, alone, too late, or by mistake.

The texts are scanned where they lie in Arrow's buffers: a table gives each byte its classes (space, capital, symbol,
continuation of a code point), and prefix sums at the rows' offsets count words, capitals, symbols and code points of all
rows of a slice at once. Words become 64-bit hashes, sorted by row; equal neighbours are compared byte by byte, so that
distinct words are counted exactly. A row leaves the scan as a mask of the filters that it fails.

Copies are told apart by a digest of the text: rows are counted by digest and kind before they are shuffled, so that a
group of copies is a few rows. The masks are counted by part; all orders and steps follow from at most 32 counts a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.fingerprints import _mixed, _powers

FILTERS = "ABCDE"
_SPACE, _CAPITAL, _SYMBOL, _MORE = 1, 2, 4, 8
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[list(b"#$%&*|")] = _SYMBOL
_CLASS[0x80:0xC0] = _MORE
#: A slice of rows has about so many bytes of text; a longer text is a slice of its own.
SLICE = 2 << 20


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the rows of a string array, without copying; null rows are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(len(texts) + 1, dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return b[at[0] : at[-1]], at - at[0]


def distinct_words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct words of each row; ``row`` is that of each word."""
    if not len(starts):
        return np.zeros(rows, dtype=np.int64)
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)[:-1]))  # the words' bytes one after the other
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    own = b[np.repeat(starts, size) + place]
    h = _mixed(np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place], first) + size.astype(np.uint64))
    order = np.lexsort((h, row))
    x, y = order[:-1], order[1:]
    same = (row[x] == row[y]) & (h[x] == h[y])
    words = np.bincount(row, minlength=rows)
    out = words - np.bincount(row[y[same]], minlength=rows)
    # verification: neighbours with one hash must have the same bytes
    x, y = x[same], y[same]
    odd = size[x] != size[y]
    wrong = row[x[odd]]
    x, y = x[~odd], y[~odd]
    if len(x):
        n = size[x]
        head = np.concatenate(([0], np.cumsum(n)[:-1]))
        step = np.arange(int(n.sum())) - np.repeat(head, n)
        equal = np.logical_and.reduceat(own[np.repeat(first[x], n) + step] == own[np.repeat(first[y], n) + step], head)
        wrong = np.concatenate((wrong, row[x[~equal]]))
    for r in np.unique(wrong).tolist():  # a collision: count this row's words themselves
        out[r] = len({b[s:e].tobytes() for s, e in zip(starts[row == r].tolist(), ends[row == r].tolist(), strict=True)})
    return out


def scan(texts: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and chars of each row."""
    b, at = buffers(texts)
    c = _CLASS[b]

    def counted(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])

    inner = np.concatenate(([True], (c & _SPACE) > 0, [True]))  # is there a space before and after; row borders count
    before, after = inner[:-2].copy(), inner[2:].copy()
    borders = at[:-1][np.diff(at) > 0]
    before[borders] = True
    after[borders[1:] - 1] = True
    letter = (c & _SPACE) == 0
    starts, ends = np.flatnonzero(letter & before), np.flatnonzero(letter & after) + 1
    row = np.searchsorted(at, starts, side="right") - 1
    words = np.bincount(row, minlength=len(texts))
    return {"words": words, "distinct": distinct_words(b, starts, ends, row, len(texts)), "capitals": counted((c & _CAPITAL) > 0), "symbols": counted((c & _SYMBOL) > 0), "chars": counted((c & _MORE) == 0)}


def mask(s: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of the failed filters A to D: too few words, too few distinct ones, too many capitals, a symbol."""
    fails = (s["words"] < 100, 100 * s["distinct"] < 80 * s["words"], 100 * s["capitals"] > 10 * s["chars"], s["symbols"] > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    _, at = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = ("words", "distinct", "capitals", "symbols", "chars")
    for batch in batches:
        for part in by_bytes(batch, 3):
            s = scan(part.column(3))
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], pa.array(mask(s), pa.int32()), *[pa.array(s[k], pa.int64()) for k in kinds]], names=["doc_id", "part", "digest", "mask", *kinds])
    pa.default_memory_pool().release_unused()


def scanned(docs: DataFrame, part: str = "lang") -> DataFrame:
    """A row per document: doc_id, part, digest of the text, the mask of failed filters A to D, and the counts behind it."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, part string, digest binary, mask int, words long, distinct long, capitals long, symbols long, chars long")


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters A to E, with those labelled good or toxic."""
    kind = ["digest", "part", "mask", "good", "toxic"]
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = scanned(docs, part).select("doc_id", "part", "digest", "mask").join(known.where("doc_id is not null"), "doc_id", "left")
    rows = rows.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    # repeated rows are one row with a count, then the copies of a kind, with how many have the least doc_id
    rows = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    rows = rows.groupBy(*kind).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    first = rows.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    rows = rows.join(first.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
    original = F.col("free") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), original.alias("k")), F.struct(F.col("mask").bitwiseOR(16).alias("m"), (F.col("n") - original).alias("k"))))
    rows = rows.select("part", "good", "toxic", split.alias("s")).where("s.k > 0")
    some = lambda c: F.sum(F.when(F.col(c), F.col("s.k")).otherwise(0)).alias(c)
    return rows.groupBy("part", F.col("s.m").alias("mask")).agg(F.sum("s.k").alias("n"), some("good"), some("toxic"))


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row per part, order of the five filters and step: what the step's filter removes there, and what it would.

    ``docs`` has doc_id, text, the column ``part`` and any others; ``labels`` doc_id, quality and toxic (1 for yes; of
    several rows of a doc_id one is enough). A null text counts as empty, a null part as the empty string. Copies are
    judged by the least doc_id of the text in the whole table; rows that repeat a doc_id with its text fare alike, and a
    null doc_id is nobody's copy, nor labelled. An empty table gives no rows. Very long texts are scanned whole, one
    at a time. Memory in the reduction: 32 counts a part.
    """
    counts = masks(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    rows = counts.select("part", "counts", orders.alias("filter_order"))
    rows = rows.select("part", "counts", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda i: F.pow(F.lit(2), F.ascii(F.substring(F.col("filter_order"), i, F.lit(1))) - ord("A")).cast("int")
    before = F.aggregate(F.when(F.col("step") > 1, F.sequence(F.lit(1), F.col("step") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, i: acc + bit(i))
    rows = rows.select("*", bit(F.col("step")).alias("bit"), before.alias("before"))

    def total(name: str, test, value: str = "n") -> Column:
        add = lambda acc, c: acc + F.when(test(c["mask"]), c[value]).otherwise(0)
        return F.aggregate("counts", F.lit(0).cast("long"), add).alias(name)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    # of the 120 orders, a filter comes first among k failed ones in 120 / k
    shapley = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["mask"]), (c["n"] * 120 / F.greatest(F.bit_count(c["mask"]), F.lit(1))).cast("long")).otherwise(0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("kept", lambda m: ~fails(m) & ~earlier(m)),
        total("removed", removed),
        total("redundant", lambda m: fails(m) & earlier(m)),
        total("unique_fails", lambda m: m == F.col("bit")),
        total("good_lost", removed, "good"),
        total("toxic_lost", removed, "toxic"),
        shapley.alias("shapley"),
    )


def op13_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders, by language."""
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
