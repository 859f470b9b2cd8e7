"""Document fingerprints that add up: a homomorphic multiset hash of the paragraphs.

A paragraph (the text between line feeds) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two. So the order of the paragraphs does not matter, and adding or
taking away a paragraph is adding or subtracting its vector (``combine``). The vector has two parts:

* four lanes modulo 2**64 from a cryptographic hash of the paragraph: equality of multisets;
* 128 lanes modulo 2**16 into which every three words of the paragraph are counted with a random sign: the inner
  product of two documents' lanes estimates how many of these they share, and so their likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import partitions, slices

LANES = 128
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S29)) * _P
    x = (x ^ (x >> _S32)) * _Q
    return x ^ (x >> _S29)


_POW = np.cumprod(np.full(1 << 12, _R | np.uint64(1), dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.full(1 << n.bit_length(), _R | np.uint64(1), dtype=np.uint64))
    return _POW[:n]


def vector(text: str) -> np.ndarray:
    """The fingerprint as 4 + LANES unsigned numbers; all zero for the empty text, which has no paragraph."""
    out = np.zeros(4 + LANES, dtype=np.uint64)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    strong = b"".join(hashlib.blake2b(p, digest_size=32).digest() for p in raw.split(b"\n"))
    out[:4] = np.frombuffer(strong, dtype="<u8").reshape(-1, 4).sum(axis=0, dtype=np.uint64)
    b = np.frombuffer(raw, dtype=np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(starts):
        # a word's hash: the sum of its bytes' hashes times powers by place in the word
        ends = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
        long = int((ends - starts).max()) + 1
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], dtype=np.int64), np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))))
        terms = np.where(space, np.uint64(0), (b.astype(np.uint64) + np.uint64(1)) * _powers(long)[np.minimum(place, long - 1)])
        w = _mixed(np.add.reduceat(terms, starts))
        line = np.cumsum(b == 10)[starts]
        second = np.zeros(len(w), dtype=np.uint64)
        third = np.zeros(len(w), dtype=np.uint64)
        second[:-1] = np.where(line[1:] == line[:-1], w[1:], 0)
        third[:-2] = np.where(line[2:] == line[:-2], w[2:], 0)
        f = _mixed(w * _P + second * _Q + third * _R + np.uint64(1))
        sign = 1.0 - 2.0 * ((f >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
        counts = np.bincount((f >> np.uint64(57)).astype(np.int64), weights=sign, minlength=LANES)
        out[4:] = counts.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFF)
    return out


def to_hex(v: np.ndarray) -> str:
    return v[:4].astype(">u8").tobytes().hex() + v[4:].astype(">u2").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    raw = bytes.fromhex(s)
    return np.concatenate((np.frombuffer(raw[:32], dtype=">u8").astype(np.uint64), np.frombuffer(raw[32:], dtype=">u2").astype(np.uint64)))


def combine(a: str, b: str, remove: bool = False) -> str:
    """The fingerprint of a document with the paragraphs of both, or of the first without those of the second."""
    x, y = from_hex(a), from_hex(b)
    out = x - y if remove else x + y
    out[4:] &= np.uint64(0xFFFF)
    return to_hex(out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """2 ab / (aa + bb) of the signed lanes, within 0 and 1; 1 for equal fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[4:].astype(np.uint16).view(np.int16).astype(np.float64) for v in (a, b))
    both = float(x @ x + y @ y)
    return min(1.0, max(0.0, 2.0 * float(x @ y) / both)) if both else 0.0


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, then in order, each bucket closed by a row that only serves as the next of the one before."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in slices(batches):
        cols: list[list] = [[] for _ in names]
        for doc_id, text, closing in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "closing")), strict=True):
            text = text or ""
            v = vector(text)
            if held is not None:
                own_id, own, own_v = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                e = vector(edited)
                row = (own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(own_v), to_hex(e), likeness(own_v, e), likeness(own_v, v))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            held = None if closing else (doc_id, text, v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def compare_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to the document and to the next one.

    Input: doc_id, text and any other columns. The next document is that of the next smaller doc_id; after the last
    comes the first. The edited text has the last floor(n/2) code points replaced by the first as many of the next.
    A null text counts as empty. Rows with a null doc_id come after all others, and rows of one doc_id follow each
    other by their text (null and empty first), so ties and repeated rows have a defined next one. A lone document is
    its own next one. An empty table gives no rows.

    The order is cut into ranges of doc_id (quantiles of all ids); each range is sorted and read as a stream, and gets
    a copy of the first row of the following range to close it. So a text is shuffled once and no task holds more than
    two rows at a time.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or 8 * partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), 100 * n).alias("q")).first()["q"] or []  # a number per range
    edges = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series(np.where(null.to_numpy(), len(edges) + 1, len(edges) - np.searchsorted(edges, ids.to_numpy(), side="right")).astype(np.int32))

    ranged = docs.withColumn("bucket", range_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()))
    tops = docs.select("doc_id").withColumn("bucket", range_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())).groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    tops = tops.collect()  # a number per range
    order = sorted(r["bucket"] for r in tops)
    if not order:
        return spark.createDataFrame([], _RESULT)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the range that a range's first row closes
    heads = spark.createDataFrame([(r["doc_id"], before[r["bucket"]]) for r in tops], "head long, bucket int")
    # as many rows as there are ranges
    closing = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    rows = ranged.withColumn("closing", F.lit(False)).unionByName(closing.withColumn("closing", F.lit(True)))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "closing", F.desc_nulls_last("doc_id"), "text")
    return rows.mapInArrow(_follow, _RESULT)


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are to each other and to the next document."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
