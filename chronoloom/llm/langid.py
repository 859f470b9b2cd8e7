"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of a text's lower-cased letters (anything else is one blank), hashed to 2**14 numbers,
counted, divided by their number and weighted by inverse document frequency. The frequencies are counted over all
learning documents in Spark. The classifier is fitted by follow-the-regularised-leader (per-coordinate step widths, L1
and L2 penalties, so weights of useless n-grams are exactly zero) on a bounded sample: per language the
``sample_rows`` learning documents, drawn by a hash of the text. A fifth of the sample is held back to calibrate
the temperature of the probabilities. Prediction is one sum over the characters of each whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import slices, written

BITS = 14
DIM = 1 << BITS
_FOLD = np.arange(0x110000, dtype=np.uint32)
_READY = False


def _fold_table() -> np.ndarray:
    """Code point to lower-case letter, or to 32 for whatever is no letter."""
    global _READY
    if not _READY:
        for c in range(0x110000):
            s = chr(c)
            if not s.isalpha():
                _FOLD[c] = 32
            elif len(low := s.lower()) == 1:
                _FOLD[c] = ord(low)
        _READY = True
    return _FOLD


def grams(text: str) -> np.ndarray | None:
    """Hashed n-grams of a text, repeats included; None if it has no letter."""
    cp = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    blank = cp == 32
    cp = cp[~(blank & np.concatenate(([False], blank[:-1])))]  # a run of non-letters is one blank
    if not len(cp) or (len(cp) == 1 and cp[0] == 32):
        return None
    one = cp * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (cp[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (cp[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    return np.concatenate((one, two, three)) >> np.uint32(32 - BITS)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    g = grams(text)
    return None if g is None else np.unique(g, return_counts=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per task: in how many of its documents each feature occurs (feature DIM: documents)."""
    df = np.zeros(DIM + 1, dtype=np.int64)
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            g = grams(text or "")
            if g is not None:
                seen = np.zeros(DIM, dtype=bool)
                seen[g] = True
                df[:DIM] += seen
                df[DIM] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["feature", "n"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bags = [_counted(t or "") for t in batch.column(1).to_pylist()]
        keep = [i for i, b in enumerate(bags) if b is not None]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([bags[i][0].astype(np.int32).tobytes() for i in keep], pa.binary()), pa.array([bags[i][1].astype(np.int32).tobytes() for i in keep], pa.binary())],
            names=["lang", "features", "counts"],
        )


def fit(bags: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, scale: float = 20.0) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, weights of DIM rows, biases, temperature) from counted n-grams. The last fifth calibrates."""
    langs = sorted({b[0] for b in bags})
    number = {x: i for i, x in enumerate(langs)}
    order = np.random.default_rng(11).permutation(len(bags))
    held = set(order[: len(bags) // 5].tolist()) if len(bags) >= 10 * len(langs) else set()
    z, n = np.zeros((DIM + 1, len(langs))), np.zeros((DIM + 1, len(langs)))

    def weights(rows) -> np.ndarray:
        zz, nn = z[rows], n[rows]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    def inputs(b) -> tuple[np.ndarray, np.ndarray]:
        x = b[2] / b[2].sum() * idf[b[1]] * scale
        return np.append(b[1], DIM), np.append(x, 1.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(bags)).tolist():
            if i in held:
                continue
            rows, x = inputs(bags[i])
            w = weights(rows)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[number[bags[i][0]]] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - step * w
            n[rows] += g * g
    w = weights(slice(None))
    scores = [(x @ w[rows], number[b[0]]) for b in ((bags[i]) for i in sorted(held)) for rows, x in [inputs(b)]]

    def loss(t: float) -> float:
        total = 0.0
        for s, y in scores:
            v = s / t
            total += np.log(np.exp(v - v.max()).sum()) + v.max() - v[y]
        return total

    temperature = min(np.exp(np.linspace(-2, 2, 81)).tolist(), key=loss) if scores else 1.0
    return langs, w[:DIM] * idf[:, None] * scale, w[DIM], temperature


def predict(docs: DataFrame, learn: DataFrame, *, sample_rows: int = 300, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score (calibrated, 0 to 1), in columns of these names.

    ``learn``: text and lang of the learning documents; those with a null text or lang or without letters teach
    nothing. Per language about ``sample_rows`` documents (different texts; all, if it has fewer) fit the
    weights; the document frequencies cover them all. A text that is null or has no letter is ``und`` with score 0, as
    are all texts if there is nothing to learn from. Repeated rows count each time. Nothing but the text decides a
    prediction. Columns of ``docs`` of the two names are replaced, all others stay as they are.
    """
    learn = learn.select("text", "lang").where("text is not null and lang is not null")
    counts = learn.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # a number per feature
    df = np.zeros(DIM + 1)
    for r in counts:
        df[r["feature"]] = r["n"]
    idf = np.log((1.0 + df[DIM]) / (1.0 + df[:DIM])) + 1.0
    pick = _sample(learn, sample_rows)
    bags = [(r["lang"], np.frombuffer(r["features"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in written(pick.mapInArrow(_bags, "lang string, features binary, counts binary"), "langid").collect()]
    bags.sort(key=lambda b: (b[0], b[1].tobytes(), b[2].tobytes()))
    model = fit(bags, idf) if bags else None
    kept = docs.drop(*names)
    fields = [*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return kept.mapInArrow(_predictor(model, names), T.StructType(fields))


def _sample(learn: DataFrame, rows: int) -> DataFrame:
    """Of each language about ``rows`` documents (all, if it has fewer): those whose text's hash lies under a bound that the language's count of distinct texts sets. Copies count once, there and in the sample."""
    distinct = learn.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.lit(1).alias("one"))
    counts = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a number per language
    if not counts:
        return learn.limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, rows / n))])[F.col("lang")]
    u = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") * F.lit(2.0**-53)
    return learn.where(u < share).select("lang", "text").distinct()


def _predictor(model, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs_out, scores = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                g = grams(text or "") if model else None
                if g is None:
                    langs_out.append("und")
                    scores.append(0.0)
                    continue
                langs, w, bias, t = model
                s = ((np.bincount(g, minlength=DIM) @ w) / len(g) + bias) / t if len(g) > DIM else (w[g].sum(axis=0) / len(g) + bias) / t
                p = np.exp(s - s.max())
                p /= p.sum()
                k = int(p.argmax())
                langs_out.append(langs[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs_out, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text is 1 modulo 3. A null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def in_known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more (a text in two languages has about a half), with all their columns."""
    found = predict(docs, docs.where(~held_out(F.col("doc_id"))), names=("__lang", "__score"))
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(marked.select("doc_id", "text", "held_out"), marked.where(~F.col("held_out"))).select("doc_id", "held_out", "lang_pred", "score")
