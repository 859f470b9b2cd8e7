"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive words: some places count, the others are ignored, so a seed still hits
where a word at an ignored place was replaced. The words under every mask at every place are hashed, in the corpus and
in the benchmark, and the hashes joined. Around each hit, text and item are then laid on each other and compared word by
word: they overlap if 13 consecutive words (all, of a shorter item) agree in all but at most 2 of 13 (1 of 7 to 12, none
of fewer).

Two masks of word pairs are such that one of them hits whatever 2 of 13 or 1 of 9 to 12 words are replaced. Items of
fewer words need denser masks, down to single words; the benchmark's short items tell which of these the corpus is
hashed by.

Only DataFrame functions; the hashes of a document are arrays in its row, and only hits leave it. A document's alignments
are compared in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import let, same_row, written

#: Masks as places of the word pairs (0: a pair of words one after the other; None: a single word) that count, with the
#: sizes of the items that need them.
MASKS: tuple[tuple[tuple[int, ...] | None, range], ...] = (
    ((0, 2, 5), range(9, 1 << 30)),
    ((0, 5, 7), range(9, 1 << 30)),
    ((0, 2), range(4, 9)),
    ((0, 4), range(7, 9)),
    ((0, 1), range(3, 4)),
    ((0,), range(2, 3)),
    (None, range(1, 2)),
)
WINDOW, WRONG = 13, 2
#: Seeds and hits are broadcast up to so many rows (32 bytes each) and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Beyond, the corpus is first held against the bare hashes, which are broadcast up to so many.
BROADCAST_HASHES = 8_000_000


def words_of(text: Column) -> Column:
    """Lower-case words without ASCII punctuation and blanks; an empty array for null."""
    parts = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _seeds(words: Column, masks: list[int]) -> Column:
    """For each mask the hashes at all places, one mask after the other. Pairs of words are hashed once for all masks."""

    def masked(v: Column) -> Column:
        pairs = v["pairs"]

        def of(k: int) -> Column:
            places = MASKS[k][0]
            if places is None:
                return F.transform(v["words"], lambda x: F.xxhash64(x, F.lit(k)))
            return F.transform(pairs, lambda x, i: F.xxhash64(x, *[F.get(pairs, i + j) for j in places[1:]], F.lit(k)))

        return F.concat(*[of(k) for k in masks])

    return let(words, lambda w: let(F.struct(w.alias("words"), F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))).alias("pairs")), masked))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and benchmark item that overlap: doc_id, text_hash, item_id, item_words, matched_words, at_word.

    ``matched_words`` are those that agree along the best alignment, ``at_word`` is where the item's first word falls
    in the text (negative if the text has only a later part). Inputs: doc_id and text, item_id and text; other columns
    are ignored. Null and empty texts and items without words overlap nothing. Rows of one doc_id and text (also a null
    doc_id) are reported once; so are items repeated under one item_id. Empty tables give no rows.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("b")).where(F.size("b") > 0).distinct()
    sizes = [r[0] for r in items.select(F.least(F.size("b"), F.lit(9))).distinct().collect()]  # nine numbers at most
    masks = [k for k, (_, fits) in enumerate(MASKS) if any(n in fits for n in sizes)] or [0]
    n = F.size("b")
    placed = items.select("item_id", F.xxhash64("b").alias("b_hash"), n.alias("n"), F.posexplode(_seeds(F.col("b"), masks)).alias("place", "seed"))
    placed = placed.withColumns({"mask": F.floor(F.col("place") / F.col("n")).cast("int"), "at": F.pmod("place", "n")})
    whole = F.lit(False)
    for i, k in enumerate(masks):
        places, fits = MASKS[k]
        span = 1 if places is None else places[-1] + 2
        whole = whole | ((F.col("mask") == i) & (F.col("at") <= F.col("n") - span) & F.col("n").between(fits[0], fits[-1]))
    seeds = written(placed.where(whole).select("seed", "item_id", "at", "b_hash").distinct(), "seeds")
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _seeds(words_of(F.col("text")), masks).alias("s"))
    found = found.select("doc_id", "text_hash", (F.size("s") / F.lit(len(masks))).cast("int").alias("n"), F.posexplode("s").alias("place", "seed"))
    if (count := seeds.count()) > BROADCAST_ROWS and (bare := seeds.select("seed").distinct()).count() <= BROADCAST_HASHES:
        found = found.join(F.broadcast(bare), "seed", "left_semi")
    found = found.join(F.broadcast(seeds) if count <= BROADCAST_ROWS else seeds, "seed")
    shift = (F.pmod("place", "n") - F.col("at")).cast("int")
    hits = found.select("doc_id", "text_hash", "item_id", "b_hash", shift.alias("shift")).distinct()
    hits = written(hits.groupBy("doc_id", "text_hash", "item_id", "b_hash").agg(F.sort_array(F.collect_list("shift")).alias("shifts")), "hits")
    # a row per document with its items; only documents with hits are read again
    lists = hits.join(_small(items.withColumn("b_hash", F.xxhash64("b"))), ["item_id", "b_hash"])
    lists = lists.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "b", "shifts")).alias("items"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # repeated rows are met once: what is judged is a function of doc_id and text
    pairs = same_row(texts, F.broadcast(lists) if hits.count() <= BROADCAST_ROWS // 10 else lists)

    def judged(w: Column) -> Column:
        def along(item: Column, shift: Column) -> Column:
            same = F.transform(item["b"], lambda x, j: F.coalesce((F.get(w, j + shift) == x).cast("int"), F.lit(0)))
            return let(same, lambda v: F.struct(F.aggregate(v, F.lit(0), lambda a, x: a + x).alias("matched_words"), (-shift).alias("before"), _enough(v).alias("overlap")))

        def best(item: Column) -> Column:
            tries = F.filter(F.transform(item["shifts"], lambda shift: along(item, shift)), lambda t: t["overlap"])
            return F.struct(item["item_id"].alias("item_id"), F.size(item["b"]).alias("item_words"), F.array_max(tries).alias("m"))

        return F.filter(F.transform("items", best), lambda t: t["m"].isNotNull())

    kept = pairs.select("doc_id", "text_hash", F.explode(let(words_of(F.col("text")), judged)).alias("v"))
    kept = kept.select("doc_id", "text_hash", "v.item_id", F.struct("v.m.matched_words", "v.item_words", "v.m.before").alias("m"))
    top = kept.groupBy("doc_id", "text_hash", "item_id").agg(F.max("m").alias("m"))
    return top.select("doc_id", "text_hash", "item_id", "m.item_words", "m.matched_words", (-F.col("m.before")).alias("at_word"))


def _enough(same: Column) -> Column:
    """Whether some 13 consecutive words (all, of fewer) agree but for the words that may be wrong, told by running sums."""
    size = F.least(F.lit(WINDOW), F.size(same))
    sums = F.aggregate(same, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def most(c: Column) -> Column:
        return F.array_max(F.transform(F.slice(c, size + 1, F.size(c) - size), lambda x, i: x - F.get(c, i)))

    return let(sums, most) >= size - F.floor(size * F.lit(WRONG) / F.lit(WINDOW))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, with all their columns."""
    bad = written(overlaps(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "contaminated")
    on = docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_h"])
    return docs.join(_small(bad), on, "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items: a row per pair."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
