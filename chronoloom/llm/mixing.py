"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are put in a random order (by hash) and read as one stream of words. The stream is cut into
blocks of ``block_words`` words; a document belongs to the block in which it starts, so documents stay whole. A
source's target says how often its stream is read: some full rounds and a last, partial one, whose final document
alone is cut so that the source gives exactly its (rounded) target. All rounds together hold an exact number of
blocks per source, its quota.

The quotas are dealt to the output shards by a binary tree. Each node splits its shards in two and draws how many
blocks of every source go left from the multivariate hypergeometric distribution, one source after another, so every
shard holds what a random deal of all blocks would have given it and the quotas stay exact. The draws run over one
small array per node (two numbers per source); no block is ever listed. A source's blocks then go to the shards along
a seeded permutation of the block numbers, and each shard is shuffled by a hash on its own.

Everything is DataFrame expressions. The running word count of a source is taken in two levels (hash buckets, then
offsets of the buckets), so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD, let, word_count, written

#: Words of a written part: shards hold as many parts as their words need.
PART_WORDS = 1 << 25
ROUNDS = 24


def permuted(x: Column, n: Column, *key: Column | str) -> Column:
    """Place of ``x`` in a permutation of 0 .. n - 1 drawn by ``key``, by the swap-or-not shuffle.

    Each round pairs every number with another one (their sum is a drawn number, modulo n) and swaps a pair if a hash of
    its larger number says so; that is a bijection for every n, and ``ROUNDS`` rounds make it a random one.
    """

    def swapped(v: Column) -> Column:
        coin = F.xxhash64(*key, v["r"], F.greatest(v["x"], v["y"]), F.lit(1))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, v["y"]).otherwise(v["x"])

    def step(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - acc, n)
        return let(F.struct(acc.alias("x"), other.alias("y"), r.alias("r")), swapped)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, brought back by the product of what lies between."""
    y = n + F.lit(8.0)
    product = n + F.lit(1.0)
    for i in range(2, 8):
        product = product * (n + F.lit(float(i)))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric draw for the uniform number ``u``: inverse distribution, walked from the mode outwards."""

    def bounds(v: Column) -> Column:
        low = F.greatest(F.lit(0.0), v["d"] - (v["n"] - v["k"]))
        high = F.least(v["d"], v["k"])
        mode = F.floor((v["d"] + 1) * (v["k"] + 1) / (v["n"] + 2)).cast("double")
        spread = F.sqrt(v["d"] * (v["k"] / v["n"]) * (1 - v["k"] / v["n"]) * (v["n"] - v["d"]) / F.greatest(v["n"] - 1, F.lit(1.0)))
        return let(F.struct(v["n"], v["k"], v["d"], v["u"], low.alias("low"), high.alias("high"), mode.alias("mode"), spread.alias("spread")), at_mode)

    def at_mode(v: Column) -> Column:
        p = F.exp(_ln_choose(v["k"], v["mode"]) + _ln_choose(v["n"] - v["k"], v["d"] - v["mode"]) - _ln_choose(v["n"], v["d"]))
        steps = F.least(v["high"] - v["low"], F.ceil(v["spread"] * 12).cast("double") + 12).cast("long")
        drawn = let(F.struct(v["n"], v["k"], v["d"], v["u"], v["low"], v["high"], v["mode"], p.alias("p"), steps.alias("steps")), walked)
        return F.when(v["low"] >= v["high"], v["low"]).otherwise(drawn)

    def walked(v: Column) -> Column:
        def walk(acc: Column, i: Column) -> Column:
            up, down = v["mode"] + i, v["mode"] - i
            p_up = F.when(up <= v["high"], acc["up"] * (v["k"] - up + 1) * (v["d"] - up + 1) / (up * (v["n"] - v["k"] - v["d"] + up))).otherwise(F.lit(0.0))
            p_down = F.when(down >= v["low"], acc["down"] * (down + 1) * (v["n"] - v["k"] - v["d"] + down + 1) / ((v["k"] - down) * (v["d"] - down))).otherwise(F.lit(0.0))
            moved = F.struct((acc["left"] - p_up - p_down).alias("left"), p_up.alias("up"), p_down.alias("down"), F.when(acc["left"] < p_up, up).when(acc["left"] < p_up + p_down, down).alias("x"))
            return F.when(acc["x"].isNotNull(), acc).otherwise(moved)

        start = F.struct((v["u"] - v["p"]).alias("left"), v["p"].alias("up"), v["p"].alias("down"), F.when(v["u"] < v["p"], v["mode"]).alias("x"))
        return F.aggregate(F.sequence(F.lit(1).cast("long"), v["steps"]), start, walk, lambda acc: F.coalesce(acc["x"], v["mode"]))

    n, k, d = (c.cast("double") for c in (total, good, draws))
    return let(F.struct(n.alias("n"), k.alias("k"), d.alias("d"), u.alias("u")), bounds).cast("long")


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def _shard_counts(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, ends): for each source, how many of its blocks lie in the shards up to each. Input: (src, blocks)."""
    # one row for all sources: two numbers for each, whatever the corpus holds
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("src", "blocks"))).alias("all")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("width"), F.col("all.src").alias("srcs"), F.col("all.blocks").alias("counts")
    )
    for level in range(max(1, (shards - 1).bit_length())):
        half = F.floor(F.col("width") / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
        part = F.floor(total.cast("double") * half / F.col("width") + _uniform(F.lit(seed), F.lit(level), F.col("first"))).cast("long")

        def deal(acc: Column, c: Column) -> Column:
            u = _uniform(F.lit(seed + 1), F.col("first"), F.col("width"), F.size(acc["took"]))
            x = F.when(acc["rest"] <= 0, F.lit(0).cast("long")).otherwise(hypergeometric(acc["rest"], c, acc["draw"], u))
            return F.struct((acc["rest"] - c).alias("rest"), (acc["draw"] - x).alias("draw"), F.concat(acc["took"], F.array(x)).alias("took"))

        start = F.struct(F.col("total").alias("rest"), F.col("part").alias("draw"), F.array().cast("array<bigint>").alias("took"))
        split = nodes.withColumns({"total": total, "half": half, "part": part}).withColumn("took", F.aggregate("counts", start, deal, lambda a: a["took"]))
        left = F.struct(F.col("first"), F.col("half").alias("width"), F.col("took").alias("counts"))
        right = F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("width") - F.col("half")).alias("width"), F.zip_with("counts", "took", lambda a, b: a - b).alias("counts"))
        same = F.struct(F.col("first"), F.col("width"), F.col("counts"))
        nodes = split.select("srcs", F.explode(F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(same))).alias("n")).select("n.first", "n.width", "srcs", "n.counts")
    long = nodes.select("first", F.explode(F.arrays_zip("srcs", "counts")).alias("z")).select(F.col("first").alias("shard"), F.col("z.srcs").alias("src"), F.col("z.counts").alias("n"))
    ends = long.withColumn("end", F.sum("n").over(W.partitionBy("src").orderBy("shard")))
    return ends.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("shard", "end"))).alias("e")).select("src", F.col("e.end").alias("ends"))


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float, total: float) -> DataFrame:
    """Adds ``target`` to (src, source_size): weights repeat by code point of the source (null last) and share ``total``
    of all sizes; no target exceeds ``cap`` times its source's size, and what lies above is shared again by weight.

    The shares that this ends in are level * weight or the cap, whichever is less. The level is found among the
    sources ordered by cap / weight: the first at which it no longer exceeds that ratio.
    """
    by_name = W.orderBy("src")  # one small row per source
    by_ratio = W.orderBy("ratio", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * F.lit(float(total)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(W.partitionBy())["level"])
    return t.select("src", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, total: float = 1.0, block_words: int = 2048, shards: int = 64, buckets: int = 1024, seed: int = 17, carry: list[str] | None = None) -> DataFrame:
    """The mix's plan: each input row (or its columns ``carry``, doc_id among them) as struct ``row`` with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``copies`` lists, for every time the document is taken, the shard, the place in it (``place``, to sort by) and the
    words taken: all of them but for the one document of a source in which its target ends. The input needs columns
    doc_id, source and text and may have any others.

    A null source is a source of its own, the last. A text that is null or has no words has size 0 and is never taken.
    Rows repeated in full count as documents of their own. An empty table gives an empty plan. Rerunning gives the same
    rows, as order and draws come from hashes of the row and of ``seed``. Documents with equal hashes follow doc_id and
    size; rows equal in all of these are alike in all that is decided here.
    """
    return _mix(docs, weights, cap, total, block_words, shards, buckets, seed, carry)[0]


def mixed(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, total: float = 1.0, shards: int = 64, seed: int = 17) -> DataFrame:
    """The mixed corpus of ``docs``: ``mix`` and ``materialize`` in one."""
    plan, words = _mix(docs, weights, cap, total, 2048, shards, 1024, seed, None)
    return materialize(plan, shards, words)


def _mix(docs: DataFrame, weights: tuple[float, ...], cap: float, total: float, block_words: int, shards: int, buckets: int, seed: int, carry: list[str] | None) -> tuple[DataFrame, int]:
    """The plan and the number of words that it takes."""
    src = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    base = docs.select(F.struct(*(carry or ["*"])).alias("row"), src.alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    base = base.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sums = written(base.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "mix-sums")  # a row per source and bucket
    source = targets(sums.groupBy("src").agg(F.sum("words").alias("source_size")), weights, cap, total)
    want = F.round("target").cast("long")
    source = source.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long"))
    source = source.withColumn("rest", F.when(F.col("source_size") > 0, want - F.col("rounds") * F.col("source_size")).otherwise(0).cast("long"))
    per_round = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    source = source.withColumns({"per_round": per_round, "blocks": F.col("rounds") * per_round + F.ceil(F.col("rest") / F.lit(block_words)).cast("long")})
    source = written(source, "mix-sources")
    words = source.agg(F.coalesce(F.sum(F.col("rounds") * F.col("source_size") + F.col("rest")), F.lit(0))).first()[0]
    source = written(source.join(_shard_counts(source.select("src", "blocks"), shards, seed), "src"), "mix-shards")
    start = F.coalesce(F.sum("words").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a table again, as its order by source alone must not become that of the rows it is joined to
    # (the rows are dealt by source and bucket already; a broadcast would send the shards of every source to all tasks)
    plan = written(sums.withColumn("bucket_start", start).drop("words").join(source, "src"), "mix-plan")
    within = W.partitionBy("src", "bucket").orderBy("h", "row.doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan.hint("merge"), ["src", "bucket"])
    first = F.col("bucket_start") + F.col("within")
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - first)).cast("long")).withColumn("block", F.floor(first / F.lit(block_words)).cast("long"))

    def copy(i: Column) -> Column:
        at = permuted(i * F.col("per_round") + F.col("block"), F.col("blocks"), F.lit(seed + 3), F.col("src"))
        return F.struct(
            let(at, lambda x: F.size(F.filter("ends", lambda e: e <= x))).alias("shard"),
            F.xxhash64(F.lit(seed + 2), F.col("h"), i).alias("place"),
            i.cast("int").alias("round"),
            F.when(i < F.col("rounds"), F.col("size")).otherwise(F.col("part")).alias("words"),
        )

    n = F.col("rounds") + F.when(F.col("part") > 0, 1).otherwise(0)
    copies = F.when((F.col("size") > 0) & (n > 0), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), copy)).otherwise(F.array().cast("array<struct<shard:int,place:bigint,round:int,words:bigint>>"))
    return placed.select("row", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("part")).alias("taken"), copies.alias("copies")), words


def materialize(plan: DataFrame, shards: int = 64, words: int = 0) -> DataFrame:
    """The mixed corpus itself: a row per copy, grouped by shard and shuffled within it; a cut copy keeps its first words.

    All columns of the input, and mix_shard, mix_place and mix_words (columns of these names are replaced). A shard is
    one partition, or as many as its share of all ``words`` needs: its places, which are even random numbers, in equal
    ranges.
    """
    parts = max(1, -(-words // (shards * PART_WORDS)))
    names = [c for c in plan.schema["row"].dataType.names if c not in ("mix_shard", "mix_place", "mix_words")]
    c = plan.select("row", F.explode("copies").alias("copy"), "size")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), 1), F.lit(1), F.col("copy.words").cast("int")), " ")
    text = F.when(F.col("copy.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    own = [text.alias(k) if k == "text" else F.length(text).cast(plan.schema["row"].dataType[k].dataType).alias(k) if k == "n_chars" else F.col(f"row.`{k}`") for k in names]
    c = c.select(*own, F.col("copy.shard").alias("mix_shard"), F.col("copy.place").alias("mix_place"), F.col("copy.words").alias("mix_words"))
    part = F.floor((F.shiftright("mix_place", 32) + F.lit(1 << 31)) * F.lit(parts) / F.lit(1 << 32)).cast("int")
    return c.repartitionById(shards * parts, F.col("mix_shard") * F.lit(parts) + part).sortWithinPartitions("mix_shard", "mix_place")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """Mix of all documents: doc_id, size, source_size, target, taken and the shards of the copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken", F.col("copies.shard").alias("shards"))
