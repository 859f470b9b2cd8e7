"""Exact join of documents by the Jaccard similarity of their word shingles: pigeonholes over a partitioned universe.

Sets are taken in bands of sizes. Within a band, two sets that are similar differ in at most H shingles. The universe of
shingles is cut in m segments by a hash; of these, u may differ in one shingle and the others in none. A segment that
breaks this takes two differences, or one, so if m + u > H, two similar sets agree in some segment. A set posts the sum
of each segment's hashed shingles, and for the u segments also what is left when any one shingle is deleted. Which m and
u a band has is decided by cost: postings, and expected meetings of unrelated sets (``allocation``). A set also posts in
the next band if a set of that band can be similar to it.

Segments that many sets have alike (empty ones, boilerplate) have long lists. m + u is higher than needed by a slack, and
the smaller sets of a band agree in more segments than its largest ones must: a set of n shingles and a similar one share
at least ``shared_lists(n)`` lists. If one of these is short, they meet there. So only sets on as many long lists go on
with them, as in large groups of near copies, and only with the rarest of them: all but that number, and one.

Lists are read in sorted order. All of a list are compared with its first set, then components are made, and only then
the sets of short lists that are still in different components meet pair by pair. In long lists, what is outside of the
main component is compared with a few sets of it and, if still outside, with all: their sketches meet block by block
within a task, and only pairs that may be similar come out. Each pair is confirmed on the full sets: a sketch only drops
pairs that differ in more shingles than they may for certain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import partitions, same_row, slices, written
from chronoloom.llm.fingerprints import _mixed
from chronoloom.llm.neardup import components, similar

SHINGLE = 4
PERCENT = 85
#: A list of up to so many sets is expanded into pairs.
SHORT_LIST = 64
#: So many unrelated sets are taken to be met with in a list when costs are compared.
CROWD = 1000
#: Rounds in which those outside of the main component of a long list are compared with one set inside.
ROUNDS = 2
#: What is outside of the main component visits a long list in blocks of so many sets.
BLOCK = 2048
#: Keys of candidate rows are broadcast up to so many (24 bytes each) and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
_RNG = np.random.default_rng(20240311)
_FOUR = _RNG.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FULL = np.int64(-(2**63))

#: Least sizes of the bands.
BORDERS = [1]
while BORDERS[-1] < 2**40:
    BORDERS.append(-(-BORDERS[-1] * 8 // 5))


def differing(total: int) -> int:
    """The most shingles in which two similar sets of ``total`` shingles in sum can differ."""
    return (100 - PERCENT) * total // (100 + PERCENT)


@cache
def allocation(band: int) -> tuple[int, int, int]:
    """(segments, those of them that may differ in one shingle, slack) of a band: the cheapest that fulfils m + u > H + slack.

    Cost: postings of a set of middle size, and ``CROWD`` times the segments in which two unrelated sets agree by chance.
    No segments, if only equal sets are similar.
    """
    low, high = BORDERS[band], BORDERS[band + 1] - 1
    h = differing(2 * high)
    if h == 0:
        return 0, 0, 0
    best = None
    for m in np.unique(np.geomspace(max(1, h // 2), 2 * h + 64, 400).astype(np.int64)).tolist():
        empty = m * np.exp(-low / m)
        slack = 0 if empty < 0.05 else int(np.ceil(empty + 3 * np.sqrt(empty)))
        u = max(0, h + 1 + slack - m)
        if u > m:
            continue
        share = (low + high) / 2 / m
        chance = np.exp(-2 * share) * (m - u + u * (1 + 2 * share))
        cost = m + u * share + CROWD * chance
        if best is None or cost < best[0]:
            best = cost, m, u, slack
    return best[1:]


def shared_lists(n: Column, m: Column, u: Column) -> Column:
    """The least number of lists that a set of n shingles shares with any similar one: by the largest such set; a segment counts twice where some may differ."""
    differ = F.floor((100 - PERCENT) * (n + F.floor(n * 100 / PERCENT)) / (100 + PERCENT))
    return F.greatest(F.lit(1), F.ceil((m + u - differ) / F.when(u > 0, 2).otherwise(1)))


def shingles(raw: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the four-word shingles; of all words, if they are fewer; none without words."""
    words = (raw or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(SHINGLE, len(w))
    s = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for i in range(n):
        s = _mixed(s + w[i : i + len(s)] * _FOUR[i])
    return np.unique(s + np.uint64(n))


def band_of(n: int) -> int:
    return int(np.searchsorted(BORDERS, n, side="right")) - 1


def postings(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's segments, and those with a shingle deleted. The last six bits tell the band."""
    full, less = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    own = band_of(len(s)) if len(s) else -2
    h = _mixed(s ^ np.uint64(0x5851F42D4C957F2D))
    for band in (own, own + 1):
        m, u, _ = allocation(band) if band >= 0 else (0, 0, 0)
        if not m or 100 * len(s) < PERCENT * BORDERS[band]:
            continue
        at = ((s >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h[order], dtype=np.uint64)))
        ends = np.cumsum(np.bincount(at, minlength=m))
        sums = total[ends] - total[np.concatenate(([0], ends[:-1]))]
        salt = _mixed(np.arange(m, dtype=np.uint64) * np.uint64(64) + np.uint64(band + 1))
        key = lambda x: (_mixed(x) & ~np.uint64(63)) | np.uint64(band)  # noqa: B023, E731
        full.append(key(sums + salt))
        some = at < u
        less.append(key(sums[at[some]] - h[some] + salt[at[some]]))
    return np.concatenate(full).view(np.int64), np.concatenate(less).view(np.int64)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[int] = set()  # equal sets post once in a task
    for batch in slices(batches, 128):
        n, cls, keys, full = [], [], [], []
        for raw in batch.column(2).cast(pa.binary()).to_pylist():
            s = shingles(raw)
            n.append(len(s))
            cls.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1)
            a, b = postings(s) if cls[-1] not in done else (np.zeros(0, dtype=np.int64),) * 2
            done.add(cls[-1])
            full.append(len(a))
            keys.append(np.concatenate((a, b)))
        at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*keys, np.zeros(0, dtype=np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(full, pa.int32()), lists], names=["doc_id", "text_hash", "n", "cls", "full", "keys"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings by key, then code (full ones first): a row for each further set of a list, with the list's first."""
    key, first, last, place = None, 0, 0, 0
    for batch in batches:
        k, c = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(k):
            continue
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        fresh[0] = key is None or k[0] != key or c[0] != last
        k, c = k[fresh], c[fresh]
        if not len(k):
            continue
        head = np.concatenate(([True], k[1:] != k[:-1]))
        head[0] = key is None or k[0] != key
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1  # -1: the list that the last batch ended with
        start = np.append(at, 0)[group] if len(at) else np.zeros(len(k), dtype=np.int64)
        firsts = np.where(group >= 0, c[start], first)
        places = np.where(group >= 0, np.arange(len(k)) - start, np.arange(len(k)) + place + 1)
        use = ~head & (firsts < 0)  # a list without a full segment makes no pair
        if use.any():
            cols = (k[use], firsts[use] ^ _FULL, c[use] & ~_FULL, c[use] < 0, places[use].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "first", "cls", "full", "place"])
        key, first, last, place = int(k[-1]), int(firsts[-1]), int(c[-1]), int(places[-1])


def pack(s: np.ndarray) -> bytes:
    """The hashes in five bytes each, for the confirmation; chance agreement is below 1e-12 for two shingles."""
    return np.ascontiguousarray((s >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    five = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    five[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return five.view("<u8").reshape(-1)


def sketch(s: np.ndarray, bits: int = 3) -> bytes:
    """Parities of about ``bits`` bits for each shingle in which similar sets of this size may differ: two sets differ in at least as many shingles as their sketches in bits."""
    size = 64 << (differing(2 * len(s)) * bits // 64).bit_length()
    n = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").tobytes()


def near(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """False only for sets that are not similar."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    size = min(len(x), len(y))
    fold = lambda v: np.bitwise_xor.reduce(v.reshape(-1, size), axis=0)
    return int(np.bitwise_count(fold(x) ^ fold(y)).sum()) <= differing(n_a + n_b)


def wide(s: np.ndarray) -> bytes:
    """A longer sketch, for the long lists whose sets have much in common."""
    return sketch(s, 24)


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        made = [shingles(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in made], pa.int64()), *[pa.array([f(s) for s in made], pa.binary()) for f in (sketch, wide, pack)]], names=["cls", "n", "sketch", "wide", "set"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar; a worker holds the sets of a slice of pairs."""
    for batch in slices(batches, 128):
        ok = [similar(unpack(x), unpack(y), PERCENT) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _confirmed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are similar, by sizes, sketches and then the full sets."""

    @F.pandas_udf("boolean")
    def hopeful(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        return pd.Series([near(*x) for x in zip(a, b, n_a, n_b, strict=True)], dtype=bool)

    side = lambda x, *cols: members.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    # sizes first: they are small, and pairs that they rule out take no sketch along
    sizes = members.select("cls", "n")
    small = F.broadcast if sizes.count() <= BROADCAST_ROWS else lambda d: d
    fit = pairs.join(small(sizes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"))), "a").join(small(sizes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"))), "b").where(fits)
    some = fit.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
    some = written(some.where(hopeful("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b"), "hopeful")
    sets = some.join(side("a", "set"), "a").join(side("b", "set"), "b").select("a", "b", "set_a", "set_b")
    return written(sets.mapInArrow(_alike, "a long, b long"), "confirmed")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(key, cls, full, comp) of all members of the lists."""
    labels = components(links)
    rows = lists.select("key", "cls", "full").union(lists.where("place = 1").select("key", F.col("first").alias("cls"), F.lit(True).alias("full")))
    return rows.join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", "full", F.coalesce("label", "cls").alias("comp"))


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of sets in different components of short lists, of which one has the full segment."""
    lists = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cls", "comp", "full"))).alias("c"))
    pairs = lists.select(F.posexplode("c").alias("i", "x"), "c").select("x", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("y"))
    return pairs.where("x.comp <> y.comp and (x.full or y.full)").select(*_ordered("x.cls", "y.cls")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """(key, size, main): lists with more than one component, and their largest one."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("k"))
    return parts.groupBy("key").agg(F.sum("k").alias("size"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")


def _visited(group: pd.DataFrame) -> pd.DataFrame:
    """Of a block's visitors and its residents the pairs whose sketches allow that they are similar."""
    home, guests = group[~group.visitor], group[group.visitor]
    size = min(map(len, group["wide"]))

    def folded(rows: pd.DataFrame) -> np.ndarray:
        v = [np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint8).reshape(-1, size), axis=0) for x in rows["wide"]]
        return np.array(v, dtype=np.uint8).reshape(-1, size).view(np.uint64)

    a, b = folded(guests), folded(home)
    n, cls, comp, full = (home[c].to_numpy() for c in ("n", "cls", "comp", "full"))
    out = []
    for i, g in enumerate(guests.itertuples()):
        total = n + g.n
        ok = (comp != g.comp) & (full | g.full) & (100 * np.minimum(n, g.n) >= PERCENT * np.maximum(n, g.n))
        ok &= np.bitwise_count(b ^ a[i]).sum(axis=1) <= (100 - PERCENT) * total // (100 + PERCENT)
        out += [(min(g.cls, x), max(g.cls, x)) for x in cls[ok].tolist()]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _long_lists(rows: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Further links in long lists (rows: key, cls, full, comp, size), of the sets that share too many of them to meet elsewhere."""
    spark = rows.sparkSession
    band = F.col("key").bitwiseAND(63).cast("int")
    bands = [r[0] for r in rows.select(band.alias("b")).distinct().collect()]  # at most 64
    if not bands:
        return links.limit(0)
    plan = spark.createDataFrame([(b, *allocation(b)[:2]) for b in bands], "band int, m int, u int")
    own = W.partitionBy("cls", "band")  # at most the segments of a set
    rows = rows.withColumn("band", band).join(F.broadcast(plan), "band").join(members.select("cls", "n"), "cls")
    rows = rows.withColumns({"e": F.count("*").over(own), "r": F.row_number().over(own.orderBy("size", "key"))})
    rows = written(rows.where(F.col("r") <= F.col("e") - shared_lists(F.col("n"), F.col("m"), F.col("u")) + 1).select("key", "cls", "full", "comp"), "heavy")
    found = []
    for i in range(ROUNDS + 1):
        open_ = written(_open(rows), "open")
        if open_.isEmpty():
            break
        rows = written(rows.join(open_, "key").select("key", "cls", "full", "comp", "main"), "heavy")
        outside = rows.where("comp <> main")
        if i < ROUNDS:
            pivots = rows.where("comp = main").groupBy("key").agg(F.min_by("cls", F.xxhash64("cls", F.lit(i))).alias("pivot"))
            met = outside.join(pivots, "key").select(*_ordered("cls", "pivot"))
        else:
            cut = rows.join(open_.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key").join(members.select("cls", "n", "wide"), "cls")
            home = cut.select("*", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("visitor"))
            guests = cut.where("comp <> main").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"))
            met = home.unionByName(guests).groupBy("key", "block").applyInPandas(_visited, "a long, b long")
        fresh = _confirmed(met.distinct(), members)
        found.append(fresh)
        if i < ROUNDS and not fresh.isEmpty():
            # components of components
            named = rows.select("cls", "comp").distinct()
            steps = fresh.join(named.select(F.col("cls").alias("a"), F.col("comp").alias("x")), "a").join(named.select(F.col("cls").alias("b"), F.col("comp").alias("y")), "b")
            labels = components(steps.select(F.col("x").alias("a"), F.col("y").alias("b")))
            rows = rows.join(labels, F.col("comp") == F.col("node"), "left").select("key", "cls", "full", F.coalesce("label", "comp").alias("comp"))
        else:
            rows = rows.select("key", "cls", "full", "comp")
    out = links.limit(0)
    for f in found:
        out = out.union(f)
    return out


def link(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles and component_id, the least doc_id that similar documents lead to.

    Input: doc_id, text and any other columns, which are not carried. Texts without words (also null ones) have an empty
    set and are components of their own. Repeated rows and copies are linked like any equal sets. Rows with a null doc_id
    count last in a component; where all are null its component_id is null. An empty table gives no rows. Very long texts
    take postings in proportion to their words. Equal sets are known by 63 bits of a hash.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = written(texts.mapInArrow(_posted, "doc_id long, text_hash long, n long, cls long, full int, keys array<long>"), "postings")
    posts = rows.select("cls", "full", F.posexplode("keys").alias("i", "key"))
    posts = posts.select("key", F.when(F.col("i") < F.col("full"), F.col("cls").bitwiseOR(F.lit(int(_FULL)))).otherwise(F.col("cls")).alias("code"))
    lists = posts.repartition(partitions(spark), "key").sortWithinPartitions("key", "code").mapInArrow(_lists, "key long, first long, cls long, full boolean, place long")
    lists = written(lists, "lists")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("low"))
    met = lists.select("cls").union(lists.select("first")).distinct()
    chosen = written(classes.join(met, "cls").select("cls", "one.*"), "chosen")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    members = same_row(texts, few).select("cls", "text").mapInArrow(_with_sets, "cls long, n long, sketch binary, wide binary, set binary")
    members = written(members, "members")
    if members.count() > chosen.count():  # repeated rows of a doc_id and text
        members = written(members.dropDuplicates(["cls"]), "members")
    links = _confirmed(lists.select(*_ordered("first", "cls")).distinct(), members)
    all_of = _labelled(lists, links)
    open_ = _open(all_of)
    all_of = written(all_of.join(open_.select("key", "size"), "key"), "open")
    links = links.union(_confirmed(_across(all_of.where(F.col("size") <= SHORT_LIST)), members))
    long_ = open_.where(F.col("size") > SHORT_LIST).select("key", "size")
    long_ = _labelled(lists.join(long_.select("key"), "key", "left_semi"), links).join(long_, "key")
    links = links.union(_long_lists(long_, members, links))
    labels = components(links)
    named = classes.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "low", F.coalesce("label", "cls").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "comp").select(F.col("cls").alias("c"), "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, F.col("cls") == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles are similar."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
