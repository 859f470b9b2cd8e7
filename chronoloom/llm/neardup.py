"""Near-duplicates by a signature-coordinate inverted join over MinHash signatures.

Every text's set of five-word shingles gets a signature of 64 MinHash coordinates. Equal sets are one class from then
on. Each class is posted under its (coordinate, value) pairs. Two sets with a Jaccard similarity of 0.75 agree in 48
coordinates on average and in fewer than ``MATCHES`` with a probability below 1e-9, so a pair that can be similar
shares ``MATCHES`` pairs at least, and (prefix) one of the rarest 64 - MATCHES + 1 pairs of either. Only these are
posted: what many texts have in common is skipped, and a class with fewer than ``MATCHES`` shared pairs is posted
nowhere.

A short posting list gives all of its pairs, kept if they agree in ``MATCHES`` coordinates; a long one, a group of many
near copies, only ties its classes together. What hangs together is a group of candidates. Only now are the shingle
sets made again, for these classes alone, and brought together by group. A group that fits a block is settled there: by
signatures, then by sets, skipping what is linked already. A larger group is cut in blocks, tied by a few pivots that
visit all of them. What then lies outside the main component meets by its sets: two similar sets share one of the
rarest quarter (and one) of the shingles of either, whatever order tells what is rare. Short lists of such a shingle
give pairs; classes on long ones, which have much in common with many without being similar, visit the blocks of the
other such classes. So no pair of different texts is lost, and a group is expanded into all pairs only among the latter.

Pairs are confirmed on the full sets. Components of the links come from label propagation with pointer jumping.

Rows are known by doc_id and a hash of the text, which no scan can change; classes by a number written with them once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import by_count, same_row, slices, written
from chronoloom.llm.fingerprints import _mixed, _powers

SHINGLE = 5
COORDINATES = 64
MATCHES = 26
LONG_LIST = 16
PIVOTS = 4
BLOCK = 256
#: A list of up to so many classes with a rare shingle in common is expanded into pairs.
COLD_LIST = 64
#: Visitors of a block come in parts of about so many blocks' size.
VISITOR_BLOCKS = 8
#: Shingles are counted in so many bins: the order by these counts need only be the same for all sets.
BINS = 1 << 18
#: Keys of candidate rows are broadcast up to so many (32 bytes each) and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_FIVE = _RNG.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of all words, if they are fewer; none without words."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)  # bytes.lower: A-Z only
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    letters = ~space
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], dtype=np.int64), np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))))
    terms = np.where(letters, _mixed(b.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[np.minimum(place, size.max())], np.uint64(0))
    w = _mixed(np.add.reduceat(terms, starts) + size.astype(np.uint64))
    n = min(SHINGLE, len(w))
    s = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for i in range(n):
        s = _mixed(s + w[i : i + len(s)] * _FIVE[i])
    return np.unique(s + np.uint64(n))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(s), 2048):
        part = ((s[i : i + 2048, None] * _A + _B) >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def pack(s: np.ndarray) -> bytes:
    """The hashes in five bytes each, for the confirmation; chance agreement is below 1e-12 for two shingles."""
    return np.ascontiguousarray((s >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    five = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    five[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return five.view("<u8").reshape(-1)


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols: list[list] = [[], [], []]
        for text in batch.column(2).to_pylist():
            s = shingles(text)
            row = (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).astype("<i4").tobytes() if len(s) else b"")
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "text_hash", "n_shingles", "set_hash", "sig"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[int] = set()  # repeated rows give their class once
    for batch in slices(batches):
        fresh = []
        for i, cls in enumerate(batch.column(1).to_pylist()):
            if cls not in done:
                done.add(cls)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        made = [shingles(t) for t in batch.column(2).to_pylist()]
        sigs = [signature(s).astype("<i4").tobytes() for s in made]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in made], pa.int64()), pa.array(sigs, pa.binary()), pa.array([pack(s) for s in made], pa.binary())], names=["grp", "cls", "n", "sig", "set"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the label is the least node of the connected component."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    nodes = labels.count()
    while True:
        near = both.join(by_count(labels, nodes), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("to"), F.col("label").alias("ahead"))
        jumped = written(stepped.join(by_count(ahead, nodes), F.col("label") == F.col("to"), "left").select("node", "old", F.least("label", "ahead").alias("label")), "labels")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of candidate pairs those of fitting sizes that agree in MATCHES coordinates. One byte of each coordinate is compared: that can only let more through."""

    @F.pandas_udf("binary")
    def low_bytes(sig: pd.Series) -> pd.Series:
        return pd.Series([x[::4] for x in sig])

    @F.pandas_udf("int")
    def agreements(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(-1, COORDINATES) for v in (x, y))
        return pd.Series((a == b).sum(axis=1).astype(np.int32))

    small = classes.select("cls", "n", low_bytes("sig").alias("sig"))
    rows = classes.count()
    side = lambda x: by_count(small.select(F.col("cls").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}")), rows)
    some = pairs.join(side("a"), "a").join(side("b"), "b")
    # sets of too different sizes cannot be similar
    return some.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * 75) & (agreements("sig_a", "sig_b") >= MATCHES)).select("a", "b")


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """Links (a < b) in a block: among its residents, and of visitors to them; enough to tie all that are similar."""
    home = group[~group.visitor].sort_values("cls")
    sigs = np.frombuffer(b"".join(home.sig), dtype="<i4").reshape(-1, COORDINATES)
    ids, n, sets = home.cls.to_numpy(), home.n.to_numpy(), list(home.set)
    known: dict[int, np.ndarray] = {}
    top = dict(zip(home.cls.tolist(), home.comp.tolist(), strict=True))  # component so far
    out = []

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]] if top[x] in top else top[x]
            x = top[x]
        return x

    def visit(cls: int, size: int, sig: np.ndarray, own: np.ndarray, among: slice) -> None:
        agree = ((sigs[among] == sig).sum(axis=1) >= MATCHES) & (np.minimum(n[among], size) * 100 >= np.maximum(n[among], size) * 75)
        for i in np.flatnonzero(agree).tolist():
            if find(cls) != find(int(ids[i])):
                if i not in known:
                    known[i] = unpack(sets[i])
                if similar(own, known[i]):
                    top[find(cls)] = find(int(ids[i]))
                    out.append((min(cls, int(ids[i])), max(cls, int(ids[i]))))

    if home.fresh.all():
        for k in range(1, len(home)):
            known[k] = unpack(sets[k])
            visit(int(ids[k]), int(n[k]), sigs[k], known[k], slice(0, k))
    for v in group[group.visitor].itertuples():
        top.setdefault(v.cls, v.comp)
        visit(int(v.cls), int(v.n), np.frombuffer(v.sig, dtype="<i4"), unpack(v.set), slice(None))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per bin and task: how many shingles of its sets fall in it."""
    n = np.zeros(BINS, dtype=np.int64)
    for batch in slices(batches):
        for raw in batch.column(0).to_pylist():
            np.add.at(n, (unpack(raw) % np.uint64(BINS)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bin", "n"])


def rarest(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which any set of similarity 0.75 shares one: all but ceil(3/4) of them and one more, rarest first."""
    order = np.lexsort((s, counts[(s % np.uint64(BINS)).astype(np.int64)]))
    return s[order[: len(s) - -(-3 * len(s) // 4) + 1]]


def _meeting(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b of classes that share a rare shingle of a short list, classes on long lists) of the open groups; only what may tie a guest."""
    spark = open_.sparkSession
    counts = np.zeros(BINS, dtype=np.int64)
    for r in open_.select("set").mapInArrow(_binned, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toLocalIterator():  # a number per bin
        counts[r["bin"]] = r["n"]
    known = spark.sparkContext.broadcast(counts)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [rarest(unpack(x), known.value) for x in batch.column(4).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            tokens = np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(4)], pa.array(tokens)], names=["grp", "cls", "comp", "guest", "token"])

    rows = open_.select("grp", "cls", "comp", (F.col("comp") != F.col("main")).alias("guest"), "set")
    posts = written(rows.mapInArrow(posted, "grp long, cls long, comp long, guest boolean, token long"), "rare")
    lists = posts.groupBy("grp", "token").agg(F.count("*").alias("size"), F.max("guest").alias("any"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    lists = written(lists.where("any and c0 <> c1").select("grp", "token", "size"), "rare-lists")
    cold = posts.join(by_count(lists.where(F.col("size") <= COLD_LIST)), ["grp", "token"]).groupBy("grp", "token").agg(F.sort_array(F.collect_list(F.struct("cls", "comp", "guest"))).alias("c"))
    pairs = cold.select(F.posexplode("c").alias("i", "x"), "c").select("x", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("y"))
    pairs = pairs.where("x.comp <> y.comp and (x.guest or y.guest)").select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    hot = posts.join(by_count(lists.where(F.col("size") > COLD_LIST)), ["grp", "token"]).select("grp", "cls").distinct()
    return pairs, written(hot, "hot")


def _links(members: DataFrame) -> DataFrame:
    """Confirmed links among ``members`` (grp, cls, n, sig, set): every pair of a group that is similar ends in one component."""
    # only groups beyond a block: at most a row for every BLOCK members
    large = members.groupBy("grp").agg(F.count("*").alias("size"), *[F.min_by("cls", F.xxhash64("cls", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]).where(F.col("size") > BLOCK)
    large = written(large.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "large")
    any_large = large.count()
    per_group = lambda table: by_count(table, any_large, BROADCAST_ROWS // 10)
    sized = members.join(per_group(large), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cols = ["grp", "block", "visitor", "fresh", "comp", "cls", "n", "sig", "set"]
    own_block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    new = sized.withColumns({"fresh": F.lit(True), "comp": F.col("cls")})
    home = new.withColumns({"block": own_block, "visitor": F.lit(False)})
    pivots = new.where((F.col("blocks") > 1) & F.col("cls").isin(*[F.col(f"p{i}") for i in range(PIVOTS)])).withColumns({"block": every_block, "visitor": F.lit(True)})
    first = written(home.select(cols).union(pivots.select(cols)).groupBy("grp", "block").applyInPandas(_settle, "a long, b long"), "links")
    if not any_large:
        return first
    labels = components(first)
    placed = sized.where(F.col("blocks") > 1).join(by_count(labels), F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "cls")).drop("label", "node")
    part = placed.groupBy("grp", "comp").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = placed.join(per_group(part), "grp").select("grp", "main", "comp", "cls", "n", "sig", "set")
    open_ = written(open_.withColumn("fresh", F.lit(False)), "open")
    pairs, hot = _meeting(open_)

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(unpack(a), unpack(b)) for a, b in zip(x, y, strict=True)], dtype=bool)

    # sets of near copies pack well: never judged by their files
    side = lambda x: open_.select(F.col("cls").alias(x), F.col("set").alias(f"set_{x}")).hint("merge")
    met = _agreeing(pairs, open_).join(side("a"), "a").join(side("b"), "b").where(alike("set_a", "set_b")).select("a", "b")
    warm = open_.join(by_count(hot.select("cls")), "cls")
    cut = warm.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.when(F.col("comp") != F.col("main"), 1)) / (VISITOR_BLOCKS * BLOCK)).cast("int").alias("chunks"))
    cut = written(cut.where("chunks > 0"), "cut")
    warm = warm.join(per_group(cut), "grp")
    some_chunk = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int")
    home = warm.withColumns({"block": own_block, "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "visitor": F.lit(False)})
    guests = warm.where("comp <> main").withColumns({"block": every_block, "chunk": some_chunk, "visitor": F.lit(True)})
    cols.append("chunk")
    more = home.select(cols).union(guests.select(cols)).groupBy("grp", "block", "chunk").applyInPandas(_settle, "a long, b long").union(met)
    return first.union(written(more.distinct(), "more"))


def link(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_hash, n_shingles, component_id, kept and ``part``, a number for each component.

    Input: doc_id, text and any other columns, which are not carried. Texts without words (also null ones) have an
    empty set and are components of their own, with a null ``part``. Repeated rows and copies are linked like any equal
    sets. ``component_id`` is the least doc_id of the component; rows with a null doc_id count last, and where all are
    null it is null. ``kept`` says that doc_id equals it (null to null). An empty table gives no rows.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = written(texts.mapInArrow(_signed, "doc_id long, text_hash long, n_shingles long, set_hash binary, sig binary"), "signatures")
    merged = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("low"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"))
    merged = written(merged.withColumn("cls", F.monotonically_increasing_id()), "classes")
    classes = merged.select("cls", "n", "sig")

    @F.pandas_udf("array<long>")
    def tokens(sig: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(sig), dtype="<u4").reshape(-1, COORDINATES).astype(np.int64)
        return pd.Series(list(a | (np.arange(COORDINATES, dtype=np.int64) << 32)))

    posts = classes.select("cls", F.explode(tokens("sig")).alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    # 64 rows of a class: what Spark estimates from the classes' files is far too little
    own = posts.join(shared.hint("merge"), "token").groupBy("cls").agg(F.collect_list(F.struct("f", "token")).alias("t")).where(F.size("t") >= MATCHES)
    prefix = own.select("cls", F.explode(F.slice(F.sort_array("t"), F.lit(1), F.size("t") - (MATCHES - 1))).alias("t")).select("cls", "t.token")
    prefix = written(prefix, "postings")
    lists = written(prefix.groupBy("token").agg(F.count("*").alias("size"), F.min("cls").alias("first")).where(F.col("size") > 1), "lists")
    short = prefix.join(by_count(lists.where(F.col("size") <= LONG_LIST).select("token")), "token").groupBy("token").agg(F.sort_array(F.collect_list("cls")).alias("c"))
    short = short.select(F.posexplode("c").alias("i", "a"), "c").select("a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b")).distinct()
    tied = prefix.join(by_count(lists.where(F.col("size") > LONG_LIST)), "token").where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    groups = components(_agreeing(short, classes).union(tied)).select(F.col("node").alias("cls"), F.col("label").alias("grp"))
    chosen = written(merged.select("cls", "one.doc_id", "one.text_hash").join(by_count(groups), "cls"), "chosen")
    members = same_row(texts, by_count(chosen, most=BROADCAST_ROWS)).select("grp", "cls", "text")
    links = _links(written(members.mapInArrow(_with_sets, "grp long, cls long, n long, sig binary, set binary"), "members"))
    labels = components(links)
    named = merged.join(by_count(labels), F.col("cls") == F.col("node"), "left").select("set_hash", "low", F.coalesce("label", "cls").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = written(named.join(lowest, "comp").select("set_hash", "component_id", F.col("comp").alias("part")), "components")
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_hash").join(by_count(named), "set_hash", "left")
    out = out.withColumn("component_id", F.when(F.col("part").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "part")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row left of every component, all columns as they are.

    It is the row with the least doc_id, of those the one with the least hash of its text; of rows repeated with the same
    doc_id and text any one stays. Texts without words all stay.
    """
    key = ["doc_id", "text_hash"]
    found = written(link(docs).where(F.col("part").isNotNull()), "linked")
    texts = found.groupBy("part", *key).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    texts = written(texts, "texts")
    number = texts.count()
    best = texts.where("kept").groupBy("part").agg(F.min(F.struct(*key)).alias("one")).select("part", "one.*")
    best = by_count(best, number)
    gone = written(same_row(texts.select(*key, F.col("part").alias("p")), best, "left").where(F.col("part").isNull()).select(*key), "gone")
    again = written(same_row(texts.where("rows > 1").select(*key), best).select(*key), "again")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    some = lambda keys: by_count(keys, most=BROADCAST_ROWS)
    kept = same_row(rows, some(gone), "left_anti")
    if not again.isEmpty():
        keys = some(again)
        kept = same_row(kept, keys, "left_anti").union(same_row(kept, keys).dropDuplicates(key))
    return kept.select("row.*")


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "part")
