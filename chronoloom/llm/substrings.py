"""Exact removal of repeated 400-byte strings by a common-prefix-aware distributed merge sort of suffixes.

Sorting all suffixes of a corpus is out of proportion, so suffixes start at anchors that the content sets: of the
128-grams in every 400-byte window, the one with the least hash. Equal windows have the same anchor at the same place,
so a repeated window always shows as two anchors whose surroundings agree for at least 400 bytes.

1. Anchors are counted by their 128-gram and by all the bytes that windows around them can reach (272 to the left, 400
   to the right). Where only one text has a 128-gram there is no repeat; where two have all those bytes in common, all
   windows there are repeats. What is left, one anchor for each surrounding, goes on. 128-grams with more than ``HOT``
   surroundings (a passage that a share of all texts have) go another way, below.
2. Each task sorts the suffixes at its anchors into runs, front-coded: a suffix is written as the length of its common
   prefix with the one before and the rest. The runs are exchanged by bucket of the 128-gram and combined by a
   loser tree that keeps, for every loser, the prefix it shares with the winner: known prefixes are not compared again.
3. The merge yields the suffixes in order with their common prefixes. A window that begins ``a`` bytes before the anchor
   is a repeat if another suffix agrees for 400 - a bytes and the text before it for ``a``; the least and the largest
   such ``a`` bound what is removed. They come from joining neighbours from the longest common prefix down.

Under a hot 128-gram, windows that begin in one of eight stretches before the anchor share what all windows of the stretch
have in common. Only surroundings that have that in common with another list the hashes of the stretch's windows, and
those are counted. All of it is grouping by hashes of contents, so no task holds the surroundings of a 128-gram.

Rows are known by doc_id and a hash of the text, which no scan can change.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import FEW_ROWS, partitions, same_row, slices, written
from chronoloom.llm.fingerprints import _P, _Q, _mixed

LENGTH = 400
GRAM = 128
REACH = LENGTH - GRAM
#: More surroundings of one 128-gram than a task holds well (700 bytes each) are not merged but counted window by window.
HOT = 50_000
#: Surroundings at more anchors than this are joined by broadcast, if they are few: a shuffle deals all of one to one task.
COPIES = 1_000
#: Hot 128-grams are broadcast up to so many (8 bytes each) and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Bytes of suffixes for each bucket of the merge.
BUCKET_BYTES = 8 << 20
STRETCHES = 8
_PLACE_BITS = 20
_PIECE = 1 << 19
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from each place, by doubling."""
    h, n = _BYTE[b], 1
    while n < size:
        h = _mixed(h[:-n] * _P + h[n:] * _Q + np.uint64(n))
        n *= 2
    return h


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the 128-grams that are the least, and leftmost of the least, in some 400-byte window."""
    if len(b) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    places, hashes = [], []
    width = REACH + 1
    for at in range(0, len(b) - LENGTH + 1, _PIECE):
        h = gram_hashes(b[at : at + _PIECE + LENGTH - 1], GRAM)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while n * 2 <= width:
            v = np.minimum(v[:-n], v[n:])
            n *= 2
        v = np.minimum(v[: len(v) - (width - n)], v[width - n :])
        own = np.unique((v & low).astype(np.int64))
        places.append(own + at)
        hashes.append(h[own])
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def _around(raw: bytes, p: int) -> tuple[int, int]:
    return max(0, p - REACH), min(len(raw), p + LENGTH)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        rows, places, grams, around = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            p, h = anchors(np.frombuffer(raw, dtype=np.uint8))
            rows.append(np.full(len(p), i))
            places.append(p)
            grams.append(h)
            around += [hashlib.blake2b(raw[s:e], digest_size=8, salt=struct.pack("<H", x - s)).digest() for x, (s, e) in ((x, _around(raw, x)) for x in p.tolist())]
        at = pa.array(np.concatenate(rows))
        cols = [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.frombuffer(b"".join(around), dtype="<i8")), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(places).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["gram", "around", "doc_id", "text_hash", "place"])


def _common(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix of two strings that agree in their first k bytes."""
    n = min(len(a), len(b))
    if a[k:n] == b[k:n]:
        return n
    step = 16
    while a[k : k + step] == b[k : k + step]:
        k += step
        step *= 2
    while step > 1:
        step //= 2
        if a[k : k + step] == b[k : k + step]:
            k += step
    return k


#: A suffix in a run: key (gram's hash and the bytes from the anchor), bytes before the anchor backwards, row (doc_id, or
#: None, and hash of the text) and place.
Suffix = tuple[bytes, bytes, tuple[int | None, int], int]
_HEAD = struct.Struct("<HHH?qqq")


def encode(run: list[Suffix]) -> bytes:
    """A sorted run, front-coded."""
    out, last = [], b""
    for key, left, (doc_id, text_hash), place in run:
        k = _common(last, key, 0)
        out += [_HEAD.pack(k, len(key) - k, len(left), doc_id is None, doc_id or 0, text_hash, place), key[k:], left]
        last = key
    return b"".join(out)


def decode(blob: bytes) -> Iterator[tuple[int, Suffix]]:
    """(common prefix with the suffix before, suffix) in order."""
    at, last = 0, b""
    while at < len(blob):
        k, rest, before, none, doc_id, text_hash, place = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        last = last[:k] + blob[at : at + rest]
        at += rest
        yield k, (last, blob[at : at + before], (None if none else doc_id, text_hash), place)
        at += before


def merge(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """Loser tree over sorted runs; yields suffixes in order with the prefix each shares with the one before.

    Each contender carries the prefix it shares with the last winner. Of two, the one that shares more is the lesser;
    only where both share the same length are bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple[int, Suffix] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size  # with the last winner

    def lesser(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        a, b = heads[x], heads[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        k = _common(a[1][0], b[1][0], shared[x])
        win, lose = (x, y) if a[1][0][k:] <= b[1][0][k:] else (y, x)
        shared[lose] = k
        return win, lose

    losers = [0] * size
    level = list(range(size))
    at = size
    while len(level) > 1:
        at //= 2
        nxt = []
        for i in range(0, len(level), 2):
            win, lose = lesser(level[i], level[i + 1])
            losers[at + i // 2] = lose
            nxt.append(win)
        level = nxt
    champion = level[0]
    while heads[champion] is not None:
        yield shared[champion], heads[champion][1]
        heads[champion] = next(runs[champion], None)
        if heads[champion] is not None:
            shared[champion] = heads[champion][0]
        node = (champion + size) // 2
        while node:
            champion, losers[node] = lesser(champion, losers[node])
            node //= 2


def _first_partner(order: list[int], lcp: list[int], rank: list[int], other: np.ndarray) -> dict[int, int]:
    """For each suffix the greatest x such that another shares x in this order and LENGTH - x in the other one.

    ``order``: suffixes sorted this way, ``lcp[i]`` what order[i] shares with order[i - 1]; ``rank``: place in the other
    order, ``other``: what neighbours share there (as ``lcp``). Neighbours are joined from the longest lcp down; the
    smaller side looks up its neighbours in the larger one, and who has found a partner is not looked at again.
    """
    m = len(order)
    tables = [other]
    while len(tables[-1]) > 1 << (len(tables) - 1):
        t, s = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[:-s], t[s:]))

    def share(x: int, y: int) -> int:
        x, y = (x, y) if x < y else (y, x)
        k = (y - x).bit_length() - 1
        return int(min(tables[k][x + 1], tables[k][y - (1 << k) + 1]))

    group = list(range(m))
    members = [[rank[i]] for i in order]  # ranks in the other order, ascending
    waiting = [[rank[i]] for i in order]
    found: dict[int, int] = {}

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i in sorted(range(1, m), key=lambda j: -lcp[j]):
        x = lcp[i]
        need = LENGTH - x
        a, b = top(i - 1), top(i)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        big, small, open_ = members[a], members[b], waiting[a]
        fresh = []
        for r in small:
            at = bisect_left(big, r)
            near = max(share(r, big[at - 1]) if at else -1, share(r, big[at]) if at < len(big) else -1)
            if near < need:
                continue
            if r not in found:
                fresh.append(r)
            j = bisect_left(open_, r)
            lo = j
            while lo > 0 and share(open_[lo - 1], r) >= need:
                lo -= 1
            hi = j
            while hi < len(open_) and share(open_[hi], r) >= need:
                hi += 1
            for y in open_[lo:hi]:
                found[y] = x
            del open_[lo:hi]
        for r in fresh:
            found[r] = x
        group[b] = a
        members[a] = _joined(big, small)
        waiting[a] = _joined(open_, [r for r in waiting[b] if r not in found])
        members[b] = waiting[b] = []
    return found


def _joined(big: list[int], small: list[int]) -> list[int]:
    if len(small) * 8 < len(big):
        for r in small:
            big.insert(bisect_left(big, r), r)
        return big
    return sorted(big + small)


def reaches(group: list[tuple[int, Suffix]]) -> Iterator[tuple[int | None, int, int, int, int]]:
    """(doc_id, text_hash, place, least a, largest a) of the suffixes of one 128-gram with a repeated window; input in order."""
    m = len(group)
    right = [0] + [group[i][0] - 8 for i in range(1, m)]
    lefts = [g[1][1] for g in group]
    by_left = sorted(range(m), key=lefts.__getitem__)
    left = [0] + [_common(lefts[by_left[i - 1]], lefts[by_left[i]], 0) for i in range(1, m)]
    left_rank = [0] * m
    for i, j in enumerate(by_left):
        left_rank[j] = i
    far = _first_partner(list(range(m)), right, left_rank, np.array(left))  # by rank in the left order
    if not far:
        return
    high = _first_partner(by_left, left, list(range(m)), np.array(right))  # by place in the right order
    for i, a in high.items():
        _, _, row, place = group[i][1]
        yield *row, place, LENGTH - far[left_rank[i]], a


def _bucket(gram: int, buckets: int) -> int:
    """An anchor's hash is the least of many, so it lies low; multiplied, it is even."""
    return ((gram * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) * buckets) >> 64


def _stretch(j: int) -> tuple[int, int]:
    """First and last ``a`` of a stretch: windows that begin so many bytes before the anchor."""
    return j * (REACH + 1) // STRETCHES, (j + 1) * (REACH + 1) // STRETCHES - 1


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


_SENT = "bucket int, run binary, gram long, doc_id long, text_hash long, place long, before int, around binary"
_SENT_TYPES = pa.schema([("bucket", pa.int32()), ("run", pa.binary()), ("gram", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("around", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of some MB by bucket of the 128-gram's hash; for hot 128-grams the surroundings themselves."""
    held: list[Suffix] = []
    size = 0
    done: set[tuple] = set()  # of repeated rows, one tells what there is to tell

    def out() -> pa.RecordBatch:
        held.sort(key=lambda s: s[0])
        by: dict[int, list[Suffix]] = {}
        for s in held:
            by.setdefault(_bucket(int.from_bytes(s[0][:8], "big"), buckets), []).append(s)
        return pa.RecordBatch.from_pylist([{"bucket": b, "run": encode(r)} for b, r in by.items()], schema=_SENT_TYPES)

    for batch in slices(batches, 128):
        hot_rows = []
        for doc_id, text_hash, text, spots in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (doc_id, text_hash) in done:
                continue
            done.add((doc_id, text_hash))
            raw = text.encode("utf-8", "surrogatepass")
            for spot in spots:
                p, g = spot["place"], spot["gram"]
                s, e = _around(raw, p)
                if spot["hot"]:
                    hot_rows.append({"gram": g, "doc_id": doc_id, "text_hash": text_hash, "place": p, "before": p - s, "around": raw[s:e]})
                    continue
                held.append((struct.pack(">Q", g & 0xFFFFFFFFFFFFFFFF) + raw[p:e], raw[s:p][::-1], (doc_id, text_hash), p))
                size += e - s + 200
        if hot_rows:
            yield pa.RecordBatch.from_pylist(hot_rows, schema=_SENT_TYPES)
        if size > 24 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each surrounding and stretch, if its windows lie in the text, the hash of what they have in common."""
    for batch in slices(batches):
        at, stretch, digest = [], [], []
        for i, (before, around) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            for j in range(STRETCHES):
                first, last = _stretch(j)
                if first <= before and before + LENGTH - last <= len(around):
                    at.append(i)
                    stretch.append(j)
                    digest.append(_digest(around[before - first : before + LENGTH - last]))
        cols = [c.take(pa.array(at, pa.int64())) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(stretch, pa.int32()), pa.array(digest, pa.int64())], names=[*batch.schema.names, "stretch", "context"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all windows of a stretch that lie in the text."""
    for batch in slices(batches):
        at, begins, digest = [], [], []
        for i, (before, around, j) in enumerate(zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True)):
            first, last = _stretch(j)
            for a in range(max(first, before + LENGTH - len(around)), min(last, before) + 1):
                at.append(i)
                begins.append(a)
                digest.append(_digest(around[before - a : before - a + LENGTH]))
        cols = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(begins, pa.int64()), pa.array(digest, pa.int64())], names=["gram", "doc_id", "text_hash", "place", "a", "window"])


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of a written table that share ``keys`` with another row. Both sides of the join are tables, so a skewed key is split."""
    often = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), name)
    return rows.join(often, keys)


def _copied(seen: DataFrame, kinds: DataFrame) -> DataFrame:
    """The anchors whose surroundings another anchor has too."""
    key = ["gram", "around"]
    often = kinds.where(F.col("n") > COPIES).select(*key)
    if not 0 < often.count() <= FEW_ROWS:
        return seen.join(kinds.where(F.col("n") > 1).select(*key), key)
    rest = seen.join(F.broadcast(often), key, "left_anti").join(kinds.where(F.col("n").between(2, COPIES)).select(*key), key)
    return seen.join(F.broadcast(often), key).unionByName(rest)


def _hot_reaches(hot: DataFrame) -> DataFrame:
    """As ``reaches``, for all surroundings of the hot 128-grams, by counting."""
    cols = "gram long, doc_id long, text_hash long, place long"
    context = written(hot.mapInArrow(_contexts, f"{cols}, before int, around binary, stretch int, context long"), "contexts")
    some = _repeated(context, ["gram", "stretch", "context"], "contexts-often").select("gram", "doc_id", "text_hash", "place", "before", "around", "stretch")
    window = written(some.mapInArrow(_windows, f"{cols}, a long, window long"), "windows")
    same = _repeated(window, ["gram", "a", "window"], "windows-often")
    return same.groupBy("doc_id", "text_hash", "place").agg(F.min("a").alias("low"), F.max("a").alias("high"))


def _merged(table: pa.Table) -> pa.Table:
    out: list[tuple] = []
    group: list[tuple[int, Suffix]] = []
    for k, s in merge([decode(r) for r in table.column("run").to_pylist()]):
        if group and k < 8 + GRAM:
            if len(group) > 1:
                out += reaches(group)
            group = []
        group.append((k, s))
    if len(group) > 1:
        out += reaches(group)
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "text_hash", "place", "low", "high"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols: list[list] = [[] for _ in range(6)]
        for doc_id, text, begins, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for s, e in sorted(zip(begins or (), ends or (), strict=True)):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            kept, at = [], 0
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            left = b"".join(kept)
            for c, x in zip(cols, (doc_id, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes left) of every document.

    Input: doc_id, text and any other columns, which are not carried. A null text counts as empty; texts of fewer than
    400 bytes lose nothing. Repeated rows repeat each other and lose all windows, like any copies; rows with a null
    doc_id take part. Removal may cut characters in two, so ``kept`` is binary. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    key = ["doc_id", "text_hash"]
    seen = written(rows.mapInArrow(_anchor_rows, "gram long, around long, doc_id long, text_hash long, place long"), "anchors")
    kinds = written(seen.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct(*key, "place")).alias("one")), "surroundings")
    several = written(kinds.groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > 1), "grams")
    whole = _copied(seen, kinds).select(*key, "place", F.lit(0).cast("long").alias("low"), F.lit(REACH).cast("long").alias("high"))
    counted = several.agg(F.count_if(F.col("k") > HOT), F.coalesce(F.sum(F.when(F.col("k") <= HOT, F.col("k"))), F.lit(0))).first()
    hot = several.where(F.col("k") > HOT).select("gram")
    hot = F.broadcast(hot) if counted[0] <= BROADCAST_ROWS else hot
    warm = kinds.join(hot, "gram", "left_anti") if counted[0] else kinds
    spots = warm.join(several.where(F.col("k") <= HOT).select("gram"), "gram").select("one", "gram", F.lit(False).alias("hot"))
    if counted[0]:
        spots = spots.union(kinds.join(hot, "gram").select("one", "gram", F.lit(True)))
    spots = spots.groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash")).agg(F.collect_list(F.struct("one.place", "gram", "hot")).alias("spots"))
    buckets = max(partitions(spark), -(-counted[1] * (LENGTH + REACH) // BUCKET_BYTES))
    sent = same_row(rows, spots).select(*key, "text", "spots").mapInArrow(lambda it: _runs(it, buckets), _SENT)
    sent = written(sent, "runs")
    found = sent.where("run is not null").select("bucket", "run").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merged, "doc_id long, text_hash long, place long, low long, high long").union(whole)
    if counted[0]:
        found = found.union(_hot_reaches(sent.where("around is not null").select("gram", *key, "place", "before", "around")))
    # windows begin ``low`` to ``high`` bytes before the anchor; those of whole surroundings, as far as the text goes
    spans = written(found, "reaches").select(*key, F.greatest(F.lit(0), F.col("place") - F.col("high")).alias("begin"), (F.col("place") - F.col("low") + LENGTH).alias("end")).distinct()
    ends = written(spans.groupBy(*key).agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")), "spans")
    joined = same_row(rows, ends, "left").select("doc_id", "text", "begins", "ends")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
