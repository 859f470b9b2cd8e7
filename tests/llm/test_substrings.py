import hashlib
import random
from collections import Counter

import numpy as np

from chronoloom.llm import substrings as S


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 399):
            if count[r[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        left = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def sample(rng):
    text = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [text(n) for n in (330, 360, 399, 400, 401, 430, 600, 1500)]
    texts = []
    for i in range(120):
        parts = [text(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 60) if rng.random() < 0.5 else 0
            parts += [p[cut:], text(rng.randrange(0, 200))]
        texts.append("".join(parts))
    base = text(3000)
    for _ in range(40):  # near copies
        t = list(base)
        for _ in range(rng.randrange(0, 8)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    return texts + ["a" * 2500, "ab" * 700, "", None, "x" * 399, "x" * 400, "q" * 401, texts[5], texts[5]]


def test_removal_equals_brute_force(spark, tmp_path):
    texts = sample(random.Random(12))
    rows = [(i if i % 50 else None, t, b"k") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, kept binary").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in S.op6_substrings(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i if i % 50 else None, *x) for i, x in enumerate(brute(texts))), key=str)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_hot_grams_are_counted_window_by_window(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    test_removal_equals_brute_force(spark, tmp_path)


def test_frequent_surroundings_are_not_dealt_to_one_task(spark, tmp_path, monkeypatch):
    gram = "if(id = 0, -1, if(id % 3 > 0, 7, id div 30)) AS gram"
    seen = spark.range(0, 9000, 1, 6).selectExpr(gram, "1L AS around", "id AS doc_id")
    kinds = seen.groupBy("gram", "around").count().withColumnRenamed("count", "n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = S._copied(seen, kinds)
        assert sorted(r.doc_id for r in rows.collect()) == list(range(1, 9000))
        assert max(rows.rdd.glom().map(len).collect()) < 3000  # a shuffle deals 6,000 of one surrounding to one task
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(S, "COPIES", 2)
    test_removal_equals_brute_force(spark, tmp_path)


def test_rows_keep_their_numbers_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    texts = sample(random.Random(5))[:60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = iter(["1000", "1000000"] * 50)
    write = S.written

    def other_splits(df, name):
        out = write(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    monkeypatch.setattr(S, "written", other_splits)
    try:
        got = sorted(tuple(r) for r in S.op6_substrings(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, *x) for i, x in enumerate(brute(texts))]


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(2)
    items = [(bytes(rng.choices(b"ab", k=rng.randrange(1, 30))), b"", (i, -i), i) for i in range(500)]
    runs = [sorted(items[i::7]) for i in range(7)]
    merged = list(S.merge([S.decode(S.encode(r)) for r in runs]))
    keys = [s[0] for _, s in merged]
    assert keys == sorted(x[0] for x in items)
    for (_, a), (k, b) in zip(merged, merged[1:]):
        n = next((i for i, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0])))
        assert k == n


def test_documents_equal_hashed_brute_force(spark):
    """All 400-byte windows of a whole table by a rolling hash, sorted; what repeats is removed."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    rng = np.random.default_rng(1)
    table, base = rng.integers(0, 2**64, 256, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 2**64))
    longest = max(len(b) for _, b in rows) + 1
    up, down = (np.cumprod(np.array([1] + [int(x)] * longest, dtype=np.uint64), dtype=np.uint64) for x in (base, back))
    hashes = []
    for _, raw in rows:
        b = np.frombuffer(raw, dtype=np.uint8)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(table[b] * up[: len(b)], dtype=np.uint64)))
        n = max(0, len(b) - 399)
        hashes.append((total[400 : 400 + n] - total[:n]) * down[:n])
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    repeats = np.zeros(len(flat), dtype=bool)
    repeats[order[1:][same]] = repeats[order[:-1][same]] = True
    want, at = {}, 0
    for (doc_id, raw), h in zip(rows, hashes, strict=True):
        cover = np.zeros(len(raw) + 1, dtype=np.int64)
        starts = np.flatnonzero(repeats[at : at + len(h)])
        at += len(h)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + 400, -1)
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        want[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op6_substrings(spark, "/root/testdata/sf0.1").collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 500
