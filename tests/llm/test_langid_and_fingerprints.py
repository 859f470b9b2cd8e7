import hashlib
import random
import zlib

import numpy as np

from chronoloom.llm import fingerprints as P
from chronoloom.llm import langid as L

LETTERS = {"en": "etaoinshrdlu", "de": "enisratdhulüß", "fr": "esaitnrulodéè"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randrange(3, 9))) for _ in range(n))


def test_language_by_held_out_accuracy(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.randrange(20, 60)), lang, "x", 9) for i in range(600) for lang in [rng.choice(list(LETTERS))]]
    rows += [(1000, None, "en", "x", 9), (1001, "", "en", "x", 9), (1002, "12 !? \U0001f600", "de", "x", 9), (1003, prose(rng, "fr", 40), None, "x", 9), (None, prose(rng, "de", 40), "de", "x", 9), (5, rows[5][1], rows[5][2], "x", 9), (1004, prose(rng, "en", 30000), "en", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op4_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _, _ in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in (*LETTERS, "und")
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "fr", "de", "en"]
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    again = L.op4_langid(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    kept = L.in_known_language(docs)
    assert kept.columns == docs.columns and 1000 not in {r.doc_id for r in kept.collect()}
    assert L.predict(docs.limit(0), docs).count() == 0
    assert {r.lang_pred for r in L.predict(docs, docs.limit(0)).collect()} == {"und"}


def test_copies_leave_the_sample_as_it_is(spark):
    rows = [(f"own text {i}", "en") for i in range(400)] + [("a copied text", "en")] * 20_000 + [("ein Text", "de")] * 3
    got = L._sample(spark.createDataFrame(rows, "text string, lang string"), 100).collect()
    assert 60 <= sum(r.lang == "en" for r in got) <= 140
    assert [r.text for r in got if r.lang == "de"] == ["ein Text"]


def test_sparse_weights_and_calibration():
    rng = random.Random(1)
    bags = [(lang, *np.unique(L.grams(prose(rng, lang, 30)), return_counts=True)) for _ in range(60) for lang in LETTERS]
    langs, w, _, t = L.fit(bags, np.ones(L.DIM))
    assert langs == sorted(LETTERS) and 0.1 < t < 8
    assert (w == 0).mean() > 0.5  # n-grams never seen have no weight


def test_fingerprints_add_up():
    a, b = "first line\nsecond line here\n\nthird", "third\nfirst line\n\nsecond line here"
    assert P.to_hex(P.vector(a)) == P.to_hex(P.vector(b)) != P.to_hex(P.vector("first line\nsecond line\nthird"))
    whole, part, rest = (P.to_hex(P.vector(x)) for x in ("p one\np two\np three", "p two", "p one\np three"))
    assert P.combine(whole, part, remove=True) == rest and P.combine(rest, part) == whole
    assert P.likeness(P.vector(""), P.vector("")) == 1.0 and P.likeness(P.vector("a b c"), P.vector("")) == 0.0
    rng = random.Random(2)
    x = [prose(rng, "en", 12) for _ in range(40)]
    near = P.likeness(P.vector("\n".join(x)), P.vector("\n".join(x[:30] + [prose(rng, "en", 12) for _ in range(10)])))
    assert 0.55 < near < 0.95
    assert np.array_equal(P.from_hex(P.to_hex(P.vector(a))), P.vector(a))


def test_next_documents(spark, tmp_path):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 80)
    rows = [(i, "".join(rng.choices("ab \nç漢\U0001f600", k=rng.randrange(0, 60))) if k % 9 else ("" if k % 2 else None), "z") for k, i in enumerate(ids)]
    rows += [(ids[0], rows[0][1], "z"), (ids[1], "another text", "z"), (None, "null id", "z"), (ids[3], "w " * 40000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, bucket string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest(), P.to_hex(P.vector(t))))
    for buckets in (1, 7, 64):
        got = P.compare_with_next(spark.read.parquet(f"{tmp_path}/documents.parquet"), buckets).collect()
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint)) for r in got)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert P.compare_with_next(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert P.compare_with_next(one).first().near_next == 1.0
