import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from chronoloom.llm import mixing as M
from chronoloom.llm.langid import grams

LANGS = {"en": "the of and to in that is was for with on".split(), "de": "der die und zu den das nicht von mit für über".split(), "fr": "le la les et des une que dans été à où".split()}
LETTERS = {"en": "etaoinshr", "de": "enisratüß", "fr": "esaitnéèu"}


def corpus(rng):
    def prose(lang, n):
        return [rng.choice(LANGS[lang]) if rng.random() < 0.4 else "".join(rng.choices(LETTERS[lang], k=rng.randrange(4, 9))) for _ in range(n)]

    items = [prose("en", 25) for _ in range(3)]
    rows = []
    for i in range(150):
        lang = rng.choice(list(LANGS))
        w = prose(lang, rng.randrange(30, 120))
        if i % 10 == 3:
            w[7:7] = items[i % 3]
        if i % 10 == 5:
            w[4:4] = ["token", "=", "a1b2c3d4e5f6"]
        rows.append((i, " ".join(w), lang, f"s{i % 5}" if i % 7 else None, 1))
    for i in range(30):
        base = rows[i * 3][1].split(" ")
        base[len(base) // 2] = "zzzz"
        rows.append((200 + i, " ".join(base), rows[i * 3][2], "s1", 1))
    rows += [(300, None, "en", "s1", 0), (301, "123 ...", None, "s1", 7), (302, "", "en", "s1", 0)]
    return rows, [(k, " ".join(w)) for k, w in enumerate(items)]


def shingle(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus(random.Random(7))
    spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, mix_place int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    after = []
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out{i}")
        docs = spark.read.parquet(f"{sf}/out{i}")
        assert name and (docs.columns == columns or i == 4)
        after.append({r.doc_id: r for r in docs.collect()} if i < 4 else docs.collect())
    texts = {r[0]: r[1] for r in rows}
    assert set(after[0]) == {i for i, t in texts.items() if grams(t or "") is not None}
    keep, sets = [], {i: shingle(after[0][i].text) for i in sorted(after[0])}
    top = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    keep = {i for i in sets if top[i] == i}
    assert set(after[1]) == keep
    clean = {i for i in keep if not any(t in texts[i] for _, t in items)}
    assert set(after[2]) == clean
    assert set(after[3]) == clean
    for i in clean:
        want = re.sub("token = a1b2c3d4e5f6", "[SECRET]", texts[i])
        assert after[3][i].text == want and (want == texts[i] or after[3][i].n_chars == len(want))
    sizes = defaultdict(int)
    for i in clean:
        sizes[after[3][i].source] += len(after[3][i].text.split())
    target = brute_targets(sizes, (1, 2, 3), 3.0)
    taken, whole = Counter(), Counter()
    for r in after[4]:
        n = len(r.text.split())
        assert n == r.mix_words and after[3][r.doc_id].text.split()[:n] == r.text.split()
        taken[r.source] += n
        whole[r.source] += n < len(after[3][r.doc_id].text.split())
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in target.items())
    assert max(whole.values()) <= 1
    assert sorted(r.doc_id for r in C.run(spark, sf).collect()) == sorted(r.doc_id for r in after[4])


def brute_targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else level * weight[s]
            rest -= target[s] if over else 0
        open_ = open_ - over if over else set()
    return target


def test_mix_shares_caps_and_shards(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        s = rng.choice(["a", "b", "c", None, "B", "é", "tiny"]) if i else "tiny"
        s = "a" if s == "tiny" and i else s
        rows.append((i, s, " ".join("w" * rng.randrange(0, 400)) if s != "é" else "", None))
    rows += [(5, rows[5][1], rows[5][2], None), (None, "b", "x y", None), (401, "b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    plan = M.mix(docs, block_words=50, shards=7, buckets=16)
    got = plan.select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "copies").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes, (1, 2, 3), 3.0)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.shard < 7 for c in r.copies)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    # every shard gets each source's share of blocks, as far as a random deal does
    words = Counter((c.shard, r.source) for r in got for c in r.copies for _ in range(c.words))
    assert len({k for k, _ in words}) == 7
    again = M.mix(docs.repartition(3), block_words=50, shards=7, buckets=16).select("row.doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in plan.select("row.doc_id", "size", "taken").collect())
    assert M.mix(docs.limit(0)).count() == 0


def test_permutation_is_a_bijection_and_no_identity(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 6, 7, 64, 333, 5000):
        rows = spark.range(n).select("id", *[M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(s)).alias(f"p{s}") for s in (1, 2)]).orderBy("id").collect()
        for p in ("p1", "p2"):
            assert sorted(r[p] for r in rows) == list(range(n))
        if n >= 64:
            assert sum(r.p1 == r.id for r in rows) < 10 and sum(r.p1 == r.p2 for r in rows) < 10
            assert sum(abs(a.p1 - b.p1) <= 2 for a, b in zip(rows, rows[1:])) < n / 10


def test_a_shard_of_many_words_is_written_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "w " * 50) for i in range(300)], "doc_id long, source string, text string")
    monkeypatch.setattr(M, "PART_WORDS", 500)
    out = M.mixed(docs, shards=4)
    assert out.rdd.getNumPartitions() == 4 * -(-15000 // 2000)
    places = out.rdd.glom().map(lambda rows: [(r.mix_shard, r.mix_place) for r in rows]).collect()
    assert [x for part in places for x in part] == sorted(x for part in places for x in part)


def test_hypergeometric_draws_follow_the_distribution(spark):
    from math import comb

    from pyspark.sql import functions as F

    n, k, d, rows = 60, 25, 18, 20000
    x = spark.range(rows).select(M.hypergeometric(F.lit(n), F.lit(k), F.lit(d), (F.col("id") + 0.5) / rows).alias("x")).groupBy("x").count().collect()
    seen = {r["x"]: r["count"] / rows for r in x}
    for i in range(0, 19):
        p = comb(k, i) * comb(n - k, d - i) / comb(n, d)
        assert abs(seen.get(i, 0) - p) < 2e-4
