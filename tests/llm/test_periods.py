import hashlib
import random
import zlib

from chronoloom.llm import periods as P


def brute(w, min_length=24, min_exponent=3):
    """Every period by itself; a stretch counts under its smallest period."""
    out = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s = w[i : j + p]
            if j > i and len(s) >= max(min_length, min_exponent * p) and not any(s[q:] == s[:-q] for q in range(1, p)):
                out.add((i, len(s), p))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(rng):
    for _ in range(400):
        n, k = rng.randrange(1, 90), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        p, a = rng.randrange(1, 9), rng.randrange(n)
        for i in range(a + p, n):
            if rng.random() < rng.choice([0, 0.9, 1]):
                w[i] = w[i - p]
        yield w


def test_runs_equal_brute_force():
    for w in sequences(random.Random(1)):
        assert P.lyndon(w)[0] == [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) for i in range(len(w))]
        for length, exponent in ((24, 3), (2, 2), (5, 3), (2, 4)):
            assert P.runs(w, length, exponent) == brute(w, length, exponent), w


def test_no_word_is_matched_twice():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    nested = [0]
    for _ in range(8):
        nested = nested * 3 + [len(nested)]
    rng = random.Random(2)
    for w in (b, [1] * 20_000, nested, [i.bit_count() % 2 for i in range(20_000)], b[:300] * 60, [rng.randrange(2) for _ in range(20_000)]):
        for order in (w, [-x for x in w], w[::-1]):
            seen = []
            P.lyndon(order, seen)
            assert seen[0] <= len(w)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 200))) for _ in range(120)]
    texts += ["x " * 30, "\t a b  c\n" * 12, "one  two\x0b", "", None, "ä b " * 40 + "c", "deep " * 3000 + "end", " ".join(f"w{i % 700}" for i in range(20_000))]
    rows = [(i * 13, t, "k") for i, t in enumerate(texts)] + [(None, "z y " * 20, "k"), (None, None, "k"), (13, texts[1], "k"), (26, "again " * 40, "k"), (-7, "m n o " * 20, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t, _ in rows:
        s = t or ""
        for c in "\t\n\v\f\r":
            s = s.replace(c, " ")
        w = [x for x in s.split(" ") if x]
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = brute(w) if len(w) < 1000 else P.runs(w)
        gone = {i for a, n, p in found for i in range(a + p, a + n)}
        best = None
        for r in found:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in ("".join(f"{a},{n},{p}\n" for a, n, p in found), text)]
        want.append((d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
    assert sum(x[1] > 0 for x in want) >= 10 and any(zlib.crc32(str(d).encode()) % 10 == 0 for d, t, _ in rows if d is not None and t)
    got = P.op12_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert P.find(docs.limit(0)).count() == 0
    one = {r.doc_id: r for r in P.find(docs).collect() if r.doc_id is not None}
    assert one[13 * 120].collapsed == "x" and one[13 * 120].runs == [(0, 30, 1)] and one[13 * 123].n_words == 0
