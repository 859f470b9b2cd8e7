import random

import numpy as np
import pytest

from chronoloom.llm import jaccard_join as J


def words_set(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [words_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(rng):
    word = lambda: rng.choice("abcdefgh") + rng.choice("XYZÄé漢") + str(rng.randrange(30))
    bases = [[word() for _ in range(n)] for n in (9, 13, 20, 40, 90, 200, 500)]
    texts = []
    for i in range(420):
        w = bases[i % 7][:]
        for _ in range(rng.randrange(0, max(2, len(w) // 20))):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [word() + str(rng.random())] * rng.randrange(2)
        texts.append(" \t".join(w) + rng.choice(["", " " + word()]))
    texts += ["a b c", "A\nb  c", "a b", "", None, " \n ", "one two three four", "x " * 5000, "x " * 6000, texts[7], "y " * 200_000]
    return texts


@pytest.mark.parametrize("short", [64, 3, 1])
def test_links_equal_brute_force(spark, tmp_path, monkeypatch, short):
    monkeypatch.setattr(J, "SHORT_LIST", short)
    monkeypatch.setattr(J, "BLOCK", 16 * short)
    texts = corpus(random.Random(short))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5, "only null"), (None, "only null"), (None, "alone"), (None, "")]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, component_id int, cls string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = J.op11_jaccard(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
    assert J.link(docs.limit(0)).count() == 0


def test_similar_sets_share_a_posting():
    """Every pair at the bound of similarity meets in a list, also without as many segments as the slack tells."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 83, 84, 85, 200, 343, 346, 900, 3000]:
        for _ in range(6):
            common = -(-J.PERCENT * n // (100 if rng.random() < 0.5 else 92))
            total = int(min(rng.integers(n, 2 * n), max(n, common * 100 // J.PERCENT)))  # size of the union
            s = rng.integers(0, 2**64, total, dtype=np.uint64)
            cut = int(rng.integers(common, total + 1)) if common <= total else total
            a, b = np.unique(s[:cut]), np.unique(np.concatenate((s[: min(common, total)], s[cut:])))
            if not J.similar(a, b, J.PERCENT) or len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            assert J.near(J.sketch(a), J.sketch(b), len(a), len(b)) and J.near(J.wide(a), J.wide(b), len(a), len(b))
            (fa, da), (fb, db) = J.postings(a), J.postings(b)
            shared = {*fa} & {*fb} | {*fa} & {*db} | {*da} & {*fb}
            assert shared, (len(a), len(b))
            for band in {int(k) & 63 for k in shared}:
                m, u, slack = J.allocation(band)
                least = -(-(m + u - J.differing(len(a) + len(a) * 100 // J.PERCENT)) // (2 if u else 1))
                assert sum(int(k) & 63 == band for k in shared) >= least
                assert (m + u) - J.differing(2 * (J.BORDERS[band + 1] - 1)) > slack


def test_lists_are_read_across_batches():
    import pyarrow as pa

    rng = random.Random(6)
    full = -(2**63)
    posts = sorted({(rng.randrange(30), rng.randrange(40) | (full if rng.random() < 0.3 else 0)) for _ in range(400)} | {(99, i) for i in range(9)})
    posts += posts[-1:]
    want = []
    for key in sorted({k for k, _ in posts}):
        own = sorted({c for k, c in posts if k == key})
        want += [(key, own[0] ^ full if own[0] < 0 else None, c & ~full, c < 0, i) for i, c in enumerate(own) if i and own[0] < 0]
    for step in (1, 2, 7, 1000):
        batches = [pa.record_batch([pa.array([k for k, _ in posts[i : i + step]]), pa.array([c for _, c in posts[i : i + step]])], names=["k", "c"]) for i in range(0, len(posts), step)]
        got = [tuple(r.values()) for b in J._lists(iter(batches)) for r in b.to_pylist()]
        assert got == [(k, f & (2**63 - 1), c, x, i) for k, f, c, x, i in want]
