import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa

from chronoloom.llm import audit as A


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)


def texts(rng):
    out = ["", " ", "a", "Ä 漢 \U0001f600 b", "#", "\n\nA B\tA", None, "word " * 30_000, "x" * 3_000_000, " lead and trail "]
    for _ in range(150):
        pool = [rng.choice("abcXYZé漢") * rng.randrange(1, 4) + str(rng.randrange(40)) for _ in range(rng.choice([5, 60, 400]))]
        out.append(rng.choice(["", " "]) + rng.choice([" ", "\n", " \t"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 240))) + rng.choice(["", " ", " &", " |x"]))
    return out


def test_scan_counts_what_plain_code_counts():
    rows = texts(random.Random(1))
    for array in (pa.array(rows), pa.array(rows, pa.large_string()), pa.array(rows).slice(3, 40), pa.array([], pa.string()), pa.array(["", None])):
        s = A.scan(array)
        assert list(zip(*(s[k].tolist() for k in ("words", "distinct", "capitals", "symbols", "chars")), strict=True)) == [plain(t or "") for t in array.to_pylist()]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(A, "_mixed", lambda x: x % np.uint64(3))
    rows = [t for t in texts(random.Random(2)) if len(t or "") < 10_000]
    assert A.scan(pa.array(rows))["distinct"].tolist() == [plain(t or "")[1] for t in rows]


def test_long_texts_are_slices_of_their_own():
    batch = pa.record_batch([pa.array(["a" * (3 << 20), "b", "", "c" * (1 << 20), "d" * (1 << 20), "e"])], names=["text"])
    assert [p.num_rows for p in A.by_bytes(batch, 0)] == [1, 3, 2]


def test_interactions_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = texts(rng)
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(base)]
    rows += [(1000 + i, rng.choice(base[10:40]), "en") for i in range(60)] + [(rng.randrange(160), base[20], "de"), rows[30], rows[30], (None, base[20], "en"), (None, "own", "en"), (None, "own", "en")]
    labels = [(rng.randrange(1200), rng.randrange(2), rng.randrange(2)) for _ in range(400)] + [(3, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, mask int, good long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    kinds = Counter()
    for d, t, lang in rows:
        n, u, c, s, k = plain(t or "")
        fails = frozenset(x for x, bad in zip("ABCDE", (n < 100, 100 * u < 80 * n, 100 * c > 10 * k, s > 0, d is not None and d > first[t or ""]), strict=True) if bad)
        kinds[lang or "", fails, d is not None and d in good, d is not None and d in toxic] += 1
    want, share = [], Counter()
    for part in {k[0] for k in kinds}:
        own = [(f, g, t, n) for (p, f, g, t), n in kinds.items() if p == part]
        for order in map("".join, permutations("ABCDE")):
            for i, x in enumerate(order):
                here = [(f, g, t, n) for f, g, t, n in own if x in f and not f & set(order[:i])]
                share[part, x] += sum(n for *_, n in here)
                want.append([part, order, i + 1, sum(n for f, *_, n in own if not f & set(order[: i + 1])), sum(n for *_, n in here), sum(n for f, *_, n in own if x in f and f & set(order[:i])), sum(n for f, *_, n in own if f == {x}), sum(n for _, g, _, n in here if g), sum(n for _, _, t, n in here if t), x])
    want = [(*w[:-1], share[w[0], w[-1]]) for w in want]
    got = A.op13_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert A.interactions(docs.limit(0), spark.read.parquet(f"{tmp_path}/labels.parquet")).count() == 0
