import random

from chronoloom.llm import neardup as N


def words_set(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [words_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(rows))], [len(s) for s in sets]


def test_links_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("XYZÄé漢")
    bases = [[word() for _ in range(n)] for n in (60, 200, 30, 8)]
    texts = []
    for i in range(260):
        w = bases[0 if i % 2 else i % 4][:]
        for _ in range(rng.randrange(0, max(2, len(w) // 22))):
            w[rng.randrange(len(w))] = word() + str(rng.random())
        texts.append(" \t".join(w))
    texts += ["a b c", "A\nb  c", "a b", "", None, " \n ", "one two three four five", "x " * 5000, "x " * 6000, texts[7]]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5, "only null"), (None, "only null"), (None, "alone"), (None, "")]
    rows.append(rows[3])
    want, sizes = brute(rows)
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, component_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = N.op7_neardup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == sorted(((d, n, c, d == c) for (d, _), n, c in zip(rows, sizes, want, strict=True)), key=str)
    kept = N.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == docs.columns
    groups = len({(w, n) if w is None else w for w, n in zip(want, sizes, strict=True) if n}) + sum(n == 0 for n in sizes)
    assert kept.count() == groups
    assert N.link(docs.limit(0)).count() == 0


def test_rows_keep_their_numbers_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    texts = [f"only {i} here in this text number {i}" for i in range(40)] + ["one two three four five six"] * 9
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, extra string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = iter(["100", "1000000"] * 500)
    write = N.written

    def other_splits(df, name):
        out = write(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    monkeypatch.setattr(N, "written", other_splits)
    try:
        kept = N.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.doc_id for r in kept) == list(range(41))


def test_templated_documents_do_not_all_visit_each_other(spark, monkeypatch):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(60)]
    texts = [" ".join(template + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(500)]  # about a third alike
    close = [f"c{i}" for i in range(24)]
    texts += [" ".join(template + close + [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(8, 16))]) for _ in range(90)]  # around the bound
    texts += [t + " one more" for t in texts[:60]]
    rows = list(enumerate(texts))
    want, sizes = brute(rows)
    settle = N._settle

    def bounded(group):
        assert group.visitor.sum() <= 300, "a block is visited by the whole group"
        return settle(group)

    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "_settle", bounded)
    got = N.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(d, n, c) for (d, _), n, c in zip(rows, sizes, want, strict=True)]


def judged_by_files(spark, monkeypatch, make):
    """What ``make`` gives of a small corpus, the components wanted, and the tables whose joins Spark would broadcast by the size of files."""
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(12)]
    rows = [(i, " ".join([*bases[i % 12], *(f"x{i}" for _ in range(i % 4))])) for i in range(600)] + [(600 + i, f"only {i} of its kind here {i}") for i in range(300)]
    want, _ = brute(rows)
    plans, write = [], N.written

    def kept_plan(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(N, "written", kept_plan)
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "BROADCAST_ROWS", -100)
    monkeypatch.setattr("chronoloom.llm.common.FEW_ROWS", -1, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300k")
    try:
        out = make(spark.createDataFrame(rows, "doc_id long, text string"))
        plans.append(("result", out._jdf.queryExecution().sparkPlan().toString()))
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return got, {d: c for (d, _), c in zip(rows, want, strict=True)}, [name for name, plan in plans if "Broadcast" in plan]


def test_tables_are_broadcast_by_their_rows_not_by_their_files(spark, monkeypatch):
    got, want, broadcast = judged_by_files(spark, monkeypatch, N.link)
    assert {r.doc_id: r.component_id for r in got} == want
    assert broadcast == []


def test_rows_that_stay_are_found_without_broadcasts_by_file_size(spark, monkeypatch):
    got, want, broadcast = judged_by_files(spark, monkeypatch, N.keep_one)
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))
    assert broadcast == []
