import hashlib
import random
import re
import time

from chronoloom.llm import decontamination as D
from chronoloom.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    rng = random.Random(3)
    bits = ["a.b", "@", "mail", ".com", "-", ".", "12", "4111111111111111", "255", "256", "0", " ", "\n", "+", "(", ")", "é", "😀", "_", "%", "x@y.zz", "1.2.3.4", "+1 (555) 123-4567", "007", "5500-0000 0000 0004", ","]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 40))) for _ in range(1500)]
    texts += ["", None, "7" * 3000, "1 " * 3000, "a" * 5000, "a.b@c." * 2000, "@" + "a.a" * 3000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "x@y.de", "k"), (3, texts[3], "k")], "doc_id long, text string, base string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op2_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = plain(texts[r.doc_id] or "") if r.doc_id is not None else ["email:0:6"]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(","))
        assert r.n_email == sum(w.startswith("email") for w in want)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"word contact: u{i}@mail.example.com end") for i in range(12)] + [(50, "so contact: joe@localhost1234 or call 123456789 now"), (51, "contact: joe@localhost1234")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == [("email", 12, 29)]
    assert got[51] == [("email", 9, 26)]
    assert got[3] == [("email", 14, 33)]


def test_recall_of_identifiers_that_base_misses(spark):
    """Contexts of one to three words on either side; a third of the identifiers are beyond the base patterns."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    noise = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.randrange(3, 12)))
    frames = {"email": ["write to {} soon", "my mail address {}", "{} is my mailbox"], "phone": ["call me at {} today", "phone number {}", "{} after six"], "card": ["charged card {} twice", "card ending {}"]}
    # (what base finds, what it misses: no top-level name, no plus sign, stops between the digits)
    card = lambda: next(c for c in ("4" + digits(15) for _ in range(1000)) if luhn(c))
    makes = {
        "email": (lambda: f"n{digits(6)}@mail.example.com", lambda: f"n{digits(6)}@intranet"),
        "phone": (lambda: "+49" + digits(9), lambda: "0049" + digits(9)),
        "card": (lambda: card(), lambda: ".".join(re.findall("....", card()))),
    }
    rows, hidden = [], {}
    for i in range(600):
        kind = rng.choice(list(frames))
        base = i % 3 > 0
        entity = makes[kind][1 - base]()
        left, right = noise(), noise()
        text = f"{left} {rng.choice(frames[kind]).format(entity)} {right}"
        if not base:
            hidden[i] = (kind, text.index(entity), text.index(entity) + len(entity))
        rows.append((i, text))
    rows += [(1000 + i, f"{noise()} order {digits(8)} {noise()} weighs {digits(7)} {noise()}") for i in range(300)]  # numbers of no kind
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(span in found[i] for i, span in hidden.items())
    wrong = sum(len(found[i]) for i in range(1000, 1300)) + sum(len(found[i]) > 1 for i in range(600))
    assert caught >= 0.9 * len(hidden) > 150, (caught, len(hidden))
    assert wrong <= 0.01 * len(rows), wrong


def test_texts_of_very_many_matches(spark):
    """50,000 instances, half of them base spans, in one text; quadratic code would take an hour."""
    rng = random.Random(6)
    words = ["".join(rng.choices("0123456789", k=7)) if i % 2 else rng.choice(("a@b.cd", "1.2.3.4", "4111111111111111", "+4912345678")) for i in range(50_000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, "+" + " 1" * 40_000)], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in P.extract(docs).collect()}
    assert time.time() - began < 60
    assert [f"{s.kind}:{s.start}:{s.end}" for s in rows[1].base] == plain(text)
    known = [i for i in rows[1].seen if i.known]
    assert len(rows[1].seen) == 50_000 and len(known) > 10_000 and all(i.known.start < i.start + len(i.found) and i.known.end > i.start for i in known)
    assert len(rows[2].seen) == 40_000


def test_instances_know_the_first_base_span_they_overlap(spark):
    rng = random.Random(7)
    bits = ["4111111111111111", "+4111111111111111", "1.2.3.4", "x@y.zz", "5500-0000 0000 0004", "77", "+1 (555) 123-4567", " ", ",", "é", "word"]
    docs = spark.createDataFrame([(i, "".join(rng.choices(bits, k=rng.randrange(1, 25)))) for i in range(300)], "doc_id long, text string")
    some = 0
    for r in P.extract(docs).collect():
        for i in r.seen:
            want = next((s for s in r.base if s.start < i.start + len(i.found) and s.end > i.start), None)
            assert i.known == want
            some += want is not None
    assert some > 300


def test_neighbours_are_whole_words(spark):
    long = "x" * 100
    docs = spark.createDataFrame([(1, f"far {long} near one 1234567 two {long} off"), (2, f"{long} 1234567 {'y' * 200}")], "doc_id long, text string")
    got = {r.doc_id: r.seen[0] for r in P.extract(docs).collect()}
    assert (got[1].left, got[1].right) == (["near", "one"], ["two"]) and (got[2].left, got[2].right) == ([], [])


def test_a_card_is_discovered_only_with_a_right_check_digit(spark):
    rows = [(i, f"charged card {c} twice") for i, c in enumerate(("4111111111111111", "5500000000000004", "4012888888881881", "4222222222222", "378282246310005", "6011111111111117"))]
    rows += [(50, "charged card 4111.1111.1111.1111 twice"), (51, "charged card 4111.1111.1111.1112 twice")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == ["card"] and got[51] == []


def test_overlaps_tolerate_substitutions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [[word() for _ in range(n)] for n in (20, 40, 9, 5)]
    docs, want = [], set()
    for i in range(60):
        text = [word() for _ in range(50)]
        k = i % 4
        if i % 3 == 0:
            piece = items[k][:]
            if k < 2:
                for j in rng.sample(range(0, len(piece), 7), 2):
                    piece[j] = word()
            text[20:20] = piece
            want.add((i, k))
        if i % 3 == 1:
            text[5:5] = items[k][:6]  # too little, but for the item of five words
            if k == 3:
                want.add((i, k))
        docs.append((i, " ".join(w.upper() + ("," if rng.random() < 0.2 else "") for w in text), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, " ".join(items[0]), "x"), (0, docs[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None), (0, " ".join(items[0]))], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in D.overlaps(d, b).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want | {(None, 0)}
    clean = D.without_contaminated(d, b)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in docs} - {x[0] for x in got}
    assert D.overlaps(d.limit(0), b).count() == 0
    assert D.overlaps(d, b.limit(0)).count() == 0


def brute_overlaps(docs, items):
    """(document, item, words that agree) by laying every item on every place of every text."""
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = words(text)
        for k, item in items:
            b = words(item)
            size = min(13, len(b))
            for shift in range(-len(b) + 1, len(w)) if b else ():
                same = [0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(b)]
                if max(sum(same[i : i + size]) for i in range(len(b) - size + 1)) >= size - size * 2 // 13:
                    out[d, k] = max(out.get((d, k), 0), sum(same))
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(21)
    word = lambda n=40: f"w{rng.randrange(n)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 21)] + [(90, "same " * 9), (91, "..."), (92, None), (93, "only"), (94, "ein Zwei, DREI")]
    docs = []
    for i in range(160):
        text = [word(400) for _ in range(60)]
        for _ in range(2):
            piece = items[rng.randrange(20)][1].split()
            for _ in range(rng.randrange(0, 4)):
                piece[rng.randrange(len(piece))] = word(400)
            text[rng.randrange(len(text)) :][:0] = piece
            at = rng.randrange(len(text) + 1)
            text[at:at] = piece[rng.randrange(3) if rng.random() < 0.2 else 0 :]
        docs.append((i, " ".join(text)))
    docs += [(200, "same " * 3000), (201, "x eins ein zwei drei only"), (202, "same " * 8), (203, ""), (204, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched_words for r in D.overlaps(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_overlaps(docs, items)


def test_the_way_without_broadcasts_gives_the_same(spark, monkeypatch):
    for hashes in (8_000_000, 0):
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(D, "BROADCAST_HASHES", hashes)
        test_overlaps_tolerate_substitutions(spark)
