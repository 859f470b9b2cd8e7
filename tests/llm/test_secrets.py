import hashlib
import random
import re

from chronoloom.llm import secrets as S

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(S.BASE[k], s, e) for s, k, e in sorted(out)]


def test_scan_equals_separate_patterns():
    rng = random.Random(5)
    bits = ["token", "secret", "Api_Key", "APIKEY", "password", "passwd", "=", ":", " ", "  ", "'", '"', "abc", "é", "漢", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", ".", "/", "\n", "x", "-", "ΑΚΙΑ", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 90))) for _ in range(3000)] + ["", "a" * 9000, "f" * 5000 + "AKIA" * 3000, "token=" + "q" * 9000]
    found = dict(S.Scanner().scan([t.encode() for t in texts]))
    for i, t in enumerate(texts):
        assert [x for x in found.get(i, []) if x[0] in S.BASE] == plain(t), t[:200]


def test_added_kinds_and_order():
    text = "é ghp_" + "a1B2" * 9 + " xoxb-123456789012-abcdefghij -----BEGIN RSA PRIVATE KEY-----"
    kinds = [k for k, _, _ in dict(S.Scanner().scan([text.encode()]))[0]]
    assert kinds == ["github", "slack", "pem"]


def test_query_and_edge_cases(spark, tmp_path):
    rows = [(1, "token = 'abcdef' x", "en", None, 5), (2, None, None, "s", None), (3, "", None, "s", 0), (1, "token = 'abcdef' x", "en", None, 5), (None, "AKIA" + "B" * 16, "xx", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(S.op8_secrets(spark, str(tmp_path)).collect(), key=str)
    assert len(got) == 5
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_assign, one.spans) == (1, "assign:0:15")
    assert one.base_sha256 == hashlib.sha256(b"assign:0:15").hexdigest()
    assert next(r for r in got if r.doc_id is None).n_access == 1
    assert next(r for r in got if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    cleaned = {(r.doc_id, r.text, r.n_chars) for r in S.redact(docs).collect()}
    assert cleaned == {(1, "[SECRET]' x", 11), (2, None, None), (3, "", 0), (None, "[SECRET]", 8)}
    assert S.find(docs.limit(0)).count() == 0
