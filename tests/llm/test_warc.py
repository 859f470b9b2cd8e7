import gzip
import hashlib
from urllib.parse import urlparse

from chronoloom.llm import warc as A


def test_round_trip(spark, tmp_path):
    long = "é" * 150_000
    rows = [(5, "http://a/5", "x" * 100, "k"), (3, "http://a/3", "x" * 100, "k"), (3, "http://a/3", "x" * 100, "k"), (None, "http://a/n", "x" * 100, "k"), (1, "http://a/1", "y" * 99, "k"), (2, "http://a/2", "y" * 99, "k"), (7, None, None, "k"), (8, "a b\r\n", "", "k"), (9, "http://a/9", long, "k"), (10, "http://a/10", long + "z", "k"), (11, "http://a/11", long, "k")]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in A.op5_warc(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, (page, _, html, _) in enumerate(rows):
        raw = (html or "").encode()
        kind, to = "response", None
        if html == "x" * 100 and i != 1:
            kind, to = "revisit", 3
        if page == 11:
            kind, to = "revisit", 9
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), kind, to))
    assert got == sorted(want, key=str)


def test_chunks_and_archives(spark):
    rows = [(1, "http://a/1", "".join(chr(97 + i * 7 % 26) for i in range(300_000))), (2, "http://a/2", "")]
    index = A.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    chunks = A.read(index).where("page_id = 1").orderBy("chunk_no").collect()
    assert b"".join(c.payload for c in chunks).decode() == rows[0][2] and len(chunks) > 3
    done = hashlib.sha256()
    for c in chunks:
        done.update(c.payload)
        assert c.payload_digest == done.hexdigest()
    path = index.where("page_id = 1").first().archive
    with gzip.open(urlparse(path).path) as f:
        assert f.read(10) == b"WARC/1.1\r\n"
    empty = A.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert A.read(empty).count() == 0
