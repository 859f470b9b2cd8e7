"""WARC archives written and read by Spark tasks, with a table of chunks in between.

Writing: pages with equal payloads (of some size) become one response record and revisit records that refer to it. Each
task streams its records into a gzip archive, a member per record as the format wants, in the shared folder; the rows
it returns are the index (archive, place, length, record). The index is a table of its own: archives of attempts that
did not finish are in no index row and are never read.

Pages are known by their content: the record that others refer to has an identifier made from its payload's digest, so
no numbers are handed from one scan to another.

Reading: tasks take stretches of the archives at record boundaries and decompress them piece by piece. A payload comes
out as rows of record identifier and chunk number, each with the SHA-256 of all bytes so far, so no task ever holds
more than a chunk of it; the row of the last chunk carries the digest of the whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import shared_dir, slices, written

#: Fixed value: payloads below this many bytes are never revisits.
LEAST_BYTES = 100
CHUNK = 1 << 16
ROLL = 256 << 20
STRETCH = 16 << 20
#: Payloads that occur several times are broadcast (digest and url) up to so many and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("b5f0cc7e-6f0e-5a39-9d0f-0e6d3c1b7a52")
_INDEX = "archive string, place long, length long, record_id string, page_id long, record_type string"
_CHUNKS = "record_id string, page_id long, record_type string, refers_to_record string, refers_to long, chunk_no int, payload binary, payload_bytes long, payload_digest string, last boolean"


def record_id(name: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, name)}"


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines]) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def _info(path: str, date: str) -> bytes:
    """The record at the head of an archive, a gzip member of its own."""
    fields = b"software: chronoloom\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(path)}>"), ("WARC-Date", date), ("WARC-Filename", path.rsplit("/", 1)[-1]), ("Content-Type", "application/warc-fields"), ("Content-Length", len(fields))]
    z = zlib.compressobj(1, wbits=31)
    return z.compress(_head(head) + fields + b"\r\n\r\n") + z.flush()


def _record(row: dict, own_id: str, date: str) -> Iterator[memoryview | bytes]:
    """The bytes of a record, payload by chunks."""
    response = row["record_type"] == "response"
    payload = memoryview((row["html"] or b"") if response else b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]) if row["url"] else None
    yield _head(
        [
            ("WARC-Type", row["record_type"]),
            ("WARC-Record-ID", f"<{own_id}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
            ("WARC-Profile", None if response else PROFILE),
            ("WARC-Refers-To", None if response else f"<{record_id(row['digest'])}>"),
            ("X-Page-Id", row["page_id"]),
            ("X-Refers-To-Page-Id", None if response else row["first_page"]),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(http) + len(payload)),
        ]
    )
    yield http
    for i in range(0, len(payload), CHUNK):
        yield payload[i : i + CHUNK]
    yield b"\r\n\r\n"


def _columns(names_types: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in names_types.split(", "))])


def _kinds(rows: DataFrame) -> DataFrame:
    """Adds record_type and first_page; ``html`` stays with responses. Input: page_id, url, html (binary), digest, payload_bytes.

    Rows that are equal in page_id, url and payload cannot be told apart. Where they are the first of their payload,
    one goes on as the response and the others are made again from their number.
    """
    same = ["digest", "page_id", "url"]
    kinds = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy(*same).agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url", "n")
    first = kinds.groupBy("digest").agg(F.min(order).alias("k"), F.sum("n").alias("copies")).where("copies > 1")
    first = written(first.select(F.col("digest").alias("d"), F.col("k.page_id").alias("first_page"), F.col("k.url").alias("first_url"), F.col("k.n").alias("alike")), "first")
    count = first.agg(F.count("*"), F.count_if(F.col("alike") > 1)).first()
    known = F.broadcast(first) if count[0] <= BROADCAST_ROWS else first
    is_first = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    joined = rows.join(known, (rows["digest"] == first["d"]) & (rows["payload_bytes"] >= LEAST_BYTES), "left").withColumn("is_first", F.col("d").isNotNull() & is_first)
    revisit = F.col("d").isNotNull() & ~F.col("is_first")
    cols = ["page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "payload_bytes", "first_page", F.when(revisit, "revisit").otherwise("response").alias("record_type"), (F.col("d").isNotNull()).alias("shared")]
    if not count[1]:
        return joined.select(cols)
    alike = joined.where("is_first and alike > 1").groupBy(*same, "payload_bytes", "first_page", "alike").agg(F.first("html").alias("html"))
    alike = alike.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    again = F.col("i") > 1
    more = alike.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "digest", "payload_bytes", "first_page", F.when(again, "revisit").otherwise("response").alias("record_type"), F.lit(True).alias("shared"))
    return joined.where("not (is_first and alike > 1)").select(cols).union(more)


def write(pages: DataFrame, name: str = "warc", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives to the shared folder and returns their index. Input: page_id, url, html; other columns are ignored.

    A null html is the empty payload. Of equal payloads of at least 100 bytes the one with the smallest page_id (null
    last, then the least url) is the response and all others, repeated rows too, revisit it. An empty table writes no
    archive. ``date`` is when the pages were fetched, which the table does not say; with a fixed one, reruns agree.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, name)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    joined = _kinds(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, path, place, n = None, "", 0, 0
        for batch in slices(batches):
            index: list[tuple] = []
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                if out is None:
                    path, n = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", n + 1
                    out = files.open_output_stream(path, compression=None)
                    place = out.write(_info(path, date))
                response = row["record_type"] == "response"
                own_id = record_id(row["digest"] if row["shared"] and response else f"{path}/{place}")
                z = zlib.compressobj(1, wbits=31)
                length = 0
                for piece in _record(row, own_id, date):
                    length += out.write(c) if (c := z.compress(piece)) else 0
                length += out.write(z.flush())
                index.append((path, place, length, own_id, row["page_id"], row["record_type"]))
                place += length
                if place >= ROLL:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True) if index else [[]] * 6, _columns(_INDEX), strict=True)], schema=_columns(_INDEX))
        if out is not None:
            out.close()

    return written(joined.mapInArrow(run, _INDEX), f"{name}-index")


class _Member:
    """Reads one gzip member of an open archive as a stream."""

    def __init__(self, file, at: int) -> None:
        self.z, self.file, self.at, self.held, self.raw = zlib.decompressobj(31), file, at, b"", b""

    def read(self, most: int) -> bytes:
        """Some bytes, at most so many; none at the end."""
        if self.held:
            out, self.held = self.held[:most], self.held[most:]
            return out
        while not self.z.eof:
            out = self.z.decompress(self.raw, most)  # may still hold output of what it was given before
            self.raw = self.z.unconsumed_tail
            if out:
                return out
            if not self.raw and not self.z.eof:
                self.file.seek(self.at)
                self.raw = self.file.read(CHUNK)
                self.at += len(self.raw)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
        return b""

    def head(self) -> dict[str, str]:
        got = b""
        while b"\r\n\r\n" not in got:
            more = self.read(CHUNK)
            if not more:
                raise ValueError("no end of a header")
            got += more
        got, _, self.held = got.partition(b"\r\n\r\n")
        first, *lines = got.decode("utf-8", "surrogatepass").split("\r\n")
        return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _chunks(file, place: int, keep: bool) -> Iterator[tuple]:
    """The chunk rows of the record at ``place``; checks its length and, of a response, its digest."""
    m = _Member(file, place)
    head = m.head()
    http = m.head()
    size, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    number = lambda k: int(head[k]) if k in head else None
    key = (head["warc-record-id"].strip("<>"), number("x-page-id"), head["warc-type"], head.get("warc-refers-to", "").strip("<>") or None, number("x-refers-to-page-id"))
    if head["warc-type"] == "revisit":
        yield (*key, 0, None, size, digest, True)
        return
    sha, done, no = hashlib.sha256(), 0, 0
    while True:
        chunk = m.read(min(CHUNK, size - done)) if done < size else b""
        if done < size and not chunk:
            raise ValueError(f"{key[0]} is cut short")
        sha.update(chunk)
        done += len(chunk)
        last = done == size
        so_far = sha.hexdigest()
        if last and so_far != digest:
            raise ValueError(f"{key[0]} has another digest than its header says")
        yield (*key, no, chunk if keep else None, done, so_far, last)
        no += 1
        if last:
            return


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The chunk table of the archives in ``index``: a row per record and chunk (a revisit has one, without payload)."""
    # as many tasks as there are bytes to read: the index itself is small and would be read by one
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = index.select("archive", "place", F.floor(F.col("place") / STRETCH).alias("part")).repartition(max(1, -(-size // STRETCH)), "archive", "part")
    stretch = dealt.groupBy("archive", "part").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                with pafs.FileSystem.from_uri(root)[0].open_input_file(path) as file:
                    for place in places:
                        for row in _chunks(file, place, payload):
                            rows.append(row)
                            held += len(row[6] or b"") + 200
                            if held > 4 << 20:
                                yield _batch(rows)
                                rows, held = [], 0
                if rows:
                    yield _batch(rows)

    root = index.sparkSession.conf.get("spark.checkpoint.dir")
    return stretch.select("archive", "places").mapInArrow(run, _CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _columns(_CHUNKS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back: what its record says."""
    chunks = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")), payload=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
