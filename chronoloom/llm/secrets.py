"""Secret scans with one deterministic automaton for all rules.

The rules are compiled together, by subset construction and minimisation, into one transition array over bytes. A
batch of texts is joined by a byte that UTF-8 never has (it leads back to the start state), cut into equal lanes, and
all lanes step through the array side by side: one pass over the bytes, whatever the number of rules. A lane that
began in the middle of something is then run on from the state its predecessor ended in until both agree.

The pass marks where matches of each rule may end. Only around these marks a backwards automaton finds the leftmost
start and a forwards one the longest end; per rule, matches are taken from left to right without overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoloom.llm.automaton import Automaton, compile_rules
from chronoloom.llm.common import slices

#: Rule, pattern (letters of the keywords in either case), and least length of a match.
KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
RULES: dict[str, tuple[str, int]] = {
    "assign": (KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 0),
    "access": ("AKIA[A-Z0-9]+", 20),
    "hex": ("[0-9a-f]{24,}", 24),
    "github": ("gh[opsu]_[A-Za-z0-9]+", 40),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", 20),
    "google": ("AIza[A-Za-z0-9_-]+", 39),
    "jwt": ("eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
}
KINDS = list(RULES)
BASE = KINDS[:3]
_VALUE = re.compile(rb"[^:=]*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_RESET = 0xFF
_LANE = 2048
_AT_ONCE = 8 << 20

Span = tuple[str, int, int]


class Scanner:
    """Holds the three automata; made once on the driver and sent to the tasks as arrays."""

    def __init__(self) -> None:
        patterns = [p for p, _ in RULES.values()]
        self.search = compile_rules(patterns, search=True, reset=_RESET)
        self.forwards = compile_rules(patterns, search=False)
        self.backwards = compile_rules(patterns, search=False, backwards=True)

    def marks(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bytes that may end a match, ascending, and the rules' bits there."""
        a = self.search
        lanes = -(-len(data) // _LANE)
        cls = np.full(lanes * _LANE, a.classes_of[_RESET], dtype=np.uint8)
        cls[: len(data)] = a.classes_of.astype(np.uint8)[data]
        by_step = np.ascontiguousarray(cls.reshape(lanes, _LANE).T)
        step, accepting = (a.step * a.classes).astype(np.int32), np.repeat(a.accepts != 0, a.classes)
        state = np.zeros(lanes, dtype=np.int32)
        places: list[np.ndarray] = []
        bits: list[np.ndarray] = []

        def note(lane: np.ndarray, i: int, at: np.ndarray) -> None:
            places.append(lane * _LANE + i)
            bits.append(a.accepts[at // a.classes])

        for i in range(_LANE):
            state = step[state + by_step[i]]
            hit = accepting[state]
            if hit.any():
                lane = np.flatnonzero(hit)
                note(lane, i, state[lane])
        # lanes that do not begin in the start state
        lane = np.flatnonzero(state[:-1]) + 1
        new = state[lane - 1]
        while len(lane):
            old = np.zeros(len(lane), dtype=np.int32)
            for i in range(_LANE):
                c = by_step[i, lane]
                old, new = step[old + c], step[new + c]
                hit = accepting[new]
                if hit.any():
                    note(lane[hit], i, new[hit])
                open_ = old != new
                if not open_.all():
                    lane, old, new = lane[open_], old[open_], new[open_]
                if not len(lane):
                    break
            go = lane + 1 < lanes  # its end state is another than assumed
            lane, new = lane[go] + 1, new[go]
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        where, what = np.concatenate(places), np.concatenate(bits)
        order = np.argsort(where, kind="stable")
        return where[order], what[order]

    @staticmethod
    def _last(a: Automaton, data: bytes, places: range, bit: int) -> int | None:
        """The last of the places after whose byte the rule accepts."""
        state, found = 0, None
        for i in places:
            state = int(a.step[state * a.classes + int(a.classes_of[data[i]])])
            if state == a.dead:
                break
            if int(a.accepts[state]) & bit:
                found = i
        return found

    def spans(self, data: bytes, where: np.ndarray, what: np.ndarray) -> list[Span]:
        """Matches in one text, in bytes, by start and then rule; ``where`` and ``what`` are its marks."""
        out = []
        for k, (kind, (_, least)) in enumerate(RULES.items()):
            ends = np.unique(where[what & (1 << k) != 0])
            done, i = 0, 0
            while i < len(ends):
                e = int(ends[i])
                start = self._last(self.backwards, data, range(e, done - 1, -1), 1 << k)
                if start is None:
                    i += 1
                    continue
                done = self._last(self.forwards, data, range(start, len(data)), 1 << k) + 1
                long = done - start >= least
                if kind == "assign":
                    long = len(_VALUE.match(data[start:done])[1]) >= 6
                if long:
                    out.append((start, k, done))
                i = int(np.searchsorted(ends, done))
        return [(KINDS[k], s, e) for s, k, e in sorted(out)]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[Span]]]:
        """(number of the text, its spans in code points) of each text that has any; joins some MB of texts at a time."""
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= _AT_ONCE):
                n += len(texts[j]) + 1
                j += 1
            begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[i:j]])))
            where, what = self.marks(np.frombuffer(b"\xff".join(texts[i:j]), dtype=np.uint8))
            owner = np.searchsorted(begins, where, side="right") - 1
            for d in np.unique(owner).tolist():
                if d < j - i:
                    own = owner == d if len(where) < 4096 else slice(*np.searchsorted(owner, [d, d + 1]))
                    found = self.spans(texts[i + d], where[own] - begins[d], what[own])
                    if found:
                        points = np.concatenate(([0], np.cumsum(np.frombuffer(texts[i + d], dtype=np.uint8) & 0xC0 != 0x80)))
                        yield i + d, [(k, int(points[s]), int(points[e])) for k, s, e in found]
            i = j


@cache
def _compiled() -> Scanner:
    return Scanner()


def _sent(docs: DataFrame):
    """The compiled automata as a broadcast of some hundred kB."""
    return docs.sparkSession.sparkContext.broadcast(_compiled())


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index("text"))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id and ``spans`` (kind, start, end), in code points, by start and then rule.

    Input: doc_id, text and any other columns, which are not carried. A null or empty text has no spans; rows with a
    null or repeated doc_id each give a row; an empty table gives none. Texts are scanned whole.
    """
    sent = _sent(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            found = dict(scanner.scan(_texts(batch)))
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found.get(i, [])] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span found replaced by ``mark``; all other columns stay, n_chars follows the text if present.

    Spans that touch or overlap are replaced as one. Null texts stay null; repeated rows stay as often as they are.
    """
    size = "n_chars" in docs.columns
    sent = _sent(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in slices(batches):
            found = dict(scanner.scan(_texts(batch)))
            if found:
                at = batch.schema.get_field_index("text")
                texts = batch.column(at).to_pylist()
                for i, spans in found.items():
                    out, done = [], 0
                    for _, s, e in spans:
                        if s > done or not out:
                            out += [texts[i][done:s], mark]
                        done = max(done, e)
                    texts[i] = "".join([*out, texts[i][done:]])
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if size:
                    n = batch.schema.get_field_index("n_chars")
                    counts = batch.column(n).to_pylist()
                    for i in found:
                        counts[i] = len(texts[i])
                    batch = batch.set_column(n, batch.schema.field(n), pa.array(counts, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base kinds, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [[(x["kind"], x["start"], x["end"]) for x in r] for r in batch.column(1).to_pylist()]
            base = [[x for x in r if x[0] in BASE] for r in rows]
            counts = [pa.array([sum(x[0] == k for x in r) for r in base], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base])
            names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(r) for r in rows], pa.string())], names=names)

    return find(docs).mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
