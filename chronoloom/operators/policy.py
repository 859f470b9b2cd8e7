"""A small rule language: conditions compile to Column expressions; policies that carry state are replayed per key.

A leaf on a missing feature is false, and ``Not`` of it is true: boolean algebra on two values, not SQL's three.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Threshold:
    feature: str
    op: str
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        near = F.abs(c - self.value) <= 1e-7 * F.greatest(F.abs(c), F.lit(abs(self.value)))
        hit = {">": c > self.value, ">=": c >= self.value, "<": c < self.value, "<=": c <= self.value, "==": near, "!=": ~near}[self.op]
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Crosses:
    """From below to above (``up``) or back, between the previous value (column ``prev``) and this one."""

    feature: str
    value: float
    up: bool = True
    prev: str | None = None

    def column(self) -> Column:
        c, p = F.col(self.feature), F.col(self.prev or f"prev_{self.feature}")
        return F.coalesce((p <= self.value) & (c > self.value) if self.up else (p >= self.value) & (c < self.value), F.lit(False))


@dataclass(frozen=True)
class Hours:
    """Hour of day within [start, end], both included, on the given weekdays (Monday 0; none: all)."""

    start: int
    end: int
    days: tuple[int, ...] = ()
    at: str = "ts"

    def column(self) -> Column:
        ok = F.hour(self.at).between(self.start, self.end)
        return ok & F.weekday(self.at).isin(*self.days) if self.days else ok


@dataclass(frozen=True)
class Noise:
    """Deterministic pseudo-random draws by row index."""

    index: str
    share: float

    def column(self) -> Column:
        x = F.sin(F.col(self.index) * 12.9898 + 78.233) * 43758.5453
        return x - F.floor(x) < self.share


@dataclass(frozen=True)
class And:
    parts: tuple

    def column(self) -> Column:
        out = F.lit(True)
        for p in self.parts:
            out = out & p.column()
        return out


@dataclass(frozen=True)
class Or:
    parts: tuple

    def column(self) -> Column:
        out = F.lit(False)
        for p in self.parts:
            out = out | p.column()
        return out


@dataclass(frozen=True)
class Not:
    part: object

    def column(self) -> Column:
        return ~self.part.column()


_NODES = {c.__name__: c for c in (Threshold, Crosses, Hours, Noise, And, Or, Not)}


def to_json(node) -> str:
    def pack(x):
        d = {"type": type(x).__name__}
        for k, v in (x.__dict__).items():
            d[k] = [pack(y) for y in v] if k == "parts" else pack(v) if k == "part" else list(v) if isinstance(v, tuple) else v
        return d

    return json.dumps(pack(node), sort_keys=True)


def from_json(text: str):
    def unpack(d):
        kind = _NODES[d.pop("type")]
        return kind(**{k: tuple(unpack(y) for y in v) if k == "parts" else unpack(v) if k == "part" else tuple(v) if isinstance(v, list) else v for k, v in d.items()})

    return unpack(json.loads(text))


def complexity(node) -> int:
    if isinstance(node, (And, Or)):
        return 1 + sum(complexity(p) for p in node.parts)
    return 1 + complexity(node.part) if isinstance(node, Not) else 1


def description_bits(node) -> int:
    return 64 + 32 * complexity(node)


@dataclass(frozen=True)
class Policy:
    """When flat, out of cooldown and ``entry`` holds: open ``side``, at the market or as a limit; then the first exit to hit closes."""

    name: str
    entry: object
    side: str = "Buy"
    volume: float = 0.01
    cooldown: float = 0.0
    delay: float = 0.0
    limit: float | None = None
    max_seconds: float | None = None
    take_profit: float | None = None
    stop_loss: float | None = None
    trail: float | None = None
    trail_from: float = 0.0
    meta: dict = field(default_factory=dict)


_TRADES = "policy string, key string, trade_id int, side string, volume double, open_us long, open_price double, close_us long, close_price double, reason string"


def replay(quotes: DataFrame, decisions: DataFrame, policies: list[Policy], *, on: str) -> DataFrame:
    """Trades of every policy: quotes (on, ts, bid, ask) and decisions (on, ts, features, status) merged in time, quotes first.

    Entries are market orders filled by the first quote ``delay`` later or limits filled when the market reaches them;
    exits are checked on the side that closes, stop before profit. Decisions of another status than ``observed`` do
    nothing. State runs along one key's time line, so policies and keys run in parallel and each is a fold.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    entries = F.array(*[p.entry.column() for p in policies])
    d = decisions.select(F.coalesce(F.col(on).cast("string"), F.lit("None")).alias("key"), us("ts").alias("us"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"), F.when(F.col("status") == "observed", entries).otherwise(F.array(*[F.lit(False)] * len(policies))).alias("enter"))
    q = quotes.select(F.coalesce(F.col(on).cast("string"), F.lit("None")).alias("key"), us("ts").alias("us"), F.lit(0).alias("kind"), "bid", "ask", F.lit(None).cast("array<boolean>").alias("enter"))
    u = q.unionByName(d).withColumn("policy", F.explode(F.array(*[F.lit(i) for i in range(len(policies))])))
    u = u.withColumn("enter", F.coalesce(F.when(F.col("enter").isNotNull(), F.element_at("enter", F.col("policy") + 1)), F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            for (i, key), rows in pdf.groupby(["policy", "key"], sort=False):
                if state is None or (state.number, state.key) != (i, key):
                    if state:
                        yield state.closed()
                    state = _Replay(int(i), policies[int(i)], key)
                yield state.read(*(rows[c].tolist() for c in ("us", "kind", "bid", "ask", "enter")))
        if state:
            yield state.closed()

    # sorted by the shuffle and read in batches: a task holds a batch and one state, whatever the number of quotes
    names = ["policy", "key"]
    return u.repartition(*names).sortWithinPartitions(*names, "us", "kind").mapInPandas(run, _TRADES)


class _Replay:
    """One policy along one key, fed in the order of time."""

    def __init__(self, number: int, policy: Policy, key: str):
        self.number, self.policy, self.key = number, policy, key
        self.pending = self.pos = self.free_from = None
        self.trades = 0

    def _trade(self, close_us, close_price, reason: str) -> tuple:
        p, pos = self.policy, self.pos
        self.trades += 1
        return (p.name, self.key, self.trades - 1, p.side, p.volume, pos["us"], pos["price"], close_us, close_price, reason)

    def read(self, us: list, kind: list, bid: list, ask: list, enter: list) -> pd.DataFrame:
        p = self.policy
        buy = p.side == "Buy"
        sign = 1 if buy else -1
        out, pending, pos, free_from = [], self.pending, self.pos, self.free_from
        for t, k, b, a, e in zip(us, kind, bid, ask, enter, strict=True):
            if k == 0:
                inside, outside = (a, b) if buy else (b, a)
                if pos:
                    move = sign * (outside - pos["price"])
                    pos["best"] = max(pos["best"], move)
                    reason = None
                    if p.stop_loss is not None and move <= -p.stop_loss:
                        reason = "stop_loss"
                    elif p.take_profit is not None and move >= p.take_profit:
                        reason = "take_profit"
                    elif p.trail is not None and pos["best"] >= p.trail_from and pos["best"] - move >= p.trail:
                        reason = "trailing"
                    elif p.max_seconds is not None and t - pos["us"] >= p.max_seconds * 1e6:
                        reason = "time"
                    if reason:
                        self.pos = pos
                        out.append(self._trade(t, outside, reason))
                        pos, free_from = None, t + p.cooldown * 1e6
                elif pending is not None and t >= pending and (p.limit is None or sign * (inside - p.limit) <= 0):
                    pos, pending = {"us": t, "price": inside, "best": 0.0}, None
            elif e and not pos and pending is None and (free_from is None or t >= free_from):
                pending = t + p.delay * 1e6
        self.pending, self.pos, self.free_from = pending, pos, free_from
        return _rows(out)

    def closed(self) -> pd.DataFrame:
        """What is open at the end."""
        return _rows([self._trade(None, None, "open")] if self.pos else [])


def _rows(trades: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(trades, columns=[c.split(" ")[0] for c in _TRADES.split(", ")])


def thresholds(values: list[float], most: int) -> list[float]:
    """Midpoints between distinct values, thinned evenly (halves to even) to ``most``."""
    v = sorted(set(values))
    mids = [(a + b) / 2 for a, b in zip(v, v[1:])]
    if len(mids) <= most:
        return mids
    at = sorted({round(i * (len(mids) - 1) / (most - 1)) if most > 1 else 0 for i in range(most)})
    return [mids[i] for i in at]


def signature(trades: DataFrame) -> DataFrame:
    """A hash of each policy's trades in order: equal ones behave the same on these data."""
    row = F.concat_ws("|", "key", "open_us", "close_us", "side", F.round("open_price", 6), F.round("close_price", 6), "reason")
    return trades.groupBy("policy").agg(F.count("*").alias("trades"), F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("signature"))


def describe(p: Policy) -> dict:
    return {k: v for k, v in asdict(p).items() if k != "entry"} | {"entry": json.loads(to_json(p.entry)), "bits": description_bits(p.entry)}
