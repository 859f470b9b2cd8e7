"""State machines along a key's rows: read in order, batch by batch, never a whole key at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, *, key: str, order: str | list[str], start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]], schema: str) -> DataFrame:
    """``step(state, row)`` for each row of a key in ``order``; the tuples that it returns are the rows of the result.

    Rows arrive sorted by the shuffle, so a task holds a batch and one state, whatever a key's number of rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, start()
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                if getattr(row, key) != last:
                    last, state = getattr(row, key), start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *([order] if isinstance(order, str) else order)).mapInPandas(run, schema)


def session_machine(hold: int, cooldown: int) -> tuple[Callable, Callable]:
    """(start, step) of a machine of four states: 0 outside the session, 1 scanning, 2 in position, 3 cooling down.

    Rows have ``us``, ``open_`` (in session) and ``trigger``; each gives (key, us, state, whether it entered).
    """

    def start() -> dict:
        return {"state": 0, "timer": 0}

    def step(s: dict, row) -> list[tuple]:
        entered = False
        if not row.open_:
            s["state"] = s["timer"] = 0
        elif s["state"] in (2, 3):
            s["timer"] -= 1
            if s["timer"] <= 0:
                s["state"], s["timer"] = (3, cooldown) if s["state"] == 2 else (1, 0)
        else:
            s["state"] = 1
            if row.trigger:
                entered = True
                s["state"], s["timer"] = 2, hold
        return [(row.symbol, row.us, s["state"], entered)]

    return start, step


def two_model_machine(hold: int, cooldown: int) -> tuple[Callable, Callable]:
    """(start, step): an eligible edge trigger enters while flat; after ``hold`` bars the position ends and ``cooldown`` bars must pass."""

    def start() -> dict:
        return {"entry": None, "clear": -1}

    def step(s: dict, row) -> list[tuple]:
        if s["entry"] is not None:
            if row.i - s["entry"] >= hold:
                s["entry"], s["clear"] = None, row.i + cooldown
            return []
        if row.eligible and row.edge and row.i > s["clear"]:
            s["entry"] = row.i
            return [(row.symbol, row.us, row.i, "BUY" if row.ret > 0 else "SELL")]
        return []

    return start, step


def bar_machine(*, stop: float, trail_from: float, trail: float, max_us: int, lots: tuple[float, float]) -> tuple[Callable, Callable]:
    """(start, step) of a single-position replay on bars: stop before trailing before time, then a new entry at the bar's
    open on a signal; the lot is the second after a win. Each closed trade is a row."""

    def start() -> dict:
        return {"side": 0, "win": False}

    def step(s: dict, row) -> list[tuple]:
        out = []
        if s["side"]:
            side, entry = s["side"], s["price"]
            best, worst = (row.high - entry, entry - row.low) if side > 0 else (entry - row.low, row.high - entry)
            s["peak"] = max(s["peak"], best)
            reason = None
            if worst >= stop:
                reason, at = "stop", entry - side * stop
            elif s["peak"] >= trail_from:
                if side * (row.close - entry) <= s["peak"] - trail:
                    reason, at = "trailing", entry + side * (s["peak"] - trail)
            elif row.us - s["us"] >= max_us:
                reason, at = "time", row.open
            if reason:
                pnl = side * (at - entry) * s["lot"] * 100
                out.append((row.symbol, s["us"], entry, "Buy" if side > 0 else "Sell", s["lot"], row.us, at, pnl, reason, s["peak"]))
                s.update(side=0, win=pnl > 0)
        if not s["side"] and row.signal:
            s.update(side=1 if row.move > 0 else -1, price=row.open, us=row.us, lot=lots[1] if s["win"] else lots[0], peak=0.0)
        return out

    return start, step


def gate_machine(*, stop: float, trail_from: float, trail: float, max_bars: int) -> tuple[Callable, Callable]:
    """(start, step): which signals a single position takes, its exit simulated from the entry bar on; a row per taken signal."""

    def start() -> dict:
        return {"side": 0}

    def step(s: dict, row) -> list[tuple]:
        out = []
        if not s["side"] and row.signal:
            s.update(side=1 if row.move > 0 else -1, price=row.open, i=row.i, peak=0.0)
            out.append((row.symbol, row.us))
        if s["side"]:
            side, entry = s["side"], s["price"]
            best, worst = (row.high - entry, entry - row.low) if side > 0 else (entry - row.low, row.high - entry)
            s["peak"] = max(s["peak"], best)
            if worst >= stop or (s["peak"] >= trail_from and side * (row.close - entry) <= s["peak"] - trail) or row.i - s["i"] >= max_bars:
                s["side"] = 0
        return out

    return start, step
