"""Scalar expressions over ledger and bar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def buckets(x: Column, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Label of the interval between edges: [a, b), or (a, b] if ``right``; null outside."""
    out = None
    for lo, hi, name in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def clock_bucket(hour: Column) -> Column:
    return buckets(hour, [0, 8, 13, 17, 22, 24], ["night", "europe", "overlap", "america", "late"])


def session_bucket(hour: Column) -> Column:
    return buckets(hour, [-1, 6, 12, 17, 23], ["asia", "london", "newyork", "late"], right=True)


def cyclic(x: Column, period: float, harmonics: int = 1) -> list[Column]:
    """sin and cos of the first harmonics of x over its period."""
    return [f(F.lit(2 * math.pi * k / period) * x) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]


def boundary(minute_of_day: Column, period: int) -> Column:
    return (minute_of_day % period == 0).cast("int")


def boundary_distance(minute_of_day: Column, period: int) -> Column:
    phase = minute_of_day % period
    return F.least(phase, F.lit(period) - phase)


def round_distance(price: Column, step: float) -> Column:
    """Distance to the nearest multiple, halves to even."""
    return F.abs(price - F.bround(price / step) * step)


def implied_exit(side: Column, price: Column, pnl: Column, lot: Column, contract: float) -> Column:
    move = pnl / (lot * contract)
    return F.when(side == "Buy", price + move).otherwise(price - move)


def normal_ticket(ticket: Column) -> Column:
    """Without leading zeros; all zeros (or none) give 0."""
    s = F.regexp_replace(F.trim(ticket), "^0+", "")
    return F.when(s == "", "0").otherwise(s)


def last_sunday(year: Column, month: int) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(end, F.pmod(F.weekday(end) + 1, F.lit(7)))


def nth_sunday(year: Column, month: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(6 - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def offset_hours(ts: Column, rule: str) -> Column:
    """Hours ahead of UTC at a UTC time: ``eu`` (2, 3 from the last Sunday of March to that of October, 1:00), ``us_dates``
    (2, 3 between the United States' change dates) or ``eastern`` (-5, -4)."""
    y, d = F.year(ts), F.to_date(ts)
    if rule == "eu":
        at = lambda m: F.make_timestamp_ntz(y, F.lit(m), F.dayofmonth(last_sunday(y, m)), F.lit(1), F.lit(0), F.lit(0))
        return F.when((ts >= at(3)) & (ts < at(10)), 3).otherwise(2)
    summer = (d >= nth_sunday(y, 3, 2)) & (d < nth_sunday(y, 11, 1))
    return F.when(summer, 3).otherwise(2) if rule == "us_dates" else F.when(summer, -4).otherwise(-5)


def path_price(o: Column, h: Column, low: Column, c: Column, second: Column) -> Column:
    """Price inside a minute bar on straight lines through open (0), the two extremes (15, 45) and close (59); low first if the bar rose."""
    first, then = F.when(c >= o, low).otherwise(h), F.when(c >= o, h).otherwise(low)
    line = lambda a, b, s, e: a + (b - a) * (second - s) / (e - s)
    return F.when(second <= 15, line(o, first, 0, 15)).when(second <= 45, line(first, then, 15, 45)).otherwise(line(then, c, 45, 59))
