"""Searches over rules and policies: enumeration, beam search, planted families, equivalence, verdicts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import policy as P


def enumerate_rules(values: dict[str, list[float]], most: int, depth: int = 1) -> list:
    """Thresholds in both directions for each feature, and conjunctions of up to ``depth`` of different features."""
    leaves = [P.Threshold(f, op, t) for f, v in sorted(values.items()) for t in P.thresholds(v, most) for op in (">", "<=")]
    out = list(leaves)
    for k in range(2, depth + 1):
        out += [P.And(c) for c in itertools.combinations(leaves, k) if len({x.feature for x in c}) == k]
    return out


def score_rules(rows: DataFrame, rules: list, label: str = "y") -> DataFrame:
    """rule number, hits, true hits, cases, rows and bits gained over the constant rate, less the rule's length; all rules in one pass."""
    flags = F.array(*[r.column() for r in rules])
    g = rows.select(F.col(label).cast("int").alias("y"), F.posexplode(flags).alias("rule", "hit"))
    g = g.groupBy("rule").agg(F.count("*").alias("n"), F.sum("y").alias("cases"), F.count_if("hit").alias("n1"), F.sum(F.when(F.col("hit"), F.col("y")).otherwise(0)).alias("y1"))
    rate = lambda y, n: (y + 0.5) / (n + 1)
    ll = lambda y, n: y * F.log(rate(y, n)) + (n - y) * F.log(1 - rate(y, n))
    c = {k: F.col(k) for k in ("n", "cases", "n1", "y1")}
    gain = (ll(c["y1"], c["n1"]) + ll(c["cases"] - c["y1"], c["n"] - c["n1"]) - ll(c["cases"], c["n"])) / F.log(F.lit(2.0))
    bits = F.element_at(F.array(*[F.lit(P.description_bits(r)) for r in rules]), F.col("rule") + 1)
    return g.select("rule", "n1", "y1", "cases", "n", gain.alias("gain_bits"), bits.alias("rule_bits"), (gain - bits).alias("net_bits"))


def beam(rows: DataFrame, leaves: list, width: int = 4, depth: int = 2, penalty: float = 0.001) -> list[tuple[object, float]]:
    """Best rules by gain less ``penalty`` times length; each level scores all extensions of the beam in one pass."""
    level, best = list(leaves), []
    for d in range(depth):
        scored = score_rules(rows, level)
        top = scored.withColumn("s", F.col("gain_bits") - penalty * F.col("rule_bits")).orderBy(F.desc("s"), "rule").limit(width).collect()
        kept = [(level[r["rule"]], float(r["s"])) for r in top]
        best = sorted(best + kept, key=lambda x: -x[1])[:width]
        parts = lambda r: r.parts if isinstance(r, P.And) else (r,)
        level = [P.And((*parts(r), x)) for r, _ in kept for x in leaves if x not in parts(r)]
        if not level:
            break
    return best


def planted(seed_policy: str) -> list[P.Policy]:
    """Planted families with known truth; the last two behave alike on purpose."""
    ret = P.Threshold("ret", ">", 0.05)
    return [
        P.Policy("threshold_time", ret, max_seconds=7200),
        P.Policy("threshold_barriers", ret, take_profit=8.0, stop_loss=12.0),
        P.Policy("trailing", ret, trail=6.0, trail_from=3.0, max_seconds=86400),
        P.Policy("cooldown", ret, max_seconds=3600, cooldown=14400),
        P.Policy("conjunction", P.And((ret, P.Threshold("volume", ">=", 2))), max_seconds=7200),
        P.Policy("negation", P.Not(P.Threshold("ret", "<=", 0.05)), max_seconds=7200),
        P.Policy("crossing", P.Crosses("volume", 2.5), max_seconds=7200),
        P.Policy("time_window", P.And((P.Hours(8, 12), ret)), max_seconds=7200),
        P.Policy("sell_side", P.Threshold("ret", "<", -0.05), side="Sell", max_seconds=7200),
        P.Policy("delayed", ret, delay=600, max_seconds=7200),
        P.Policy(seed_policy, P.Threshold("ret", ">=", 0.05), max_seconds=7200),
    ]


def equivalence_classes(signatures: DataFrame) -> DataFrame:
    """Policies with equal trades share a class, named by its first member."""
    g = signatures.groupBy("signature").agg(F.min("policy").alias("representative"), F.count("*").alias("size"))
    return signatures.join(g, "signature").select("policy", "representative", "size", "trades")


def divergences(matches: DataFrame, status: str, per_group: int, group: list[str], order: Column) -> DataFrame:
    """The first misses or false alarms of each group: a casebook."""
    w = W.partitionBy(*group).orderBy(order)
    return matches.where(F.col("status") == status).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_group).drop("r")


def verdict(f1: float | None, placebo: float | None, bits: float | None, coverage: float) -> str:
    """Decision table: unsupported data never speak against a rule."""
    if coverage < 0.5 or f1 is None:
        return "unknown"
    if f1 >= 0.99:
        return "identified"
    if placebo is not None and f1 <= placebo:
        return "no_better_than_placebo"
    return "supported" if bits is not None and bits > 0 else "not_supported"
