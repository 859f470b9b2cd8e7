"""Models of ordered sequences whose state runs through all rows of a key: hidden Markov models and self-exciting events.

Rows are packed in blocks of a key's day. What a block does to the state is one small operator (a product of transition
matrices, or a decay with its derivative), computed for all blocks at once; a table of these, one row a block, is folded
per key, and each block then runs again from the state that reaches it. Every round of fitting is one job over the
blocks for all candidate parameters, and the driver gets sums: their number does not depend on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.models import _spread_starts


def packed(df: DataFrame, key: str, order: str, tie: str, columns: list[str], rows: int = 256) -> DataFrame:
    """(key, day, part, rows): up to ``rows`` rows of a key and day in order, each (at, tie, x); ``at`` is seconds.

    ``columns`` become the doubles ``x``; they and ``order`` must not be null. Rows of equal time are ordered by ``tie``.
    """
    us = F.unix_micros(F.col(order).cast("timestamp"))
    one = F.struct((us / 1e6).alias("at"), F.col(tie).alias("tie"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    d = df.select(F.col(key).alias("key"), F.floor(us / 86_400_000_000).alias("day"), one.alias("row"))
    n = F.row_number().over(W.partitionBy("key", "day").orderBy("row.at", "row.tie")) - 1
    d = d.withColumn("part", F.floor(n / rows))
    return d.groupBy("key", "day", "part").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, values, lengths) of the blocks of a batch, padded to the longest."""
    n = np.array([len(r) for r in pdf["rows"]])
    at, x = np.zeros((len(n), n.max())), np.zeros((len(n), n.max(), len(pdf["rows"].iloc[0][0]["x"])))
    for i, r in enumerate(pdf["rows"]):
        at[i, : n[i]] = [v["at"] for v in r]
        at[i, n[i] :] = at[i, n[i] - 1]
        x[i, : n[i]] = np.array([v["x"] for v in r])
    return at, x, n


def _firsts(blocks: DataFrame) -> DataFrame:
    """The blocks with ``first``: whether it is the key's first."""
    f = blocks.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("day", "part")).alias("f"))
    return blocks.join(F.broadcast(f), F.col("key") == F.col("k")).select("key", "day", "part", "rows", ((F.col("day") == F.col("f.day")) & (F.col("part") == F.col("f.part"))).alias("first"))


# Hidden Markov models


@dataclass
class Hidden:
    """Chances of the first state and of moves, and each state's means and variances of the features."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Densities of each row by state, scaled by the greatest, and the logarithm of the scale."""
        d = x[..., None, :] - self.mean
        logs = -0.5 * ((d * d / self.var).sum(axis=-1) + np.log(2 * np.pi * self.var).sum(axis=-1))
        top = logs.max(axis=-1)
        return np.exp(logs - top[..., None]), top


def _products(h: Hidden, b: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each block does to a row vector of state chances: a matrix of sum one, and the logarithm of its scale."""
    k = len(h.start)
    p, logs = np.broadcast_to(np.eye(k), (len(n), k, k)).copy(), np.zeros(len(n))
    for t in range(b.shape[1]):
        step = np.where((first & (t == 0))[:, None, None], np.eye(k), h.move) * b[:, t, None, :]
        q = p @ step
        s = q.sum(axis=(1, 2))
        live = t < n
        p = np.where(live[:, None, None], q / s[:, None, None], p)
        logs += np.where(live, np.log(s), 0.0)
    return p, logs


def _smoothed(h: Hidden, b: np.ndarray, n: np.ndarray, first: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chances of the states at each row, sums of the moves) of blocks from what reaches them from both sides."""
    nb, size, k = b.shape
    alpha, a = np.zeros((nb, size, k)), before
    for t in range(size):
        a = np.where((first & (t == 0))[:, None], a, a @ h.move) * b[:, t]
        a = np.where((t < n)[:, None], a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300), 0.0)
        alpha[:, t] = a
    gamma, moves = np.zeros((nb, size, k)), np.zeros((k, k))
    beta = after
    for t in range(size - 1, -1, -1):
        live = t < n
        g = alpha[:, t] * beta
        gamma[:, t] = np.where(live[:, None], g / np.where(live, g.sum(axis=1), 1.0)[:, None], 0.0)
        source = alpha[:, t - 1] if t else before
        x = source[:, :, None] * h.move * (b[:, t] * beta)[:, None, :]
        total = x.sum(axis=(1, 2))
        use = live & ~(first & (t == 0)) & (total > 0)
        moves += (x[use] / total[use, None, None]).sum(axis=0)
        back = (h.move @ (b[:, t] * beta)[:, :, None])[:, :, 0]
        beta = np.where(live[:, None], back / back.sum(axis=1, keepdims=True), beta)
    return gamma, moves


def _carried(blocks: DataFrame, models: dict[int, Hidden]) -> DataFrame:
    """The blocks with ``carry``: by model, the chances before and after the block; and the likelihood of the block."""

    def products(batches):
        for pdf in batches:
            _, x, n = _stacked(pdf)
            for m, h in models.items():
                b, top = h.emissions(x)
                p, logs = _products(h, b, n, pdf["first"].to_numpy())
                logs = logs + np.where(np.arange(x.shape[1]) < n[:, None], top, 0.0).sum(axis=1)
                yield pd.DataFrame({"key": pdf["key"], "day": pdf["day"], "part": pdf["part"], "m": m, "p": list(p.reshape(len(n), -1)), "logs": logs})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "part"])
        h = models[int(pdf["m"].iloc[0])]
        k = len(h.start)
        p = np.array(pdf["p"].tolist()).reshape(-1, k, k)
        before, after, ll = np.empty((len(p), k)), np.empty((len(p), k)), np.empty(len(p))
        a = h.start
        for i in range(len(p)):
            before[i] = a
            a = a @ p[i]
            ll[i] = np.log(a.sum())
            a = a / a.sum()
        z = np.ones(k)
        for i in range(len(p) - 1, -1, -1):
            after[i] = z
            z = p[i] @ z
            z = z / z.sum()
        return pd.DataFrame({"key": pdf["key"], "day": pdf["day"], "part": pdf["part"], "m": pdf["m"], "before": list(before), "after": list(after), "ll": ll + pdf["logs"].to_numpy()})

    kind = blocks.schema["key"].dataType.simpleString()
    ends = blocks.mapInPandas(products, f"key {kind}, day long, part long, m int, p array<double>, logs double")
    ends = ends.groupBy("key", "m").applyInPandas(fold, f"key {kind}, day long, part long, m int, before array<double>, after array<double>, ll double")
    carry = ends.groupBy("key", "day", "part").agg(F.sort_array(F.collect_list(F.struct("m", "before", "after", "ll"))).alias("carry"))
    return blocks.join(carry, ["key", "day", "part"])


def _expected(blocks: DataFrame, models: dict[int, Hidden]) -> dict[int, np.ndarray]:
    """Per model the sums that the next parameters need: by state (rows, firsts, most likely rows, x, x * x), moves, likelihood."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            _, x, n = _stacked(pdf)
            first = pdf["first"].to_numpy()
            for j, (m, h) in enumerate(sorted(models.items())):
                b, _ = h.emissions(x)
                before, after = (np.array([c[j][side] for c in pdf["carry"]]) for side in ("before", "after"))
                g, moves = _smoothed(h, b, n, first, before, after)
                flat, v = g.reshape(-1, g.shape[-1]), x.reshape(-1, x.shape[-1])
                likely = (g.argmax(axis=-1)[..., None] == np.arange(g.shape[-1])) & (np.arange(x.shape[1]) < n[:, None])[..., None]
                s = np.column_stack([flat.sum(axis=0), g[first, 0].sum(axis=0), likely.sum(axis=(0, 1)), flat.T @ v, flat.T @ (v * v)])
                s = np.concatenate([s.ravel(), moves.ravel(), [sum(c[j]["ll"] for c in pdf["carry"])]])
                total[m] = total.get(m, 0.0) + s
        yield pd.DataFrame([(m, i, float(v)) for m, s in total.items() for i, v in enumerate(s)], columns=["m", "i", "v"])

    out: dict[int, dict[int, float]] = {m: {} for m in models}
    for r in _carried(blocks, models).mapInPandas(sums, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
        out[r["m"]][r["i"]] = r["v"]
    return {m: np.array([v[i] for i in range(len(v))]) for m, v in out.items()}


def fit_hidden(df: DataFrame, key: str, order: str, tie: str, features: list[str], most: int = 6, rounds: int = 30, rows: int = 256, least_gain: float = 1e-4) -> list[tuple[Hidden, float, np.ndarray, bool]]:
    """For 1 to ``most`` states: (model, log-likelihood, rows by most likely state, converged), fitted by Baum-Welch.

    All keys are sequences of one model. Start values come from up to 2,000 rows, drawn by a hash. A model stops when a
    round gains less than ``least_gain`` times the rows' number in likelihood. Rows with a null in a feature are left out.
    """
    clean = df.dropna(subset=[key, order, *features])
    blocks = _firsts(packed(clean, key, order, tie, features, rows)).cache()
    draw = clean.select(*[F.col(f).cast("double").alias(f) for f in features]).orderBy(F.xxhash64(*features)).limit(2000).collect()
    sample = np.array([list(r) for r in draw])
    spread = np.maximum(sample.var(axis=0), 1e-4)
    models = {}
    for k in range(1, most + 1):
        models[k] = Hidden(np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), _spread_starts(sample / np.sqrt(spread), k, 3) * np.sqrt(spread), np.tile(spread, (k, 1)))
    done: dict[int, tuple[Hidden, float, np.ndarray, bool]] = {}
    open_, last, d = dict(models), {}, len(features)
    for i in range(rounds + 1):
        for m, s in _expected(blocks, open_).items():
            k, h = len(open_[m].start), open_[m]
            state, moves, ll = s[: k * (3 + 2 * d)].reshape(k, -1), s[k * (3 + 2 * d) : -1].reshape(k, k), s[-1]
            settled = m in last and ll - last[m] < least_gain * max(1.0, state[:, 0].sum() ** 0.5)
            done[m] = h, float(ll), state[:, 2], settled
            last[m] = ll
            n = np.maximum(state[:, 0], 1e-9)
            mean = state[:, 3 : 3 + d] / n[:, None]
            var = np.maximum(state[:, 3 + d :] / n[:, None] - mean * mean, 1e-4)
            start = state[:, 1] + 1e-12
            models[m] = Hidden(start / start.sum(), (moves + 1e-12) / (moves + 1e-12).sum(axis=1, keepdims=True), mean, var)
        open_ = {m: models[m] for m in open_ if not done[m][3]}
        if not open_ or i == rounds:
            break
    blocks.unpersist()
    return [done[k] for k in sorted(done)]


def hidden_selection(spark, fits: list, features: int) -> DataFrame:
    """(states, parameters, ll, aic, bic, converged, least_share, most_share, chosen) of ``fit_hidden``'s models; the least BIC is chosen."""
    rows = []
    for h, ll, sizes, settled in fits:
        k, n = len(h.start), sizes.sum()
        parameters = (k - 1) + k * (k - 1) + 2 * k * features
        rows.append((k, parameters, round(ll, 4), round(2 * parameters - 2 * ll, 4), round(parameters * float(np.log(n)) - 2 * ll, 4), bool(settled), round(float(sizes.min() / n), 6), round(float(sizes.max() / n), 6)))
    best = min(rows, key=lambda r: r[4])[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "states int, parameters int, ll double, aic double, bic double, converged boolean, least_share double, most_share double, chosen boolean")


def hidden_labels(df: DataFrame, h: Hidden, key: str, order: str, tie: str, features: list[str], rows: int = 256) -> DataFrame:
    """(key, tie, state, chance): the most likely state of every row, given its key's whole sequence; states by their first feature's mean."""
    blocks = _firsts(packed(df.dropna(subset=[key, order, *features]), key, order, tie, features, rows))
    place = np.argsort(np.argsort(h.mean[:, 0]))

    def labels(batches):
        for pdf in batches:
            _, x, n = _stacked(pdf)
            b, _ = h.emissions(x)
            before, after = (np.array([c[0][side] for c in pdf["carry"]]) for side in ("before", "after"))
            g, _ = _smoothed(h, b, n, pdf["first"].to_numpy(), before, after)
            yield pd.DataFrame([(k, v["tie"], int(place[g[i, t].argmax()]), float(g[i, t].max())) for i, (k, r) in enumerate(zip(pdf["key"], pdf["rows"], strict=True)) for t, v in enumerate(r)], columns=[key, tie, "state", "chance"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _carried(blocks, {0: h}).mapInPandas(labels, f"{key} {kinds[key]}, {tie} {kinds[tie]}, state int, chance double")


# Self-exciting events


def _excited(at: np.ndarray, y: np.ndarray, decay: float, r0: np.ndarray, q0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Excitation and its derivative by the decay at each row of blocks; r0 and q0 are those at the first row."""
    r, q = np.zeros_like(at), np.zeros_like(at)
    r[:, 0], q[:, 0] = r0, q0
    for t in range(1, at.shape[1]):
        gap = at[:, t] - at[:, t - 1]
        a, s = np.exp(-decay * gap), r[:, t - 1] + y[:, t - 1]
        r[:, t] = a * s
        q[:, t] = a * (q[:, t - 1] - gap * s)
    return r, q


def _excitation_carry(blocks: DataFrame, decays: list[float]) -> DataFrame:
    """The blocks with ``carry``: by decay, the excitation and its derivative that reach the block's first row."""

    def ends(batches):
        for pdf in batches:
            at, x, n = _stacked(pdf)
            i, last = np.arange(len(n)), n - 1
            y = x[:, :, 0] * (np.arange(x.shape[1]) < n[:, None])
            for m, decay in enumerate(decays):
                r, q = _excited(at, y, decay, np.zeros(len(n)), np.zeros(len(n)))
                yield pd.DataFrame({"key": pdf["key"], "day": pdf["day"], "part": pdf["part"], "m": m, "t0": at[:, 0], "t1": at[i, last], "r": r[i, last] + y[i, last], "q": q[i, last]})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "part"])
        decay = decays[int(pdf["m"].iloc[0])]
        r0, q0 = np.zeros(len(pdf)), np.zeros(len(pdf))
        r = q = 0.0
        t = None
        for i, v in enumerate(pdf.itertuples()):
            if t is not None:
                a = np.exp(-decay * (v.t0 - t))
                r0[i], q0[i] = a * r, a * (q - (v.t0 - t) * r)
            a = np.exp(-decay * (v.t1 - v.t0))
            r, q, t = v.r + a * r0[i], v.q + a * (q0[i] - (v.t1 - v.t0) * r0[i]), v.t1
        return pd.DataFrame({"key": pdf["key"], "day": pdf["day"], "part": pdf["part"], "m": pdf["m"], "r0": r0, "q0": q0})

    kind = blocks.schema["key"].dataType.simpleString()
    e = blocks.mapInPandas(ends, f"key {kind}, day long, part long, m int, t0 double, t1 double, r double, q double")
    e = e.groupBy("key", "m").applyInPandas(fold, f"key {kind}, day long, part long, m int, r0 double, q0 double")
    return blocks.join(e.groupBy("key", "day", "part").agg(F.sort_array(F.collect_list(F.struct("m", "r0", "q0"))).alias("carry")), ["key", "day", "part"])


def _excited_sums(blocks: DataFrame, tries: list[np.ndarray], excited: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per vector of parameters: log-likelihood by part, and the gradient and information of part 0.

    Parameters: weights of the features, then the logarithms of the jump and of the decay if ``excited``.
    """
    decays = [float(np.exp(v[-1])) if excited else 1.0 for v in tries]

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            at, x, n = _stacked(pdf)
            live = np.arange(x.shape[1]) < n[:, None]
            y, part, z = x[:, :, 0] * live, x[:, :, 1], x[:, :, 2:]
            d = z.shape[2]
            for m, v in enumerate(tries):
                base = 1 / (1 + np.exp(-np.clip(z @ v[:d], -30, 30)))
                parts = [base * (1 - base)]
                if excited:
                    carry = [c[m] for c in pdf["carry"]]
                    r, q = _excited(at, y, decays[m], np.array([c["r0"] for c in carry]), np.array([c["q0"] for c in carry]))
                    jump = np.exp(v[d])
                    stay = np.exp(-jump * r)
                    p = 1 - (1 - base) * stay
                    parts = [base * (1 - base) * stay, (1 - base) * stay * r * jump, (1 - base) * stay * jump * q * decays[m]]
                else:
                    p = base
                p = np.clip(p, 1e-12, 1 - 1e-12)
                slopes = np.concatenate([parts[0][..., None] * z, *[c[..., None] for c in parts[1:]]], axis=2)
                ll = y * np.log(p) + (1 - y) * np.log(1 - p)
                use = (live & (part == 0))[..., None]
                s = np.where(use, slopes, 0.0).reshape(-1, slopes.shape[2])
                flat, yy = p.ravel()[:, None], y.ravel()[:, None]
                g = (s * (yy - flat) / (flat * (1 - flat))).sum(axis=0)
                info = (s / (flat * (1 - flat))).T @ s
                v = np.concatenate([[ll[live & (part == k)].sum() for k in (0, 1)], g, info.ravel()])
                total[m] = total.get(m, 0.0) + v
        yield pd.DataFrame([(m, i, float(v)) for m, s in total.items() for i, v in enumerate(s)], columns=["m", "i", "v"])

    source = _excitation_carry(blocks, decays) if excited else blocks
    got: dict[int, dict[int, float]] = {m: {} for m in range(len(tries))}
    for r in source.mapInPandas(sums, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
        got[r["m"]][r["i"]] = r["v"]
    out = []
    for m, v in enumerate(tries):
        s = np.array([got[m][i] for i in range(len(got[m]))])
        out.append((s[:2], s[2 : 2 + len(v)], s[2 + len(v) :].reshape(len(v), len(v))))
    return out


def fit_excitation(df: DataFrame, key: str, order: str, tie: str, label: str, features: list[str], part: str, decays: tuple[float, ...] = (), rounds: int = 25, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, log-likelihood by part) of events that excite later ones: 1 - p = (1 - sigmoid(w . features)) * exp(-jump * r).

    r is the sum of exp(-decay * age) over the key's earlier events. Weights, jump and decay are fitted together on rows
    with ``part`` 0; rows with 1 are only scored, with all earlier events behind them. ``decays`` are start values (one
    fit each, the best is kept); none of them: only the weights. Each round tries several lengths of the scoring step at
    once. ``df`` must hold a constant feature if one is wanted.
    """
    excited = bool(decays)
    blocks = packed(df.dropna(subset=[key, order, label, part, *features]), key, order, tie, [label, part, *features], rows).cache()
    start = np.zeros(len(features))
    now = [np.append(start, [np.log(0.1), np.log(d)]) for d in decays] if excited else [start]
    state = _excited_sums(blocks, now, excited)
    lengths = (1.0, 0.4, 0.1, 0.02)
    for _ in range(rounds):
        tries = []
        for v, (_, g, info) in zip(now, state, strict=True):
            step = np.clip(np.linalg.solve(info + 1e-6 * np.eye(len(v)) * max(1.0, np.trace(info) / len(v)), g), -2, 2)
            tries += [v + a * step for a in lengths]
        found = _excited_sums(blocks, tries, excited)
        gain = 0.0
        for j in range(len(now)):
            own = range(j * len(lengths), (j + 1) * len(lengths))
            best = max(own, key=lambda i: found[i][0][0])
            if found[best][0][0] > state[j][0][0]:
                gain = max(gain, found[best][0][0] - state[j][0][0])
                now[j], state[j] = tries[best], found[best]
        if gain < 1e-6:
            break
    blocks.unpersist()
    best = max(range(len(now)), key=lambda j: state[j][0][0])
    return now[best], state[best][0]
