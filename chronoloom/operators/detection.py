"""Unusual rows and changes: isolation forests, optimal segmentation under a kernel cost, and rules out of boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import policy as P

_EULER = 0.5772156649015329


def expected_path(n):
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def forest_draws(df: DataFrame, row: str, features: list[str], trees: int, sample: int, seed: int) -> tuple[DataFrame, int]:
    """(tree, row, features) of the rows that each tree is grown from, drawn by hashes of ``row``; and their mean number."""
    n = df.count()
    size = min(sample, n)
    turns = max(1, -(-trees * size // max(1, n)))
    unit = lambda c: F.pmod(c, F.lit(1 << 40)) / (1 << 40)
    d = df.select(F.col(row).alias("row"), *[F.col(f).cast("double").alias(f) for f in features]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    d = d.where(unit(F.xxhash64("row", "turn", F.lit(seed))) < trees * size / (max(1, n) * turns))
    d = d.withColumn("tree", F.pmod(F.xxhash64("row", "turn", F.lit(seed + 1)), F.lit(trees)).cast("int"))
    return d.select("tree", "row", *features).distinct(), size


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, cut, left, right, path of a leaf) of a random tree: a random cut of a random feature that varies."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varies = np.flatnonzero(high > low)
        if depth >= limit or not len(varies):
            nodes[at] = (-1, 0.0, -1, -1, depth + float(expected_path(len(rows))))
            continue
        f = int(rng.choice(varies))
        cut = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] <= cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        todo += [(len(nodes), rows[below], depth + 1), (len(nodes) + 1, rows[~below], depth + 1)]
        nodes += [None, None]
    return nodes


def isolation_forest(df: DataFrame, row: str, features: list[str], trees: int = 100, sample: int = 256, seed: int = 11) -> DataFrame:
    """``df`` with ``score`` in (0, 1]: near 1 for rows that random cuts isolate soon. Null where a feature is null.

    Each tree is grown in a task of its own from about ``sample`` rows. The trees are what reaches the driver and is
    broadcast: at most ``trees * (2 * sample - 1)`` nodes. Every row is scored; ``row`` must identify rows.
    """
    clean = df.dropna(subset=features)
    drawn, size = forest_draws(clean, row, features, trees, sample, seed)

    def planted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        tree = int(pdf["tree"].iloc[0])
        nodes = grow(pdf[features].to_numpy(), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "nodes": [[list(map(float, v)) for v in nodes]]})

    model = [np.array([list(v) for v in r["nodes"]]) for r in drawn.groupBy("tree").applyInPandas(planted, "tree int, nodes array<array<double>>").orderBy("tree").collect()]
    known = df.sparkSession.sparkContext.broadcast(model)
    scale = float(expected_path(size)) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(dtype=float)
        ok = ~np.isnan(v).any(axis=1)
        total = np.zeros(len(v))
        for nodes in known.value:
            total += path_lengths(nodes, np.nan_to_num(v))
        return pd.Series(np.where(ok, np.exp2(-total / max(1, len(known.value)) / scale), np.nan)).astype(object).where(ok, None)

    return df.withColumn("score", score(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))


def path_lengths(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    feature, links = nodes[:, 0].astype(int), nodes[:, 2:4].astype(int)
    while (inner := feature[at] >= 0).any():
        i = np.flatnonzero(inner)
        right = x[i, feature[at[i]]] > nodes[at[i], 1]
        at[i] = links[at[i], right.astype(int)]
    return nodes[at, 4]


# Change points


def kernel_width(x: np.ndarray, most: int = 1000) -> float:
    """One over the median squared distance of pairs, of evenly spaced rows if there are more than ``most``."""
    v = x[:: max(1, -(-len(x) // most))]
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)[np.triu_indices(len(v), 1)]
    m = float(np.median(d)) if len(d) else 0.0
    return 1.0 / m if m > 0 else 1.0


def pelt(x: np.ndarray, penalty: float, least: int, width: float) -> tuple[list[int], float]:
    """(borders inside, total cost) of the cheapest segmentation: each segment costs the spread of its rows in kernel
    space plus ``penalty`` and has ``least`` rows or more. Starts that can be in no cheapest one are dropped on the way.

    The kernel's sums over all open segments are kept as one number a start, so memory is that of the rows.
    """
    n = len(x)
    if n < 2 * least:
        return [], float("nan")
    sums, best, back = np.zeros(n + 1), np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = 0.0
    until = np.full(n + 1, n + 1)  # a start is open for ends before that
    low = 0
    for t in range(n):
        k = np.exp(-width * ((x[low:t] - x[t]) ** 2).sum(axis=1))
        sums[low:t] += 2 * np.cumsum(k[::-1])[::-1] + 1
        sums[t] = 1
        e = t + 1
        s = np.arange(low, max(low, e - least + 1))
        s = s[(until[s] > e) & np.isfinite(best[s])]
        if not len(s):
            continue
        cost = best[s] + (e - s) - sums[s] / (e - s)
        i = int(cost.argmin())
        best[e], back[e] = cost[i] + penalty, s[i]
        # what is no better than a border at e stays so, once a segment from e may end
        worse = s[cost >= best[e]]
        until[worse] = np.minimum(until[worse], e + least)
        while until[low] <= e:
            low += 1
    out, e = [], n
    while e > 0:
        e = int(back[e])
        if e > 0:
            out.append(e)
    return out[::-1], float(best[n])


def change_points(series: DataFrame, key: str, order: str, features: list[str], least: int = 30, multiples: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """(key, multiple, number, at, rows_before, rows): segments of each key's cheapest segmentation, for multiples of the
    penalty log(rows) * features. ``at`` is a segment's first ``order``. Features are standardised within the key.

    A key is one task: aggregate long histories to steps of time first. Rows with a null feature are left out; a key of
    fewer rows than two least segments is one segment.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[features].to_numpy(dtype=float)
        spread = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
        width, rows = kernel_width(x), []
        for m in multiples:
            borders, _ = pelt(x, m * np.log(max(len(x), 2)) * len(features), least, width)
            rows += [(pdf[key].iloc[0], m, i, pdf[order].iloc[a], a, b - a) for i, (a, b) in enumerate(zip([0, *borders], [*borders, len(x)], strict=True))]
        return pd.DataFrame(rows, columns=[key, "multiple", "number", "at", "rows_before", "rows"])

    clean = series.dropna(subset=[key, order, *features]).select(key, order, *features)
    return clean.groupBy(key).applyInPandas(cut, f"{key} {kinds[key]}, multiple double, number int, at {kinds[order]}, rows_before long, rows long")


# Rules of boosted trees


@dataclass(frozen=True)
class Leaf:
    """A path of a fitted tree as a rule, with what the tree adds to the margin there."""

    tree: int
    number: int
    rule: P.And
    value: float


def tree_rules(model: GBTClassificationModel, features: list[str]) -> list[Leaf]:
    """All leaves of all trees; of each tree exactly one rule holds for a row without nulls."""
    out = []
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        todo, number = [(tree._call_java("rootNode"), ())], 0
        while todo:
            node, path = todo.pop()
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                name, cut = features[split.featureIndex()], float(split.threshold())
                todo += [(node.rightChild(), (*path, P.Threshold(name, ">", cut))), (node.leftChild(), (*path, P.Threshold(name, "<=", cut)))]
            else:
                out.append(Leaf(t, number, P.And(path), float(weight * node.prediction())))
                number += 1
    return out


def boosted_rules(rows: DataFrame, label: str, features: list[str], train, *, trees: int = 12, depth: int = 3, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rules, scored rows): boosted trees fitted where ``train`` holds; their rules counted on the other rows.

    Rules: tree, leaf, rule (JSON of the rule language), value, n, positives, rate, lift against the rate of all test
    rows. Scored: the test rows with ``model_p`` by the fitted model and ``rules_p`` by the rules, which agree. All rules
    are counted in one pass: a row gives the numbers of those that hold. Rows with null features or labels are left out.
    """
    clean = rows.dropna(subset=[label, *features]).withColumn("_train", train)
    made = VectorAssembler(inputCols=features, outputCol="_x")
    fit = made.transform(clean.where("_train").withColumn("_y", F.col(label).cast("double")))
    model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed).fit(fit)
    leaves = tree_rules(model, features)
    test = made.transform(clean.where("not _train").withColumn("_y", F.col(label).cast("double")))
    held = F.array_compact(F.array(*[F.when(leaf.rule.column(), F.lit(i)) for i, leaf in enumerate(leaves)]))
    values = F.array(*[F.lit(leaf.value) for leaf in leaves])
    margin = F.aggregate("held", F.lit(0.0), lambda a, i: a + F.get(values, i))
    scored = model.transform(test).withColumn("model_p", vector_to_array("probability")[1]).withColumn("held", held)
    scored = scored.withColumn("rules_p", 1 / (1 + F.exp(-2 * margin)))
    counts = scored.select(F.explode("held").alias("i"), "_y").groupBy("i").agg(F.count("*").alias("n"), F.sum("_y").cast("long").alias("positives"))
    all_of = scored.agg(F.avg("_y").alias("rate_of_all"))
    named = rows.sparkSession.createDataFrame([(i, leaf.tree, leaf.number, P.to_json(leaf.rule), leaf.value) for i, leaf in enumerate(leaves)], "i int, tree int, leaf int, rule string, value double")
    table = named.join(F.broadcast(counts), "i", "left").join(F.broadcast(all_of))  # one row
    rate = F.col("positives") / F.col("n")
    table = table.select("tree", "leaf", "rule", "value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"), rate.alias("rate"), (rate / F.col("rate_of_all")).alias("lift"))
    return table, scored.drop("_x", "_train", "rawPrediction", "probability", "prediction", "held")
