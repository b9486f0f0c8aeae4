"""Attribution: additive contributions, importance ranks, and how leakage moves them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators import treegrids
from foldwise.operators.joins import aligned_ranks
from foldwise.operators.rollup import share


def linear_contributions(df: DataFrame, weights: dict[str, float], keys: Sequence[str], means: dict[str, float] | None = None) -> DataFrame:
    """``keys, feature, phi``: weight times the distance from the mean; they add up to f(x) - E f."""
    if means is None:
        means = df.agg(*[F.avg(c).alias(c) for c in weights]).first().asDict()
    parts = [F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))).alias("phi")) for c, w in weights.items()]
    return df.select(*keys, F.inline(F.array(*parts)))


def correlated_contributions(df: DataFrame, weights: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Linear contributions that share credit among correlated features.

    Shapley values of the conditional expectation of a linear model under a normal distribution, from the features'
    covariance matrix (a few numbers). Subsets are enumerated, so at most ten features.
    """
    names = list(weights)
    p = len(names)
    if p > 10:
        raise ValueError("at most ten features")
    row = df.agg(*[F.avg(c) for c in names], *[F.covar_pop(a, b) for a in names for b in names]).first()
    mean, cov = np.array(row[:p], float), np.array(row[p:], float).reshape(p, p)
    beta = np.array([weights[c] for c in names])

    def value(s: tuple[int, ...]) -> np.ndarray:
        """Coefficients on (x - mean) of E[f | x_S]."""
        out = np.zeros(p)
        if s:
            s = list(s)
            rest = [i for i in range(p) if i not in s]
            out[s] = beta[s]
            if rest:
                out[s] += np.linalg.pinv(cov[np.ix_(s, s)]) @ cov[np.ix_(s, rest)] @ beta[rest]
        return out

    known = {s: value(s) for k in range(p + 1) for s in combinations(range(p), k)}
    phi = np.zeros((p, p))
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for k in range(p):
            w = math.factorial(k) * math.factorial(p - 1 - k) / math.factorial(p)
            for s in combinations(others, k):
                phi[i] += w * (known[tuple(sorted((*s, i)))] - known[s])
    parts = []
    for i, c in enumerate(names):
        total = F.lit(0.0)
        for j, d in enumerate(names):
            total = total + F.lit(float(phi[i, j])) * (F.col(d) - F.lit(float(mean[j])))
        parts.append(F.struct(F.lit(c).alias("feature"), total.alias("phi")))
    return df.select(*keys, F.inline(F.array(*parts)))


def mean_abs(contributions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, mean_abs``."""
    return contributions.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def importance_ranks(importance: DataFrame, keys: Sequence[str] = (), value: str = "mean_abs") -> DataFrame:
    """Rank 1 for the largest; ties go by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.col("feature"))
    return importance.withColumn("rank", F.row_number().over(order))


def attribution_distortion(clean: DataFrame, leaky: DataFrame, convention: int = 1, how: str = "full") -> DataFrame:
    """Rank distortion by leakage: convention 1 is clean less leaky (positive: promoted), convention 2 its negative."""
    out = aligned_ranks(clean, leaky, how)
    return out.withColumn("adi", F.col("distortion") if convention == 1 else -F.col("distortion")).drop("distortion")


def distortion_summary(df: DataFrame, keys: Sequence[str] = ("feature",), value: str = "adi") -> DataFrame:
    """Over resamples: mean, sd, 95 % interval, and % negative, zero and positive."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"),
        F.percentile(v, F.lit(0.025)).alias("ci_low"), F.percentile(v, F.lit(0.975)).alias("ci_high"),
        share(v < 0).alias("pct_neg"), share(v == 0).alias("pct_zero"), share(v > 0).alias("pct_pos"),
    )


def sign_concordance(df: DataFrame, unit: str, group: str, value: str = "adi", item: str = "feature") -> DataFrame:
    """``feature, a, b, pct``: resamples in which two classifiers agree on the sign, over complete resamples only."""
    known = df.where(F.col(value).isNotNull())
    groups = known.agg(F.count_distinct(group)).first()[0]
    complete = known.groupBy(unit, item).agg(F.count_distinct(group).alias("__c")).where(F.col("__c") == groups).drop("__c")
    rows = known.join(complete, [unit, item]).select(unit, item, group, F.signum(F.col(value).cast("double")).alias("s"))
    left, right = rows.toDF(unit, item, "a", "sa"), rows.toDF(unit, item, "b", "sb")
    pairs = left.join(right, [unit, item]).where("a < b")
    return pairs.groupBy(item, "a", "b").agg(share(F.col("sa") == F.col("sb")).alias("pct"))


def rank_stability(df: DataFrame, expected: dict[str, int], keys: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """% of resamples in which a feature has its expected rank."""
    table = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    return df.where(F.col("feature").isin(*expected)).groupBy(*keys, "feature").agg(share(F.col(rank) == table[F.col("feature")]).alias("pct_stable"))


def false_attribution_rate(df: DataFrame, feature: str, top: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Share of runs that rank the feature among the first; no row without runs."""
    return df.where(F.col("feature") == feature).groupBy(*keys).agg(F.avg((F.col("rank") <= top).cast("double")).alias("far"))


# -- trees -------------------------------------------------------------------


def tree_arrays(model) -> list[dict]:
    """Node arrays of each tree of a fitted pyspark.ml tree ensemble (model-sized, on the driver)."""
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0] * len(trees)
    forest = "Forest" in type(model).__name__
    out = []
    for t, w in zip(trees, weights):
        rows: list[list] = []

        def visit(node) -> int:
            at = len(rows)
            stats = node.impurityStats()
            count = float(stats.count())
            if hasattr(stats, "stats") and forest:
                values = list(stats.stats())
                value = values[1] / sum(values) if len(values) > 1 and sum(values) else 0.0
            else:
                value = float(node.prediction())
            rows.append([-1, 0.0, -1, -1, value, count])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][0], rows[at][1] = int(split.featureIndex()), float(split.threshold())
                rows[at][2] = visit(node.leftChild())
                rows[at][3] = visit(node.rightChild())
            return at

        visit(t._call_java("rootNode"))
        a = np.array(rows, float)
        out.append({"feature": a[:, 0].astype(int), "threshold": a[:, 1], "left": a[:, 2].astype(int), "right": a[:, 3].astype(int), "value": a[:, 4], "cover": a[:, 5], "weight": w / (sum(weights) if forest else 1.0)})
    return out


def tree_contributions_of(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Shapley values of path-dependent tree expectations, for a matrix of rows: by tables, or leaf by leaf where a tree's are too large."""
    phi, left = treegrids.contributions(x, trees)
    return phi + contributions_by_leaves(x, left)


def contributions_by_leaves(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """The same for trees of any size.

    Each leaf is worth its value where all its path's conditions hold. A feature that is unknown follows the cover
    of the branches. So a leaf gives a product over its path's features, whose Shapley values need the subset sums
    of the other features' factors by size: a polynomial for each leaf, computed for all rows at once.
    """
    n, p = x.shape
    phi = np.zeros((n, p))
    for t in trees:
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = t["feature"][node]
            if f >= 0:
                go_left = x[:, f] <= t["threshold"][node]
                for child, hit in ((t["left"][node], go_left), (t["right"][node], ~go_left)):
                    share_ = t["cover"][child] / t["cover"][node] if t["cover"][node] else 0.5
                    hot, cold = path.get(f, (np.ones(n), 1.0))
                    stack.append((child, {**path, f: (hot * hit, cold * share_)}))
                continue
            names = list(path)
            m = len(names)
            scale = t["value"][node] * t["weight"]
            for f in names:
                hot, cold = path[f]
                poly = np.zeros((m, n))
                poly[0] = 1.0
                for k, g in enumerate(x_ for x_ in names if x_ != f):
                    h, c = path[g]
                    poly[1 : k + 2] = poly[1 : k + 2] * c + poly[: k + 1] * h
                    poly[0] = poly[0] * c
                w = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
                phi[:, f] += scale * (hot - cold) * (w @ poly)
    return phi


def tree_contributions(df: DataFrame, model, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, feature, phi`` of a fitted forest or boosted trees, scored in Arrow batches."""
    return contributions_of_trees(df, tree_arrays(model), features, keys)


def contributions_of_trees(df: DataFrame, trees: list[dict], features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, feature, phi`` of trees given as node arrays."""
    names = list(features)

    @F.pandas_udf("array<double>")
    def phi(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns]) if len(columns[0]) else np.zeros((0, len(columns)))
        return pd.Series(list(tree_contributions_of(x, trees)))

    out = df.select(*keys, phi(*[F.col(c).cast("double") for c in names]).alias("__phi"))
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), F.col("__phi").alias("phi"))
    return out.select(*keys, F.inline(pairs))


def mean_abs_of_trees(df: DataFrame, trees: list[dict], features: Sequence[str]) -> DataFrame:
    """``feature, s, n``: sums over rows of |phi|, from tasks that gather their rows; the mean is ``sum(s) / sum(n)``."""
    names, shared = list(features), df.sparkSession.sparkContext.broadcast(trees)

    def work(batches):
        for pdf in treegrids.chunks(batches):
            phi = tree_contributions_of(pdf[names].to_numpy(float), shared.value)
            yield pd.DataFrame({"feature": names, "s": np.abs(phi).sum(0), "n": len(pdf)})

    return df.select(*[F.col(c).cast("double") for c in names]).mapInPandas(work, "feature string, s double, n long")


def kernel_contributions(df: DataFrame, predict, features: Sequence[str], keys: Sequence[str], background: np.ndarray) -> DataFrame:
    """Exact Shapley values of any ``predict(matrix) -> vector`` against a small background, for at most ten features."""
    names = list(features)
    p = len(names)
    if p > 10:
        raise ValueError("at most ten features")

    @F.pandas_udf("array<double>")
    def phi(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns]) if len(columns[0]) else np.zeros((0, p))
        value = {}
        for mask in range(1 << p):
            on = np.array([mask >> i & 1 for i in range(p)], bool)
            mixed = np.repeat(x, len(background), 0)
            mixed[:, ~on] = np.tile(background, (len(x), 1))[:, ~on]
            value[mask] = predict(mixed).reshape(len(x), -1).mean(1) if len(x) else np.zeros(0)
        out = np.zeros((len(x), p))
        for i in range(p):
            for mask in range(1 << p):
                if not mask >> i & 1:
                    k = mask.bit_count()
                    out[:, i] += math.factorial(k) * math.factorial(p - 1 - k) / math.factorial(p) * (value[mask | 1 << i] - value[mask])
        return pd.Series(list(out))

    out = df.select(*keys, phi(*[F.col(c).cast("double") for c in names]).alias("__phi"))
    return out.select(*keys, F.inline(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), F.col("__phi").alias("phi"))))


def top_feature(importance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The most important feature of each run; of ties the first by name."""
    return importance.groupBy(*keys).agg(F.coalesce(F.min_by("feature", F.struct(-F.col("mean_abs"), F.col("feature"))), F.lit("N/A")).alias("top_feature"))
