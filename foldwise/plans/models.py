"""Classifiers: pyspark.ml for single large fits, one small fit a task for sweeps; calibration and oversampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import uniform
from foldwise.operators import boosting
from foldwise.sources.scratch import forget, written

SEED = 2026


def estimator(name: str, total_weight: float, features: str = "features", label: str = "label", weight: str | None = None, **options):
    """An unfitted classifier by name; ``total_weight`` (rows or summed weights) scales the penalty of C = 1."""
    common = {"featuresCol": features, "labelCol": label} | ({"weightCol": weight} if weight else {})
    if name == "lr":
        c = options.pop("c", 1.0)
        return LogisticRegression(regParam=1 / (c * total_weight), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8, **common, **options)
    if name == "rf":
        return RandomForestClassifier(**{"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt", "seed": SEED} | common | options)
    if name == "xgb":
        return GBTClassifier(**{"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": SEED} | common | options)
    if name == "lgbm":
        return GBTClassifier(**{"maxIter": 300, "maxDepth": 5, "stepSize": 0.05, "seed": SEED} | common | options)
    if name in ("svm", "linear_svm"):
        return LinearSVC(**{"regParam": 1 / total_weight, "maxIter": 100, "standardization": False} | common | options)
    raise ValueError(name)


def fit(df: DataFrame, name: str, features: Sequence[str], label: str = "label", balanced: bool = False, **options):
    """A fitted pipeline of assembler and classifier. ``balanced`` weighs classes equally. Boosted trees of few columns are grown on counts."""
    weight, total = None, float(df.count())
    if balanced:
        n1 = df.agg(F.sum(F.col(label).cast("long"))).first()[0] or 0
        w1, w0 = total / (2 * max(n1, 1)), total / (2 * max(total - n1, 1))
        df = df.withColumn("__weight", F.when(F.col(label) == 1, w1).otherwise(w0))
        weight = "__weight"
    columns = list(features)
    if name == "xgb" and not balanced and not options:
        boosted = boosting.fit_boosted(df.dropna(subset=[*columns, label]), columns, label, seed=SEED)
        if boosted is not None:
            return boosted
    df = df.withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), estimator(name, total, label=label, weight=weight, **options)]).fit(df)


def predict(model, df: DataFrame, name: str = "score") -> DataFrame:
    """The positive class's probability, or the margin of a model without one."""
    if isinstance(model, boosting.Boosted):
        return model.predict(df, name)
    out = model.transform(df)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    made = [c for c in ("features", "rawPrediction", "probability", "prediction") if c in out.columns and c not in df.columns]
    return out.withColumn(name, vector_to_array(column)[1]).drop(*made)


def kernel_features(df: DataFrame, features: Sequence[str], gamma: float | None = None, dims: int = 100, seed: int = SEED, prefix: str = "rff_") -> DataFrame:
    """Random Fourier features of the Gaussian kernel: a linear model on them stands in for a kernel machine."""
    rng = np.random.default_rng(seed)
    gamma = gamma or 1.0 / len(features)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (dims, len(features))), rng.uniform(0, 2 * math.pi, dims)
    out = {}
    for k in range(dims):
        dot = F.lit(float(b[k]))
        for j, c in enumerate(features):
            dot = dot + F.lit(float(w[k, j])) * F.col(c)
        out[f"{prefix}{k}"] = F.lit(math.sqrt(2 / dims)) * F.cos(dot)
    return df.withColumns(out)


class Landmarks:
    """Nystroem features of the Gaussian kernel: inner products of rows' features are the kernel as seen from a few landmarks.

    A row's squared length falls short of 1 by its kernel error, which falls with the number of landmarks.
    """

    def __init__(self, points: np.ndarray, mean: np.ndarray, sd: np.ndarray, gamma: float | None = None) -> None:
        self.mean, self.sd = mean, np.where(sd > 0, sd, 1.0)
        self.points = (points - self.mean) / self.sd
        self.gamma = gamma or 1.0 / points.shape[1]
        value, vector = np.linalg.eigh(self._kernel(self.points))
        keep = value > 1e-10 * max(value.max(initial=0.0), 1e-300)
        self.root = np.zeros((len(points), len(points)))
        self.root[:, keep] = vector[:, keep] / np.sqrt(value[keep])

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        gap = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1) - 2 * x @ self.points.T
        return np.exp(-self.gamma * np.maximum(gap, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._kernel((x - self.mean) / self.sd) @ self.root


def platt(df: DataFrame, score: str, label: str):
    """An unpenalised logistic fit on the raw score."""
    return fit_one(df, score, label, LogisticRegression(regParam=0.0, maxIter=200, featuresCol="features", labelCol="__y"))


def fit_one(df: DataFrame, score: str, label: str, model):
    rows = df.withColumn("__y", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="features"), model]).fit(rows)


def isotonic(df: DataFrame, score: str, label: str):
    """A monotone fit; scores out of range take the end values."""
    return fit_one(df, score, label, IsotonicRegression(featuresCol="features", labelCol="__y", predictionCol="__iso"))


def calibrated(model, df: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    out = model.transform(df.withColumn("__y", F.lit(0.0)))
    value = F.col("__iso") if "__iso" in out.columns else vector_to_array("probability")[1]
    return out.withColumn(name, value).select(*df.columns, name)


def newton_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Intercept and coefficients of logistic regression with an L2 penalty of 1/(2C) on the coefficients."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x1.shape[1]), np.r_[0.0, np.full(x.shape[1], 1 / c)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-10)
        step = np.linalg.solve(h, x1.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def for_each_fold(df: DataFrame, folds: int = 5, fold: str = "fold") -> DataFrame:
    """Each row once for each fold ``k``, with ``is_test`` where it is that fold's own. For small tables of a sweep."""
    k = F.explode(F.array(*[F.lit(i) for i in range(folds)])).alias("k")
    return df.select("*", k).withColumn("is_test", F.col("k") == F.col(fold))


def oversample(x: np.ndarray, y: np.ndarray, seed: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Synthetic minority rows between neighbours until the classes are balanced; too few rows change nothing."""
    n1 = int(y.sum())
    minor = 1 if n1 * 2 <= len(y) else 0
    rows = x[y == minor]
    need = len(y) - 2 * len(rows)
    if len(rows) < 2 or need <= 0:
        return x, y
    rng = np.random.default_rng(seed)
    gap = ((rows[:, None, :] - rows[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(gap, np.inf)
    near = np.argsort(gap, 1, kind="stable")[:, : min(k, len(rows) - 1)]
    i = rng.integers(0, len(rows), need)
    j = near[i, rng.integers(0, near.shape[1], need)]
    made = rows[i] + rng.random((need, 1)) * (rows[j] - rows[i])
    return np.vstack([x, made]), np.r_[y, np.full(need, float(minor))]


def fit_and_score(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", is_test: str = "is_test", c: float = 1.0, balance: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One small logistic fit for each group, many at once: test rows with ``score``, scaled by their training rows.

    A group is one fit of a sweep, a table of at most some thousand rows. One large table takes :func:`fit`
    instead. Rows with nulls in features or label are left out; a group trained on one class has null scores.
    """
    names = list(features)
    kept = [*keys, *carry, label]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[names + [label]].notna().all(axis=1)]
        test = pdf[is_test].to_numpy(bool)
        x, y = pdf[names].to_numpy(float), pdf[label].to_numpy(float)
        out = pdf.loc[test, kept].copy()
        if len(np.unique(y[~test])) < 2:
            out["score"] = np.nan
            return out
        mean, sd = x[~test].mean(0), x[~test].std(0)
        sd[sd == 0] = 1.0
        xt, yt = (x[~test] - mean) / sd, y[~test]
        if balance:
            xt, yt = oversample(xt, yt, SEED)
        w = newton_logistic(xt, yt, c)
        out["score"] = 1 / (1 + np.exp(-np.clip(w[0] + ((x[test] - mean) / sd) @ w[1:], -30, 30)))
        return out

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in kept) + ", score double"
    return df.select(*dict.fromkeys([*kept, is_test, *names])).groupBy(*keys).applyInPandas(work, schema).where("score is not null and not isnan(score)")


def fit_and_measure(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", is_test: str = "is_test", c: float = 1.0, balance: bool = False, winsor: bool = False) -> DataFrame:
    """Like :func:`fit_and_score`, but one row for each group with its test rows' ``auroc, pr_auc, brier``.

    ``winsor`` clips features at the training rows' 1st and 99th percentiles before scaling. Groups that train or
    test one class only have no row.
    """
    names = list(features)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[names + [label]].notna().all(axis=1)]
        test = pdf[is_test].to_numpy(bool)
        x, y = pdf[names].to_numpy(float), pdf[label].to_numpy(float)
        if len(np.unique(y[~test])) < 2 or len(np.unique(y[test])) < 2:
            return pd.DataFrame(columns=[*keys, "auroc", "pr_auc", "brier"])
        if winsor:
            x = np.clip(x, *np.quantile(x[~test], [0.01, 0.99], axis=0))
        mean, sd = x[~test].mean(0), x[~test].std(0)
        sd[sd == 0] = 1.0
        xt, yt = (x[~test] - mean) / sd, y[~test]
        if balance:
            xt, yt = oversample(xt, yt, SEED)
        w = newton_logistic(xt, yt, c)
        p = 1 / (1 + np.exp(-np.clip(w[0] + ((x[test] - mean) / sd) @ w[1:], -30, 30)))
        return pd.DataFrame([(*key, *measured(p, y[test]))], columns=[*keys, "auroc", "pr_auc", "brier"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", auroc double, pr_auc double, brier double"
    return df.select(*dict.fromkeys([*keys, label, is_test, *names])).groupBy(*keys).applyInPandas(work, schema)


def measured(p: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """AUROC (ties half), average precision over distinct scores, and Brier score of one small test set."""
    score, at = np.unique(p, return_inverse=True)
    pos, n = np.bincount(at, y, len(score)), np.bincount(at, minlength=len(score))
    neg = n - pos
    auroc = (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())
    tp, m = np.cumsum(pos[::-1]), np.cumsum(n[::-1])
    return float(auroc), float((pos[::-1] * tp / m).sum() / pos.sum()), float(((p - y) ** 2).mean())


#: Distinct points that a leaf of the neighbour search holds at most, unless they can't be cut.
BLOCK_ROWS = 256


def _leaves(points: DataFrame, xs: Sequence[str], least: int) -> tuple[DataFrame, int]:
    """``points`` with ``leaf``, and the depth: nodes of a k-d tree, cut at medians of their widest column until small.

    A level is two aggregates by node. A node stays whole where a side would have fewer than ``least`` points. Numbers go
    from 1, a node's sides are twice its number and one more, and all leaves have numbers of the same depth.
    """
    at, depth = written(points.withColumn("leaf", F.lit(1).cast("long")), "kd"), 0
    while depth < 60:
        spread = F.array(*[F.max(x) - F.min(x) for x in xs])
        nodes = at.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), spread.alias("w"), F.array(*[F.percentile_approx(x, 0.5, 1000) for x in xs]).alias("m"), F.array(*[F.max(x) for x in xs]).alias("top")).where(F.col("n") > BLOCK_ROWS)
        widest = F.array_position("w", F.array_max("w")).cast("int")
        nodes = nodes.withColumn("j", widest).select("leaf", "j", F.element_at("m", F.col("j")).alias("cut"), F.element_at("top", F.col("j")).alias("top"))
        nodes = written(nodes, "cuts")
        value = F.element_at(F.array(*[F.col(x) for x in xs]), F.col("j"))
        # a median that is the largest value leaves what is below it on the left
        right = (value > F.col("cut")) | ((F.col("cut") == F.col("top")) & (value == F.col("cut")))
        sides = at.join(nodes, "leaf").groupBy("leaf").agg(F.count_if(right).alias("r"), F.count(F.lit(1)).alias("n"))
        good = written(nodes.join(sides.where((F.col("r") >= least) & (F.col("n") - F.col("r") >= least)).select("leaf"), "leaf"), "cuts")
        if not good.limit(1).count():
            break
        after = at.join(good, "leaf", "left").withColumn("leaf", F.col("leaf") * 2 + F.coalesce(right, F.lit(False)).cast("long")).drop("j", "cut", "top")
        after = written(after, "kd")
        forget(at, nodes, good)
        at, depth = after, depth + 1
    return at, depth


def neighbours(rows: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """``__id, near``: the k nearest other rows of each row (ties by id), as ``array<struct<d, id, x>>``; exact at every size.

    ``rows`` has ``__id`` and the features. Points are the leaves of a k-d tree. A point's k-th distance within its leaf bounds how
    far it has to look; leaves then go down the tree, level by level, to the leaves whose boxes are within their points'
    bounds, and a point meets those whose box is within its own. Rows with equal features are one point with a list of
    at most ``k + 1`` ids, so ties don't crowd a leaf.
    """
    names = list(features)
    xs = [f"__f{j}" for j in range(len(names))]
    rows = rows.select("__id", *[F.col(c).cast("double").alias(x) for c, x in zip(names, xs)])
    first_ids = Window.partitionBy(*xs).orderBy("__id")
    ids = rows.distinct().withColumn("__r", F.row_number().over(first_ids)).where(F.col("__r") <= k + 1)
    points = ids.groupBy(*xs).agg(F.sort_array(F.collect_list("__id")).alias("ids"), F.min("__id").alias("pid"))
    points, depth = _leaves(points, xs, k + 1)
    kind = f"array<struct<d:double,id:bigint,x:struct<{','.join(f'`{c}`:double' for c in names)}>>>"
    other = points.select("leaf", F.col("ids").alias("ids2"), F.struct(*[F.col(x).alias(c) for c, x in zip(names, xs)]).alias("x2"))
    square = lambda c: F.pow(c, F.lit(2.0))
    gap = sum((square(F.col(x) - F.col("x2")[c]) for c, x in zip(names, xs)), F.lit(0.0))

    def best(asked: DataFrame) -> DataFrame:
        """``pid, more``: of the points of the asked leaves the nearest ids."""
        met = asked.join(other, "leaf").select("pid", F.explode(F.transform("ids2", lambda i: F.struct(gap.alias("d"), i.alias("id"), F.col("x2").alias("x")))).alias("m"))
        order = Window.partitionBy("pid").orderBy("m.d", "m.id")
        return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("pid").agg(F.sort_array(F.collect_list("m")).cast(kind).alias("more"))

    own = points.join(best(points.select("pid", *xs, "leaf")).withColumnRenamed("more", "near"), "pid")
    reach = F.when(F.size("near") > k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
    own = written(own.withColumn("reach", reach), "near")
    box = lambda p: [f(x).alias(f"{p}{e}{j}") for j, x in enumerate(xs) for e, f in (("a", F.min), ("b", F.max))]
    leaves = written(own.groupBy("leaf").agg(*box("l"), F.max("reach").alias("reach")), "leaves")
    apart = lambda low, high, a, b: square(F.greatest(a - high, low - b, F.lit(0.0)))
    pairs = leaves.select("leaf", *[c for c in leaves.columns if c[:2] in ("la", "lb")], "reach", F.lit(1).cast("long").alias("node"))
    for level in range(1, depth + 1):
        nodes = leaves.groupBy(F.shiftright("leaf", depth - level).alias("node")).agg(*[f(f"l{e}{j}").alias(f"n{e}{j}") for j in range(len(xs)) for e, f in (("a", F.min), ("b", F.max))])
        far = sum((apart(F.col(f"la{j}"), F.col(f"lb{j}"), F.col(f"na{j}"), F.col(f"nb{j}")) for j in range(len(xs))), F.lit(0.0))
        below = pairs.withColumn("node", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)))
        pairs = written(below.join(nodes, "node").where(far <= F.col("reach")).select(*pairs.columns), "frontier")
    more = pairs.where(F.col("node") != F.col("leaf")).select("leaf", "node").join(leaves.select(F.col("leaf").alias("node"), *[c for c in leaves.columns if c[:2] in ("la", "lb")]), "node")
    within = sum((apart(F.col(x), F.col(x), F.col(f"la{j}"), F.col(f"lb{j}")) for j, x in enumerate(xs)), F.lit(0.0))
    asked = own.select("pid", *xs, "leaf", "reach").join(more, "leaf").where(within <= F.col("reach")).select("pid", *xs, F.col("node").alias("leaf"))
    done = own.join(best(asked), "pid", "left").select("pid", *xs, F.slice(F.sort_array(F.concat("near", F.coalesce("more", F.array().cast(kind)))), 1, k + 1).alias("near"))
    done = done.select(*[F.col(x).alias(f"__p{j}") for j, x in enumerate(xs)], "near")
    same = F.lit(True)
    for j, x in enumerate(xs):
        same = same & F.col(x).eqNullSafe(F.col(f"__p{j}"))
    return rows.join(done, same).select("__id", F.slice(F.filter("near", lambda m: m["id"] != F.col("__id")), 1, k).alias("near"))


def smote(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], k: int = 5, seed=0) -> DataFrame:
    """The rows, and synthetic minority rows ``x + d (neighbour - x)`` until the classes are balanced.

    A neighbour is one of the k nearest minority rows, exactly (:func:`neighbours`). Fewer than two minority rows give
    the table back. Rows with null features make none. Made rows have null keys.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 2:
        return df.withColumn("synthetic", F.lit(False))
    minor = min(counts, key=counts.get)
    need = max(counts.values()) - counts[minor]
    names = list(features)
    rows = df.where(F.col(label) == minor).dropna(subset=names).select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    rows = written(rows.withColumn("__id", F.xxhash64(*keys)), "minority")
    near = rows.join(neighbours(rows.select("__id", *names), names, k), "__id")
    per = -(-need // max(rows.count(), 1))
    made = near.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(per))))
    made = made.orderBy("__draw", uniform(*keys, "__draw", seed=f"{seed}:pick"), "__id").limit(need)
    pick = F.floor(uniform(*keys, "__draw", seed=f"{seed}:nn") * F.size("near")).cast("int")
    x2, d = F.get("near", pick)["x"], uniform(*keys, "__draw", seed=f"{seed}:gap")
    values = [F.coalesce(F.col(c) + d * (x2[c] - F.col(c)), F.col(c)).alias(c) for c in names]
    made = made.select(*[F.lit(None).cast(dict(df.dtypes)[x]).alias(x) for x in keys], *values, F.lit(minor).alias(label), F.lit(True).alias("synthetic"))
    return df.select(*keys, *names, label, F.lit(False).alias("synthetic")).unionByName(made)
