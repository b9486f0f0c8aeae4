"""Association and tests from sums that Spark adds up; only a few moments reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.special import normal_cdf, t_sf
from foldwise.operators.ranking import midranks


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, r`` for each pair of columns, in one pass."""
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``rho, n``: correlation of average ranks over rows that have both."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = midranks(midranks(known, [], a, "__ra"), [], b, "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation by Student's t."""
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    return 2 * t_sf(t, n - 2)


def partial_correlation(df: DataFrame, x: str, y: str, covariates: Sequence[str]) -> tuple[float, float]:
    """(r, p) of residuals of x and y on the covariates, without an intercept, from one pass of product sums."""
    names = [x, y, *covariates]
    known = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]] + [F.sum(c) for c in names] + [F.count(F.lit(1))]
    row = list(known.agg(*sums).first())
    k, n = len(names), row[-1]
    if not n:
        return float("nan"), float("nan")
    products = np.zeros((k, k))
    it = iter(row)
    for i in range(k):
        for j in range(i, k):
            products[i, j] = products[j, i] = next(it)
    totals = np.array([next(it) for _ in range(k)])
    z, zx, zy = products[2:, 2:], products[2:, 0], products[2:, 1]
    bx, by = np.linalg.lstsq(z, zx, rcond=None)[0], np.linalg.lstsq(z, zy, rcond=None)[0]
    cross = products[0, 1] - bx @ zy - by @ zx + bx @ z @ by
    sx, sy = totals[0] - bx @ totals[2:], totals[1] - by @ totals[2:]
    vx = products[0, 0] - 2 * bx @ zx + bx @ z @ bx - sx * sx / n
    vy = products[1, 1] - 2 * by @ zy + by @ z @ by - sy * sy / n
    r = float((cross - sx * sy / n) / math.sqrt(vx * vy))
    return r, correlation_p(r, n)


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``feature, f``: one-way F of each column over the label's classes, from counts, sums and squares by class."""
    centre = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    x = {c: F.col(c) - F.lit(float(centre[c] or 0.0)) for c in columns}
    parts = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.sum(x[c]).alias("s"), F.sum(x[c] * x[c]).alias("q")) for c in columns]
    by_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.array(*parts).alias("r")).select(F.inline("r")).where("n > 0")
    sums = by_class.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between")
    )
    between = F.col("between") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("between")
    return sums.select("feature", F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f"))


def top_k(df: DataFrame, value: str, k: int, keys: Sequence[str] = (), name: str = "feature") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.col(name))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def wilcoxon(df: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """``keys, n, w, p``: signed-rank statistic and two-sided normal p-value with tie correction.

    Zero differences are dropped; only zeros give statistic 0 and p 1.
    """
    d = df.where(F.col(difference).isNotNull()).withColumn("__a", F.abs(F.col(difference)))
    ranked = midranks(d.where("__a > 0"), keys, "__a", "__r")
    plus = F.sum(F.when(F.col(difference) > 0, F.col("__r")).otherwise(0.0))
    ties = ranked.groupBy(*keys, "__a").agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = ranked.groupBy(*keys).agg(plus.alias("plus"), F.sum("__r").alias("total"), F.count(F.lit(1)).alias("n"))
    everyone = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("all_n"))
    if keys:
        out = everyone.join(sums, list(keys), "left").join(ties, list(keys), "left")
    else:
        out = everyone.join(F.broadcast(sums), F.lit(True), "left").join(F.broadcast(ties), F.lit(True), "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    w = F.coalesce(F.least(F.col("plus"), F.col("total") - F.col("plus")), F.lit(0.0))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.coalesce("ties", F.lit(0.0)) / 48
    z = F.when(var > 0, (w - n * (n + 1) / 4) / F.sqrt(var)).otherwise(0.0)
    from foldwise.functions.special import normal_cdf_col

    p = F.when(var > 0, F.least(F.lit(1.0), 2 * normal_cdf_col(-F.abs(z)))).otherwise(1.0)
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), w.alias("w"), p.alias("p"))


def bonferroni(df: DataFrame, p: str = "p", keys: Sequence[str] = (), name: str = "p_adjusted") -> DataFrame:
    """p times the number of tests that have a p, at most 1."""
    tests = F.count(p).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * tests)))


def equivalence_statistics(n: str, mean: str, sd: str, target: float, target_sd: float, share: float = 0.1) -> tuple[Column, Column]:
    """Both one-sided t statistics of a mean against a target less and plus the margin, from moments."""
    se, margin = F.col(sd) / F.sqrt(F.col(n)), share * target_sd
    return F.try_divide(F.col(mean) - target + margin, se), F.try_divide(F.col(mean) - target - margin, se)


def tost(df: DataFrame, column: str, target: float, target_sd: float, share: float = 0.1) -> dict:
    """Equivalence of a column's mean to a target within ``share`` of its sd, by two one-sided t-tests."""
    n, mean, sd = df.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    margin = share * target_sd
    if not n or n < 2 or not sd:
        p = 0.0 if n and mean is not None and abs(mean - target) < margin else 1.0
    else:
        se = sd / math.sqrt(n)
        p = max(t_sf((mean - target + margin) / se, n - 1), t_sf(-(mean - target - margin) / se, n - 1))
    return {"feature": column, "n": n, "mean": mean, "p": p, "equivalent": p < 0.05}


def expected_auroc_under_noise(multiple: float, separation: float = 1.94, share: float = 0.767) -> float:
    """Area under the curve when a score of the given separation is measured with noise of ``multiple`` sd."""
    return normal_cdf(separation / math.sqrt(1 + 2 * multiple * multiple / share))
