"""Scoring metrics as aggregations over score-grouped counts, any number of groups at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.formulas import clip
from foldwise.operators.ranking import by_cuts, percentiles, running
from foldwise.sources.scratch import written


def score_counts(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, score, pos, neg``: every metric of rank needs no more. Written, as it is read several times."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    return written(counts, "scores")


def auroc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, n, n_pos, auroc``: pairs in order, ties half; null for one class only."""
    return _auroc(score_counts(df, keys, score, label), keys)


def _auroc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    below = running(counts, keys, [F.col("score")], by_cuts(counts, "score"), {"below": F.col("neg")}, exclusive=True)
    pairs = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0)))
    out = below.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("__n0"), pairs.alias("__p"))
    return out.withColumn("auroc", F.try_divide(F.col("__p"), (F.col("n_pos") * F.col("__n0")).cast("double"))).drop("__p", "__n0")


def _from_above(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running true and false positives from the highest score down."""
    bucket = -by_cuts(counts, "score")
    return running(counts, keys, [F.desc("score")], bucket, {"tp": F.col("pos"), "fp": F.col("neg")})


def average_precision(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, average_precision``: precision at each distinct score, weighted by the recall it adds."""
    return _average_precision(score_counts(df, keys, score, label), keys)


def _average_precision(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    at = _from_above(counts, keys)
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = at.groupBy(*keys).agg(step.alias("__s"), F.sum("pos").alias("__p"))
    return out.select(*keys, F.try_divide(F.col("__s"), F.col("__p").cast("double")).alias("average_precision"))


def discrimination(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, n, n_pos, auroc, average_precision``, from scores that are counted once."""
    counts = score_counts(df, keys, score, label)
    return _auroc(counts, keys).join(_average_precision(counts, keys), list(keys))


def roc_curve(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, score, tpr, fpr`` at each distinct score."""
    at = _from_above(score_counts(df, keys, score, label), keys)
    sizes = at.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    at = at.join(sizes, list(keys)) if keys else at.join(F.broadcast(sizes))
    return at.select(*keys, "score", F.try_divide(F.col("tp"), F.col("__p")).alias("tpr"), F.try_divide(F.col("fp"), F.col("__n")).alias("fpr"))


def brier(score: str, label: str) -> Column:
    return F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0)))


#: The edges 0, 0.1 ... 1 as floating point has them; multiplying by ten would misplace scores on an edge.
EDGES = tuple(np.linspace(0.0, 1.0, 11).tolist())


def bin_of(score: Column, edges: Sequence[float | Column], right_closed: bool = False) -> Column:
    """Index of the bin: half-open with the last closed, or right-closed with the first closed."""
    inner = [e if isinstance(e, Column) else F.lit(e) for e in edges[1:-1]]
    out = F.lit(0)
    for e in inner:
        out = out + ((score > e) if right_closed else (score >= e)).cast("int")
    return F.when(score.isNotNull(), out)


def reliability(df: DataFrame, keys: Sequence[str], score: str, label: str, edges: Sequence[float] = EDGES, right_closed: bool = True) -> DataFrame:
    """``keys, bin, n, mean_score, share_pos`` of the bins that have rows."""
    binned = df.withColumn("bin", bin_of(F.col(score), edges, right_closed)).where(F.col("bin").isNotNull())
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share_pos"))


def calibration_error(df: DataFrame, keys: Sequence[str], score: str, label: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """``keys, ece``: bins' |share - mean score|, weighted by their rows."""
    bins = reliability(df, keys, score, label, edges, right_closed=False)
    gap = F.abs(F.col("share_pos") - F.col("mean_score"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def quantile_edges(df: DataFrame, score: str, bins: int = 10) -> list[float]:
    """Exact quantiles as edges (``bins + 1`` numbers)."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    row = percentiles(df, [], score, probs).first()
    return [row[f"q{i}"] for i in range(bins + 1)]


def thresholds(low: float, high: float, count: int) -> list[float]:
    """Evenly spaced, both ends included."""
    return np.linspace(low, high, count).tolist()


def net_benefit(df: DataFrame, keys: Sequence[str], score: str, label: str, points: Sequence[float]) -> DataFrame:
    """``keys, threshold, net_benefit, treat_all, treat_none``.

    Rows are counted by the last point that their score reaches (the number of points bounds the counts) and the
    counts are summed from above, so each row is read once, whatever the number of points.
    """
    points = sorted(points)
    at = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= F.col(score)))
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, at.alias("__at")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(label).cast("long")).alias("p"))
    grid = F.posexplode(F.array(*[F.lit(p) for p in points])).alias("__i", "threshold")
    per = counts.select(*keys, "__at", "c", "p", grid)
    hit = F.col("__at") > F.col("__i")
    out = per.groupBy(*keys, "threshold").agg(
        F.sum("c").alias("n"), F.sum("p").alias("all_pos"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("c") - F.col("p")).otherwise(0)).alias("fp")
    )
    odds = F.col("threshold") / (1 - F.col("threshold"))
    n = F.col("n").cast("double")
    return out.select(
        *keys,
        "threshold",
        (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"),
        (F.col("all_pos") / n - (1 - F.col("all_pos") / n) * odds).alias("treat_all"),
        F.lit(0.0).alias("treat_none"),
    )


def confusion(predicted: str, label: str) -> list[Column]:
    """Aggregates: tp, fp, fn, tn and agreement."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    return [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"), F.avg((p == y).cast("double")).alias("agreement")]


def calibration_line(df: DataFrame, score: str, label: str, rounds: int = 25, tolerance: float = 1e-10) -> tuple[float, float]:
    """Intercept and slope of the label on the score's logit, by Newton steps of five sums each."""
    eps = 1e-7
    x = clip(F.col(score), eps, 1 - eps)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.log(x / (1 - x)).alias("x"), F.col(label).cast("double").alias("y"))
    a, b = 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = p * (1 - p)
        r = F.col("y") - p
        g0, g1, h00, h01, h11 = rows.agg(F.sum(r), F.sum(r * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        det = (h00 or 0) * (h11 or 0) - (h01 or 0) ** 2
        if not det:
            return float("nan"), float("nan")
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tolerance:
            break
    return a, b
