"""Roll-ups of result records: per-seed summaries, pivots, flags, best and worst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ranking import percentiles


def share(pred: Column) -> Column:
    """Percentage of rows for which the predicate holds; null without rows."""
    return F.avg(pred.cast("double")) * 100.0


def summary(df: DataFrame, keys: Sequence[str], value: str, band: tuple[float, float] = (0.45, 0.55)) -> DataFrame:
    """Mean, sample sd (0 for one row), median, 2.5 and 97.5 percentiles, % within the band, rows."""
    known = df.where(F.col(value).isNotNull())
    v = F.col(value)
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.025)).alias("ci_low"),
        F.percentile(v, F.lit(0.975)).alias("ci_high"),
        share((v >= band[0]) & (v <= band[1])).alias("pct_in_band"),
    )


def equivalence(low: str = "ci_low", high: str = "ci_high", bounds: tuple[float, float] = (0.40, 0.60)) -> Column:
    return (F.col(low) >= bounds[0]) & (F.col(high) <= bounds[1])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, n, mean, sd, min, q1, median, q3, max`` of each column; quartiles by counted values, so no task holds a column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))
    moments = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = percentiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(quartiles, "feature", "left").select("feature", "n", "mean", "sd", "min", "q1", "median", "q3", "max")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, n``: equal widths between minimum and maximum, the last bin closed."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    width = ((hi - lo) / bins or 1.0) if lo is not None else 1.0
    at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, value: str, how: str = "avg") -> DataFrame:
    """One column for each of the named values."""
    agg = {"avg": F.avg, "first": F.min, "max": F.max, "sum": F.sum}[how]
    return df.groupBy(*rows).agg(*[agg(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values])


def nearest(df: DataFrame, keys: Sequence[str], item: str, value: str, to: float = 0.5) -> DataFrame:
    """``keys, best, worst``: items whose value is nearest to and farthest from a number, of ties the first by name."""
    gap = F.abs(F.col(value) - F.lit(to))
    return df.groupBy(*keys).agg(F.min_by(item, F.struct(gap, F.col(item))).alias("best"), F.min_by(item, F.struct(-gap, F.col(item))).alias("worst"))


def category_order(column: str, order: Sequence[str]) -> Column:
    """Sort key of a custom order; unknown categories come last."""
    out = F.lit(len(order))
    for i, x in enumerate(order):
        out = F.when(F.col(column) == x, i).otherwise(out)
    return out


def leak_flag(bias: Column, least: float = 0.01) -> Column:
    return F.when(bias > least, "INFLATION").otherwise("OK")


def clean_flag(mean: Column, low: float = 0.44, high: float = 0.56) -> Column:
    return F.when(mean < low, "DEGRADED").when(mean > high, "INFLATED").otherwise("OK")


def leaky_flag(mean: Column, least: float = 0.70) -> Column:
    return F.when(mean > least, "STABLE").otherwise("DEGRADED")


def grid(spark, **axes: Sequence) -> DataFrame:
    """All combinations of small lists of numbers or strings, one column each."""
    out = None
    for name, values in axes.items():
        one = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def todo(all_keys: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells that are not done yet."""
    return all_keys.join(done.select(*keys).distinct(), list(keys), "left_anti")


def exploded_folds(df: DataFrame, arrays: Sequence[str], name: str = "fold") -> DataFrame:
    """A row for each element of parallel arrays, without columns that start with an underscore."""
    kept = [c for c in df.columns if c not in arrays and not c.startswith("_")]
    return df.select(*kept, F.posexplode(F.arrays_zip(*arrays)).alias(name, "__r")).select(*kept, name, "__r.*")
