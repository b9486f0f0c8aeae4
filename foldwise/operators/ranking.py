"""Exact ranks, running totals and percentiles that no single task has to see whole.

Windows over a whole table put it into one task. Here rows are first cut into buckets that follow the order;
a window ranks within each bucket and the buckets' totals, a few rows, are summed before them. Values are counted
once, the counts are written, and everything else reads the counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.sources.scratch import written

#: Rows a bucket is to hold, about; the fewest and most buckets; and the accuracy of their cut points.
BUCKET_ROWS, LEAST, MOST, ACCURACY = 250_000, 8, 10_000, 50


def buckets_for(n: int) -> int:
    return min(MOST, max(LEAST, math.ceil(n / BUCKET_ROWS)))


def by_uniform(u: Column, n: int | None = None) -> Column:
    """Bucket of a number in [0, 1), for a table of ``n`` rows."""
    return F.floor(u * buckets_for(n or 0)).cast("int")


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are below the value: two looks, over groups of cuts and within one."""
    if not cuts:
        return F.lit(0)
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    count = lambda a: F.size(F.filter(a, lambda c: c < value))
    outer = count(F.array(*[F.lit(g[0]) for g in groups]))
    inner = F.coalesce(count(F.get(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), outer - 1)), F.lit(0))
    return F.when(outer > 0, (outer - 1) * wide + inner).otherwise(0).cast("int")


def by_cuts(df: DataFrame, value: str) -> Column:
    """Bucket of a value by approximate percentiles of its column (at most MOST numbers on the driver).

    Equal values share a bucket, so ``df`` is best a table of counted values. It is read twice: write it first.
    """
    buckets = buckets_for(df.count())
    x = F.col(value).cast("double")
    got = df.select(F.percentile_approx(x, [i / buckets for i in range(1, buckets)], ACCURACY * buckets)).first()[0] or []
    return F.coalesce(bucket_of(x, sorted(set(got))), F.lit(0))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, sums: dict[str, Column], exclusive: bool = False) -> DataFrame:
    """Running totals ``{name: weight}`` within the keys, in an order that the bucket follows.

    ``exclusive`` leaves the row itself out. Rows that tie in ``order`` follow each other in no fixed order. The table
    is read twice, so one that is dear to compute is best written first.
    """
    df = df.withColumns({"__b": bucket} | {f"__w_{n}": w for n, w in sums.items()})
    here = Window.partitionBy(*keys, "__b").orderBy(*order)
    here = here.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = df.groupBy(*keys, "__b").agg(*[F.sum(f"__w_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    totals = totals.toDF(*[f"__k_{k}" for k in keys], "__c", *[f"__o_{n}" for n in sums])
    df = df.withColumns({f"__r_{n}": F.coalesce(F.sum(f"__w_{n}").over(here), F.lit(0)) for n in sums})
    same = F.col("__b") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    df = df.join(totals, same)
    df = df.withColumns({n: F.col(f"__r_{n}") + F.col(f"__o_{n}") for n in sums})
    return df.drop("__b", "__c", *[f"__k_{k}" for k in keys], *[f"__{x}_{n}" for n in sums for x in "wro"])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """1-based row number within the keys."""
    return running(df, keys, order, bucket, {name: F.lit(1).cast("long")})


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return written(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), "counts")


def _below(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    counts = _counted(df, keys, value)
    return running(counts, keys, [F.col(value)], by_cuts(counts, value), {"__below": F.col("__n")}, exclusive=True)


def _ranked(df: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str, name: str, rank: Column) -> DataFrame:
    ranks = ranks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(value).alias("__v"), rank.alias(name))
    same = F.col(value) == F.col("__v")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(ranks, same, "left").drop("__v", *[f"__k_{k}" for k in keys])


def midranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average ranks of the rows' values within the keys, ties sharing theirs; null values have none."""
    return _ranked(df, _below(df, keys, value), keys, value, name, F.col("__below") + (F.col("__n") + 1) / F.lit(2.0))


def competition_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks of the rows' values within the keys, ties sharing the lowest (1, 2, 2, 4); null values have none."""
    return _ranked(df, _below(df, keys, value), keys, value, name, F.col("__below") + 1)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles ``{name: p}`` by linear interpolation, one row per keys, over values of any number."""
    counts = _counted(df, keys, value)
    ranked = running(counts, keys, [F.col(value)], by_cuts(counts, value), {"__upto": F.col("__n")})
    if keys:
        sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__size"))
        ranked = ranked.join(sizes, list(keys))
    else:
        ranked = ranked.withColumn("__size", F.lit(counts.agg(F.sum("__n")).first()[0] or 0))
    return ranked.groupBy(*keys).agg(*[_between("__upto", "__size", value, p).alias(n) for n, p in probs.items()])


def _between(upto: str, size: str, value: str, p: float) -> Column:
    """The percentile as an aggregate over rows of values with running counts."""
    at = F.lit(float(p)) * (F.col(size) - 1)
    low, high = F.floor(at), F.ceil(at)
    a = F.min(F.when(F.col(upto) >= low + 1, F.col(value)))
    b = F.min(F.when(F.col(upto) >= high + 1, F.col(value)))
    return a + (b - a) * F.max(at - low)


def train_percentiles(df: DataFrame, values: Sequence[str], probs: dict[str, float], fold: str = "fold", folds: int = 5) -> DataFrame:
    """For each fold and column the percentiles of all other folds' rows, ``fold, feature, <names>``, in one pass.

    Values are counted once with a column for each fold; a fold's training counts are the total less its own, so
    rows are not copied for the folds they train. The result has a row for each fold and column, and no lineage.
    """
    long = F.inline(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("value")) for v in values]))
    known = df.select(fold, long).where("value is not null")
    each = [F.sum((F.col(fold) != f).cast("long")).alias(f"__n{f}") for f in range(folds)]
    counts = written(known.groupBy("feature", "value").agg(*each), "counts")
    sizes = {r["feature"]: r for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"__n{f}").alias(f"s{f}") for f in range(folds)]).collect()}
    buckets = buckets_for(max((r["n"] for r in sizes.values()), default=0))
    cut = F.percentile_approx("value", [i / buckets for i in range(1, buckets)], ACCURACY * buckets)
    bucket = F.lit(0)
    for r in counts.groupBy("feature").agg(cut.alias("cuts")).collect():
        bucket = F.when(F.col("feature") == r["feature"], bucket_of(F.col("value"), sorted(set(r["cuts"])))).otherwise(bucket)
    ranked = running(counts, ["feature"], [F.col("value")], bucket, {f"__u{f}": F.col(f"__n{f}") for f in range(folds)})
    for f in range(folds):
        of = F.create_map(*[F.lit(x) for v, r in sizes.items() for x in (v, r[f"s{f}"] or 0)]) if sizes else F.create_map()
        ranked = ranked.withColumn(f"__z{f}", of[F.col("feature")] if sizes else F.lit(0).cast("long"))
    wide = ranked.groupBy("feature").agg(*[_between(f"__u{f}", f"__z{f}", "value", p).alias(f"{n}__{f}") for f in range(folds) for n, p in probs.items()])
    got = {r["feature"]: r for r in wide.collect()}
    rows = [(f, v, *[got[v][f"{n}__{f}"] if v in got else None for n in probs]) for f in range(folds) for v in values]
    return df.sparkSession.createDataFrame(rows, ", ".join([f"{fold} int", "feature string", *[f"{n} double" for n in probs]]))
