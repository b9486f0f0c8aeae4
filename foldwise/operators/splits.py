"""Fold and split columns. All randomness is a hash of keys, so splits are reproducible anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import uniform
from foldwise.operators.ranking import by_cuts, by_uniform, row_numbers, running
from foldwise.sources.scratch import written


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str | Column], k: int = 5, seed=0, name: str = "fold") -> DataFrame:
    """Balanced folds within each class: row number by hash, modulo k. Keys have to tell rows apart."""
    df = df.withColumn("__u", uniform(*keys, seed=seed))
    order = [F.col("__u"), *[F.col(x) if isinstance(x, str) else x for x in keys]]
    df = row_numbers(df, [label], order, by_uniform(F.col("__u"), df.count()), "__rn")
    return df.withColumn(name, ((F.col("__rn") - 1) % k).cast("int")).drop("__u", "__rn")


def group_folds(df: DataFrame, group: str, k: int = 5, seed=0, name: str = "fold") -> DataFrame:
    """Folds that keep groups whole: distinct groups dealt in the order of their hash."""
    groups = df.select(group).distinct().withColumn("__u", uniform(group, seed=seed))
    groups = written(groups, "groups")
    groups = row_numbers(groups, [], [F.col("__u"), F.col(group)], by_uniform(F.col("__u"), groups.count()), "__rn")
    groups = groups.select(F.col(group).alias("__g"), ((F.col("__rn") - 1) % k).cast("int").alias(name))
    return df.join(groups, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed=0, name: str = "fold") -> DataFrame:
    """Whole groups, dealt in a snake by how many positive rows they have, so that folds get alike shares."""
    groups = df.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    groups = written(groups.withColumn("__u", uniform(group, seed=seed)), "groups")
    # rows with as many are ordered by hash; the pairs of numbers, few, come before each other
    pairs = written(groups.groupBy("__pos", "__n").agg(F.count(F.lit(1)).alias("__m")), "pairs")
    before = running(pairs, [], [F.desc("__pos"), F.desc("__n")], -by_cuts(pairs, "__pos"), {"__before": F.col("__m")}, exclusive=True)
    groups = row_numbers(groups, ["__pos", "__n"], [F.col("__u"), F.col(group)], by_uniform(F.col("__u"), groups.count()), "__at")
    groups = groups.join(before.select("__pos", "__n", "__before"), ["__pos", "__n"]).withColumn("__rn", F.col("__at") + F.col("__before"))
    at = (F.col("__rn") - 1) % (2 * k)
    fold = F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int")
    return df.join(groups.select(F.col(group).alias("__g"), fold.alias(name)), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def leave_one_group_out(df: DataFrame, group: str, label: str) -> DataFrame:
    """One row a group, with what its held-out test has and what training on the others has.

    ``usable`` is false where the test or the training rows are of one class only.
    """
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"), F.sum(F.col(label).cast("long")).alias("pos_test"))
    total = per.agg(F.sum("n_test").alias("n"), F.sum("pos_test").alias("pos")).first()
    n, pos = F.lit(total["n"] or 0), F.lit(total["pos"] or 0)
    out = per.withColumns({"n_train": n - F.col("n_test"), "pos_train": pos - F.col("pos_test")})
    mixed = lambda a, b: (F.col(a) > 0) & (F.col(a) < F.col(b))
    return out.withColumn("usable", mixed("pos_test", "n_test") & mixed("pos_train", "n_train"))


def holdout(df: DataFrame, label: str, keys: Sequence[str | Column], share: float = 0.2, seed=0, name: str = "is_test") -> DataFrame:
    """Stratified split: the first of 1/share folds is the test."""
    out = stratified_folds(df, label, keys, round(1 / share), seed, "__fold")
    return out.withColumn(name, F.col("__fold") == 0).drop("__fold")


def group_holdout(df: DataFrame, group: str, share: float = 0.2, seed=0, name: str = "is_test") -> DataFrame:
    return df.withColumn(name, uniform(group, seed=seed) < share)


def positional_split(df: DataFrame, key: str, most: int = 200, name: str = "part") -> DataFrame:
    """The first min(most, n/2) rows by key calibrate, the rest test."""
    n = df.count()
    cut = df.select(key).orderBy(key).limit(min(most, n // 2)).agg(F.max(key)).first()[0]
    first = F.col(key) <= F.lit(cut) if cut is not None else F.lit(False)
    return df.withColumn(name, F.when(first, "calibrate").otherwise("test"))
