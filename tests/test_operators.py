"""Operators held against plain Python on small tables, with ties, nulls and empty tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import joins, metrics, sealed, splits


def brute_auroc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(3)
    return [(rng.randint(0, 12) / 12, int(rng.random() < 0.4)) for _ in range(300)]


def test_auroc_with_ties(spark, scored):
    df = spark.createDataFrame(scored, "score double, label int").withColumn("run", F.lit("x"))
    got = metrics.auroc(df, ["run"], "score", "label").first()
    assert got["auroc"] == pytest.approx(brute_auroc(scored), abs=1e-12)
    assert (got["n"], got["n_pos"]) == (300, sum(y for _, y in scored))


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("x", 0.5, 1), ("x", 0.1, 1)], "run string, score double, label int")
    assert metrics.auroc(df, ["run"], "score", "label").first()["auroc"] is None


def test_forward_asof(spark):
    rng = random.Random(5)
    t0 = datetime.datetime(2024, 1, 1)
    make = lambda n, lo: [(lo + i, rng.randint(0, 5), t0 + datetime.timedelta(minutes=rng.randint(0, 3000))) for i in range(n)]
    left, right = make(120, 0), make(80, 1000)
    schema = "event_id long, user_id long, ts timestamp"
    got = joins.asof_forward(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["user_id"], "ts", "4 hours", tie="event_id")
    got = {(r["event_id"], r["next_event_id"]) for r in got.collect() if r["next_event_id"] is not None}
    want = set()
    for i, u, t in left:
        near = sorted((s, j) for j, v, s in right if v == u and t + datetime.timedelta(seconds=1) <= s <= t + datetime.timedelta(hours=4))
        if near:
            want.add((i, near[0][1]))
    assert got == want


def test_sealed_threshold_ignores_the_fold_itself(spark):
    """Rows of a fold can be changed at will without moving the fold's own threshold."""
    rows = [(i, i % 5, float((i * 37) % 101)) for i in range(200)]
    fit = lambda r: {x["fold"]: x["threshold"] for x in sealed.fit_threshold(spark.createDataFrame(r, "id long, fold int, y double"), "y", 0.25).collect()}
    before, after = fit(rows), fit([(i, f, y + 1e6 * (f == 2)) for i, f, y in rows])
    assert before[2] == after[2] and any(before[k] != after[k] for k in before if k != 2)


def test_folds_are_balanced_and_groups_whole(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"), (F.col("id") % 40).alias("g"))
    counts = splits.stratified_folds(df, "label", ["id"], 5, 1).groupBy("label", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["label"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert splits.group_folds(df, "g", 5, 1).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
