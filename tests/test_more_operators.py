"""Ranks, fits, event joins, neighbours and special functions against plain Python and numpy."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import special
from foldwise.operators import checks, contaminate, joins, metrics, ranking, resample, sealed, splits, stats
from foldwise.plans import models
from foldwise.plans.simulate import simulate


def test_percentiles_and_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 7)
    rng = random.Random(2)
    rows = [("x" if i % 3 else None, float(rng.randint(-40, 40)) if i % 11 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ranking.percentiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.9}).where("g is not null").collect()}
    of = lambda g: np.array([v for h, v in rows if h == g and v is not None])
    assert [got["x"][c] for c in "abc"] == pytest.approx(np.quantile(of("x"), [0.01, 0.5, 0.9]).tolist())
    ranks = ranking.competition_ranks(ranking.midranks(df, ["g"], "v", "m"), ["g"], "v", "c").collect()
    for r in ranks:
        own = of(r["g"])
        if r["v"] is None:
            assert r["m"] is None and r["c"] is None
        else:
            assert r["c"] == (own < r["v"]).sum() + 1 and r["m"] == (own < r["v"]).sum() + ((own == r["v"]).sum() + 1) / 2


def test_fits_of_several_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 5), float(rng.normal()), None if i % 7 == 0 else float(rng.integers(0, 5))) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, a double, b double")
    for scope in ("fold", "global"):
        got = {r["fold"]: r for r in sealed.fit_percentiles(df, ["a", "b"], {"lo": 0.01, "mid": 0.5}, scope).collect()}
        for k in range(5):
            for j, c in ((1, "a"), (2, "b")):
                v = [r[j] for r in rows if (scope == "global" or r[0] != k) and r[j] is not None]
                assert [got[k][f"{c}__lo"], got[k][f"{c}__mid"]] == pytest.approx(np.quantile(v, [0.01, 0.5]).tolist())
    empty = sealed.fit_percentiles(df.limit(0), ["a"], {"lo": 0.5}).collect()
    assert [r["a__lo"] for r in empty] == [None] * 5


def test_scaler_uses_training_rows_only_and_survives_constant_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 5), float(rng.normal(10, 2)), 3.0) for i in range(500)]
    p = {(r["fold"], r["feature"]): r for r in sealed.fit_scaler(spark.createDataFrame(rows, "fold int, a double, b double"), ["a", "b"]).collect()}
    for k in range(5):
        a = np.array([x for f, x, _ in rows if f != k])
        assert p[k, "a"]["mean"] == pytest.approx(a.mean()) and p[k, "a"]["sd"] == pytest.approx(a.std())
        assert p[k, "b"]["sd"] == 1.0
    z = sealed.apply_scaler(spark.createDataFrame(rows, "fold int, a double, b double"), sealed.fit_scaler(spark.createDataFrame(rows, "fold int, a double, b double"), ["a", "b"]), ["b"])
    assert z.where("b_z <> 0").count() == 0


def test_composite_preprocessor(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 5), None if i % 9 == 0 else float(rng.normal()), [None, "u", "v", "v"][i % 4] if i != 3 else "only") for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, a double, c string")
    pre = sealed.FoldSealedPreprocessor(["a"], ["c"])
    out = pre.fit_transform(df).collect()
    assert len(out) == 300 and all(r["a_z"] is not None and r["c_code_z"] is not None for r in out)
    a = [np.array([x for f, x, _ in rows if f != k and x is not None]) for k in range(5)]
    med = {r["fold"]: r["a__median"] for r in pre.params["median", "*"].collect()}
    assert [med[k] for k in range(5)] == pytest.approx([float(np.median(x)) for x in a])
    assert {r["mode"] for r in pre.params["mode", "c"].collect()} == {"v"}
    assert pre.transform(df).count() == 300


def brute(left, right, hours):
    out = set()
    for i, u, t in left:
        near = sorted((s, j) for j, v, s in right if v == u and t + datetime.timedelta(seconds=1) <= s <= t + datetime.timedelta(seconds=1, hours=hours))
        if near:
            out.add((i, near[0][1]))
    return out


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_event_joins_of_one_subject(spark, kind):
    rng = random.Random(6)
    t0 = datetime.datetime(2024, 3, 1)
    make = lambda n, lo: [(lo + i, 1 if rng.random() < 0.9 else 2, t0 + datetime.timedelta(seconds=rng.randint(0, 900_000) // 60 * 60 + rng.randint(0, 1))) for i in range(n)]
    left, right = make(300, 0), make(200, 1000)
    l, r = (spark.createDataFrame(x, "event_id long, user_id long, ts timestamp").withColumn("ts", F.col("ts").cast(kind)) for x in (left, right))
    pairs = joins.asof_forward(l, r, ["user_id"], "ts", "4 hours", tie="event_id")
    assert {(x["event_id"], x["next_event_id"]) for x in pairs.collect()} == brute(left, right, 4)
    rows = pairs.collect()
    alone = {(x["event_id"], x["next_event_id"]) for x in joins.no_event_between(pairs, l, ["user_id"], "ts", "next_ts", "ts", "1 hour").collect()}
    assert alone == {(x["event_id"], x["next_event_id"]) for x in rows if not any(u == x["user_id"] and x["ts"] < t < x["next_ts"] for _, u, t in left)}
    got = {x["event_id"]: x["n_readings"] for x in joins.interval_join(l, r, ["user_id"], "ts", "15 minutes", "5 hours", [F.max("r_event_id").alias("m")]).collect()}
    lo, hi = datetime.timedelta(minutes=15), datetime.timedelta(hours=5)
    want = {i: sum(v == u and t + lo < s <= t + hi for _, v, s in right) for i, u, t in left}
    assert got == {i: n for i, n in want.items() if n}


def test_a_subject_of_many_events_is_spread(spark):
    e = spark.range(50_000).select(F.col("id").alias("event_id"), F.lit(7).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))
    left, right = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    pairs = joins.asof_forward(left, right, ["user_id"], "ts", "4 hours", tie="event_id")
    assert pairs.where("next_event_id = event_id + 1").count() == pairs.count() == 25_000
    assert joins.no_event_between(pairs, left, ["user_id"], "ts", "next_ts", "ts").count() == 25_000


def test_group_folds_with_few_positives(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("g"), (F.col("id") % 997 == 0).cast("int").alias("y"))
    folds = splits.stratified_group_folds(df, "g", "y", 5, 1)
    sizes = folds.groupBy("fold").agg(F.count_distinct("g").alias("n")).collect()
    assert len(sizes) == 5 and {r["n"] for r in sizes} == {60}
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_neighbours_are_exact_at_every_size(spark, block, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_ROWS", block)
    rng = random.Random(8)
    rows = [(i, round(rng.expovariate(1), 2) if i % 5 else 0.0, float(rng.randint(0, 3))) for i in range(150)] + [(900, 50.0, 1.0)]
    got = models.neighbours(spark.createDataFrame(rows, "__id long, x double, z double"), ["x", "z"], 3).collect()
    assert len(got) == len(rows)
    at = {i: (x, z) for i, x, z in rows}
    for r in got:
        x, z = at[r["__id"]]
        want = sorted(((x - a) ** 2 + (z - b) ** 2, i) for i, (a, b) in at.items() if i != r["__id"])[:3]
        assert [m["d"] for m in r["near"]] == pytest.approx([d for d, _ in want])
        assert [m["id"] for m in r["near"]] == [i for _, i in want]


def test_neighbours_beside_a_constant_column(spark):
    """Leaves stay small where the first column tells nothing, a fifth of the rows tie and one lies far away."""
    rng = np.random.default_rng(9)
    x = np.column_stack([np.ones(6000), np.round(rng.normal(size=6000), 3), np.where(rng.random(6000) < 0.2, 7.0, rng.normal(size=6000))])
    x[0] = 1, 900, 900
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "__id long, c double, x double, z double")
    leaves, _ = models._leaves(rows.select(*[F.col(c).alias(f"f{j}") for j, c in enumerate("cxz")]), ["f0", "f1", "f2"], 4)
    sizes = [r["count"] for r in leaves.groupBy("leaf").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= models.BLOCK_ROWS and min(sizes) >= 4
    got = {r["__id"]: r["near"] for r in models.neighbours(rows, ["c", "x", "z"], 3).collect()}
    assert len(got) == 6000
    for i in [0, *range(1, 6000, 83)]:
        d = ((x - x[i]) ** 2).sum(1)
        want = sorted((round(float(v), 9), j) for j, v in enumerate(d) if j != i)[:3]
        assert [m["id"] for m in got[i]] == [j for _, j in want], i


def test_smote_lies_between_neighbours(spark):
    rng = random.Random(9)
    rows = [(i, rng.random(), rng.random(), int(i < 20)) for i in range(100)]
    out = models.smote(spark.createDataFrame(rows, "id long, x double, z double, y int"), ["x", "z"], "y", ["id"]).collect()
    made = [r for r in out if r["synthetic"]]
    assert len(made) == 60 and all(r["y"] == 1 and r["id"] is None for r in made)
    minor = np.array([(x, z) for i, x, z, y in rows if y])
    for r in made:
        p = np.array([r["x"], r["z"]])
        gaps = [np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a in minor for b in minor]
        assert min(gaps) < 1e-9


def test_metrics_of_one_small_test_set_equal_the_distributed_ones(spark):
    rng = np.random.default_rng(1)
    p, y = np.round(rng.random(300), 2), (rng.random(300) < 0.3).astype(float)
    df = spark.createDataFrame([("r", float(a), int(b)) for a, b in zip(p, y)], "run string, score double, label int")
    auroc, pr, brier = models.measured(p, y)
    assert metrics.auroc(df, ["run"], "score", "label").first()["auroc"] == pytest.approx(auroc)
    assert metrics.average_precision(df, ["run"], "score", "label").first()["average_precision"] == pytest.approx(pr)
    assert df.agg(metrics.brier("score", "label")).first()[0] == pytest.approx(brier)


def test_special_functions(spark):
    normal = statistics.NormalDist()
    for x in (-3.2, -1.0, 0.0, 0.4, 2.5):
        assert special.normal_cdf(x) == pytest.approx(normal.cdf(x), abs=1e-9)
        assert special.normal_ppf(normal.cdf(x)) == pytest.approx(x, abs=1e-6)
    xs = spark.createDataFrame([(x,) for x in (0.001, 0.2, 0.5, 0.9, 0.9999)], "u double").select("u", special.normal_ppf_col(F.col("u")).alias("q"))
    assert all(r["q"] == pytest.approx(normal.inv_cdf(r["u"]), abs=1e-6) for r in xs.collect())
    for df in (1, 4, 30):  # the tail by quadrature of the density
        for t in (0.3, 2.0):
            grid = np.linspace(0, t, 200_001)
            dens = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2) * (1 + grid**2 / df) ** (-(df + 1) / 2)
            assert special.t_sf(t, df) == pytest.approx(0.5 - float(((dens[1:] + dens[:-1]) / 2).sum() * t / 200_000), abs=1e-6)


def test_calibration_line_and_bca(spark):
    rng = np.random.default_rng(2)
    logit = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 0.7 * logit)))).astype(int)
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(logit, y)], "s double, y int")
    a, b = metrics.calibration_line(df, "s", "y")
    w = models.newton_logistic(logit[:, None], y.astype(float), c=1e12)
    assert (a, b) == pytest.approx((w[0], w[1]), abs=1e-4)
    x = rng.exponential(size=200)
    reps = [rng.choice(x, 200).mean() for _ in range(800)]
    lo, hi = resample.bca_interval(x.mean(), reps, [(x.sum() - v) / 199 for v in x])
    plain = np.percentile(reps, [2.5, 97.5])
    assert plain[0] < lo < x.mean() < hi and hi > plain[1] and hi - lo < 0.5  # skewed to the right


def test_equivalence_and_confirmation(spark):
    t = simulate(spark, {}, 7, 4000)
    told = {r["feature"]: r for r in checks.equivalence_report(t)}
    assert told["age"]["equivalent"] and told["wbv"]["equivalent"] and len(told) == 9
    row = spark.range(1).select(checks.rank_confirmed("null", F.lit(4)).alias("a"), checks.rank_confirmed("null", F.lit(3)).alias("b"), checks.rank_confirmed("wbv_positive", F.lit(3)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, True)
    low, high = stats.equivalence_statistics("n", "m", "s", 10.0, 2.0, 0.5)
    r = spark.createDataFrame([(25, 10.0, 5.0)], "n int, m double, s double").select(low.alias("a"), high.alias("b")).first()
    assert (r["a"], r["b"]) == (1.0, -1.0)


def test_injected_values_stay_in_their_intervals(spark):
    t = simulate(spark, {}, [1, 2], 500)
    for kind, (column, *spans) in contaminate.INJECTED.items():
        out = contaminate.inject_outliers(t, [kind], 0.02, ["seed", "record_id"], 1, by=["seed"])
        hit = out.alias("o").join(t.alias("t"), ["seed", "record_id"]).where(F.col(f"o.{column}") != F.col(f"t.{column}")).select("seed", F.col(f"o.{column}").alias("v")).collect()
        assert len(hit) == 20 and sum(r["seed"] == 1 for r in hit) == 10
        assert all(any(lo <= r["v"] <= hi for lo, hi in spans) for r in hit)
    gone = contaminate.missing_at_random(t, "hct", 0.1, ["seed", "record_id"], 1, by=["seed"]).where("hct is null").groupBy("seed").count().collect()
    assert {r["count"] for r in gone} == {50}


def test_simulated_tables_keep_their_ranges_and_seeds(spark):
    a, b, c = simulate(spark, {}, 2026, 1500), simulate(spark, {}, 2026, 1500), simulate(spark, {}, 2027, 1500)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != sorted(map(tuple, c.collect()))
    assert all(r["passed"] for r in checks.validation_report(a).collect())
    assert a.where(F.abs(F.col("wbv") - (0.12 * F.col("hct") + 0.17 * (F.col("tp") - 2.07))) > 0.01).count() == 0
