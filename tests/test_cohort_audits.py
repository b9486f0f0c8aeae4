"""Audits with batched fits against plain versions, on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import attribution, forests, manyfits, metrics, resample
from foldwise.plans import audits, cohort_audits, models
from foldwise.plans.models import newton_logistic

SF = "/root/testdata/sf0.001"
CLEAN = ["a", "b"]
PIPELINES = {"clean": CLEAN, "leaky": [*CLEAN, "f"]}


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 40, 900)
    a, b = rng.normal(size=(2, 900)) + rng.normal(size=40)[s]
    v = a - b + rng.normal(size=900)
    return pd.DataFrame({"id": np.arange(900), "s": s, "a": a, "b": b, "f": v + rng.normal(size=900) / 9, "v": v, "w": np.where(s % 2, "x", "y")})


def test_grouped_scores_are_those_of_single_fits(spark, cohort):
    got = cohort_audits.grouped_scores(spark.createDataFrame(cohort), ["w"], "id", "s", "v", PIPELINES).toPandas()
    assert len(got) == 900 * 5 and got.groupby("s").fold.nunique().max() == 1
    t = cohort.merge(got[["id", "fold"]].drop_duplicates(), on="id")
    for w in "xy":
        for k in range(5):
            train, test = t[(t.w == w) & (t.fold != k)], t[(t.w == w) & (t.fold == k)]
            cut = np.percentile(train.v, 75)
            for name, f in PIPELINES.items():
                mean, sd = train[f].mean().to_numpy(), train[f].std(ddof=0).to_numpy()
                c = newton_logistic(((train[f] - mean) / sd).to_numpy(), (train.v >= cut).to_numpy(float))
                want = 1 / (1 + np.exp(-(c[0] + ((test[f] - mean) / sd).to_numpy() @ c[1:])))
                mine = got[(got.pipeline == name) & (got.model == "lr") & (got.w == w) & (got.fold == k)].set_index("id").loc[test.id]
                assert np.allclose(mine.score, want, atol=1e-6) and (mine.label.to_numpy() == (test.v >= cut)).all()


def test_the_clean_pipeline_never_sees_the_follow_up(spark, cohort):
    """Other follow-up values leave the clean scores, and a fold's threshold, as they are."""
    other = cohort.assign(f=cohort.f.to_numpy()[::-1])
    score = lambda d: cohort_audits.grouped_scores(spark.createDataFrame(d), [], "id", "s", "v", PIPELINES).toPandas().set_index(["pipeline", "model", "id"]).sort_index()
    one, two = score(cohort), score(other)
    assert np.allclose(one.loc["clean"].score, two.loc["clean"].score, atol=1e-9) and (one.loc["clean"].label == two.loc["clean"].label).all()
    assert not np.allclose(one.loc["leaky"].score, two.loc["leaky"].score)


def test_grouped_audit(spark, cohort):
    got = cohort_audits.grouped_audit(spark.createDataFrame(cohort), [], "id", "s", "v", PIPELINES).toPandas().set_index(["pipeline", "model"])
    assert got.n_subjects.eq(40).all() and got.n.eq(900).all() and got.n_folds.eq(5).all()
    for m in ("lr", "linear_svm"):
        assert got.auroc["leaky", m] > 0.98 > 0.92 > got.auroc["clean", m] > 0.7 and got.delta_auroc["clean", m] == 0
    assert got.auroc["oracle", "rule"] == 1


def test_balanced_fits_and_calibration_of_many_groups(spark, cohort):
    d = spark.createDataFrame(cohort.assign(y=(cohort.v > 1.5).astype(float)))
    s = cohort_audits.grouped_scores(d, ["w"], "id", "s", "y", {"clean": CLEAN}, models=["lr"], cut=0.5, balanced=True).where("model = 'lr'")
    got = s.toPandas()
    assert (got.label == (cohort.set_index("id").v > 1.5).loc[got.id].to_numpy()).all()
    means = got.groupby("label").score.mean()  # with equal weights, and only then, the classes' means are as far from a half
    assert abs(means.mean() - 0.5) < 0.04 and got.label.mean() < 0.3
    table = cohort_audits.calibration_table(s, ["w", "pipeline", "model"]).toPandas()
    for _, r in table.iterrows():
        one = s.where(F.col("w") == r.w)
        a, b = metrics.calibration_line(one, "score", "label")
        assert np.allclose([r.intercept, r.slope], [a, b], atol=1e-5)
        deciles = metrics.calibration_error(one, [], "score", "label", metrics.quantile_edges(one, "score", 10)).first()["ece"]
        assert np.isclose(r.ece_deciles, deciles) and np.isclose(r.ece, metrics.calibration_error(one, [], "score", "label").first()["ece"])


def test_resampled_subjects_equal_plain_refits(spark, cohort):
    d = spark.createDataFrame(cohort)
    got = cohort_audits.resampled_subjects(d, "s", {"clean": CLEAN}, "v", 4).toPandas().sort_values("boot_id")
    u = d.select("id", F.xxhash64("s").alias("u")).toPandas().set_index("id").loc[cohort.id].u.to_numpy()
    for _, r in got.iterrows():
        w = manyfits.poisson_weights(u, int(r.boot_id))
        drawn = cohort.loc[cohort.index.repeat(w.astype(int))]
        assert r.n_train == len(drawn) and r.n_test == (w == 0).sum()
        order = np.sort(drawn.v)
        at = 0.75 * (len(order) - 1)
        assert order[int(at)] - 1e-4 <= r.threshold <= order[int(at) + 1] + 1e-4
        mean, sd = drawn[CLEAN].mean().to_numpy(), drawn[CLEAN].std(ddof=0).to_numpy()
        c = newton_logistic(((drawn[CLEAN] - mean) / sd).to_numpy(), (drawn.v >= r.threshold).to_numpy(float))
        out = cohort[w == 0]
        p, y = ((out[CLEAN] - mean) / sd).to_numpy() @ c[1:], (out.v >= r.threshold).to_numpy()
        auroc = (p[y][:, None] > p[~y]).mean() + 0.5 * (p[y][:, None] == p[~y]).mean()
        assert abs(auroc - r.auroc) < 2e-3


def test_resampled_attributions_equal_plain_ones(spark, cohort):
    d = spark.createDataFrame(cohort.assign(y=(cohort.v > 0.5).astype(int)))
    got = cohort_audits.resampled_attributions(d, ["s"], "y", PIPELINES, 3).toPandas().set_index(["boot_id", "classifier", "pipeline", "feature"]).mean_abs
    u = d.select("id", F.xxhash64("s").alias("u")).toPandas().set_index("id").loc[cohort.id].u.to_numpy()
    for b in range(3):
        drawn = cohort.loc[cohort.index.repeat(manyfits.poisson_weights(u, b).astype(int))]
        for p, f in PIPELINES.items():
            x = drawn[f].to_numpy()
            z = (x - x.mean(0)) / x.std(0)
            c = newton_logistic(z, (drawn.v > 0.5).to_numpy(float))
            assert np.allclose([got[b, "lr", p, k] for k in f], np.abs(z * c[1:]).mean(0), rtol=1e-5)
    adi = cohort_audits.distortions(cohort_audits.resampled_attributions(d, ["s"], "y", PIPELINES, 3), "clean", "leaky").toPandas()
    assert len(adi) == 3 * 2 * 3 and adi.adi.notna().sum() == 3 * 2 * 2


def test_bca_equals_plain_jackknife_and_draws(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    s = np.round(y + rng.normal(size=200) * 1.5, 1)
    d = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "y": y, "s": s, "k": "one"}))
    auroc = lambda s, y, w: float(((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])).__mul__(w[y == 1][:, None] * w[y == 0]).sum() / (w[y == 1].sum() * w[y == 0].sum()))
    one = np.ones(200)
    jack = np.array([auroc(np.delete(s, i), np.delete(y, i), one[1:]) for i in range(200)])
    got = resample.auroc_jackknife(resample.auroc_placements(d, ["k"], "s", "y"), ["k"]).first()
    dev = jack.mean() - jack
    assert np.allclose([got["auroc"], got["jack_mean"], got["jack_se"], got["acceleration"]], [auroc(s, y, one), jack.mean(), np.sqrt(199 / 200 * (dev**2).sum()), (dev**3).sum() / (6 * (dev**2).sum() ** 1.5)])
    u = d.select("id", F.xxhash64("id").alias("u")).toPandas().sort_values("id").u.to_numpy()
    drawn = [auroc(s, y, manyfits.poisson_weights(u, b)) for b in range(400)]
    want = resample.bca_interval(auroc(s, y, one), drawn, jack)
    mine = resample.auroc_bca(d, ["k"], ["id"], "s", "y", 400).first()
    assert abs(mine["ci_low"] - want[0]) < 0.01 and abs(mine["ci_high"] - want[1]) < 0.01
    assert resample.auroc_bca(d.where("y = 1"), ["k"], ["id"], "s", "y", 9).first()["ci_low"] is None


def test_landmarks_see_the_kernel_and_more_of_them_see_more():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    error = []
    for m in (10, 50, 300):
        z = models.Landmarks(x[:m], x.mean(0), x.std(0))(x)
        error.append((1 - (z * z).sum(1)).mean())
    assert error[0] > error[1] > error[2] and error[2] < 1e-6
    u = (x - x.mean(0)) / x.std(0)
    assert np.allclose(z @ z.T, np.exp(-((u[:, None] - u) ** 2).sum(2) / 3), atol=1e-5)


def test_kernel_machine_is_near_the_exact_one(spark):
    """Fifty landmarks against all rows as landmarks, on a border that no line draws."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 2))
    t = pd.DataFrame({"id": np.arange(1000), "a": x[:, 0], "b": x[:, 1], "fold": np.arange(1000) % 5, "y": ((x**2).sum(1) + rng.normal(size=1000) * 0.4 < 1.2).astype(int)})
    s, error = audits.kernel_scores(spark.createDataFrame(t), ["a", "b"], "id", "fold", lambda k: F.col("y"))
    got = s.toPandas().set_index("id").loc[t.id]
    exact = np.zeros(1000)
    for k in range(5):
        train = t[t.fold != k]
        f = models.Landmarks(train[["a", "b"]].to_numpy(), train[["a", "b"]].to_numpy().mean(0), train[["a", "b"]].to_numpy().std(0))
        z, w = np.column_stack([np.ones(len(train)), f(train[["a", "b"]].to_numpy())]), None
        y, w = train.y.to_numpy() * 2 - 1, np.zeros(len(train) + 1)
        for _ in range(30):  # Newton on the squared hinge
            on = 1 - y * (z @ w) > 0
            ridge = np.r_[1e-9, np.ones(len(train))]
            w = w + np.linalg.solve(2 * z[on].T @ z[on] + np.diag(ridge), 2 * z[on].T @ (y - z @ w)[on] - ridge * w)
        test = (t.fold == k).to_numpy()
        exact[test] = np.column_stack([np.ones(test.sum()), f(t.loc[test, ["a", "b"]].to_numpy())]) @ w
    of = lambda v: models.measured(np.asarray(v), t.y.to_numpy(float))[0]
    per = lambda v: np.mean([models.measured(np.asarray(v)[t.fold == k], t.y[t.fold == k].to_numpy(float))[0] for k in range(5)])
    assert abs(per(got.margin) - per(exact)) < 0.01 and per(got.margin) > 0.9 and of(got.score) > 0.9
    assert 0 <= max(error) < 0.1


def test_forests_grow_and_attributions_add_up(spark, cohort):
    y = (cohort.v > 0).to_numpy()
    d = spark.createDataFrame(cohort.assign(fold=cohort.id % 2, y=y.astype(int)))
    member = lambda pdf, k: (pdf["fold"].to_numpy() != k, pdf["y"].to_numpy())
    trees = forests.forests(d, ["id"], ["a", "b", "f"], [0, 1], member, {"clean": ["a", "b"], "leaky": ["a", "b", "f"]}, 450, trees=30, bag=300)
    grown = forests.as_arrays(trees)
    assert set(grown) == {(k, p) for k in (0, 1) for p in ("clean", "leaky")} and all(len(f) == 30 for f in grown.values())
    x = cohort[["a", "b", "f"]].to_numpy()
    for p, least in (("clean", 0.75), ("leaky", 0.95)):
        s = np.where(cohort.id % 2 == 0, forests.predict(x, grown[0, p]), forests.predict(x, grown[1, p]))
        assert models.measured(s, y.astype(float))[0] > least
        assert all(t["cover"].min() >= 5 for f in grown.values() for t in f)
    assert all(2 not in t["feature"] for t in grown[0, "clean"])
    phi = attribution.contributions_of_trees(d, grown[0, "leaky"], ["a", "b", "f"], ["id"]).groupBy("id").agg(F.sum("phi").alias("s")).toPandas().set_index("id").loc[cohort.id].s
    mean = sum(t["weight"] * t["value"][0] for t in grown[0, "leaky"])
    assert np.allclose(phi, forests.predict(x, grown[0, "leaky"]) - mean, atol=1e-6)


def test_audits_run_whole(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    r = audits.m_kernel_svm(spark, SF).first()
    assert r["n"] == n and r["n_folds"] == 5 and 0 < r["kernel_error"] < 0.2
    out = {r["pipeline"]: r for r in audits.m_rf(spark, SF, trees=20).collect()}
    assert all(r["n"] == n and r["n_folds"] == 5 for r in out.values()) and out["follow_up"]["auroc"] > 0.75
    assert abs(out["clean"]["auroc"] - 0.5) < 0.05
    adi = {(r["classifier"], r["feature"]): r for r in audits.m_attribution(spark, SF, trees=3).collect()}
    assert len(adi) == 8 and adi["lr", "b"]["rank_leaky"] <= 2
    loso = {r["pipeline"]: r for r in cohort_audits.m_loso_models(spark, SF).collect()}
    assert loso["b_component"]["mean"] > 0.98 > loso["clean"]["mean"] > 0.8
    boot = {r["pipeline"]: r for r in cohort_audits.m_subject_bootstrap_models(spark, SF, 10).collect()}
    assert boot["clean"]["n"] == 10 and boot["b_component"]["mean"] > 0.95
    assert len(cohort_audits.m_cohort_attribution(spark, SF, 5).collect()) == 10
    per = metrics.auroc(cohort_audits.grouped_scores(cohort_audits.meals(spark, SF), [], "event_id", "user_id", "rise", cohort_audits.MEAL_PIPELINES), ["pipeline", "model"], "score", "label").collect()
    assert all(r["auroc"] > 0.95 for r in per if r["pipeline"] != "clean")
