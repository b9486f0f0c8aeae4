"""Attributions of resampled models by expansion, and by squares with the rows near the hinge, are those of plain refits."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foldwise.operators import manyfits
from foldwise.plans import cohort_audits
from foldwise.plans.models import newton_logistic


def squared_hinge(z, y, w):
    x, t, b = np.column_stack([np.ones(len(z)), z]), 2 * y - 1, np.zeros(z.shape[1] + 1)
    for _ in range(100):
        on = w * (1 - t * (x @ b) > 0)
        b = np.linalg.solve(2 * (x * on[:, None]).T @ x + np.diag([0.0, *np.ones(z.shape[1])]), 2 * (x * on[:, None]).T @ t)
    return b


def test_resampled_models_equal_plain_refits_on_columns_of_any_size(spark):
    rng, n = np.random.default_rng(2), 4000
    a, c = rng.normal(0, 1, n), rng.normal(3, 2, n).round()
    t = pd.DataFrame({"id": np.arange(n), "a": 3e5 + 1e5 * a, "c": c, "y": (a + 0.3 * c + rng.normal(0, 2, n) > 1).astype(int)})
    d = spark.createDataFrame(t)
    got = cohort_audits.resampled_attributions(d, ["id"], "y", {"clean": ["a"], "both": ["a", "c"]}, 3).toPandas().set_index(["boot_id", "classifier", "pipeline", "feature"]).mean_abs
    u = d.select("id", F.xxhash64("id").alias("u")).toPandas().set_index("id").loc[t.id].u.to_numpy()
    for b in range(3):
        w = manyfits.poisson_weights(u, b)
        of = np.repeat(np.arange(n), w.astype(int))
        for p, f in {"clean": ["a"], "both": ["a", "c"]}.items():
            x = t[f].to_numpy(float)
            z = (x - x[of].mean(0)) / x[of].std(0)
            spread = np.abs(z[of]).mean(0)
            assert np.allclose([got[b, "lr", p, k] for k in f], np.abs(newton_logistic(z[of], t.y.to_numpy(float)[of])[1:]) * spread, rtol=2e-7)
            assert np.allclose([got[b, "linear_svm", p, k] for k in f], np.abs(squared_hinge(z, t.y.to_numpy(float), w)[1:]) * spread, rtol=1e-7)


def test_draws_at_once_are_the_draws_one_by_one():
    unit = np.random.default_rng(0).integers(-(2**62), 2**62, 50_000)
    got = manyfits.poisson_draws(unit, [0, 7, 499])
    for row, b in zip(got, (0, 7, 499)):
        z = unit.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (b + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
        assert np.array_equal(row, np.searchsorted(manyfits._POISSON, u, "right"))


def test_rows_in_several_groups_are_drawn_once(spark, monkeypatch):
    from foldwise.operators import resample

    rng = np.random.default_rng(6)
    t = pd.DataFrame({"id": np.arange(300), "y": rng.integers(0, 2, 300)})
    long = pd.concat([t.assign(k=k, s=np.round(t.y + rng.normal(size=300) * (k + 1), 1)) for k in range(3)])
    drawn = []
    real_sums, real_draws = manyfits.sums, manyfits.poisson_draws

    def here(rows, size, width, of):  # in this process, to count
        total = np.zeros((size, width))
        for i, v in of(rows.toPandas()):
            total[i] += v
        return total

    monkeypatch.setattr(manyfits, "poisson_draws", lambda u, b: drawn.append(len(u) * len(b)) or real_draws(u, b))
    monkeypatch.setattr(manyfits, "sums", here)
    got = {r["k"]: r for r in resample.auroc_bca(spark.createDataFrame(long), ["k"], ["id"], "s", "y", 50).collect()}
    assert sum(drawn) == 300 * 50
    monkeypatch.setattr(manyfits, "sums", real_sums)
    for k in range(3):
        one = resample.auroc_bca(spark.createDataFrame(long[long.k == k]), ["k"], ["id"], "s", "y", 50).first()
        assert np.allclose([got[k][c] for c in ("auroc", "ci_low", "ci_high")], [one[c] for c in ("auroc", "ci_low", "ci_high")], atol=1e-12)
