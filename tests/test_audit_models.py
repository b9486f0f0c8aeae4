"""Audits with models score every row out of fold, with models of the stated sizes."""

import pytest

from foldwise.plans import audits, models

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fits(monkeypatch):
    """Each fit's name, features and options; one short fit for each set of features stands in for them all."""
    seen, done, fit = [], {}, models.fit

    def quick(df, name, features, label="label", balanced=False, **options):
        seen.append((name, len(features), options))
        if tuple(features) not in done:
            done[tuple(features)] = fit(df, "svm", features, label, maxIter=2)
        return done[tuple(features)]

    monkeypatch.setattr(models, "fit", quick)
    return seen


@pytest.mark.parametrize("name", ["m_lr", "m_gbt", "m_linear_svm", "m_status_audit"])
def test_all_folds_are_scored(spark, fits, name):
    table = "orders" if name == "m_status_audit" else "lineitem"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    out = audits.QUERIES[name](spark, SF).collect()
    assert all(r["n"] == n and r["n_folds"] == 5 for r in out) and len(out) == (3 if table == "orders" else 2)
    assert len(fits) == 10 and all(not options for _, _, options in fits)
