"""Sweeps over simulated tables: their rows lie in the pre-specified bands, with few seeds."""

import pytest

from foldwise.plans import audits, queries

SF = "/root/testdata/sf0.001"


def test_scenarios_lie_in_their_bands(spark):
    got = {(r["scenario"], r["pipeline"]): r["mean"] for r in audits.m_scenario_sweep(spark, seeds=(1, 2, 3)).collect()}
    assert len(got) == 12
    assert 0.44 <= got["null", "clean"] <= 0.56 and got["null", "follow_up"] > 0.85 and got["null", "target"] > 0.95
    assert got["wbv_positive", "clean"] > 0.75 and 0.5 < got["weak_signal", "clean"] < got["moderate_signal", "clean"] < got["wbv_positive", "clean"]


def test_leaks_inflate(spark):
    got = {r["pipeline"]: r for r in audits.m_leak_benchmark(spark, seeds=(1, 2)).collect()}
    assert set(got) == {"clean", "follow_up", "target", "global_scaling", "global_winsor", "global_threshold", "smote_before_cv", "selection_before_cv", "combined"}
    assert all(got[p]["auc_inflation"] > 0.35 for p in ("follow_up", "target", "combined")) and got["clean"]["auc_inflation"] == 0
    assert all(abs(got[p]["auc_inflation"]) < 0.06 for p in ("global_scaling", "global_winsor", "global_threshold"))


def test_missingness_and_outlier_settings(spark):
    missing = audits.m_missingness_sweep(spark, seeds=(1, 2)).collect()
    assert len(missing) == 12 and {r["setting"] for r in missing} == set(audits.MISSING)
    for r in missing:
        setting = audits.MISSING[r["setting"]]
        assert r["actual_rate"] == pytest.approx(setting[1] if setting else 0.0, abs=0.02) and 0.5 < r["auroc_mean"] < 0.7
    outliers = audits.m_outlier_sweep(spark, seeds=(1, 2)).collect()
    assert len(outliers) == 32
    for r in outliers:
        assert (r["n_implausible"] == 0) == (r["setting"] == "clean_0pct") and r["auroc_mean"] > 0.6


def test_sample_sizes_and_noise(spark):
    sizes = {(r["scenario"], r["n_rows"]): r for r in audits.m_sample_size_sweep(spark, sizes=(300, 3000), seeds=(1, 2, 3, 4)).collect()}
    spread = {n: sum(r["sd"] for (_, m), r in sizes.items() if m == n) for n in (300, 3000)}
    assert len(sizes) == 8 and spread[300] > spread[3000]
    noise = sorted(audits.m_measurement_noise(spark, seeds=(1, 2), multiples=(0.5, 3.0)).collect(), key=lambda r: r["multiple"])
    assert noise[0]["mean"] > noise[1]["mean"] and noise[0]["expected"] > noise[1]["expected"]
    assert all(abs(r["mean"] - r["expected"]) < 0.06 for r in noise)


def test_out_of_fold_calibration(spark):
    rows = {r["pipeline"]: r for r in audits.m_oof_calibration(spark, SF).collect()}
    n = queries.paired(spark, SF).count()
    assert set(rows) == {"clean", "follow_up"} and all(r["n"] == n and 0 <= r["ece"] <= 0.2 and r["brier"] < 0.25 for r in rows.values())
