"""Composite audits with models. No SQL can express the fits; tests hold their rows against known bands.

Sweeps simulate many small tables in one plan, label each fold by its own training quartile, fit one small model a
task and roll the folds' metrics up. Audits of the driver's tables fit pyspark.ml models on whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions import formulas as fx
from foldwise.functions.hashing import uniform
from foldwise.operators import attribution, checks, contaminate, forests, joins, manyfits, metrics, ranking, rollup, sealed, splits, stats, treegrids
from foldwise.plans import models, queries
from foldwise.plans.simulate import POPULATION, SCENARIOS, simulate
from foldwise.sources.scratch import written
from foldwise.sources.tables import parquet

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FOLDS, N = 5, 1500
FEATURES = fx.PREDICTORS


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- sweeps over simulated tables --------------------------------------------


def in_folds(rows: DataFrame, run: Sequence[str], outcome: str = fx.TARGET, q: float = 0.25, side: str = "low", scope: str = "fold", k: int = FOLDS, seed=0) -> DataFrame:
    """Rows of many runs, once for each fold, with ``is_test`` and the fold's ``label``.

    Folds are stratified by the run's overall label. The label's threshold is a quantile of the fold's training
    rows, or with ``scope="global"`` of all the run's rows, which leaks.
    """
    rows = written(rows, "runs")
    whole = rows.groupBy(*run).agg(F.percentile(outcome, F.lit(q)).alias("__q"))
    rows = rows.join(F.broadcast(whole), list(run)).withColumn("__y0", fx.binarise(F.col(outcome), F.col("__q"), side))
    rows = rows.withColumn("__u", uniform(*run, "record_id", seed=seed))
    rows = ranking.row_numbers(rows, [*run, "__y0"], [F.col("__u"), F.col("record_id")], F.lit(0), "__rn")
    rows = rows.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__u", "__y0")
    each = models.for_each_fold(rows, k)
    if scope == "global":
        each = each.withColumn("threshold", F.col("__q"))
    else:
        fitted = each.where("not is_test").groupBy(*run, "k").agg(F.percentile(outcome, F.lit(q)).alias("threshold"))
        each = each.join(fitted, [*run, "k"])
    return written(each.withColumn("label", fx.binarise(F.col(outcome), F.col("threshold"), side)).drop("__q"), "in-folds")


def over_folds(each: DataFrame, run: Sequence[str], features: Sequence[str], **how) -> DataFrame:
    """``run, auroc, pr_auc, brier, n_folds``: means over folds that have both classes, of one small fit a fold."""
    per = models.fit_and_measure(each, [*run, "k"], features, **how)
    return per.groupBy(*run).agg(*[F.avg(c).alias(c) for c in ("auroc", "pr_auc", "brier")], F.count(F.lit(1)).alias("n_folds"))


#: The sealed pipeline: each fold is clipped and scaled by its training rows, which are then balanced.
SEALED = {"winsor": True, "balance": True}


def cross_validated(rows: DataFrame, run: Sequence[str], features: Sequence[str] = FEATURES, how: dict = SEALED, **label) -> DataFrame:
    return over_folds(in_folds(rows, run, **label), run, features, **how)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def many(spark: SparkSession, configs: dict[str, dict], name: str, seeds: Sequence[int], n: int = N) -> DataFrame:
    """Simulated tables of several named configurations and seeds."""
    return _union([simulate(spark, c, seeds, n).withColumn(name, F.lit(k)) for k, c in configs.items()])


def scenario_sweep_rows(spark, seeds, n=N) -> DataFrame:
    return many(spark, {s: {"scenario": s} for s in SCENARIOS}, "scenario", seeds, n)


def seeds_to(n: int) -> tuple[int, ...]:
    return tuple(range(1, n + 1))


@query
def m_scenario_sweep(spark, sf_dir=None, seeds=seeds_to(100)):
    """Each scenario's clean, follow-up-leaking and target-leaking discrimination over seeds."""
    pipelines = {"clean": FEATURES, "follow_up": [*FEATURES, fx.FOLLOW_UP], "target": [*FEATURES, fx.TARGET]}
    run = ["scenario", "seed"]
    each = in_folds(scenario_sweep_rows(spark, seeds), run)
    out = written(_union([over_folds(each, run, f, **SEALED).withColumn("pipeline", F.lit(p)) for p, f in pipelines.items()]), "sweep")
    return rollup.summary(out, ["scenario", "pipeline"], "auroc")


@query
def m_sample_size_sweep(spark, sf_dir=None, sizes=(300, 500, 750, 1500, 3000, 6000, 10000, 50000, 100000), seeds=seeds_to(2)):
    """Discrimination by sample size, with the percentile equivalence rule. The training rows are not balanced."""
    parts = [scenario_sweep_rows(spark, seeds, n).withColumn("n_rows", F.lit(n)) for n in sizes]
    out = cross_validated(_union(parts), ["scenario", "n_rows", "seed"], how={"winsor": True})
    return rollup.summary(written(out, "sweep"), ["scenario", "n_rows"], "auroc").withColumn("equivalent", rollup.equivalence())


@query
def m_noise_sweep(spark, sf_dir=None, seeds=seeds_to(20)):
    """Outcome noise at several levels, clean and leaking; rows in the order of the levels."""
    levels = [f"noise_x{x}" for x in contaminate.NOISE_LEVELS]
    rows = many(spark, {k: contaminate.shifted(POPULATION, k) for k in levels}, "noise", seeds)
    run = ["noise", "seed"]
    each = in_folds(rows, run)
    parts = [over_folds(each, run, f, **SEALED).withColumn("pipeline", F.lit(p)) for p, f in (("clean", FEATURES), ("follow_up", [*FEATURES, fx.FOLLOW_UP]))]
    out = rollup.summary(written(_union(parts), "sweep"), ["noise", "pipeline"], "auroc")
    return out.withColumn("flag", F.when(F.col("pipeline") == "clean", rollup.clean_flag(F.col("mean"))).otherwise(rollup.leaky_flag(F.col("mean")))).orderBy(rollup.category_order("noise", levels), "pipeline")


@query
def m_measurement_noise(spark, sf_dir=None, seeds=seeds_to(20), multiples=(0.5, 1.0, 1.5, 2.0, 3.0)):
    """Measurement noise on the follow-up, and what the analytic curve expects; ``mean_inverse_square`` is the mean of 1/a^2."""
    rows = written(simulate(spark, {}, seeds, N), "simulated")
    parts = [contaminate.with_noise(rows, fx.FOLLOW_UP, m * POPULATION["tcr_sd"], 17).withColumn("multiple", F.lit(m)) for m in multiples]
    out = cross_validated(_union(parts), ["multiple", "seed"], [*FEATURES, fx.FOLLOW_UP], how={"winsor": True})
    out = rollup.summary(written(out, "sweep"), ["multiple"], "auroc")
    moments = rows.agg(F.avg(1.0 / (F.col("tg0h") * F.col("tg0h"))).alias("mean_inverse_square")).first()["mean_inverse_square"]
    ratio = {m: 100 * moments**0.5 * m for m in multiples}
    expected = F.create_map(*[F.lit(x) for m in multiples for x in (m, stats.expected_auroc_under_noise(ratio[m]))])
    return out.withColumns({"expected": expected[F.col("multiple")], "mean_inverse_square": F.lit(moments)})


#: Settings of the missingness sweep, by mechanism, rate and the column that missingness depends on.
MISSING = {
    "complete": None,
    "MCAR_5pct": ("MCAR", 0.05, None),
    "MCAR_10pct": ("MCAR", 0.10, None),
    "MCAR_20pct": ("MCAR", 0.20, None),
    "MAR_bmi": ("MAR", 0.10, "bmi"),
    "MAR_tg0h": ("MAR", 0.10, "tg0h"),
}
HOLES = ("hct", "tp", "hdl", "ldl")


@query
def m_missingness_sweep(spark, sf_dir=None, seeds=seeds_to(20)):
    """Missingness mechanisms and rates, imputed by training or by overall medians."""
    rows, key = written(simulate(spark, {"scenario": "weak_signal"}, seeds, N), "simulated"), ["seed", "record_id"]
    parts = []
    for name, setting in MISSING.items():
        t = rows
        for c in HOLES if setting else ():
            how, rate, driver = setting
            t = contaminate.missing_at_random(t, c, rate, key, 5, by=["seed"]) if how == "MCAR" else contaminate.missing_by(t, c, driver, rate, key, 5, by=["seed"])
        parts.append(t.withColumn("setting", F.lit(name)))
    run = ["setting", "seed"]
    each = in_folds(_union(parts), run)
    rates = written(each.where("is_test").groupBy(*run).agg(contaminate.missing_rate(HOLES).alias("actual_rate")), "rates")
    out = []
    for strategy in ("fold", "global"):
        fitted = each.where("not is_test") if strategy == "fold" else each
        medians = fitted.groupBy(*run, "k").agg(*[F.median(c).alias(f"__{c}") for c in HOLES])
        filled = each.join(medians, [*run, "k"]).withColumns({c: F.coalesce(c, f"__{c}") for c in HOLES})
        out.append(over_folds(filled, run, FEATURES, **SEALED).join(rates, run).withColumn("strategy", F.lit(strategy)))
    out = _union(out).groupBy("setting", "strategy")
    return out.agg(F.avg("auroc").alias("auroc_mean"), F.coalesce(F.stddev_samp("auroc"), F.lit(0.0)).alias("auroc_sd"), F.avg("brier").alias("brier_mean"), F.avg("actual_rate").alias("actual_rate"))


#: Settings of the outlier stress: share of rows, and which values are made implausible.
OUTLIERS = {
    "clean_0pct": (0.0, []),
    "neg_tg4h_1pct": (0.01, ["neg_tg4h"]),
    "neg_tg4h_5pct": (0.05, ["neg_tg4h"]),
    "ext_hct_1pct": (0.01, ["extreme_hct"]),
    "ext_hct_5pct": (0.05, ["extreme_hct"]),
    "ext_tp_1pct": (0.01, ["extreme_tp"]),
    "mixed_1pct": (0.01, ["neg_tg4h", "extreme_hct", "extreme_tp"]),
    "mixed_5pct": (0.05, ["neg_tg4h", "extreme_hct", "extreme_tp"]),
}


@query
def m_outlier_sweep(spark, sf_dir=None, seeds=seeds_to(15)):
    """Implausible values against four ways of cleaning, with counts of what is out of range."""
    rows, run = written(simulate(spark, {"scenario": "wbv_positive"}, seeds, N), "simulated"), ["setting", "seed"]
    t = _union([contaminate.inject_outliers(rows, kinds, rate, ["seed", "record_id"], 9, by=["seed"]).withColumn("setting", F.lit(s)) for s, (rate, kinds) in OUTLIERS.items()])
    t = written(t, "outliers")
    bounds = {c: b for c, b in contaminate.PLAUSIBLE.items() if c in FEATURES}
    bad = t.groupBy(*run).agg(*contaminate.out_of_range(contaminate.PLAUSIBLE))
    n_bad = sum((F.col(f"{c}_out") for c in contaminate.PLAUSIBLE), F.lit(0))
    each = in_folds(t, run)
    names = list(bounds)
    quantiles = lambda d, keys: d.groupBy(*keys).agg(*[F.percentile(c, F.lit([0.01, 0.99])).alias(f"__{c}") for c in names])

    def clipped(params: DataFrame, keys: list[str]) -> DataFrame:
        return each.join(params, keys).withColumns({c: fx.clip(F.col(c), F.col(f"__{c}")[0], F.col(f"__{c}")[1]) for c in names})

    tables = {
        "no_cleaning": each,
        "global_cleaning": clipped(quantiles(t, run), run),
        "fold_cleaning": clipped(quantiles(each.where("not is_test"), [*run, "k"]), [*run, "k"]),
        "prespecified_clean": contaminate.cleaned(each, bounds),
    }
    parts = [over_folds(d, run, FEATURES, balance=True).withColumn("strategy", F.lit(s)) for s, d in tables.items()]
    out = _union(parts).join(bad.select(*run, n_bad.alias("n_implausible")), run)
    return out.groupBy("setting", "strategy").agg(F.avg("auroc").alias("auroc_mean"), F.coalesce(F.stddev_samp("auroc"), F.lit(0.0)).alias("auroc_sd"), F.avg("n_implausible").alias("n_implausible"))


@query
def m_leak_benchmark(spark, sf_dir=None, seeds=seeds_to(10), scenario="null"):
    """The clean pipeline against eight leaks: discrimination, and inflation over clean. Features are selected for each seed by itself."""
    rows, run = written(simulate(spark, {"scenario": scenario}, seeds, N), "simulated"), ["seed"]
    leaky = [*FEATURES, fx.FOLLOW_UP]
    sealed_, open_ = in_folds(rows, run), in_folds(rows, run, scope="global")
    tails = rows.groupBy("seed").agg(*[F.percentile(c, F.lit([0.01, 0.99])).alias(f"__{c}") for c in leaky])
    winsor = written(open_.join(tails, "seed").withColumns({c: fx.clip(F.col(c), F.col(f"__{c}")[0], F.col(f"__{c}")[1]) for c in leaky}), "winsor")

    def scaled(t: DataFrame, columns: Sequence[str]) -> DataFrame:
        moments = t.where("k = 0").groupBy("seed").agg(*[f(c).alias(f"__{k}{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        return t.join(moments, "seed").withColumns({c: (F.col(c) - F.col(f"__m{c}")) / F.col(f"__s{c}") for c in columns})

    selected = []
    for seed in seeds:  # the leak is in each run: its own five best features over all its rows
        one = open_.where(F.col("seed") == seed)
        best = stats.top_k(stats.anova_f(one.where("k = 0"), FEATURES, "label"), "f", 5)
        selected.append(over_folds(one, run, [r["feature"] for r in best.collect()]))
    fits = {
        "clean": (sealed_, FEATURES, SEALED),
        "follow_up": (sealed_, leaky, SEALED),
        "target": (sealed_, [*FEATURES, fx.TARGET], SEALED),
        "global_scaling": (scaled(open_, FEATURES), FEATURES, {}),
        "global_winsor": (winsor, FEATURES, {}),
        "global_threshold": (open_, FEATURES, {}),
        "smote_before_cv": (_balanced_before(open_, FEATURES), FEATURES, {}),
        "combined": (_balanced_before(scaled(winsor, leaky), leaky), leaky, {}),
    }
    parts = [over_folds(d, run, f, **how).withColumn("pipeline", F.lit(p)) for p, (d, f, how) in fits.items()]
    parts.append(_union(selected).withColumn("pipeline", F.lit("selection_before_cv")))
    out = joins.against_baseline(written(_union(parts), "sweep"), "auroc", ["seed"])
    return out.groupBy("pipeline").agg(F.avg("auroc").alias("auroc_mean"), F.coalesce(F.stddev_samp("auroc"), F.lit(0.0)).alias("auroc_sd"), F.avg("pr_auc").alias("pr_auc_mean"), F.avg("brier").alias("brier_mean"), F.avg("delta").alias("auc_inflation"))


def _balanced_before(each: DataFrame, features: Sequence[str]) -> DataFrame:
    """Synthetic rows made from all rows and then dealt to the folds: the leak of oversampling before splitting."""
    names = list(features)

    def work(pdf):
        x, y = models.oversample(pdf[names].to_numpy(float), pdf["label"].to_numpy(float), 3)
        extra = len(x) - len(pdf)
        fold = np.r_[pdf["fold"].to_numpy(), np.arange(extra) % FOLDS]
        import pandas as pd

        out = pd.DataFrame(x, columns=names)
        return out.assign(seed=pdf["seed"].iloc[0], k=pdf["k"].iloc[0], label=y.astype(int), is_test=fold == pdf["k"].iloc[0])

    schema = ", ".join(f"{c} double" for c in names) + ", seed int, k int, label int, is_test boolean"
    return each.select("seed", "k", "fold", "label", *[F.col(c).cast("double").alias(c) for c in names]).groupBy("seed", "k").applyInPandas(work, schema)


@query
def m_formula_benchmarks(spark, sf_dir=None, seeds=seeds_to(10)):
    """Outcomes by difference and by ratio, labelled by their overall upper quartile; clean against follow-up."""
    rows = simulate(spark, {}, seeds, N)
    a, b = F.col("tg0h"), F.col("tg4h")
    parts = []
    for name in ("difference", "ratio"):
        _, side, q = fx.OUTCOMES[name]
        t = rows.withColumn("outcome", fx.outcome(name, a, b))
        each = in_folds(t, ["seed"], "outcome", q, side, "global")
        for p, f in (("clean", FEATURES), ("follow_up", [*FEATURES, fx.FOLLOW_UP])):
            parts.append(over_folds(each, ["seed"], f).withColumns({"formula": F.lit(name), "pipeline": F.lit(p)}))
    return joins.against_baseline(_union(parts), "auroc", ["formula", "seed"]).groupBy("formula", "pipeline").agg(F.avg("auroc").alias("auroc_mean"), F.avg("delta").alias("delta_mean"), F.count(F.lit(1)).alias("n"))


@query
def m_domain_shift(spark, sf_dir=None, seeds=seeds_to(10)):
    """Train on the original population, test on shifted ones, before and after recalibration on a small sample."""
    base = simulate(spark, {"scenario": "weak_signal"}, seeds, N).withColumn("part", F.lit("train"))
    kinds = ["none", "tg0h_shift", "bmi_shift", "noise_shift", "prevalence_shift"]
    cfg = POPULATION | {"scenario": "weak_signal"}
    tests = many(spark, {k: contaminate.shifted(cfg, k) for k in kinds}, "shift", [s + 1000 for s in seeds])
    tests = tests.withColumns({"seed": F.col("seed") - 1000, "part": F.lit("test")})
    train = base.withColumn("shift", F.explode(F.array(*[F.lit(k) for k in kinds])))
    q = base.groupBy("seed").agg(F.percentile(fx.TARGET, F.lit(0.25)).alias("q25"), F.percentile(fx.TARGET, F.lit(0.35)).alias("q35"))
    both = train.unionByName(tests).join(F.broadcast(q), "seed")
    cut = F.when((F.col("shift") == "prevalence_shift") & (F.col("part") == "test"), F.col("q35")).otherwise(F.col("q25"))
    both = written(both.withColumns({"label": (F.col(fx.TARGET) <= cut).cast("int"), "is_test": F.col("part") == "test"}), "shifts")
    parts = []
    for p, f in (("clean", FEATURES), ("follow_up", [*FEATURES, fx.FOLLOW_UP])):
        scores = models.fit_and_score(both, ["shift", "seed"], f, carry=["record_id"]).withColumn("pipeline", F.lit(p))
        parts.append(scores)
    scores = written(_union(parts), "scores")
    keys = ["shift", "pipeline", "seed"]
    first = F.substring("record_id", 4, 5).cast("int") <= 200
    # recalibration: one logistic of the label on the score's logit, fitted on the first 200 test rows
    logit = fx.logit(F.col("score"))
    recal = models.fit_and_score(scores.withColumns({"x": logit, "cal": ~first}), keys, ["x"], is_test="cal", c=1e6)
    before = metrics.auroc(scores, keys, "score", "label").join(metrics.calibration_error(scores, keys, "score", "label"), keys)
    after = metrics.calibration_error(recal, keys, "score", "label").withColumnRenamed("ece", "ece_recalibrated")
    out = before.join(after, keys).join(scores.groupBy(*keys).agg(F.avg("label").alias("prevalence")), keys)
    return out.groupBy("shift", "pipeline").agg(*[F.avg(c).alias(c) for c in ("auroc", "ece", "ece_recalibrated", "prevalence")])


@query
def m_repeated_cv(spark, sf_dir=None, repeats=(1, 2, 3)):
    """One table, several fold assignments."""
    rows = simulate(spark, {"scenario": "moderate_signal"}, 2026, N).withColumn("seed", F.explode(F.array(*[F.lit(r) for r in repeats])))
    return cross_validated(rows, ["seed"])


@query
def m_simulated_validation(spark, sf_dir=None):
    """The validation report of each scenario's table."""
    return _union([checks.validation_report(simulate(spark, {"scenario": s}, 2026, N), s).withColumn("scenario", F.lit(s)) for s in SCENARIOS])


@query
def m_confirmatory(spark, sf_dir=None, seeds=seeds_to(100)):
    """Whether each pre-specified band holds."""
    out = written(m_scenario_sweep(spark, sf_dir, seeds), "bands")
    rows = []
    for (scenario, pipeline), (lo, hi) in checks.CONFIRM.items():
        hit = out.where((F.col("scenario") == scenario) & (F.col("pipeline") == pipeline))
        rows.append(hit.select("scenario", "pipeline", "mean", F.lit(lo).alias("low"), F.lit(hi).alias("high"), checks.confirmed(scenario, pipeline, F.col("mean")).alias("holds")))
    return _union(rows)


@query
def m_preprocessor(spark, sf_dir):
    """The composite preprocessor over the whole paired table: training moments of what it makes, by fold and scope."""
    from foldwise.operators.sealed import FoldSealedPreprocessor

    d = queries.with_missing(spark, sf_dir)
    parts = []
    for scope in ("fold", "global"):
        p = FoldSealedPreprocessor(["a", "qty", "tax"], ["flag"], scope)
        out = p.fit_transform(d.select("rid", "fold", "a", "qty", "tax", "flag"))
        made = [c for c in out.columns if c.endswith("_z")]
        parts.append(out.groupBy("fold").agg(*[F.avg(c).alias(f"mean_{c}") for c in made], *[F.stddev_pop(c).alias(f"sd_{c}") for c in made]).withColumn("scope", F.lit(scope)))
    return _union(parts)


# -- audits of whole tables with pyspark.ml ----------------------------------


def _each_fold(spark, work) -> list:
    """``work(k)`` of every fold; the fits of different folds run side by side, as many of their jobs are short."""
    with ThreadPool(FOLDS) as pool:
        return pool.map(inheritable_thread_target(spark)(work), range(FOLDS))


def _rounds(spark, sf_dir):
    """The paired table by round: for fold k, all rows labelled by the threshold of k's training rows."""
    f = queries.folded(spark, sf_dir)
    cuts = {r["fold"]: r["threshold"] for r in sealed.fit_threshold(f, "y", 0.25, folds=FOLDS).collect()}
    d = f.select("rid", "fold", "y", "a", "qty", "tax", "b")
    return lambda k: d.withColumn("label", (F.col("y") <= F.lit(cuts[k])).cast("int"))


PIPELINES = {"clean": ["a", "qty", "tax"], "follow_up": ["a", "qty", "tax", "b"]}


def _scored_by(spark, sf_dir, name: str, **options) -> DataFrame:
    """The whole paired table scored out of fold, clean and with the follow-up: each fold by a model trained on the others."""
    in_round = _rounds(spark, sf_dir)

    def work(k: int) -> DataFrame:
        d, parts = in_round(k), []
        for p, f in PIPELINES.items():
            m = models.fit(d.where(F.col("fold") != k), name, f, **options)
            parts.append(models.predict(m, d.where(F.col("fold") == k)).select("rid", "fold", "label", "score", F.lit(p).alias("pipeline")))
        return _union(parts)

    return written(_union(_each_fold(spark, work)), "scored")


def _over_folds(per: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows in all, and the mean of each fold's values."""
    return per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), *[F.avg(v).alias(v) for v in values], F.count("auroc").alias("n_folds"))


def _ml_audit(name: str, **options):
    def run(spark, sf_dir):
        s, by = _scored_by(spark, sf_dir, name, **options), ["pipeline", "fold"]
        per = metrics.discrimination(s, by, "score", "label")
        return _over_folds(per, ["pipeline"], ["auroc", "average_precision"]).withColumn("model", F.lit(name))

    run.__doc__ = f"Cross-validated discrimination of {name} on the whole paired table, clean and leaking: means over the folds."
    return run


QUERIES["m_lr"] = _ml_audit("lr")
QUERIES["m_gbt"] = _ml_audit("xgb")
QUERIES["m_linear_svm"] = _ml_audit("linear_svm")


def kernel_scores(d: DataFrame, features: Sequence[str], row: str, fold: str, label, landmarks: int = 50, folds: int = FOLDS) -> tuple[DataFrame, list[float]]:
    """Rows with ``score``, from kernel machines of the other folds calibrated by Platt's method, and each fold's kernel error.

    Columns are standardised and landmarks drawn (by the smallest hashes) from each round's training rows. Platt's line is fitted to
    training rows scored out of fold. All machines of all rounds are fitted side by side, and so are all lines.
    ``label(k)`` is the label's column in round k.
    """
    xs, p = [f"x{j}" for j in range(len(features))], len(features)
    rows = d.select(F.col(row).alias("row"), F.col(fold).alias("fold"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)], *[label(k).cast("int").alias(f"y{k}") for k in range(folds)]).dropna()
    rows = written(rows.withColumn("u", uniform("row", seed="landmarks")), "rows")

    def rounds(pdf):
        x, of = manyfits.with_ones(pdf, xs), pdf["fold"].to_numpy()
        for k in range(folds):
            yield k, x, pdf[f"y{k}"].to_numpy(float), of

    about = manyfits.moments(rows, folds, p + 1, lambda pdf: ((k, x[of != k], y[of != k], np.ones((of != k).sum())) for k, x, y, of in rounds(pdf)))
    first = rows.orderBy("u", "row").select("fold", *xs).limit(4 * landmarks * folds).collect()  # a bounded number of rows
    maps = []
    for k in range(folds):
        points = np.array([r[1:] for r in first if r["fold"] != k][:landmarks], float).reshape(-1, p)
        maps.append(models.Landmarks(points, about["mean"][k, 1:], about["sd"][k, 1:]))
    size, width = folds * folds, landmarks + 1
    z = lambda k, x: np.column_stack([np.ones(len(x)), np.pad(maps[k](x[:, 1:]), ((0, 0), (0, landmarks - len(maps[k].points))))])

    def training(pdf):
        """Round k without fold j; j = k is the round's own machine."""
        for k, x, y, of in rounds(pdf):
            zk = z(k, x)
            for j in range(folds):
                on = (of != k) & (of != j)
                yield k * folds + j, zk[on], y[on], np.ones(on.sum())

    ridge = np.r_[0.0, np.ones(landmarks)]
    w = manyfits.fit_many(rows, size, width, training, ridge, loss="squared_hinge")

    def margins(pdf):
        for k, x, y, of in rounds(pdf):
            zk = z(k, x)
            for j in range(folds):
                on = of == j
                if j != k:
                    yield k, np.column_stack([np.ones(on.sum()), zk[on] @ w[k * folds + j]]), y[on], np.ones(on.sum())

    line = manyfits.fit_many(rows, folds, 2, margins, np.full((folds, 2), 1e-9))
    short = manyfits.sums(rows, folds, 2, lambda pdf: ((k, np.r_[(of == k).sum(), (1 - (z(k, x[of == k])[:, 1:] ** 2).sum(1)).sum()]) for k, x, y, of in rounds(pdf)))

    def score(batches):
        for pdf in batches:
            for k, x, y, of in rounds(pdf):
                on = of == k
                if on.any():
                    m = z(k, x[on]) @ w[k * folds + k]
                    yield pdf.loc[on, ["row", "fold"]].assign(label=y[on].astype("int32"), margin=m, score=1 / (1 + np.exp(-np.clip(line[k, 0] + line[k, 1] * m, -500, 500))))

    types = dict(rows.dtypes)
    out = written(rows.mapInPandas(score, f"row {types['row']}, fold {types['fold']}, label int, margin double, score double"), "scored")
    return out.withColumnRenamed("row", row), (short[:, 1] / np.maximum(short[:, 0], 1)).tolist()


@query
def m_kernel_svm(spark, sf_dir):
    """A kernel machine on 50 landmarks, calibrated by Platt's method: cross-validated means over the folds, and the mean kernel error."""
    f = queries.folded(spark, sf_dir)
    cuts = {r["fold"]: r["threshold"] for r in sealed.fit_threshold(f, "y", 0.25, folds=FOLDS).collect()}
    s, error = kernel_scores(f, PIPELINES["clean"], "rid", "fold", lambda k: F.col("y") <= F.lit(cuts[k]))
    per = metrics.auroc(s, ["fold"], "score", "label").join(s.groupBy("fold").agg(metrics.brier("score", "label").alias("brier")), "fold")
    return _over_folds(per, [], ["auroc", "brier"]).withColumn("kernel_error", F.lit(float(np.mean(error))))


def _labelled_by_round(spark, sf_dir) -> DataFrame:
    """The paired table with a label for each round, ``y0 ... y4``, cut by the round's training rows."""
    f = queries.folded(spark, sf_dir)
    cuts = {r["fold"]: r["threshold"] for r in sealed.fit_threshold(f, "y", 0.25, folds=FOLDS).collect()}
    return written(f.select("rid", "fold", "a", "qty", "tax", "b", *[(F.col("y") <= F.lit(cuts[k])).cast("int").alias(f"y{k}") for k in range(FOLDS)]), "rounds")


#: Rows of a task that scores or explains by tables of trees, at least.
TASK_ROWS = 100_000


def _forests(d: DataFrame, pipelines: dict[str, Sequence[str]], trees: int) -> dict:
    n = d.count() * (FOLDS - 1) // FOLDS
    member = lambda pdf, k: (pdf["fold"].to_numpy() != k, pdf[f"y{k}"].to_numpy())
    return forests.as_arrays(forests.forests(d.select("rid", "fold", "a", "qty", "tax", "b", *[f"y{k}" for k in range(FOLDS)]), ["rid"], ["a", "qty", "tax", "b"], range(FOLDS), member, pipelines, n, trees, seed=models.SEED))


def _of_fold(d: DataFrame, k: int, n: int) -> DataFrame:
    """A fold's rows in tasks that are worth a forest's tables."""
    return d.where(F.col("fold") == k).coalesce(-(-n // (FOLDS * TASK_ROWS)) or 1)


@query
def m_rf(spark, sf_dir, trees: int = 200):
    """Forests of bounded bags, without a limit of depth, on the whole paired table, clean and leaking: means over the folds."""
    d, names = _labelled_by_round(spark, sf_dir), PIPELINES["follow_up"]
    grown, n = _forests(d, PIPELINES, trees), d.count()

    def scores_of(k: int) -> DataFrame:
        mine = spark.sparkContext.broadcast({p: grown[k, p] for p in PIPELINES if (k, p) in grown})

        def score(batches):
            for pdf in treegrids.chunks(batches):
                x = pdf[names].to_numpy(float)
                for p, forest in mine.value.items():
                    yield pdf[["fold", "label"]].assign(score=forests.predict(x, forest), pipeline=p)

        rows = _of_fold(d, k, n).select("fold", F.col(f"y{k}").alias("label"), *names)
        return rows.mapInPandas(score, "fold int, label int, score double, pipeline string")

    s, by = written(_union([scores_of(k) for k in range(FOLDS)]), "scored"), ["pipeline", "fold"]
    per = metrics.discrimination(s, by, "score", "label")
    return _over_folds(per, ["pipeline"], ["auroc", "average_precision"]).withColumn("model", F.lit("rf"))


@query
def m_calibration(spark, sf_dir):
    """Platt and isotonic calibration of document length as a quality score: Brier and calibration error of each."""
    j = queries.judged(spark, sf_dir).where("task = 'quality'").withColumn("fit", uniform("doc_id", seed=3) < 0.5)
    train, test = j.where("fit"), j.where("not fit")
    versions = {"raw": test.withColumn("p", F.col("score"))}
    for name, fitter in (("platt", models.platt), ("isotonic", models.isotonic)):
        versions[name] = models.calibrated(fitter(train, "score", "label"), test, "score", "p")
    parts = []
    for name, t in versions.items():
        a, b = metrics.calibration_line(t, "p", "label")
        one = metrics.calibration_error(t, [], "p", "label").join(F.broadcast(t.agg(metrics.brier("p", "label").alias("brier"))))
        parts.append(one.withColumns({"version": F.lit(name), "intercept": F.lit(a), "slope": F.lit(b)}))
    return _union(parts)


@query
def m_oof_calibration(spark, sf_dir):
    """Calibration of the logistic model's out-of-fold scores of the whole paired table, clean and leaking: errors by equal widths and by deciles, Brier score, intercept and slope."""
    s, parts = _scored_by(spark, sf_dir, "lr"), []
    for p in PIPELINES:
        t = s.where(F.col("pipeline") == p)
        a, b = metrics.calibration_line(t, "score", "label")
        width = metrics.calibration_error(t, [], "score", "label").first()["ece"]
        deciles = metrics.calibration_error(t, [], "score", "label", metrics.quantile_edges(t, "score", 10)).first()["ece"]
        one = t.agg(F.count(F.lit(1)).alias("n"), metrics.brier("score", "label").alias("brier"))
        parts.append(one.select(F.lit(p).alias("pipeline"), "n", "brier", F.lit(width).alias("ece"), F.lit(deciles).alias("ece_deciles"), F.lit(a).alias("intercept"), F.lit(b).alias("slope")))
    return _union(parts)


@query
def m_smote(spark, sf_dir):
    """Class counts of the labelled documents before and after oversampling."""
    d = parquet(spark, sf_dir, "labels").join(parquet(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.select("doc_id", F.log1p("n_chars").alias("x"), F.sqrt(F.col("n_chars").cast("double")).alias("z"), F.col("quality").alias("label"))
    return models.smote(d, ["x", "z"], "label", ["doc_id"]).groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))


@query
def m_decision_curve(spark, sf_dir):
    """Net benefit of the clean and leaking logistic models, all rows scored out of fold, on 490 thresholds, wide."""
    s = _scored_by(spark, sf_dir, "lr")
    b = metrics.net_benefit(s, ["pipeline"], "score", "label", queries.GRID_490)
    wide = rollup.pivot(b, ["threshold", "treat_none"], "pipeline", ["clean", "follow_up"], "net_benefit", "max")
    return wide.join(b.where("pipeline = 'clean'").select("threshold", "treat_all"), "threshold")


def _status_audit(keys: Sequence[str]):
    def run(spark, sf_dir):
        o = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        o = o.withColumn("label", ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") <= 144000)).cast("int"))
        o = splits.stratified_folds(o, "label", ["o_orderkey"], FOLDS, 5)
        from foldwise.operators.sealed import apply_ordinal, fit_ordinal

        for c in ("o_orderpriority", "c_mktsegment", "o_orderstatus"):
            o = apply_ordinal(o, fit_ordinal(o, c), c, f"{c}_code").withColumn(f"{c}_code", F.col(f"{c}_code").cast("double"))
        o = written(o, "orders")
        clean = ["c_acctbal", "o_orderpriority_code", "c_mktsegment_code"]

        def work(k: int) -> DataFrame:
            parts = []
            for p, f in (("clean", clean), ("leaky", [*clean, *keys])):
                m = models.fit(o.where(F.col("fold") != k), "lr", f, balanced=True)
                parts.append(models.predict(m, o.where(F.col("fold") == k)).select("fold", "label", "score", F.lit(p).alias("pipeline")))
            return _union(parts)

        rule = o.select("fold", "label", F.col("label").cast("double").alias("score"), F.lit("oracle").alias("pipeline"))
        per = metrics.auroc(written(_union([*_each_fold(spark, work), rule]), "scored"), ["pipeline", "fold"], "score", "label")
        out = _over_folds(per, ["pipeline"], ["auroc"]).withColumn("unit", F.lit("all"))
        return joins.headroom(joins.against_baseline(out, "auroc", ["unit"])).drop("unit")

    run.__doc__ = "Status outcomes: clean predictors, with leaking columns, and the rule itself; cross-validated means over the folds."
    return run


QUERIES["m_status_audit"] = _status_audit(["o_totalprice", "o_orderstatus_code"])
QUERIES["m_proxy_audit"] = _status_audit(["o_orderstatus_code"])


@query
def m_event_pairs_audit(spark, sf_dir):
    """Paired events in three windows, with and without pairs that another event interrupts: clean, leaking, oracle."""
    e = queries.events(spark, sf_dir)
    left = e.where("event_type in ('purchase', 'click')").select("event_id", "user_id", "ts", "value")
    right = e.where("event_type in ('error', 'view')").select("event_id", "user_id", "ts", "value")
    widest = joins.asof_forward(left, right, ["user_id"], "ts", "48 hours", tie="event_id")
    parts = []
    for hours in (12, 24, 48):  # nearest first, so a narrower window is a filter of the widest
        pairs = widest.where(F.col("next_ts") <= F.col("ts") + F.expr(f"interval 1 second + interval {hours} hours"))
        for cohort, t in (("all", pairs), ("uninterrupted", joins.no_event_between(pairs, left, ["user_id"], "ts", "next_ts", "ts"))):
            parts.append(t.withColumns({"window": F.lit(hours), "cohort": F.lit(cohort)}))
    pairs = written(_union(parts).withColumn("drop", fx.outcome("drop", F.col("value"), F.col("next_value"))), "pairs")
    q = ranking.percentiles(pairs, ["window", "cohort"], "drop", {"q": 0.75})
    d = pairs.join(q, ["window", "cohort"]).withColumn("label", (F.col("drop") >= F.col("q")).cast("int"))
    rows = F.array(*[F.struct(F.lit(n).alias("pipeline"), s.alias("score")) for n, s in (("clean", F.hour("ts").cast("double")), ("baseline", F.col("value")), ("follow_up", -F.col("next_value")), ("oracle", F.col("drop")))])
    out = metrics.auroc(d.select("window", "cohort", "label", F.inline(rows)), ["window", "cohort", "pipeline"], "score", "label")
    return joins.headroom(joins.against_baseline(out, "auroc", ["window", "cohort"]))


@query
def m_subject_audit(spark, sf_dir):
    """Leave-one-subject-out AUROC of value against being a purchase, over usable subjects, with its interval."""
    e = parquet(spark, sf_dir, "events").select("user_id", "value", (F.col("event_type") == "purchase").cast("int").alias("label"))
    usable = splits.leave_one_group_out(e, "user_id", "label").where("usable").select("user_id")
    per = metrics.auroc(e.join(usable, "user_id", "left_semi"), ["user_id"], "value", "label")
    return rollup.summary(per, [], "auroc")


@query
def m_meal_cohort(spark, sf_dir):
    """Meals with peaks and outcomes, and the cohort's summary: subjects, meals, threshold and reconstruction error."""
    meals = queries.range_window_peak(spark, sf_dir).join(queries.events(spark, sf_dir).select("event_id", F.col("value").alias("pre"), F.hour("ts").alias("hour_of_day")), "event_id")
    meals = written(meals, "meals")
    q = ranking.percentiles(meals, [], "rise", {"q": 0.75}).first()["q"] or 0.0
    return meals.agg(
        F.count(F.lit(1)).alias("n_meals"), F.count_distinct("user_id").alias("n_subjects"), F.lit(q).alias("threshold"), F.avg((F.col("rise") >= F.lit(q)).cast("double")).alias("prevalence"),
        *checks.reconstruction_error("pre", "peak", "rise"),
    )


# -- attribution -------------------------------------------------------------


@query
def m_attribution(spark, sf_dir, trees: int = 100):
    """Mean |phi| and ranks of a forest (of 100 trees, as in the reference) and of a logistic model, clean and leaking, with distortions.

    Every row of the paired table is explained by the models of its round, which were trained on the other folds.
    """
    d, pipelines = _labelled_by_round(spark, sf_dir), {"clean": PIPELINES["clean"], "leaky": PIPELINES["follow_up"]}
    names, kinds = pipelines["leaky"], list(pipelines)
    grown, n = _forests(d, pipelines, trees), d.count()

    def training(pdf):
        x, fold = manyfits.with_ones(pdf, names), pdf["fold"].to_numpy()
        for k in range(FOLDS):
            on, y = (fold != k).astype(float), pdf[f"y{k}"].to_numpy(float)
            for p in range(len(kinds)):
                yield k * len(kinds) + p, x, y, on

    size, width, rows = FOLDS * len(kinds), len(names) + 1, d.drop("rid")
    about = manyfits.moments(rows, size, width, training)
    used = np.array([[True, *[c in pipelines[kinds[i % len(kinds)]] for c in names]] for i in range(size)])
    w = manyfits.fit_many(rows, size, width, training, manyfits.standard_ridge(about["sd"]), used)

    # each fold's rows by its own models; a forest's are explained a chunk at a time, a linear score's as one aggregate
    sums = {p: [attribution.mean_abs_of_trees(_of_fold(d, k, n), grown[k, p], names) for k in range(FOLDS) if (k, p) in grown] for p in pipelines}
    found = {"rf": {p: _union(x).groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("mean_abs")).where(F.col("feature").isin(*pipelines[p])) for p, x in sums.items()}}
    means = d.groupBy("fold").agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    at, every = d.join(F.broadcast(means), "fold"), F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])
    of = lambda p, c: F.abs(every[F.col("fold") * len(kinds) + kinds.index(p)][names.index(c) + 1] * (F.col(c) - F.col(f"m_{c}")))
    linear = at.agg(*[F.avg(of(p, c)).alias(f"{p}|{c}") for p in pipelines for c in pipelines[p]]).first()
    found["lr"] = {p: spark.createDataFrame([(c, linear[f"{p}|{c}"]) for c in pipelines[p]], "feature string, mean_abs double") for p in pipelines}

    parts = []
    for name, of_kind in found.items():
        ranks = {p: attribution.importance_ranks(written(x, "importance")) for p, x in of_kind.items()}
        parts.append(attribution.attribution_distortion(ranks["clean"], ranks["leaky"]).withColumn("classifier", F.lit(name)))
    return written(_union(parts), "attribution")


@query
def m_correlated_attribution(spark, sf_dir):
    """Independent and correlation-aware contributions of one linear score: mean |phi| of each."""
    p = queries.paired(spark, sf_dir)
    w = {"a": 0.001, "b": -0.002, "qty": 0.1}
    one = attribution.mean_abs(attribution.linear_contributions(p, w, ["rid"])).withColumnRenamed("mean_abs", "independent")
    return one.join(attribution.mean_abs(attribution.correlated_contributions(p, w, ["rid"])).withColumnRenamed("mean_abs", "correlated"), "feature")


@query
def m_adi_tests(spark, sf_dir):
    """Signed-rank tests of the distortions between two importance measures, by feature, Bonferroni-adjusted."""
    d = queries.distortions(spark, sf_dir).where("adi is not null")
    wide = rollup.pivot(d, ["boot_id", "feature"], "classifier", ["label", "target"], "adi", "max").dropna()
    out = stats.wilcoxon(wide.withColumn("d", (F.col("label") - F.col("target")).cast("double")), ["feature"], "d")
    return stats.bonferroni(out)


@query
def m_correlation_tests(spark, sf_dir):
    """Pearson, Spearman and partial correlations of the paired table with p-values."""
    p = queries.paired(spark, sf_dir)
    n = p.count()
    r = stats.correlations(p, ["qty", "y"]).where("a <> b").first()["r"]
    rho = stats.spearman(p, "qty", "y").first()["rho"]
    pr, pp = stats.partial_correlation(p, "qty", "y", ["a", "tax"])
    rows = [("pearson", r, stats.correlation_p(r, n)), ("spearman", rho, stats.correlation_p(rho, n)), ("partial", pr, pp)]
    return spark.createDataFrame([(k, float(x), float(z), n) for k, x, z in rows], "kind string, r double, p double, n long")
