"""Audits of event cohorts and the paired table with models: grouped cross-validation, leave-one-subject-out, resampled fits.

All fits of an audit are made side by side by :mod:`foldwise.operators.manyfits`, so the table is read once a Newton round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions import formulas as fx
from foldwise.operators import attribution, joins, manyfits, metrics, ranking, resample, rollup, splits
from foldwise.plans import audits, queries
from foldwise.functions.hashing import uniform_sql
from foldwise.sources import table_functions
from foldwise.sources.scratch import shared_dir, written
from foldwise.sources.sinks import resume_cells
from foldwise.sources.tables import parquet

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FOLDS, SEED = 5, 42
MODELS = ("lr", "linear_svm")
INNER = 3


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- cohorts ------------------------------------------------------------------


def event_pairs(spark, sf_dir) -> DataFrame:
    """Purchases and clicks with the next error or view of the user within 12, 24 and 48 hours, and those that no other
    purchase or click interrupts: ``window, cohort``, what is known at the event, the follow-up and the outcome ``drop``."""
    e = queries.events(spark, sf_dir).where("value is not null and user_id is not null and ts is not null")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    left = e.where("event_type in ('purchase', 'click')").select("event_id", "user_id", "ts", "value", "event_type")
    right = e.where("event_type in ('error', 'view')").select("event_id", "user_id", "ts", "value")
    widest = written(joins.asof_forward(left, right, ["user_id"], "ts", "48 hours", tie="event_id"), "widest")
    parts = []
    for hours in (12, 24, 48):  # nearest first, so a narrower window is a filter of the widest
        pairs = widest.where(F.col("next_ts") <= F.col("ts") + F.expr(f"interval 1 second + interval {hours} hours"))
        for cohort, t in (("all", pairs), ("uninterrupted", joins.no_event_between(pairs, left, ["user_id"], "ts", "next_ts", "ts"))):
            parts.append(t.withColumns({"window": F.lit(hours), "cohort": F.lit(cohort)}))
    out = audits._union(parts).join(first, "user_id")
    elapsed = F.timestamp_diff("SECOND", "first_ts", "ts") / F.lit(86400.0)
    return out.select(
        "window", "cohort", "event_id", "user_id", "value", F.hour("ts").cast("double").alias("hour"), elapsed.alias("elapsed"), (F.col("event_type") == "purchase").cast("double").alias("kind"),
        "next_value", fx.outcome("drop", F.col("value"), F.col("next_value")).alias("drop"),
    )


PAIR_CLEAN = ("value", "hour", "elapsed", "kind")
PAIR_PIPELINES = {"clean": PAIR_CLEAN, "b_component": (*PAIR_CLEAN, "next_value"), "target_leaky": (*PAIR_CLEAN, "drop")}


def meals(spark, sf_dir) -> DataFrame:
    """Purchases as meals: pre-meal value, peak and rise over the next day, hour and meal type as numbers."""
    e = queries.events(spark, sf_dir)
    m = queries.range_window_peak(spark, sf_dir).join(e.select("event_id", F.col("value").alias("pre"), F.hour("ts").alias("h")), "event_id")
    types = [F.col("h").between(a, b).cast("double").alias(n) for n, a, b in (("breakfast", 5, 10), ("lunch", 11, 14), ("dinner", 17, 21))]
    return m.select("event_id", "user_id", "pre", F.col("h").cast("double").alias("hour"), *types, F.col("n_readings").cast("double").alias("readings"), "peak", "rise")


MEAL_CLEAN = ("pre", "hour", "breakfast", "lunch", "dinner")
MEAL_PIPELINES = {"clean": MEAL_CLEAN, "peak_leak": (*MEAL_CLEAN, "peak"), "target_leak": (*MEAL_CLEAN, "rise")}


# -- grouped cross-validation -------------------------------------------------


def grouped_scores(rows: DataFrame, tasks: Sequence[str], row: str, subject: str, outcome: str, pipelines: dict[str, Sequence[str]], q: float = 0.75, models: Sequence[str] = MODELS, folds: int = FOLDS, seed=SEED, c: float = 1.0, cut: float | None = None, balanced: bool = False) -> DataFrame:
    """``<tasks>, pipeline, model, fold, <row>, <subject>, label, score``: rows scored by models that never saw their subject.

    Folds keep subjects whole and have alike shares of high outcomes. Labels are cut at the training rows' percentile, or at
    ``cut``; columns are standardised by the training rows, and ``balanced`` weighs a fit's classes equally. ``lr`` is logistic, ``linear_svm`` a squared-hinge machine whose margins are calibrated by
    Platt's method in three inner folds, averaged. The rule itself is the pipeline ``oracle``. Every fit of every task, pipeline
    and fold is one of the cells of :func:`manyfits.fit_many`. Rows with nulls are left out.
    """
    names = list(dict.fromkeys(x for f in pipelines.values() for x in f))
    kinds, width = list(pipelines), len(names) + 1
    rows = rows.select(*tasks, F.col(row).alias("__row"), F.col(subject).alias("__subject"), F.col(outcome).cast("double").alias("__v"), *[F.col(x).cast("double").alias(f"__x{j}") for j, x in enumerate(names)]).dropna()
    rows = written(rows.withColumn("__task", F.concat_ws("|", *[F.col(t).cast("string") for t in tasks]) if tasks else F.lit("")), "rows")
    overall = ranking.percentiles(rows, ["__task"], "__v", {"__q": q})
    high = rows.join(F.broadcast(overall), "__task").withColumn("__y0", (F.col("__v") >= F.col("__q")).cast("int"))
    high = high if cut is None else high.withColumn("__y0", (F.col("__v") >= F.lit(float(cut))).cast("int"))
    fold = splits.stratified_group_folds(high, "__subject", "__y0", folds, seed, "__fold").drop("__q", "__y0")
    inner = F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(INNER)).cast("int").alias("__inner")
    rows = written(fold.select("*", inner), "folded")
    each = rows.select("__task", "__fold", "__v", F.explode(F.array(*[F.lit(k) for k in range(folds)])).alias("k")).where(F.col("k") != F.col("__fold"))
    cuts = {(r["__task"], r["k"]): r["q"] if cut is None else cut for r in ranking.percentiles(each, ["__task", "k"], "__v", {"q": q}).collect()}
    order = sorted({t for t, _ in cuts})
    at = {t: i for i, t in enumerate(order)}
    xs = [f"__x{j}" for j in range(len(names))]
    cell = lambda t, p, k: (t * len(kinds) + p) * folds + k
    size = max(1, len(order) * len(kinds) * folds)
    used = np.array([[True, *[x in pipelines[kinds[i // folds % len(kinds)]] for x in names]] for i in range(size)])

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pd.DataFrame]]:
        """Each task's rows with each fold that they train or test: task, fold, matrix, outcomes, rows."""
        for t, sub in pdf.groupby("__task", sort=False):
            x, v = manyfits.with_ones(sub, xs), sub["__v"].to_numpy()
            for k in range(folds):
                if (t, k) in cuts:
                    yield at[t], k, x, (v >= cuts[t, k]).astype(float), sub

    def training(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for t, k, x, y, sub in parts(pdf):
            on = (sub["__fold"].to_numpy() != k).astype(float)
            for p in range(len(kinds)):
                yield cell(t, p, k), x, y, on

    about = manyfits.moments(rows, size, width, training)
    ridge = manyfits.standard_ridge(about["sd"], c)
    weights = np.ones((2, size))  # of the classes, by fit
    if balanced:
        weights = about["n"] / (2 * np.maximum([about["n"] - about["pos"], about["pos"]], 1))

    def weighed(members, per: int = 1):
        if not balanced:
            return members
        return lambda pdf: ((i, x, y, one * np.where(y > 0, weights[1, i // per], weights[0, i // per])) for i, x, y, one in members(pdf))

    linear: dict[str, np.ndarray] = {}
    if "lr" in models:
        linear["lr"] = manyfits.fit_many(rows, size, width, weighed(training), ridge, used)
    if "linear_svm" in models:
        # margins of a squared-hinge fit on two inner folds calibrate on the third
        def inner_training(pdf: pd.DataFrame, held: bool = False):
            for t, k, x, y, sub in parts(pdf):
                mine, fold_ = sub["__inner"].to_numpy(), sub["__fold"].to_numpy()
                for j in range(INNER):
                    on = (fold_ != k) & ((mine == j) if held else (mine != j))
                    xj, yj, one = (x[on], y[on], np.ones(on.sum())) if held else (x, y, on.astype(float))
                    for p in range(len(kinds)):
                        yield cell(t, p, k) * INNER + j, xj, yj, one

        w = manyfits.fit_many(rows, size * INNER, width, weighed(inner_training, INNER), np.repeat(ridge, INNER, 0), np.repeat(used, INNER, 0), "squared_hinge")
        counts = manyfits.moments(rows, size * INNER, width, lambda pdf: inner_training(pdf, True))
        hi, lo = (counts["pos"] + 1) / (counts["pos"] + 2), 1 / (counts["n"] - counts["pos"] + 2)

        def margins(pdf: pd.DataFrame):
            for i, x, y, one in inner_training(pdf, True):
                yield i, np.column_stack([one, x @ w[i]]), np.where(y > 0, hi[i], lo[i]), one

        platt = manyfits.fit_many(rows, size * INNER, 2, margins, np.full((size * INNER, 2), 1e-9))
        linear["linear_svm"] = np.stack([w * platt[:, 1:], np.column_stack([platt[:, 0], np.zeros((len(w), width - 1))])])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, k, x, y, sub in parts(pdf):
                on = sub["__fold"].to_numpy() == k
                if not on.any():
                    continue
                kept, xk = sub.loc[on, [*tasks, "__row", "__subject", "__fold"]], x[on]
                made = [("oracle", "rule", sub["__v"].to_numpy()[on])]
                for p, kind in enumerate(kinds):
                    i = cell(t, p, k)
                    if "lr" in linear:
                        made.append((kind, "lr", 1 / (1 + np.exp(-np.clip(xk @ linear["lr"][i], -500, 500)))))
                    if "linear_svm" in linear:
                        of = linear["linear_svm"][:, i * INNER : (i + 1) * INNER].sum(0)
                        made.append((kind, "linear_svm", (1 / (1 + np.exp(-np.clip(xk @ of.T, -500, 500)))).mean(1)))
                for pipeline, model, s in made:
                    yield kept.assign(pipeline=pipeline, model=model, label=y[on].astype("int32"), score=s)

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{t}` {types[t]}" for t in tasks], f"__row {types['__row']}", f"__subject {types['__subject']}", "__fold int", "pipeline string", "model string", "label int", "score double"])
    out = rows.mapInPandas(score, schema).withColumnsRenamed({"__row": row, "__subject": subject, "__fold": "fold"})
    return written(out, "scored")


def grouped_audit(rows: DataFrame, tasks: Sequence[str], row: str, subject: str, outcome: str, pipelines: dict[str, Sequence[str]], **how) -> DataFrame:
    """``<tasks>, pipeline, model``: rows and subjects, mean and sd over folds of AUROC and average precision, the rise over the clean
    pipeline of the same model and the share of its headroom that the rise takes."""
    s = grouped_scores(rows, tasks, row, subject, outcome, pipelines, **how)
    by = [*tasks, "pipeline", "model", "fold"]
    per = metrics.discrimination(s, by, "score", "label").where("auroc is not null")
    of = [*tasks, "model", "pipeline"]
    sd = lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))
    out = per.groupBy(*of).agg(
        F.avg("auroc").alias("auroc"), sd("auroc").alias("auroc_sd"), F.avg("average_precision").alias("pr_auc"), sd("average_precision").alias("pr_auc_sd"),
        F.count(F.lit(1)).alias("n_folds"), F.sum("n").alias("n"),
    )
    people = s.groupBy(*of).agg(F.count_distinct(subject).alias("n_subjects"))
    # from the same row: a mean of the folds taken again may add them in another order
    clean = F.max(F.when(F.col("pipeline") == "clean", F.col("auroc"))).over(Window.partitionBy(*tasks, "model"))
    out = out.join(people, of).withColumn("__clean", clean)
    delta = F.col("auroc") - F.col("__clean")
    return out.withColumns({"delta_auroc": delta, "headroom_pct": F.when(F.col("__clean") < 1, 100 * delta / (1 - F.col("__clean")))}).drop("__clean")


@query
def m_event_pairs_models(spark, sf_dir):
    """Event pairs in three windows and two cohorts: clean, with the follow-up, with the outcome, and the rule; folds keep users whole."""
    return grouped_audit(event_pairs(spark, sf_dir), ["window", "cohort"], "event_id", "user_id", "drop", PAIR_PIPELINES)


@query
def m_meal_models(spark, sf_dir):
    """Meals: clean, with the peak, with the rise, and the rule; folds keep users whole."""
    return grouped_audit(meals(spark, sf_dir), [], "event_id", "user_id", "rise", MEAL_PIPELINES)


def order_outcomes(spark, sf_dir) -> DataFrame:
    """Orders with an outcome for each of two horizons: closed with a price up to a limit, which status and price leak."""
    o = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    code = lambda c: F.ascii(F.substring(c, 1, 1)).cast("double")  # noqa: E731  first letters and digits tell the values apart
    o = o.select(
        "o_orderkey", "o_custkey", F.col("c_acctbal").alias("balance"), code("o_orderpriority").alias("priority"), code("c_mktsegment").alias("segment"),
        F.month("o_orderdate").cast("double").alias("month"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").cast("double").alias("closed"),
    )
    horizon = F.explode(F.array(F.lit(100000), F.lit(144000))).alias("horizon")
    return o.select("*", horizon).withColumn("outcome", F.col("closed") * (F.col("price") <= F.col("horizon")).cast("double"))


ORDER_CLEAN = ("balance", "priority", "segment", "month")
ORDER_PIPELINES = {"clean": ORDER_CLEAN, "proxy": (*ORDER_CLEAN, "closed"), "leaky": (*ORDER_CLEAN, "closed", "price")}


@query
def m_status_models(spark, sf_dir):
    """Status outcomes at two horizons: balanced models with clean, proxy and leaking columns, and the rule; folds keep customers whole."""
    return grouped_audit(order_outcomes(spark, sf_dir), ["horizon"], "o_orderkey", "o_custkey", "outcome", ORDER_PIPELINES, cut=0.5, balanced=True)


def calibration_lines(s: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, intercept, slope`` of the label on the score's logit, for all groups side by side; nulls where a group has one class only."""
    keys = list(keys)
    groups = [tuple(r) for r in s.select(*keys).distinct().orderBy(*keys).collect()]
    at = {g: i for i, g in enumerate(groups)}
    rows = s.select(*keys, F.col(score).cast("double").alias("__s"), F.col(label).cast("int").alias("__y")).dropna()

    def members(pdf: pd.DataFrame):
        for g, part in pdf.groupby(keys, sort=False):
            p = np.clip(part["__s"].to_numpy(), 1e-7, 1 - 1e-7)
            yield at[g], np.column_stack([np.ones(len(part)), np.log(p / (1 - p))]), part["__y"].to_numpy(float), np.ones(len(part))

    size = max(1, len(groups))
    about = manyfits.moments(rows, size, 2, members)
    w = manyfits.fit_many(rows, size, 2, members, np.zeros((size, 2)))
    both = [0 < p < n for p, n in zip(about["pos"], about["n"])]
    types = dict(s.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "intercept double, slope double"])
    return s.sparkSession.createDataFrame([(*g, *(map(float, w[i]) if both[i] else (None, None))) for g, i in at.items()], schema)


def calibration_table(s: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys, n, brier, ece, ece_deciles, intercept, slope`` of out-of-fold scores, for any number of groups at once."""
    keys = list(keys)
    edges = ranking.percentiles(s, keys, score, {f"__q{i}": i / 10 for i in range(11)})
    cut = s.join(edges, keys)
    bin_ = metrics.bin_of(F.col(score), [F.col(f"__q{i}") for i in range(11)])
    bins = cut.withColumn("__bin", bin_).groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.avg(score).alias("__m"), F.avg(F.col(label).cast("double")).alias("__p"))
    deciles = bins.groupBy(*keys).agg((F.sum(F.col("__n") * F.abs(F.col("__p") - F.col("__m"))) / F.sum("__n")).alias("ece_deciles"))
    out = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), metrics.brier(score, label).alias("brier"))
    for more in (metrics.calibration_error(s, keys, score, label), deciles, calibration_lines(s, keys, score, label)):
        out = out.join(more, keys)
    return out


@query
def m_cohort_calibration(spark, sf_dir):
    """Calibration of out-of-fold scores over event cohorts, pipelines and models."""
    s = grouped_scores(event_pairs(spark, sf_dir), ["window", "cohort"], "event_id", "user_id", "drop", PAIR_PIPELINES)
    return calibration_table(s.where("model <> 'rule'"), ["window", "cohort", "pipeline", "model"])


# -- leave one subject out, and subjects resampled ----------------------------


def loso_scores(spark, sf_dir) -> DataFrame:
    pairs = event_pairs(spark, sf_dir).where("window = 48 and cohort = 'all'")
    return written(manyfits.leave_one_out(pairs, "user_id", {"clean": PAIR_CLEAN, "b_component": PAIR_PIPELINES["b_component"]}, "drop"), "loso")


@query
def m_loso_models(spark, sf_dir):
    """Leave-one-subject-out AUROC of logistic models, clean and leaking, over subjects with both classes, with their spread."""
    per = metrics.auroc(loso_scores(spark, sf_dir), ["pipeline", "user_id"], "score", "label").where("auroc is not null")
    return rollup.summary(per, ["pipeline"], "auroc")


def resampled_subjects(df: DataFrame, subject: str, pipelines: dict[str, Sequence[str]], outcome: str, resamples: int, q: float = 0.75, c: float = 1.0, bins: int = 1024) -> DataFrame:
    """``pipeline, boot_id, n_train, n_test, threshold, auroc``: models of resampled subjects, measured on the subjects left out.

    A subject's multiplicity in a resample is Poisson(1), drawn by a hash in the task, so no draw is stored and each row is read once a
    round for all resamples. A resample's threshold is its weighted percentile to one part in ``bins^2`` of the outcome's range,
    and its AUROC is that of scores cut into ``bins`` of equal width, ties half.
    """
    names = list(dict.fromkeys(x for f in pipelines.values() for x in f))
    kinds, width, xs = list(pipelines), len(names) + 1, [f"x{j}" for j in range(len(names))]
    rows = df.select(F.xxhash64(F.col(subject)).alias("u"), F.col(outcome).cast("double").alias("v"), *[F.col(f).cast("double").alias(x) for f, x in zip(names, xs)]).dropna()
    rows = written(rows, "rows")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    span = (high - low) or 1.0 if low is not None else 1.0
    low = low or 0.0

    def weighted_counts(of) -> np.ndarray:
        def count(pdf: pd.DataFrame):
            u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
            for b in range(resamples):
                yield b, of(b, v, manyfits.poisson_weights(u, b))

        return manyfits.sums(rows, resamples, bins + 1, count)

    def level(b, v, w, start=None, step=span / bins):
        at = np.clip(np.floor((v - (low if start is None else start[b])) / step), -1, bins - 1).astype(int) + 1
        keep = (at > 0) & (v < (start[b] + bins * step if start is not None else np.inf))
        return np.bincount(np.where(keep, at, 0), w * keep if start is not None else w, bins + 1)

    coarse = weighted_counts(level)
    total = coarse.sum(1)
    want = q * np.maximum(total - 1, 0) + 1
    upto = np.cumsum(coarse, 1)
    first = np.array([np.searchsorted(upto[b], want[b] - 1e-9) for b in range(resamples)])
    start = low + (np.maximum(first, 1) - 1) * span / bins
    left = want - np.where(first > 0, np.take_along_axis(upto, np.maximum(first - 1, 0)[:, None], 1)[:, 0], 0)
    fine = weighted_counts(lambda b, v, w: level(b, v, w, start, span / bins**2))
    inside = np.array([np.searchsorted(np.cumsum(fine[b, 1:]), left[b] - 1e-9) for b in range(resamples)])
    cuts = start + np.minimum(inside, bins - 1) * span / bins**2

    size = resamples * len(kinds)
    used = np.array([[True, *[f in pipelines[kinds[i % len(kinds)]] for f in names]] for i in range(size)])

    def training(pdf: pd.DataFrame):
        x, u, v = manyfits.with_ones(pdf, xs), pdf["u"].to_numpy(), pdf["v"].to_numpy()
        for b in range(resamples):
            w = manyfits.poisson_weights(u, b)
            on = w > 0
            y = (v[on] >= cuts[b]).astype(float)
            for p in range(len(kinds)):
                yield b * len(kinds) + p, x[on], y, w[on]

    about = manyfits.moments(rows, size, width, training)
    coef = manyfits.fit_many(rows, size, width, training, manyfits.standard_ridge(about["sd"], c), used)

    def left_out(pdf: pd.DataFrame):
        x, u, v = manyfits.with_ones(pdf, xs), pdf["u"].to_numpy(), pdf["v"].to_numpy()
        for b in range(resamples):
            on = manyfits.poisson_weights(u, b) == 0
            y = v[on] >= cuts[b]
            for p in range(len(kinds)):
                i = b * len(kinds) + p
                at = np.minimum((bins / (1 + np.exp(-np.clip(x[on] @ coef[i], -500, 500)))).astype(int), bins - 1)
                yield i, np.r_[np.bincount(at[y], minlength=bins), np.bincount(at[~y], minlength=bins)]

    got = manyfits.sums(rows, size, 2 * bins, left_out).reshape(size, 2, bins)
    out = []
    for i in range(size):
        pos, neg = got[i]
        pairs = pos.sum() * neg.sum()
        auroc = float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs and 0 < about["pos"][i] < about["n"][i] else None
        out.append((kinds[i % len(kinds)], i // len(kinds), int(about["n"][i]), int(pos.sum() + neg.sum()), float(cuts[i // len(kinds)]), auroc))
    return df.sparkSession.createDataFrame(out, "pipeline string, boot_id int, n_train long, n_test long, threshold double, auroc double")


@query
def m_subject_bootstrap_models(spark, sf_dir, resamples: int = 500):
    """Models of 500 resamples of users, clean and leaking, measured on the users left out: mean, sd and 95 % interval."""
    pairs = event_pairs(spark, sf_dir).where("window = 48 and cohort = 'all'")
    got = resampled_subjects(pairs, "user_id", {"clean": PAIR_CLEAN, "b_component": PAIR_PIPELINES["b_component"]}, "drop", resamples)
    return rollup.summary(got, ["pipeline"], "auroc")


# -- resampled attributions ---------------------------------------------------


#: Moves of a margin's root mean square, as so many of those that chance brings, that rows near a kink are looked up for.
REACH = 10.0


def resampled_attributions(df: DataFrame, unit: Sequence[str], label: str, pipelines: dict[str, Sequence[str]], resamples: int, models: Sequence[str] = MODELS, c: float = 1.0) -> DataFrame:
    """``boot_id, classifier, pipeline, feature, mean_abs``: attributions of models of resampled units.

    A linear score's contribution of a feature is its weight times the distance from the resample's mean, so its mean absolute value is the
    weight's size times the mean absolute deviation. One pass sums for all resamples, as a matrix product of draws and columns, what
    their models need: derivatives of the logistic loss at the fit of all rows, which give each resample's fit by expansion, and squares
    of the rows that stay within the hinge. Rows near the hinge or near a mean, few, are read by themselves. Resamples that move
    further than that holds for are fitted on all rows.
    """
    names = list(dict.fromkeys(x for f in pipelines.values() for x in f))
    kinds, width, xs = list(pipelines), len(names) + 1, [f"x{j}" for j in range(len(names))]
    rows = df.select(F.xxhash64(*[F.col(u) for u in unit]).alias("u"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(x) for f, x in zip(names, xs)]).dropna()
    rows = written(rows, "rows")
    about = rows.agg(*[f(x).alias(f"{k}{j}") for j, x in enumerate(xs) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    n = max(about["n"], 1)
    rows = written(rows.withColumns({x: (F.col(x) - F.lit(about[f"m{j}"] or 0.0)) / F.lit(about[f"s{j}"] or 1.0) for j, x in enumerate(xs)}), "rows")
    flat = np.r_[0.0, [1.0 if about[f"s{j}"] else 0.0 for j in range(len(xs))]]
    size = resamples * len(kinds)
    used = np.array([[True, *[f in pipelines[k] for f in names]] for k in kinds])
    cols = [np.flatnonzero(u) for u in used]
    losses = [m for m in ("lr", "linear_svm") if m in models]
    loss_of = {"lr": "logistic", "linear_svm": "squared_hinge"}

    def everyone(pdf: pd.DataFrame):
        x, y = manyfits.with_ones(pdf, xs), pdf["y"].to_numpy()
        return [(i, x, y, np.ones(len(y))) for i in range(len(kinds))]

    base = {m: manyfits.fit_many(rows, len(kinds), width, everyone, flat / c, used, loss_of[m]) for m in losses}

    def products(pdf: pd.DataFrame):
        x = manyfits.with_ones(pdf, xs)
        yield 0, (x.T @ x).ravel()

    second = manyfits.sums(rows, 1, width * width, products)[0].reshape(width, width) / n
    inverse = [np.linalg.pinv(second[np.ix_(at, at)]) for at in cols]
    reach = [REACH * np.sqrt(len(at) / n) for at in cols]
    degrees = (1, 2, 3, 4) if n < 1_000_000 else (1, 2, 3)  # by then the fourth power of a move is nothing
    terms = [[manyfits.monomials(len(at), d) for d in degrees] for at in cols]

    def near(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Rows that may be on either side of the hinge, by pipeline."""
        out = []
        for i, at in enumerate(cols):
            z = x[:, at]
            out.append(np.abs(1 - (2 * y - 1) * (x @ base["linear_svm"][i])) <= reach[i] * np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", z, inverse[i], z), 0)))
        return out

    close = REACH / np.sqrt(n)  # to a mean

    def columns(pdf: pd.DataFrame) -> np.ndarray:
        x, y = manyfits.with_ones(pdf, xs), pdf["y"].to_numpy()
        side = np.where(np.abs(x[:, 1:]) > close, np.sign(x[:, 1:]), 0.0)
        out = [x, x[:, 1:] ** 2, side, side * x[:, 1:]]
        if "lr" in losses:
            for i, at in enumerate(cols):
                p = 1 / (1 + np.exp(-np.clip(x @ base["lr"][i], -500, 500)))
                d2 = p * (1 - p)
                slopes, made = (p - y, d2, d2 * (1 - 2 * p), d2 * (1 - 6 * d2)), {(): np.ones(len(x))}
                for s, (of, _) in zip(slopes, terms[i]):
                    made |= {m: made[m[:-1]] * x[:, at[m[-1]]] for m in of}
                    out.append(np.column_stack([made[m] for m in of]) * s[:, None])
        if "linear_svm" in losses:
            t = 2 * y - 1
            for i, (at, hit) in enumerate(zip(cols, near(x, y))):
                inside = (~hit & (t * (x @ base["linear_svm"][i]) < 1)).astype(float)
                z = x[:, at] * inside[:, None]
                up = np.triu_indices(len(at))
                out += [inside[:, None], z * t[:, None], z[:, up[0]] * x[:, at[up[1]]]]
        return np.column_stack(out)

    sizes = [width, *[len(xs)] * 3]
    sizes += [len(of) for i in range(len(kinds)) for of, _ in terms[i]] * ("lr" in losses)
    sizes += [k for at in cols for k in (1, len(at), len(at) * (len(at) + 1) // 2)] * ("linear_svm" in losses)
    got = iter(np.split(manyfits.resampled_sums(rows, "u", resamples, sum(sizes), columns), np.cumsum(sizes)[:-1], axis=1))
    first, squares, sided, sided_x = next(got), next(got), next(got), next(got)
    total = np.maximum(first[:, :1], 1e-300)
    mean = first[:, 1:] / total
    ridge = np.column_stack([np.zeros(resamples), np.maximum(squares / total - mean**2, 0) / c])

    # mean absolute deviations: rows near a mean are read again, or all rows where a resample's mean is further off
    spread = sided_x - mean * sided
    if np.abs(mean).max(initial=0.0) > close:
        spread, some = np.zeros_like(spread), rows
        between = lambda x: np.ones_like(x, bool)
    else:
        some = rows.where(" or ".join(f"abs({x}) <= {float(close)!r}" for x in xs))
        between = lambda x: np.abs(x) <= close

    def deviations(pdf: pd.DataFrame):
        x, u = pdf[xs].to_numpy(), pdf["u"].to_numpy()
        for b in range(resamples):
            yield b, manyfits.poisson_weights(u, b) @ (np.abs(x - mean[b]) * between(x))

    spread = (spread + manyfits.sums(some, resamples, len(xs), deviations)) / total

    coef, again = {m: np.repeat(base[m][None], resamples, 0) for m in losses}, {m: [] for m in losses}
    if "lr" in losses:
        sums_of = [[next(got) for _ in degrees] for _ in kinds]
        for i, at in enumerate(cols):
            places = [place for _, place in terms[i]]
            for b in range(resamples):
                t = [v[b][place] for v, place in zip(sums_of[i], places)] + [np.zeros((len(at),) * 4)] * (4 - len(degrees))
                w0, r, d = base["lr"][i][at], ridge[b][at], np.zeros(len(at))
                for _ in range(30):
                    t4 = (t[3] @ d) @ d
                    grad = t[0] + t[1] @ d + 0.5 * (t[2] @ d) @ d + t4 @ d / 6 + r * (w0 + d)
                    step = np.linalg.lstsq(t[1] + t[2] @ d + 0.5 * t4 + np.diag(r + 1e-10), -grad, rcond=None)[0]
                    d = d + step / max(1.0, np.abs(step).max())
                    if np.abs(step).max() < 1e-12:
                        break
                coef["lr"][b, i, at] = w0 + d
                if not np.sqrt(max(d @ second[np.ix_(at, at)] @ d, 0)) <= manyfits.FAR or np.abs(step).max() > 1e-8:
                    again["lr"].append((b, i))
    if "linear_svm" in losses:
        fixed = np.zeros((resamples, len(kinds))), np.zeros((resamples, len(kinds), width)), np.zeros((resamples, len(kinds), width, width))
        for i, at in enumerate(cols):
            fixed[0][:, i], fixed[1][:, i, at] = next(got)[:, 0], -2 * next(got)
            up, v = np.triu_indices(len(at)), 2 * next(got)
            fixed[2][:, i, at[up[0]], at[up[1]]] = v
            fixed[2][:, i, at[up[1]], at[up[0]]] = v

        def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                hits = near(manyfits.with_ones(pdf, xs), pdf["y"].to_numpy())
                yield pdf.assign(**{f"near{i}": h.astype(float) for i, h in enumerate(hits)})[np.any(hits, 0)]

        band = rows.mapInPandas(kept, ", ".join(["u long", "y double", *[f"{x} double" for x in xs], *[f"near{i} double" for i in range(len(kinds))]]))
        band = written(band, "band")

        def banded(pdf: pd.DataFrame):
            x, y, u = manyfits.with_ones(pdf, xs), pdf["y"].to_numpy(), pdf["u"].to_numpy()
            hits = [pdf[f"near{i}"].to_numpy() for i in range(len(kinds))]
            for b in range(resamples):
                w = manyfits.poisson_weights(u, b)
                for i, h in enumerate(hits):
                    yield b * len(kinds) + i, x, y, w * h

        w = manyfits.fit_many(band, size, width, banded, np.repeat(ridge, len(kinds), 0), np.tile(used, (resamples, 1)), "squared_hinge", coef["linear_svm"].reshape(size, width), tuple(f.reshape(size, *f.shape[2:]) for f in fixed))
        coef["linear_svm"] = w.reshape(resamples, len(kinds), width)
        for i, at in enumerate(cols):
            d = (coef["linear_svm"] - base["linear_svm"])[:, i, at]
            moved = np.sqrt(np.maximum(np.einsum("bi,ij,bj->b", d, second[np.ix_(at, at)], d), 0))
            again["linear_svm"] += [(b, i) for b in np.flatnonzero(~(moved <= reach[i])).tolist()]

    for m in losses:
        todo = again[m]
        if todo:

            def drawn(pdf: pd.DataFrame, todo=sorted(todo)):
                x, y, u, last = manyfits.with_ones(pdf, xs), pdf["y"].to_numpy(), pdf["u"].to_numpy(), None
                for k, (b, i) in enumerate(todo):
                    if b != last:
                        last, w = b, manyfits.poisson_weights(u, b)
                    yield k, x, y, w

            at = np.array(sorted(todo))
            coef[m][at[:, 0], at[:, 1]] = manyfits.fit_many(rows, len(at), width, drawn, ridge[at[:, 0]], used[at[:, 1]], loss_of[m], base[m][at[:, 1]])
    out = [
        (b, m, kind, f, float(abs(coef[m][b, i, j]) * spread[b, j - 1] * (about[f"s{j - 1}"] and 1.0 or 0.0)))
        for m in losses for b in range(resamples) for i, kind in enumerate(kinds) for j, f in enumerate(names, 1) if f in pipelines[kind]
    ]
    return df.sparkSession.createDataFrame(out, "boot_id int, classifier string, pipeline string, feature string, mean_abs double")


def distortions(importance: DataFrame, clean: str, leaky: str, units: Sequence[str] = ("boot_id", "classifier")) -> DataFrame:
    """``<units>, feature, rank_clean, rank_leaky, adi``: ranks of a feature in both pipelines, and clean less leaky."""
    ranks = attribution.importance_ranks(importance, [*units, "pipeline"])
    of = lambda p: ranks.where(F.col("pipeline") == p).select(*units, "feature", F.col("rank").alias(f"rank_{'clean' if p == clean else 'leaky'}"))
    return of(clean).join(of(leaky), [*units, "feature"], "full").withColumn("adi", F.col("rank_clean") - F.col("rank_leaky"))


PAPER_PIPELINES = {"clean": ("a", "qty", "tax"), "follow_up": ("a", "qty", "tax", "b")}


@query
def m_bootstrap_attribution(spark, sf_dir, resamples: int = 500):
    """Rank distortions by leakage over 500 resamples of the paired table, by classifier and feature, with the agreement of their signs and
    how often a feature keeps its usual rank in the clean pipeline."""
    d = queries.labelled(spark, sf_dir)
    imp = written(resampled_attributions(d, ["rid"], "label", PAPER_PIPELINES, resamples), "importance")
    adi = written(distortions(imp, "clean", "follow_up"), "adi")
    out = attribution.distortion_summary(adi, ["classifier", "feature"])
    agree = attribution.sign_concordance(adi, "boot_id", "classifier").select("feature", F.col("pct").alias("pct_signs_agree"))
    usual = adi.where("rank_clean is not null").groupBy("classifier", "feature").agg(F.mode("rank_clean").alias("usual"))
    stable = adi.join(usual, ["classifier", "feature"]).groupBy("classifier", "feature").agg(rollup.share(F.col("rank_clean") == F.col("usual")).alias("pct_stable"))
    return out.join(agree, "feature", "left").join(stable, ["classifier", "feature"], "left")


@query
def m_cohort_attribution(spark, sf_dir, resamples: int = 200):
    """The same on event pairs with users as units: mean |phi|, rank distortions and their intervals, by classifier and feature."""
    pairs = event_pairs(spark, sf_dir).where("window = 48 and cohort = 'all'")
    q = ranking.percentiles(pairs, [], "drop", {"q": 0.75}).first()["q"]
    d = pairs.withColumn("label", (F.col("drop") >= F.lit(q)).cast("int"))
    imp = written(resampled_attributions(d, ["user_id"], "label", {"clean": PAIR_CLEAN, "b_component": PAIR_PIPELINES["b_component"]}, resamples), "importance")
    adi = distortions(imp, "clean", "b_component")
    sizes = imp.where("pipeline = 'b_component'").groupBy("classifier", "feature").agg(F.avg("mean_abs").alias("mean_abs_leaky"))
    return attribution.distortion_summary(adi, ["classifier", "feature"]).join(sizes, ["classifier", "feature"], "right")


@query
def m_auroc_bca(spark, sf_dir, resamples: int = 1000):
    """Bias-corrected and accelerated intervals of AUROC by fold and pipeline of the paired table."""
    return resample.auroc_bca(queries.scored(spark, sf_dir), ["pipeline", "fold"], ["rid"], "score", "label", resamples)


# -- cohorts, resumed work, SQL and streams -----------------------------------


@query
def meal_cohort(spark, sf_dir):
    """Meals of the user's denser sensor: pre-meal value, readings, peak and rise over the next day, and the meal's type by its hour."""
    e = queries.events(spark, sf_dir)
    first = F.col("event_type").isin("view", "click")
    both = e.select("event_id", "user_id", "ts", F.when(first, F.col("value")).alias("libre"), F.when(~first, F.col("value")).alias("dexcom"))
    r = joins.denser_column(both, "user_id", "libre", "dexcom", "cgm").where("cgm is not null").select("user_id", "ts", F.col("cgm").alias("value"))
    m = e.where("event_type = 'purchase' and value > 0").select("event_id", "user_id", "ts", F.col("value").alias("pre"))
    out = joins.interval_extremes(m, r, ["user_id"], "ts", "15 minutes", "24 hours", "value", 2)
    h = F.hour("ts")
    kind = F.when(h.between(5, 10), "breakfast").when(h.between(11, 14), "lunch").when(h.between(17, 21), "dinner").otherwise("snack")
    rise = fx.outcome("rise", F.col("pre"), F.col("peak"))
    return out.where(rise >= -30).select("event_id", "user_id", queries.r6("pre").alias("pre"), "n_readings", queries.r6("peak").alias("peak"), queries.r6(rise).alias("rise"), kind.alias("meal_type"))


ORACLES["meal_cohort"] = """WITH e AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN value END AS libre, CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS dexcom FROM events),
n AS (SELECT user_id, count(libre) AS a, count(dexcom) AS b FROM e GROUP BY user_id),
r AS (SELECT user_id, ts, CASE WHEN a >= b THEN libre ELSE dexcom END AS v FROM e JOIN n USING (user_id))
SELECT m.event_id, m.user_id, round(m.value, 6) AS pre, CAST(count(*) AS BIGINT) AS n_readings, round(max(v), 6) AS peak, round(max(v) - m.value, 6) AS rise,
  CASE WHEN hour(m.ts) BETWEEN 5 AND 10 THEN 'breakfast' WHEN hour(m.ts) BETWEEN 11 AND 14 THEN 'lunch' WHEN hour(m.ts) BETWEEN 17 AND 21 THEN 'dinner' ELSE 'snack' END AS meal_type
FROM events m JOIN r ON m.user_id = r.user_id AND v IS NOT NULL AND r.ts > m.ts + INTERVAL 15 MINUTE AND r.ts <= m.ts + INTERVAL 24 HOUR
WHERE m.event_type = 'purchase' AND m.value > 0 GROUP BY m.event_id, m.user_id, m.value, m.ts HAVING count(*) >= 2 AND max(v) - m.value >= -30"""


@query
def resumed_grid(spark, sf_dir):
    """A grid of order status by priority done in two sittings: the second does what the first, stopped halfway, has not."""
    o = parquet(spark, sf_dir, "orders")
    grid = o.select("o_orderstatus", "o_orderpriority").dropna().distinct()

    def work(cells: DataFrame) -> DataFrame:
        of = o.join(cells, ["o_orderstatus", "o_orderpriority"], "left_semi").groupBy("o_orderstatus", "o_orderpriority")
        return of.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))

    path = f"{shared_dir(spark)}/foldwise-grid-{uuid.uuid4().hex}"
    half = grid.where(F.pmod(F.xxhash64("o_orderstatus", "o_orderpriority"), F.lit(2)) == 0)
    resume_cells(half, ["o_orderstatus", "o_orderpriority"], work, path, 2)
    return resume_cells(grid, ["o_orderstatus", "o_orderpriority"], work, path, 2)


ORACLES["resumed_grid"] = "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL"


@query
def sql_fold_rounds(spark, sf_dir):
    """Cross-validation rounds of all orders from SQL text, by a registered table function."""
    table_functions.register(spark)
    parquet(spark, sf_dir, "orders").createOrReplaceTempView("foldwise_orders")
    return spark.sql(
        "SELECT round, is_test, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM foldwise_orders, LATERAL fold_rounds(CAST(o_orderkey AS STRING), 5, '7') GROUP BY round, is_test"
    )


ORACLES["sql_fold_rounds"] = f"""WITH f AS (SELECT *, CAST(floor({uniform_sql("o_orderkey", seed="7")} * 5) AS INT) AS fold FROM orders)
SELECT CAST(k AS INT) AS round, fold = k AS is_test, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean_price FROM f, range(5) t(k) GROUP BY k, fold = k"""


@query
def stream_event_pairs(spark, sf_dir):
    """Purchases with the user's next error within four hours, by a stream-stream join over a replay of the events."""
    schema = parquet(spark, sf_dir, "events").schema
    home = f"{shared_dir(spark)}/foldwise-stream-{uuid.uuid4().hex}"

    def side(kind: str, prefix: str) -> DataFrame:
        e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where(F.col("event_type") == kind)
        e = e.select(F.col("event_id").alias(f"{prefix}event_id"), F.col("user_id").alias(f"{prefix}user"), F.col("ts").cast("timestamp").alias(f"{prefix}ts"), F.col("value").alias(f"{prefix}value"))
        return e.withWatermark(f"{prefix}ts", "1 hour")

    l, r = side("purchase", ""), side("error", "next_")
    near = (F.col("next_ts") >= F.col("ts") + F.expr("interval 1 second")) & (F.col("next_ts") <= F.col("ts") + F.expr("interval 1 second + interval 4 hours"))
    run = l.join(r, (F.col("user") == F.col("next_user")) & near).writeStream.format("parquet").option("path", f"{home}/pairs").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    # a purchase may pair with several errors, in any batch: the first in time is its own, whatever the batches were
    nearest = F.min(F.struct("next_ts", "next_event_id", "next_value")).alias("m")
    schema_out = "event_id long, user long, ts timestamp, value double, next_event_id long, next_user long, next_ts timestamp, next_value double"
    out = spark.read.schema(schema_out).parquet(f"{home}/pairs").groupBy("event_id", F.col("user").alias("user_id"), "value").agg(nearest)
    return out.select("event_id", "user_id", F.col("m.next_event_id").alias("next_event_id"), queries.r6(F.col("value") - F.col("m.next_value")).alias("drop"))


ORACLES["stream_event_pairs"] = """SELECT event_id, user_id, next_event_id, round(value - next_value, 6) AS "drop" FROM (
  SELECT l.event_id, l.user_id, l.value, r.event_id AS next_event_id, r.value AS next_value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts, r.event_id) AS k
  FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts >= l.ts + INTERVAL 1 SECOND AND r.ts <= l.ts + INTERVAL 1 SECOND + INTERVAL 4 HOUR
  WHERE l.event_type = 'purchase' AND r.event_type = 'error') WHERE k = 1"""
