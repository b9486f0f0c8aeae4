"""Bootstrap draws as tables: rows or groups, with what was left out of the bag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import uniform
from foldwise.operators.metrics import score_counts
from foldwise.operators.ranking import by_cuts, by_uniform, row_numbers, running
from foldwise.sources.scratch import written


def numbered(df: DataFrame, keys: Sequence[str | Column], seed=0, name: str = "row") -> DataFrame:
    """Rows numbered from 0 in the order of a hash of their keys."""
    df = df.withColumn("__u", uniform(*keys, seed=seed))
    order = [F.col("__u"), *[F.col(k) if isinstance(k, str) else k for k in keys]]
    return row_numbers(df, [], order, by_uniform(F.col("__u"), df.count()), "__rn").withColumn(name, F.col("__rn") - 1).drop("__rn", "__u")


def draws(spark, n: int, resamples: int, seed=0) -> DataFrame:
    """``boot_id, draw, row``: n row numbers with replacement for each resample, by hash."""
    cells = spark.range(resamples * n).select(F.floor(F.col("id") / n).alias("boot_id"), (F.col("id") % n).alias("draw"))
    return cells.withColumn("row", F.floor(uniform("boot_id", "draw", seed=seed) * n).cast("long"))


def row_bootstrap(df: DataFrame, keys: Sequence[str | Column], resamples: int, seed=0) -> DataFrame:
    """Each resample's rows with their multiplicity, ``boot_id, n_drawn`` added.

    Draws are counted before the join, so a row is copied once for each resample that has it.
    """
    rows = numbered(df, keys, seed)
    n = df.count()
    times = draws(df.sparkSession, n, resamples, seed).groupBy("boot_id", "row").agg(F.count(F.lit(1)).alias("n_drawn"))
    return rows.join(times, "row")


def weighted_mean(value: str) -> Column:
    """Aggregate over :func:`row_bootstrap`'s rows."""
    return F.sum(F.col(value) * F.col("n_drawn")) / F.sum(F.when(F.col(value).isNotNull(), F.col("n_drawn")))


def group_bootstrap(df: DataFrame, group: str, resamples: int, seed=0) -> tuple[DataFrame, DataFrame]:
    """(in bag, out of bag): rows with ``boot_id``; each draw of a group copies all its rows."""
    groups = numbered(df.select(group).distinct(), [group], seed, "__g")
    n = groups.count()
    picks = draws(df.sparkSession, n, resamples, seed).select("boot_id", "draw", F.col("row").alias("__g"))
    named = picks.join(groups, "__g").select("boot_id", "draw", group)
    in_bag = df.join(named, group)
    boots = df.sparkSession.range(resamples).select(F.col("id").alias("boot_id"))
    # every resample with every group: resamples are few and fixed
    left = groups.select(group).join(F.broadcast(boots)).join(named.select("boot_id", group).distinct(), ["boot_id", group], "left_anti")
    return in_bag, df.join(left, group)


def poisson_bootstrap(df: DataFrame, keys: Sequence[str | Column], resamples: int, seed=0) -> DataFrame:
    """Approximate bootstrap for any size: each row's multiplicity in each resample is Poisson(1) by hash.

    No draw table and no join: ``boot_id, n_drawn`` come with the row.
    """
    cumulative, term, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += term
        cumulative.append(total)
        term /= k + 1
    rows = df.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = uniform(*keys, "boot_id", seed=seed)
    times = F.size(F.filter(F.array(*[F.lit(c) for c in cumulative]), lambda c: c <= u))
    return rows.withColumn("n_drawn", times.cast("long")).where(F.col("n_drawn") > 0)


def subsample(df: DataFrame, n: int, keys: Sequence[str | Column], seed=0) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(uniform(*keys, seed=seed), *[F.col(k) if isinstance(k, str) else k for k in keys]).limit(n)


def auroc_placements(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, score, pos, neg, n_pos, n_neg, auroc, v_pos, v_neg``: for each distinct score how many rows of each class have it, and
    the share of the other class that such a row is in order with, ties half. One ranking of the counted scores."""
    counts = score_counts(df, keys, score, label)
    at = running(counts, keys, [F.col("score")], by_cuts(counts, "score"), {"__neg": F.col("neg"), "__pos": F.col("pos")})
    pairs = F.sum(F.col("pos") * (F.col("__neg") - F.col("neg") / F.lit(2.0)))
    totals = at.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), pairs.alias("__p"))
    totals = totals.withColumn("auroc", F.try_divide(F.col("__p"), (F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("__p")
    at = at.join(totals, list(keys)) if keys else at.join(F.broadcast(totals))
    v_pos = F.try_divide(F.col("__neg") - F.col("neg") / F.lit(2.0), F.col("n_neg").cast("double"))
    v_neg = F.try_divide(F.col("n_pos") - F.col("__pos") + F.col("pos") / F.lit(2.0), F.col("n_pos").cast("double"))
    return at.select(*keys, "score", "pos", "neg", "n_pos", "n_neg", "auroc", v_pos.alias("v_pos"), v_neg.alias("v_neg"))


def auroc_jackknife(placements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n, auroc, jack_mean, jack_se, acceleration`` of AUROC without each row in turn, over :func:`auroc_placements`.

    Without a row of a class of m, AUROC is (m AUROC - the row's placement) / (m - 1). Null where a class has fewer than two rows.
    """
    without = lambda m, v: F.try_divide(F.col(m) * F.col("auroc") - F.col(v), F.col(m) - F.lit(1.0))
    rows = written(placements.withColumns({"j1": without("n_pos", "v_pos"), "j0": without("n_neg", "v_neg")}), "jackknife")
    n = F.col("n_pos") + F.col("n_neg")
    both = lambda f: F.sum(F.when(F.col("pos") > 0, F.col("pos") * f("j1")).otherwise(0.0)) + F.sum(F.when(F.col("neg") > 0, F.col("neg") * f("j0")).otherwise(0.0))
    mean = rows.groupBy(*keys).agg(F.first(n).alias("n"), F.first("auroc").alias("auroc"), (both(F.col) / F.first(n)).alias("jack_mean"), F.min(F.least("n_pos", "n_neg")).alias("__least"))
    rows = rows.join(mean.select(*keys, "jack_mean"), list(keys)) if keys else rows.join(F.broadcast(mean.select("jack_mean")))
    power = lambda k: both(lambda j: F.pow(F.col("jack_mean") - F.col(j), F.lit(float(k))))
    spread = rows.groupBy(*keys).agg(power(2).alias("__s2"), power(3).alias("__s3"))
    out = mean.join(spread, list(keys)) if keys else mean.join(F.broadcast(spread))
    enough = F.col("__least") > 1
    se = F.sqrt((F.col("n") - 1) / F.col("n") * F.col("__s2"))
    a = F.coalesce(F.try_divide(F.col("__s3"), 6 * F.pow("__s2", F.lit(1.5))), F.lit(0.0))
    return out.select(*keys, "n", "auroc", F.when(enough, F.col("jack_mean")).alias("jack_mean"), F.when(enough, se).alias("jack_se"), F.when(enough, a).alias("acceleration"))


def auroc_bca(df: DataFrame, keys: Sequence[str], row: Sequence[str], score: str, label: str, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """``keys, n, auroc, ci_low, ci_high``: bias-corrected and accelerated intervals, the acceleration by the exact jackknife.

    Replicates weigh rows by Poisson(1) draws, made in the task by a hash of ``row``; a replicate is the weighted mean placement
    of each class, added, less AUROC, which is AUROC of the draws up to terms of order 1 / n. All groups' replicates are four sums each, a
    matrix product of draws and placements. Groups, a few rows on the driver, whose classes have fewer than two rows have no interval.
    """
    from foldwise.functions.special import normal_cdf, normal_ppf
    from foldwise.operators import manyfits

    df = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    placed = written(auroc_placements(df, keys, score, label), "placements")
    known = [r for r in auroc_jackknife(placed, keys).collect()]
    at = {tuple(r[k] for k in keys): i for i, r in enumerate(known)}
    rows = df.select(*keys, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("__y"), F.xxhash64(*row).alias("__u"))
    rows = rows.join(placed.select(*keys, "score", "v_pos", "v_neg"), [*keys, "score"])
    rows = rows.select("__u", "__y", *keys, F.when(F.col("__y") == 1, F.col("v_pos")).otherwise(F.col("v_neg")).alias("v"))
    # a row's draws are made once for all its groups
    rows = written(rows.repartition("__u").sortWithinPartitions("__u"), "placed")

    def of(pdf, block: int = 512):
        import numpy as np

        unit, unit_at = np.unique(pdf["__u"].to_numpy(), return_inverse=True)
        group = np.zeros(len(pdf), int)
        for key, idx in pdf.groupby(list(keys), sort=False).indices.items() if keys else ():
            group[idx] = at[key if isinstance(key, tuple) else (key,)]
        y, v = pdf["__y"].to_numpy() == 1, pdf["v"].to_numpy()
        met, place = np.unique(group, return_inverse=True)
        width, total = 4 * len(met), np.zeros((4 * len(met), resamples))
        cell = unit_at * width + place * 4 + np.where(y, 0, 2)
        z = np.bincount(np.r_[cell, cell + 1], np.r_[np.ones(len(v)), v], len(unit) * width).reshape(-1, width)
        for lo in range(0, len(unit), block):
            total += z[lo : lo + block].T @ manyfits.poisson_draws(unit[lo : lo + block], range(resamples)).T
        for i, part in zip(met, total.reshape(len(met), 4, resamples)):
            yield i, part.T.ravel()

    got = manyfits.sums(rows, max(1, len(known)), 4 * resamples, of).reshape(-1, resamples, 4)
    out = []
    for i, r in enumerate(known):
        low = high = None
        drawn = got[i][(got[i][:, 0] > 0) & (got[i][:, 2] > 0)]
        if r["acceleration"] is not None and len(drawn) > 1:
            replicates = drawn[:, 1] / drawn[:, 0] + drawn[:, 3] / drawn[:, 2] - r["auroc"]
            low, high = bca_of(r["auroc"], replicates, r["acceleration"], level, normal_cdf, normal_ppf)
        out.append((*[r[k] for k in keys], r["n"], r["auroc"], low, high))
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame(out, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n long, auroc double, ci_low double, ci_high double"]))


def bca_of(estimate: float, replicates, acceleration: float, level: float, cdf, ppf) -> tuple[float, float]:
    import numpy as np

    reps = np.sort(np.asarray(replicates, float))
    below = min(max((reps < estimate).mean(), 0.5 / len(reps)), 1 - 0.5 / len(reps))
    z0, out = ppf(below), []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + ppf(p)
        out.append(float(np.percentile(reps, 100 * cdf(z0 + z / (1 - acceleration * z)))))
    return out[0], out[1]


def bca_interval(estimate: float, replicates: Sequence[float], jackknife: Sequence[float], level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval from a few hundred replicates and leave-one-out estimates."""
    import numpy as np

    from foldwise.functions.special import normal_cdf, normal_ppf

    jack = np.asarray(jackknife, float)
    dev = jack.mean() - jack
    spread = (dev**2).sum() ** 1.5
    return bca_of(estimate, replicates, (dev**3).sum() / (6 * spread) if spread else 0.0, level, normal_cdf, normal_ppf)
