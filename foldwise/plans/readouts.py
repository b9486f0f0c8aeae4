"""Smaller registered queries: read-outs, rank rules, tests and roll-ups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.hashing import uniform_sql
from foldwise.operators import checks, contaminate, joins, manyfits, metrics, ranking, resample, rollup, splits, stats
from foldwise.operators.sealed import fit_percentiles
from foldwise.plans.queries import BOUNDS, FOLDED, FOLDS, GRID_490, JUDGED, ORACLES, PAIRED, QUERIES, SCORED, SEED, folded, judged, paired, query, r6, scored
from foldwise.plans.queries import _benefit_sql
from foldwise.sources.tables import parquet

__all__ = ["ORACLES", "QUERIES"]


@query(
    "null_pattern_split",
    """WITH e AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'click') THEN ts END AS start, CASE WHEN value > 5 THEN value END AS dose, CASE WHEN event_type <> 'error' THEN value END AS reading FROM events),
k AS (SELECT user_id, CASE WHEN start IS NOT NULL AND dose IS NOT NULL THEN 'dose' WHEN reading IS NOT NULL THEN 'reading' END AS kind FROM e)
SELECT user_id, kind, CAST(count(*) AS BIGINT) AS n FROM k WHERE kind IS NOT NULL GROUP BY user_id, kind""",
)
def null_pattern_split(spark, sf_dir):
    """Events told apart by which of their columns are null; rows of neither pattern go."""
    e = parquet(spark, sf_dir, "events").select(
        "user_id", F.when(F.col("event_type").isin("purchase", "click"), F.col("ts")).alias("start"), F.when(F.col("value") > 5, F.col("value")).alias("dose"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("reading"),
    )
    is_dose = F.col("start").isNotNull() & F.col("dose").isNotNull()
    doses, readings = e.where(is_dose), e.where(~is_dose & F.col("reading").isNotNull())
    return doses.select("user_id", F.lit("dose").alias("kind")).unionByName(readings.select("user_id", F.lit("reading").alias("kind"))).groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("head_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def head_sample(spark, sf_dir):
    """The first 500 orders by date: a sample that names its order."""
    return parquet(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query(
    "with_metadata",
    """SELECT o_orderpriority, round(avg(o_totalprice), 6) AS mean_price, 'orders' AS cohort, 'finished' AS label,
       (SELECT CAST(count(*) AS BIGINT) FROM orders) AS n_total, (SELECT round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) FROM orders) AS prevalence FROM orders GROUP BY o_orderpriority""",
)
def with_metadata(spark, sf_dir):
    """Constants and the table's size and prevalence on every result row."""
    o = parquet(spark, sf_dir, "orders")
    facts = o.agg(F.count(F.lit(1)).alias("n_total"), r6(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("prevalence"))
    per = o.groupBy("o_orderpriority").agg(r6(F.avg("o_totalprice")).alias("mean_price"))
    return per.withColumns({"cohort": F.lit("orders"), "label": F.lit("finished")}).join(F.broadcast(facts))  # one row


@query(
    "competition_rank",
    """SELECT o_orderkey, o_orderpriority, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000) DESC) AS BIGINT) AS rank FROM orders""",
)
def competition_rank(spark, sf_dir):
    """One more than the orders of the priority with a greater price, in thousands."""
    o = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (-F.round(F.col("o_totalprice") / 1000)).alias("v"))
    return ranking.competition_ranks(o, ["o_orderpriority"], "v", "rank").select("o_orderkey", "o_orderpriority", "rank")


@query("largest_distortions", "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS INT) AS place FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 50")
def largest_distortions(spark, sf_dir):
    """The fifty customers with the largest balances of either sign, by absolute value."""
    c = parquet(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.abs("c_acctbal").alias("size"))
    return stats.top_k(c.orderBy(F.desc("size"), "c_custkey").limit(50), "size", 50, name="c_custkey").select("c_custkey", "c_acctbal", F.col("rank").alias("place"))


@query(
    "first_by_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def first_by_key(spark, sf_dir):
    """Each customer's first order: duplicates of a key go, the first stays."""
    row = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    return parquet(spark, sf_dir, "orders").groupBy("o_custkey").agg(row).select("o_custkey", "r.*")


@query("nearest_threshold", f"SELECT task, arg_min(threshold, abs(threshold - 0.25)) AS threshold, arg_min(net_benefit, abs(threshold - 0.25)) AS net_benefit FROM ({_benefit_sql(GRID_490)}) GROUP BY task")
def nearest_threshold(spark, sf_dir):
    """The decision curve read out where its threshold is nearest to 0.25."""
    b = metrics.net_benefit(judged(spark, sf_dir), ["task"], "score", "label", GRID_490)
    gap = F.struct(F.abs(F.col("threshold") - 0.25), "threshold")
    return b.groupBy("task").agg(F.min_by(F.struct("threshold", "net_benefit"), gap).alias("r")).select("task", r6("r.threshold").alias("threshold"), r6("r.net_benefit").alias("net_benefit"))


@query("inverse_square_moment", f"WITH {PAIRED} SELECT flag, round(avg(1e6 / (a * a)), 6) AS moment FROM p GROUP BY flag")
def inverse_square_moment(spark, sf_dir):
    """The mean of 1 / a^2, in millionths, by flag."""
    return paired(spark, sf_dir).groupBy("flag").agg(r6(F.avg(1e6 / (F.col("a") * F.col("a")))).alias("moment"))


@query(
    "partial_correlation",
    f"""WITH {PAIRED}, s AS (SELECT sum(a * a) AS aa, sum(a * tax) AS ax, sum(tax * tax) AS tt, sum(qty * a) AS xa, sum(qty * tax) AS xt, sum(y * a) AS ya, sum(y * tax) AS yt FROM p),
b AS (SELECT (tt * xa - ax * xt) / (aa * tt - ax * ax) AS x1, (aa * xt - ax * xa) / (aa * tt - ax * ax) AS x2, (tt * ya - ax * yt) / (aa * tt - ax * ax) AS y1, (aa * yt - ax * ya) / (aa * tt - ax * ax) AS y2 FROM s)
SELECT round(corr(qty - x1 * a - x2 * tax, y - y1 * a - y2 * tax), 6) AS r FROM p, b""",
)
def partial_correlation(spark, sf_dir):
    """Correlation of quantity and outcome given price and tax, by residuals without an intercept."""
    r, _ = stats.partial_correlation(paired(spark, sf_dir), "qty", "y", ["a", "tax"])
    return spark.createDataFrame([(round(r, 6),)], "r double")


@query(
    "inner_rank_alignment",
    """WITH n AS (SELECT n_name AS feature, c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 6) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
c AS (SELECT feature, row_number() OVER (ORDER BY n DESC, feature) AS rank_clean FROM n WHERE k >= 5), l AS (SELECT feature, row_number() OVER (ORDER BY bal DESC, feature) AS rank_leaky FROM n WHERE k < 20)
SELECT feature, CAST(rank_clean AS INT) AS rank_clean, CAST(rank_leaky AS INT) AS rank_leaky, CAST(rank_leaky - rank_clean AS INT) AS distortion FROM c JOIN l USING (feature)""",
)
def inner_rank_alignment(spark, sf_dir):
    """Ranks of features that both sides have, and the distortion leaky less clean (the second sign convention)."""
    n = parquet(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c_acctbal")).alias("bal"))
    n = n.join(parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("feature")), "c_nationkey")
    clean, leaky = stats.top_k(n.where("c_nationkey >= 5"), "n", 100), stats.top_k(n.where("c_nationkey < 20"), "bal", 100)
    out = joins.aligned_ranks(clean, leaky, "inner")
    return out.select("feature", "rank_clean", "rank_leaky", (-F.col("distortion")).cast("int").alias("distortion"))


@query(
    "checklist_score",
    """WITH a AS (SELECT o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN ' Yes' WHEN '2-HIGH' THEN 'yes' WHEN '3-MEDIUM' THEN 'YES ' WHEN '5-LOW' THEN 'N/A' ELSE 'no' END AS answer FROM orders),
s AS (SELECT 100.0 * count(*) FILTER (lower(trim(answer)) = 'yes') / (count(*) - count(*) FILTER (lower(trim(answer)) = 'n/a'))::DOUBLE AS score FROM a)
SELECT round(score, 6) AS score, score >= 83.3 AS passed FROM s""",
)
def checklist_score(spark, sf_dir):
    """Yes answers over applicable ones, and whether they reach the pass mark."""
    p = F.col("o_orderpriority")
    answer = F.when(p == "1-URGENT", " Yes").when(p == "2-HIGH", "yes").when(p == "3-MEDIUM", "YES ").when(p == "5-LOW", "N/A").otherwise("no")
    return checks.checklist_score(parquet(spark, sf_dir, "orders").select(answer.alias("answer"))).withColumn("score", r6("score"))


@query(
    "rank_rules",
    """WITH n AS (SELECT o_orderpriority AS scenario, o_orderstatus AS feature, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY n DESC, feature) AS rank FROM n)
SELECT scenario, CAST(rank AS INT) AS rank, rank >= 2 AS low_enough, rank <= 3 AS high_enough FROM r WHERE feature = 'P'""",
)
def rank_rules(spark, sf_dir):
    """Where one feature ranks in each scenario, against the rules for a rank that has to be low, or high."""
    n = parquet(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    r = stats.top_k(n, "n", 100, ["scenario"]).where("feature = 'P'")
    return r.select("scenario", "rank", checks.rank_at_least(F.col("rank"), 2).alias("low_enough"), checks.rank_at_most(F.col("rank"), 3).alias("high_enough"))


@query(
    "equivalence_t",
    f"""WITH {PAIRED}, m AS (SELECT flag, count(qty) AS n, avg(qty) AS mean, stddev_samp(qty) AS sd FROM p GROUP BY flag)
SELECT flag, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round((mean - 25 + 0.15 * 14) / (sd / sqrt(n)), 6) AS t_low, round((mean - 25 - 0.15 * 14) / (sd / sqrt(n)), 6) AS t_high FROM m""",
)
def equivalence_t(spark, sf_dir):
    """Both one-sided t statistics of quantity's mean against 25 within 0.15 of a sd of 14, by flag."""
    m = paired(spark, sf_dir).groupBy("flag").agg(F.count("qty").alias("n"), F.avg("qty").alias("mean"), F.stddev_samp("qty").alias("sd"))
    low, high = stats.equivalence_statistics("n", "mean", "sd", 25.0, 14.0, 0.15)
    return m.select("flag", "n", r6("mean").alias("mean"), r6(low).alias("t_low"), r6(high).alias("t_high"))


@query(
    "group_means",
    """SELECT event_type, CAST(dayofweek(ts) AS INT) AS weekday, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1, 2""",
)
def group_means(spark, sf_dir):
    """Means by event type and weekday (Sunday is 0)."""
    e = parquet(spark, sf_dir, "events").groupBy("event_type", (F.dayofweek("ts") - 1).alias("weekday"))
    return e.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("sd"))


@query(
    "inflation_heatmap",
    """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS finished, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS open,
       round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS pending FROM orders GROUP BY o_orderpriority""",
)
def inflation_heatmap(spark, sf_dir):
    """A pivot of means, one column a status."""
    out = rollup.pivot(parquet(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    return out.select("o_orderpriority", r6("F").alias("finished"), r6("O").alias("open"), r6("P").alias("pending"))


@query(
    "all_outlier_kinds",
    f"""WITH {PAIRED}, n AS (SELECT greatest(1, CAST(floor(count(*) * 0.02) AS BIGINT)) AS m FROM p),
r AS (SELECT row_number() OVER (ORDER BY {uniform_sql("rid", seed="4:extreme_tg4h")}, rid) AS rn, {uniform_sql("rid", seed="4:extreme_tg4h:value")} AS u, b FROM p)
SELECT CAST(sum(CASE WHEN rn <= m THEN 1 ELSE 0 END) AS BIGINT) AS n_hit, round(min(CASE WHEN rn <= m THEN 1500 + u * 1500 END), 6) AS low, round(max(CASE WHEN rn <= m THEN 1500 + u * 1500 END), 6) AS high,
       round(avg(CASE WHEN rn <= m THEN 1500 + u * 1500 ELSE b END), 6) AS mean FROM r, n""",
)
def all_outlier_kinds(spark, sf_dir):
    """The follow-up with extreme values in two rows of a hundred."""
    p = paired(spark, sf_dir).select("rid", F.col("b").alias("tg4h"), F.col("b").alias("before"))
    t = contaminate.inject_outliers(p, ["extreme_tg4h"], 0.02, ["rid"], 4)
    hit = F.col("tg4h") != F.col("before")
    inside = F.when(hit, F.col("tg4h"))
    return t.agg(F.count_if(hit).alias("n_hit"), r6(F.min(inside)).alias("low"), r6(F.max(inside)).alias("high"), r6(F.avg("tg4h")).alias("mean"))


@query(
    "fold_bounds_of_columns",
    f"""WITH {FOLDED}, l AS (SELECT fold, unnest(['a', 'qty', 'tax']) AS feature, unnest([a, qty, tax]) AS v FROM f)
SELECT k AS fold, feature, round(quantile_cont(v, 0.05), 6) AS lo, round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.95), 6) AS hi FROM folds, l WHERE l.fold <> k GROUP BY k, feature""",
)
def fold_bounds_of_columns(spark, sf_dir):
    """Training percentiles of several columns, fitted in one pass."""
    names = ("a", "qty", "tax")
    wide = fit_percentiles(folded(spark, sf_dir), list(names), {"lo": 0.05, "mid": 0.5, "hi": 0.95}, folds=FOLDS)
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[r6(f"{c}__{x}").alias(x) for x in ("lo", "mid", "hi")]) for c in names]))
    return wide.select("fold", rows)


@query(
    "loso_threshold",
    """WITH e AS (SELECT user_id, value FROM events WHERE value IS NOT NULL), u AS (SELECT DISTINCT user_id FROM e)
SELECT u.user_id, CAST(count(*) AS BIGINT) AS n_train, round(quantile_cont(e.value, 0.75), 6) AS threshold FROM u, e WHERE e.user_id <> u.user_id GROUP BY u.user_id""",
)
def loso_threshold(spark, sf_dir):
    """The upper quartile of all other subjects' values, for every subject."""
    e = parquet(spark, sf_dir, "events").select("user_id", "value")
    out = manyfits.leave_one_out_percentiles(e, "user_id", "value", 0.75)
    return out.select("user_id", F.col("n_rest").alias("n_train"), r6("threshold").alias("threshold"))


@query(
    "auroc_jackknife",
    f"""WITH {SCORED},
c AS (SELECT pipeline, fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY pipeline, fold, score),
r AS (SELECT *, sum(pos) OVER g AS m1, sum(neg) OVER g AS m0, sum(neg) OVER o - neg / 2.0::DOUBLE AS b, sum(pos) OVER g - sum(pos) OVER o + pos / 2.0::DOUBLE AS a
      FROM c WINDOW g AS (PARTITION BY pipeline, fold), o AS (PARTITION BY pipeline, fold ORDER BY score)),
t AS (SELECT *, sum(pos * b) OVER (PARTITION BY pipeline, fold) / (m1 * m0) AS auc FROM r),
j AS (SELECT *, (m1 * auc - b / m0) / (m1 - 1) AS j1, (m0 * auc - a / m1) / (m0 - 1) AS j0 FROM t),
k AS (SELECT *, sum(pos * j1 + neg * j0) OVER (PARTITION BY pipeline, fold) / (m1 + m0) AS jm FROM j)
SELECT pipeline, fold, CAST(max(m1 + m0) AS BIGINT) AS n, round(max(auc), 6) AS auroc, round(max(jm), 6) AS jack_mean,
       round(sqrt((max(m1 + m0) - 1) / max(m1 + m0) * sum(pos * (jm - j1) ** 2 + neg * (jm - j0) ** 2)), 6) AS jack_se FROM k GROUP BY pipeline, fold""",
)
def auroc_jackknife(spark, sf_dir):
    """AUROC without each row in turn, by fold and pipeline: mean and standard error, from placements in one ranking."""
    placed = resample.auroc_placements(scored(spark, sf_dir), ["pipeline", "fold"], "score", "label")
    out = resample.auroc_jackknife(placed, ["pipeline", "fold"])
    return out.select("pipeline", "fold", "n", *[r6(x).alias(x) for x in ("auroc", "jack_mean", "jack_se")])
