"""The registered queries, each with the SQL it is held against where SQL can express it.

The paired outcome is lineitem: baseline a is the extended price, follow-up b the discounted price, and the
outcome y the relative change in percent. Subjects are events' users, and a stay is a user's day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions import formulas as fx
from foldwise.functions.hashing import uniform, uniform_sql
from foldwise.operators import attribution, checks, contaminate, joins, metrics, ranking, resample, rollup, sealed, splits, stats
from foldwise.sources.scratch import written
from foldwise.sources.tables import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FOLDS, SEED = 5, 11


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


# -- shared tables -----------------------------------------------------------


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parquet(spark, sf_dir, "lineitem")
    rid = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.select(
        rid.alias("rid"), a.alias("a"), b.alias("b"), F.round(fx.outcome("relative", a, b), 6).alias("y"),
        F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


PAIRED = """p AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS rid,
         l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b,
         round(100 * (l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice, 6) AS y,
         l_quantity AS qty, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired rows in folds stratified by the overall quartile label. Written once, as every fit reads them."""
    p = paired(spark, sf_dir)
    q = ranking.percentiles(p, [], "y", {"q": 0.25}).first()["q"]
    p = p.withColumn("y0", (F.col("y") <= F.lit(q)).cast("int"))
    return written(splits.stratified_folds(p, "y0", ["rid"], FOLDS, SEED), "folded")


FOLDED = f"""{PAIRED},
g AS (SELECT quantile_cont(y, 0.25) AS q FROM p),
f AS (SELECT p.*, CAST(y <= q AS INT) AS y0,
             CAST((row_number() OVER (PARTITION BY (y <= q) ORDER BY {uniform_sql("rid", seed=SEED)}, rid) - 1) % {FOLDS} AS INT) AS fold
      FROM p, g),
folds AS (SELECT CAST(range AS INT) AS k FROM range({FOLDS})),
thr AS (SELECT k AS fold, quantile_cont(y, 0.25) AS threshold FROM folds, f WHERE f.fold <> k GROUP BY k),
lab AS (SELECT f.*, threshold, CAST(y <= threshold AS INT) AS label FROM f JOIN thr USING (fold))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded rows labelled by their fold's own training threshold."""
    f = folded(spark, sf_dir)
    return sealed.apply_threshold(f, sealed.fit_threshold(f, "y", 0.25, folds=FOLDS), "y", "label", "low")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``pipeline, fold, label, score``: by the baseline, by the follow-up, and by the formula itself."""
    d = labelled(spark, sf_dir)
    scores = {"clean": -F.col("a"), "follow_up": F.col("b"), "oracle": -F.round(100 * (1 - F.col("b") / F.col("a")), 6)}
    rows = F.array(*[F.struct(F.lit(n).alias("pipeline"), s.alias("score")) for n, s in scores.items()])
    return d.select("rid", "fold", "label", F.inline(rows))


SCORED = f"""{FOLDED},
s AS (SELECT rid, fold, label, 'clean' AS pipeline, -a AS score FROM lab
      UNION ALL SELECT rid, fold, label, 'follow_up', b FROM lab
      UNION ALL SELECT rid, fold, label, 'oracle', -round(100 * (1 - b / a), 6) FROM lab)"""


def _auroc_sql(source: str, keys: str) -> str:
    """AUROC by average ranks."""
    return f"""SELECT {keys}, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS n_pos,
       round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
             / nullif(sum(label) * sum(1 - label), 0), 6) AS auroc
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score)
             + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS rk FROM {source}) GROUP BY {keys}"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in long form ``task, label, score``; the score is a squashed length."""
    d = parquet(spark, sf_dir, "labels").join(parquet(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in ("quality", "toxic")])
    return d.select("doc_id", score.alias("score"), F.inline(tasks))


JUDGED = """j AS (
  SELECT doc_id, n_chars / (n_chars + 2000.0::DOUBLE) AS score, task, label FROM (
    SELECT doc_id, n_chars, 'quality' AS task, quality AS label FROM labels JOIN documents USING (doc_id)
    UNION ALL SELECT doc_id, n_chars, 'toxic', toxic FROM labels JOIN documents USING (doc_id)))"""


# -- outcomes, folds, fold-sealed fitting ------------------------------------


@query(
    "paired_outcome",
    f"""WITH {PAIRED}, q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(round(a - b, 6), 0.75) AS q2, quantile_cont(round(b / a, 6), 0.75) AS q3 FROM p)
SELECT rid, y AS relative, round(a - b, 6) AS difference, round(b / a, 6) AS ratio, CAST(y <= q1 AS INT) AS low_relative,
       CAST(round(a - b, 6) >= q2 AS INT) AS high_difference, CAST(round(b / a, 6) >= q3 AS INT) AS high_ratio FROM p, q""",
)
def paired_outcome(spark, sf_dir):
    p = paired(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    p = p.select("rid", F.col("y").alias("relative"), r6(fx.outcome("difference", a, b)).alias("difference"), r6(fx.outcome("ratio", a, b)).alias("ratio"))
    q1 = ranking.percentiles(p, [], "relative", {"q": 0.25}).first()["q"]
    q2 = ranking.percentiles(p, [], "difference", {"q": 0.75}).first()["q"]
    q3 = ranking.percentiles(p, [], "ratio", {"q": 0.75}).first()["q"]
    return p.withColumns({
        "low_relative": fx.binarise(F.col("relative"), F.lit(q1), "low"),
        "high_difference": fx.binarise(F.col("difference"), F.lit(q2), "high"),
        "high_ratio": fx.binarise(F.col("ratio"), F.lit(q3), "high"),
    })


@query("oracle_reconstruction", f"WITH {PAIRED} SELECT round(max(abs(b - a * (1 - y / 100))), 6) AS max_error, round(avg(abs(b - a * (1 - y / 100))), 6) AS mean_error FROM p")
def oracle_reconstruction(spark, sf_dir):
    p = paired(spark, sf_dir).withColumns({"pre": F.lit(0.0), "rebuilt": F.col("a") * (1 - F.col("y") / 100)})
    row = p.agg(*checks.reconstruction_error("pre", "b", "rebuilt"))
    return row.select(*[r6(c).alias(c) for c in row.columns])


@query(
    "stratified_folds",
    f"""SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY {uniform_sql("o_orderkey", seed=SEED)}, o_orderkey) - 1) % {FOLDS} AS INT) AS fold FROM orders""",
)
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], FOLDS, SEED)


@query(
    "group_folds",
    f"""WITH u AS (SELECT user_id, CAST((row_number() OVER (ORDER BY {uniform_sql("user_id", seed=SEED)}, user_id) - 1) % {FOLDS} AS INT) AS fold
        FROM (SELECT DISTINCT user_id FROM events)) SELECT event_id, user_id, fold FROM events JOIN u USING (user_id)""",
)
def group_folds(spark, sf_dir):
    return splits.group_folds(parquet(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", FOLDS, SEED).select("event_id", "user_id", "fold")


@query(
    "stratified_group_folds",
    f"""WITH u AS (SELECT user_id, sum(CAST(event_type = 'purchase' AS INT)) AS pos, count(*) AS n FROM events GROUP BY user_id),
w AS (SELECT user_id, (row_number() OVER (ORDER BY pos DESC, n DESC, {uniform_sql("user_id", seed=SEED)}, user_id) - 1) % {2 * FOLDS} AS s FROM u)
SELECT user_id, CAST(CASE WHEN s < {FOLDS} THEN s ELSE {2 * FOLDS - 1} - s END AS INT) AS fold FROM w""",
)
def stratified_group_folds(spark, sf_dir):
    e = parquet(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return splits.stratified_group_folds(e, "user_id", "y", FOLDS, SEED).select("user_id", "fold").distinct()


@query(
    "holdout_split",
    f"""SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {uniform_sql("o_orderkey", seed=7)}, o_orderkey) - 1) % 5 = 0) AS is_test,
       ({uniform_sql("o_custkey", seed=7)} < 0.2) AS is_group_test FROM orders""",
)
def holdout_split(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = splits.group_holdout(splits.holdout(o, "o_orderstatus", ["o_orderkey"], 0.2, 7), "o_custkey", 0.2, 7, "is_group_test")
    return out.select("o_orderkey", "is_test", "is_group_test")


@query("positional_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= least(200, (SELECT count(*) // 2 FROM orders)) THEN 'calibrate' ELSE 'test' END AS part FROM orders")
def positional_split(spark, sf_dir):
    return splits.positional_split(parquet(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("fold_thresholds", f"WITH {FOLDED} SELECT fold, round(threshold, 6) AS threshold FROM thr")
def fold_thresholds(spark, sf_dir):
    return sealed.fit_threshold(folded(spark, sf_dir), "y", 0.25, folds=FOLDS).select("fold", r6("threshold").alias("threshold"))


BOUNDS = f"""{FOLDED}, bounds AS (SELECT k AS fold, quantile_cont(a, 0.01) AS lo, quantile_cont(a, 0.99) AS hi FROM folds, f WHERE f.fold <> k GROUP BY k)"""


@query("fold_winsor_bounds", f"WITH {BOUNDS} SELECT fold, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bounds")
def fold_winsor_bounds(spark, sf_dir):
    return sealed.fit_winsor(folded(spark, sf_dir), "a", folds=FOLDS).select("fold", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(
    "winsorized",
    f"""WITH {BOUNDS} SELECT fold, CAST(count(*) FILTER (a < lo) AS BIGINT) AS n_low, CAST(count(*) FILTER (a > hi) AS BIGINT) AS n_high,
       round(min(least(greatest(a, lo), hi)), 6) AS min_a, round(max(least(greatest(a, lo), hi)), 6) AS max_a, round(avg(least(greatest(a, lo), hi)), 6) AS mean_a
FROM f JOIN bounds USING (fold) GROUP BY fold""",
)
def winsorized(spark, sf_dir):
    f = folded(spark, sf_dir)
    w = sealed.apply_winsor(f, sealed.fit_winsor(f, "a", folds=FOLDS), "a", "w")
    return w.groupBy("fold").agg(
        F.count_if(F.col("w") > F.col("a")).alias("n_low"), F.count_if(F.col("w") < F.col("a")).alias("n_high"),
        r6(F.min("w")).alias("min_a"), r6(F.max("w")).alias("max_a"), r6(F.avg("w")).alias("mean_a"),
    )


SCALER = f"""{FOLDED}, sc AS (
  SELECT k AS fold, 'a' AS feature, avg(a) AS mean, CASE WHEN stddev_pop(a) = 0 THEN 1 ELSE stddev_pop(a) END AS sd FROM folds, f WHERE f.fold <> k GROUP BY k
  UNION ALL SELECT k, 'qty', avg(qty), CASE WHEN stddev_pop(qty) = 0 THEN 1 ELSE stddev_pop(qty) END FROM folds, f WHERE f.fold <> k GROUP BY k
  UNION ALL SELECT k, 'tax', avg(tax), CASE WHEN stddev_pop(tax) = 0 THEN 1 ELSE stddev_pop(tax) END FROM folds, f WHERE f.fold <> k GROUP BY k)"""


@query("fold_scaler", f"WITH {SCALER} SELECT fold, feature, round(mean, 6) AS mean, round(sd, 6) AS sd FROM sc")
def fold_scaler(spark, sf_dir):
    return sealed.fit_scaler(folded(spark, sf_dir), ["a", "qty", "tax"], folds=FOLDS).select("fold", "feature", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(
    "zscores",
    f"""WITH {SCALER} SELECT fold, round(avg((a - mean) / sd), 6) AS mean_z, round(stddev_pop((a - mean) / sd), 6) AS sd_z, round(max((a - mean) / sd), 6) AS max_z
FROM f JOIN sc USING (fold) WHERE feature = 'a' GROUP BY fold""",
)
def zscores(spark, sf_dir):
    f = folded(spark, sf_dir)
    z = sealed.apply_scaler(f, sealed.fit_scaler(f, ["a"], folds=FOLDS), ["a"])
    return z.groupBy("fold").agg(r6(F.avg("a_z")).alias("mean_z"), r6(F.stddev_pop("a_z")).alias("sd_z"), r6(F.max("a_z")).alias("max_z"))


@query(
    "global_vs_fold_leak",
    f"""WITH {BOUNDS} SELECT 'fold' AS scope, fold, round(threshold, 6) AS threshold, round(lo, 6) AS lo, round(hi, 6) AS hi FROM thr JOIN bounds USING (fold)
UNION ALL SELECT 'global', k, round(t, 6), round(l, 6), round(h, 6) FROM folds, (SELECT quantile_cont(y, 0.25) AS t, quantile_cont(a, 0.01) AS l, quantile_cont(a, 0.99) AS h FROM f)""",
)
def global_vs_fold_leak(spark, sf_dir):
    f = folded(spark, sf_dir)
    out = None
    for scope in ("fold", "global"):
        one = sealed.fit_threshold(f, "y", 0.25, scope, folds=FOLDS).join(sealed.fit_winsor(f, "a", scope=scope, folds=FOLDS), "fold").withColumn("scope", F.lit(scope))
        out = one if out is None else out.unionByName(one)
    return out.select("scope", "fold", *[r6(c).alias(c) for c in ("threshold", "lo", "hi")])


@query("label_prevalence", f"WITH {FOLDED} SELECT fold, CAST(count(*) AS BIGINT) AS n, round(avg(label), 6) AS prevalence, round(avg(y0), 6) AS global_prevalence FROM lab GROUP BY fold")
def label_prevalence(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("label")).alias("prevalence"), r6(F.avg("y0")).alias("global_prevalence"))


# -- metrics -----------------------------------------------------------------


@query("auroc_by_fold", f"WITH {SCORED} {_auroc_sql('s', 'pipeline, fold')}")
def auroc_by_fold(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir), ["pipeline", "fold"], "score", "label").withColumn("auroc", r6("auroc"))


@query("auroc_documents", f"WITH {JUDGED} {_auroc_sql('j', 'task')}")
def auroc_documents(spark, sf_dir):
    return metrics.auroc(judged(spark, sf_dir), ["task"], "score", "label").withColumn("auroc", r6("auroc"))


@query(
    "average_precision",
    f"""WITH {JUDGED}, c AS (SELECT task, score, sum(label) AS pos, count(*) AS n FROM j GROUP BY task, score),
w AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS m FROM c WINDOW o AS (PARTITION BY task ORDER BY score DESC))
SELECT task, round(sum(pos * (tp::DOUBLE / m)) / sum(pos), 6) AS average_precision FROM w GROUP BY task""",
)
def average_precision(spark, sf_dir):
    return metrics.average_precision(judged(spark, sf_dir), ["task"], "score", "label").withColumn("average_precision", r6("average_precision"))


@query(
    "roc_curve",
    f"""WITH {JUDGED}, c AS (SELECT task, score, sum(label) AS pos, sum(1 - label) AS neg FROM j GROUP BY task, score)
SELECT task, round(score, 6) AS score, round(sum(pos) OVER o / sum(pos) OVER (PARTITION BY task), 6) AS tpr, round(sum(neg) OVER o / sum(neg) OVER (PARTITION BY task), 6) AS fpr
FROM c WINDOW o AS (PARTITION BY task ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
)
def roc_curve(spark, sf_dir):
    out = metrics.roc_curve(judged(spark, sf_dir), ["task"], "score", "label")
    return out.select("task", *[r6(c).alias(c) for c in ("score", "tpr", "fpr")])


def _bin_sql(edges, op: str, of: str = "score") -> str:
    return " + ".join(f"CAST({of} {op} {e!r}::DOUBLE AS INT)" for e in edges[1:-1])


ECE_BINS = f"b AS (SELECT task, {_bin_sql(metrics.EDGES, '>=')} AS bin, score, label FROM j)"


@query(
    "brier_ece",
    f"""WITH {JUDGED}, {ECE_BINS}, e AS (SELECT task, bin, count(*) AS n, abs(avg(label) - avg(score)) AS gap FROM b GROUP BY task, bin)
SELECT task, round(brier, 6) AS brier, round(ece, 6) AS ece FROM (SELECT task, avg((score - label) ** 2) AS brier FROM j GROUP BY task)
JOIN (SELECT task, sum(n * gap) / sum(n) AS ece FROM e GROUP BY task) USING (task)""",
)
def brier_ece(spark, sf_dir):
    j = judged(spark, sf_dir)
    return j.groupBy("task").agg(r6(metrics.brier("score", "label")).alias("brier")).join(metrics.calibration_error(j, ["task"], "score", "label"), "task").select("task", "brier", r6("ece").alias("ece"))


@query(
    "ece_quantile",
    f"""WITH {JUDGED}, d AS (SELECT DISTINCT doc_id, score FROM j), q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM d),
b AS (SELECT task, score, label, len(list_filter(e, lambda x: score >= x)) AS bin FROM j, q),
c AS (SELECT task, bin, count(*) AS n, abs(avg(label) - avg(score)) AS gap FROM b GROUP BY task, bin)
SELECT task, round(sum(n * gap) / sum(n), 6) AS ece FROM c GROUP BY task""",
)
def ece_quantile(spark, sf_dir):
    j = judged(spark, sf_dir)
    edges = metrics.quantile_edges(j.select("doc_id", "score").distinct(), "score", 10)
    return metrics.calibration_error(j, ["task"], "score", "label", edges).withColumn("ece", r6("ece"))


@query(
    "reliability_curve",
    f"""WITH {JUDGED} SELECT task, CAST({_bin_sql(metrics.EDGES, '>')} AS INT) AS bin, CAST(count(*) AS BIGINT) AS n,
       round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share_pos FROM j GROUP BY 1, 2""",
)
def reliability_curve(spark, sf_dir):
    return metrics.reliability(judged(spark, sf_dir), ["task"], "score", "label").select("task", "bin", "n", r6("mean_score").alias("mean_score"), r6("share_pos").alias("share_pos"))


def _benefit_sql(points) -> str:
    values = ", ".join(f"({p!r}::DOUBLE)" for p in points)
    return f"""WITH {JUDGED}, pts AS (SELECT t FROM (VALUES {values}) v(t)),
c AS (SELECT task, t, count(*) AS n, sum(label) AS pos, sum(CASE WHEN score >= t THEN label ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN 1 - label ELSE 0 END) AS fp
      FROM j, pts GROUP BY task, t)
SELECT task, round(t, 6) AS threshold, round(tp / n - fp / n * t / (1 - t), 6) AS net_benefit,
       round(pos / n - (1 - pos / n) * t / (1 - t), 6) AS treat_all, 0.0::DOUBLE AS treat_none FROM c"""


GRID_99, GRID_490 = [i / 100 for i in range(1, 100)], metrics.thresholds(0.01, 0.50, 490)


@query("net_benefit", _benefit_sql(GRID_99))
def net_benefit(spark, sf_dir):
    out = metrics.net_benefit(judged(spark, sf_dir), ["task"], "score", "label", GRID_99)
    return out.select("task", *[r6(c).alias(c) for c in ("threshold", "net_benefit", "treat_all", "treat_none")])


@query("decision_curve", _benefit_sql(GRID_490))
def decision_curve(spark, sf_dir):
    out = metrics.net_benefit(judged(spark, sf_dir), ["task"], "score", "label", GRID_490)
    return out.select("task", *[r6(c).alias(c) for c in ("threshold", "net_benefit", "treat_all", "treat_none")])


@query(
    "confusion_agreement",
    """WITH x AS (SELECT o_orderpriority, CAST(o_totalprice <= 150000 AS INT) AS p, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders)
SELECT o_orderpriority, CAST(sum(p * y) AS BIGINT) AS tp, CAST(sum(p * (1 - y)) AS BIGINT) AS fp, CAST(sum((1 - p) * y) AS BIGINT) AS fn, CAST(sum((1 - p) * (1 - y)) AS BIGINT) AS tn,
       round(avg(CAST(p = y AS INT)), 6) AS agreement FROM x GROUP BY o_orderpriority""",
)
def confusion_agreement(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") <= 150000).cast("int").alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return o.groupBy("o_orderpriority").agg(*metrics.confusion("p", "y")).withColumn("agreement", r6("agreement"))


@query(
    "status_oracle",
    f"""WITH x AS (SELECT c_mktsegment, CAST(o_orderstatus = 'F' AND o_totalprice <= 144000 AS INT) AS label,
  unnest([CAST(o_orderstatus = 'F' AND o_totalprice <= 144000 AS DOUBLE), -o_totalprice]) AS score, unnest(['rule', 'price']) AS pipeline
  FROM orders JOIN customer ON o_custkey = c_custkey) {_auroc_sql('x', 'c_mktsegment, pipeline')}""",
)
def status_oracle(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") <= 144000)
    rows = F.array(F.struct(F.lit("rule").alias("pipeline"), label.cast("double").alias("score")), F.struct(F.lit("price").alias("pipeline"), (-F.col("o_totalprice")).alias("score")))
    x = o.select("c_mktsegment", label.cast("int").alias("label"), F.inline(rows))
    return metrics.auroc(x, ["c_mktsegment", "pipeline"], "score", "label").withColumn("auroc", r6("auroc"))


@query(
    "auc_inflation",
    f"""WITH {SCORED}, m AS ({_auroc_sql('s', 'pipeline, fold')}),
x AS (SELECT *, max(auroc) FILTER (pipeline = 'clean') OVER (PARTITION BY fold) AS clean_auroc FROM m)
SELECT pipeline, fold, n, n_pos, auroc, clean_auroc, round(coalesce(auroc - clean_auroc, 0), 6) AS delta,
       CASE WHEN 1 - clean_auroc > 0 THEN round((auroc - clean_auroc) / (1 - clean_auroc) * 100, 4) END AS headroom_pct FROM x""",
)
def auc_inflation(spark, sf_dir):
    out = joins.against_baseline(auroc_by_fold(spark, sf_dir), "auroc", ["fold"])
    out = joins.headroom(out)
    return out.withColumns({"delta": r6("delta"), "headroom_pct": F.round("headroom_pct", 4)})


# -- event joins -------------------------------------------------------------


def events(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _asof(hours: int):
    @query(
        f"asof_forward_{hours}h",
        f"""WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS next_event_id, user_id, ts AS next_ts, value AS next_value FROM events WHERE event_type = 'error')
SELECT l.event_id, l.user_id, l.ts, l.value, r.next_event_id, r.next_ts, r.next_value, round(l.value - r.next_value, 6) AS drop
FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ts + INTERVAL 1 SECOND <= r.next_ts
WHERE r.next_ts <= l.ts + INTERVAL 1 SECOND + INTERVAL {hours} HOUR""",
    )
    def asof_forward(spark, sf_dir):
        e = events(spark, sf_dir)
        left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
        right = e.where("event_type = 'error'").select("event_id", "user_id", "ts", "value")
        out = joins.asof_forward(left, right, ["user_id"], "ts", f"{hours} hours", tie="event_id")
        return out.withColumn("drop", r6(fx.outcome("drop", F.col("value"), F.col("next_value"))))


for _h in (4, 6, 8):
    _asof(_h)


@query(
    "no_intervening",
    """WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS next_event_id, user_id, ts AS next_ts FROM events WHERE event_type = 'error'),
p AS (SELECT l.event_id, l.user_id, l.ts, r.next_event_id, r.next_ts FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ts + INTERVAL 1 SECOND <= r.next_ts WHERE r.next_ts <= l.ts + INTERVAL 1 SECOND + INTERVAL 48 HOUR)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = p.user_id AND l.ts > p.ts AND l.ts < p.next_ts)""",
)
def no_intervening(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    pairs = joins.asof_forward(left, right, ["user_id"], "ts", "48 hours", tie="event_id")
    return joins.no_event_between(pairs, left, ["user_id"], "ts", "next_ts", "ts").select("event_id", "user_id", "ts", "next_event_id", "next_ts")


@query(
    "admission_elapsed",
    """SELECT event_id, user_id, min(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS admit_ts,
       round(greatest(date_diff('second', min(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE)), ts) / 86400.0::DOUBLE, 0), 6) AS elapsed_days, CAST(hour(ts) AS INT) AS hour_of_day FROM events""",
)
def admission_elapsed(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    e = joins.first_in_group(e, ["user_id", "day"], "ts", "admit_ts")
    seconds = F.expr("timestampdiff(SECOND, date_trunc('second', admit_ts), date_trunc('second', ts))")
    elapsed = fx.fill(F.greatest(seconds / F.lit(86400.0), F.lit(0.0)), 0.0)
    days = F.round(elapsed * 1e6) / 1e6  # whole seconds often lie half way between six-digit days: round the double, not its decimal form
    return e.select("event_id", "user_id", F.col("admit_ts").cast("timestamp_ntz").alias("admit_ts"), days.alias("elapsed_days"), F.hour("ts").alias("hour_of_day"))


@query(
    "range_window_peak",
    """WITH m AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE value IS NOT NULL)
SELECT m.event_id, m.user_id, CAST(count(*) AS BIGINT) AS n_readings, max(r.value) AS peak, round(max(r.value) - m.value, 6) AS rise
FROM m JOIN r ON m.user_id = r.user_id AND r.ts > m.ts + INTERVAL 15 MINUTE AND r.ts <= m.ts + INTERVAL 24 HOUR
GROUP BY m.event_id, m.user_id, m.value HAVING count(*) >= 2 AND max(r.value) - m.value >= -30""",
)
def range_window_peak(spark, sf_dir):
    e = events(spark, sf_dir)
    meals = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    readings = e.where("value is not null").select("user_id", "ts", "value")
    out = joins.interval_extremes(meals, readings, ["user_id"], "ts", "15 minutes", "24 hours", "value", 2)
    rise = fx.outcome("rise", F.col("value"), F.col("peak"))
    return out.where(rise >= -30).select("event_id", "user_id", "n_readings", "peak", r6(rise).alias("rise"))


@query(
    "dim_left_join",
    """SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def dim_left_join(spark, sf_dir):
    o, c, n = (parquet(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    out = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    return out.select("o_orderkey", "c_mktsegment", "n_name")


@query(
    "source_choice",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN value END AS libre, CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS dexcom FROM events),
n AS (SELECT user_id, count(libre) AS a, count(dexcom) AS b FROM e GROUP BY user_id)
SELECT event_id, CASE WHEN a >= b THEN libre ELSE dexcom END AS cgm FROM e JOIN n USING (user_id)""",
)
def source_choice(spark, sf_dir):
    first = F.col("event_type").isin("view", "click")
    e = events(spark, sf_dir).select("event_id", "user_id", F.when(first, F.col("value")).alias("libre"), F.when(~first, F.col("value")).alias("dexcom"))
    return joins.denser_column(e, "user_id", "libre", "dexcom", "cgm").select("event_id", "cgm")


# -- missing data, encoding, outliers ----------------------------------------

MCAR = f"""{FOLDED}, mc AS (SELECT * REPLACE (CASE WHEN row_number() OVER (ORDER BY {uniform_sql("rid", seed="3:qty")}, rid) > CAST(floor((SELECT count(*) FROM f) * 0.1) AS BIGINT) THEN qty END AS qty) FROM f)"""


def with_missing(spark, sf_dir) -> DataFrame:
    return contaminate.missing_at_random(folded(spark, sf_dir), "qty", 0.1, ["rid"], 3)


@query("mcar_missingness", f"WITH {MCAR} SELECT fold, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(qty) AS BIGINT) AS n_missing, round(avg(qty), 6) AS mean_qty FROM mc GROUP BY fold")
def mcar_missingness(spark, sf_dir):
    return with_missing(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("qty").isNull()).alias("n_missing"), r6(F.avg("qty")).alias("mean_qty"))


@query(
    "mar_missingness",
    f"""WITH {PAIRED}, mm AS (SELECT min(a) AS lo, max(a) AS hi FROM p),
x AS (SELECT p.*, least(greatest((a - lo) / (hi - lo + 1e-9) * 2 * 0.1, 0.02), 0.2) AS pr FROM p, mm),
z AS (SELECT *, least(greatest(pr * 0.1 / avg(pr) OVER (), 0), 0.9) AS pz FROM x)
SELECT flag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN {uniform_sql("rid", seed="3:tax")} < pz THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM z GROUP BY flag""",
)
def mar_missingness(spark, sf_dir):
    out = contaminate.missing_by(paired(spark, sf_dir), "tax", "a", 0.1, ["rid"], 3)
    return out.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tax").isNull()).alias("n_missing"))


@query(
    "median_impute",
    f"""WITH {MCAR}, md AS (SELECT 'fold' AS scope, k AS fold, quantile_cont(qty, 0.5) AS m FROM folds, mc WHERE mc.fold <> k GROUP BY k
  UNION ALL SELECT 'global', k, m FROM folds, (SELECT quantile_cont(qty, 0.5) AS m FROM mc))
SELECT scope, fold, round(m, 6) AS median, round(avg(coalesce(qty, m)), 6) AS mean_filled FROM mc JOIN md USING (fold) GROUP BY scope, fold, m""",
)
def median_impute(spark, sf_dir):
    d, out = with_missing(spark, sf_dir), None
    for scope in ("fold", "global"):
        params = sealed.fit_median(d, "qty", scope, folds=FOLDS)
        one = sealed.apply_fill(d, params.withColumn("m", F.col("median")), "qty", "m", "filled").groupBy("fold", "median").agg(r6(F.avg("filled")).alias("mean_filled")).withColumn("scope", F.lit(scope))
        out = one if out is None else out.unionByName(one)
    return out.select("scope", "fold", r6("median").alias("median"), "mean_filled")


def orders_folded(spark, sf_dir) -> DataFrame:
    o = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o = o.withColumn("fold", F.floor(uniform("o_orderkey", seed=SEED) * FOLDS).cast("int"))
    gone = uniform("o_orderkey", seed="gone") < 0.2
    return o.withColumn("priority", F.when(~gone, F.col("o_orderpriority")))


ORDERS_FOLDED = f"""folds AS (SELECT CAST(range AS INT) AS k FROM range({FOLDS})),
o AS (SELECT o_orderkey, o_orderstatus, CAST(floor({uniform_sql("o_orderkey", seed=SEED)} * {FOLDS}) AS INT) AS fold,
             CASE WHEN NOT ({uniform_sql("o_orderkey", seed="gone")} < 0.2) THEN o_orderpriority END AS priority FROM orders)"""


@query(
    "mode_impute",
    f"""WITH {ORDERS_FOLDED}, c AS (SELECT k AS fold, priority, count(*) AS n FROM folds, o WHERE o.fold <> k AND priority IS NOT NULL GROUP BY k, priority),
m AS (SELECT fold, min(priority) AS mode FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.fold = c.fold) GROUP BY fold)
SELECT fold, mode, CAST(count(*) FILTER (priority IS NULL) AS BIGINT) AS n_filled, CAST(count(*) FILTER (coalesce(priority, mode) = mode) AS BIGINT) AS n_mode FROM o JOIN m USING (fold) GROUP BY fold, mode""",
)
def mode_impute(spark, sf_dir):
    o = orders_folded(spark, sf_dir)
    params = sealed.fit_mode(o, "priority", folds=FOLDS)
    out = sealed.apply_fill(o, params.withColumn("m", F.col("mode")), "priority", "m", "filled")
    return out.groupBy("fold", "mode").agg(F.count_if(F.col("priority").isNull()).alias("n_filled"), F.count_if(F.col("filled") == F.col("mode")).alias("n_mode"))


@query(
    "ordinal_encode",
    f"""WITH {ORDERS_FOLDED}, o2 AS (SELECT *, CASE WHEN fold = 0 AND priority = '5-LOW' THEN 'new' ELSE priority END AS cat FROM o),
c AS (SELECT DISTINCT k AS fold, cat FROM folds, o2 WHERE o2.fold <> k AND cat IS NOT NULL), e AS (SELECT fold, cat, dense_rank() OVER (PARTITION BY fold ORDER BY cat) - 1 AS code FROM c)
SELECT o2.fold, o2.cat, CAST(coalesce(code, -1) AS INT) AS code, CAST(count(*) AS BIGINT) AS n FROM o2 LEFT JOIN e ON o2.fold = e.fold AND o2.cat = e.cat GROUP BY 1, 2, 3""",
)
def ordinal_encode(spark, sf_dir):
    o = orders_folded(spark, sf_dir).withColumn("cat", F.when((F.col("fold") == 0) & (F.col("priority") == "5-LOW"), "new").otherwise(F.col("priority")))
    out = sealed.apply_ordinal(o, sealed.fit_ordinal(o, "cat", folds=FOLDS), "cat", "encoded")
    return out.groupBy("fold", "cat", F.col("encoded").alias("code")).agg(F.count(F.lit(1)).alias("n"))


LINE_BOUNDS = {"a": (1000.0, 90000.0), "b": (0.0, 90000.0), "qty": (1.0, 45.0), "tax": (0.0, 0.07)}


@query("plausibility_counts", f"WITH {PAIRED} SELECT " + ", ".join(f"CAST(count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS BIGINT) AS {c}_out" for c, (lo, hi) in LINE_BOUNDS.items()) + " FROM p")
def plausibility_counts(spark, sf_dir):
    return paired(spark, sf_dir).agg(*contaminate.out_of_range(LINE_BOUNDS))


def _named(spark, sf_dir) -> DataFrame:
    """The paired rows under the names that outlier injection knows."""
    return paired(spark, sf_dir).select("rid", "flag", F.col("qty").alias("hct"), (F.col("tax") * 100).alias("tp"), F.col("b").alias("tg4h")).withColumn("wbv", fx.wbv(F.col("hct"), F.col("tp")))


_RN = lambda kind: f"row_number() OVER (ORDER BY {uniform_sql('rid', seed=f'5:{kind}')}, rid)"
_VAL = lambda kind, lo, hi: f"({lo!r}::DOUBLE + {uniform_sql('rid', seed=f'5:{kind}:value')} * {hi - lo!r}::DOUBLE)"


@query(
    "outlier_inject",
    f"""WITH {PAIRED}, n AS (SELECT rid, flag, qty AS hct, tax * 100 AS tp, b AS tg4h, greatest(1, CAST(floor((SELECT count(*) FROM p) * 0.05) AS BIGINT)) AS m FROM p),
r AS (SELECT *, {_RN("neg_tg4h")} AS r1, {_RN("extreme_hct")} AS r2 FROM n),
x AS (SELECT flag, tp, CASE WHEN r1 <= m THEN {_VAL("neg_tg4h", -200.0, -1.0)} ELSE tg4h END AS tg4h,
  CASE WHEN r2 > m THEN hct WHEN r2 <= m // 2 THEN {_VAL("extreme_hct", 8.0, 19.9)} ELSE {_VAL("extreme_hct", 65.1, 80.0)} END AS hct FROM r)
SELECT flag, CAST(count(*) FILTER (tg4h < 0) AS BIGINT) AS n_negative, round(avg(tg4h), 4) AS mean_tg4h, round(avg(hct), 6) AS mean_hct, round(max(hct), 6) AS max_hct, round(avg(0.12 * hct + 0.17 * (tp - 2.07)), 3) AS mean_wbv FROM x GROUP BY flag""",
)
def outlier_inject(spark, sf_dir):
    d = contaminate.inject_outliers(_named(spark, sf_dir), ["neg_tg4h", "extreme_hct"], 0.05, ["rid"], 5)
    return d.groupBy("flag").agg(
        F.count_if(F.col("tg4h") < 0).alias("n_negative"), F.round(F.avg("tg4h"), 4).alias("mean_tg4h"), r6(F.avg("hct")).alias("mean_hct"), r6(F.max("hct")).alias("max_hct"), F.round(F.avg(fx.wbv(F.col("hct"), F.col("tp"))), 3).alias("mean_wbv"),
    )


@query(
    "cleaning_strategies",
    f"""WITH {BOUNDS} SELECT 'none' AS strategy, round(avg(a), 6) AS mean_a, round(max(a), 6) AS max_a FROM f
UNION ALL SELECT 'global', round(avg(least(greatest(a, l), h)), 6), round(max(least(greatest(a, l), h)), 6) FROM f, (SELECT quantile_cont(a, 0.01) AS l, quantile_cont(a, 0.99) AS h FROM f)
UNION ALL SELECT 'fold', round(avg(least(greatest(a, lo), hi)), 6), round(max(least(greatest(a, lo), hi)), 6) FROM f JOIN bounds USING (fold)
UNION ALL SELECT 'prespecified', round(avg(least(greatest(a, 1000), 90000)), 6), round(max(least(greatest(a, 1000), 90000)), 6) FROM f""",
)
def cleaning_strategies(spark, sf_dir):
    f = folded(spark, sf_dir)
    tables = {
        "none": f,
        "global": sealed.apply_winsor(f, sealed.fit_winsor(f, "a", scope="global", folds=FOLDS), "a"),
        "fold": sealed.apply_winsor(f, sealed.fit_winsor(f, "a", folds=FOLDS), "a"),
        "prespecified": contaminate.cleaned(f, {"a": LINE_BOUNDS["a"]}),
    }
    out = None
    for name, t in tables.items():
        one = t.agg(F.lit(name).alias("strategy"), r6(F.avg("a")).alias("mean_a"), r6(F.max("a")).alias("max_a"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "validation_report",
    f"""WITH {PAIRED}, v AS (SELECT max(abs(b - a * (1 - y / 100))) AS v1, count(*) FILTER (b <= 0) AS v2, abs(corr(qty, y)) AS v3, count(*) FILTER (qty < 1 OR qty > 50) AS v4 FROM p)
SELECT unnest(['derived', 'positive', 'independent', 'range_qty']) AS "check", unnest([v1 < 1.0, v2 = 0, v3 < 0.10, v4 = 0]) AS passed, round(unnest([v1, v2, v3, v4]::DOUBLE[]), 6) AS value FROM v""",
)
def validation_report(spark, sf_dir):
    rules = {
        "derived": (F.max(F.abs(F.col("b") - F.col("a") * (1 - F.col("y") / 100))), lambda v: v < 1.0),
        "positive": (F.count_if(F.col("b") <= 0), lambda v: v == 0),
        "independent": (F.abs(F.corr("qty", "y")), lambda v: v < 0.10),
        "range_qty": (F.count_if((F.col("qty") < 1) | (F.col("qty") > 50)), lambda v: v == 0),
    }
    return checks.report(paired(spark, sf_dir), rules).withColumn("value", r6("value"))


# -- statistics --------------------------------------------------------------


@query(
    "corr_matrix",
    f"WITH {PAIRED} " + " UNION ALL ".join(f"SELECT '{x}' AS a, '{z}' AS b, round(corr({x}, {z}), 6) AS r FROM p" for i, x in enumerate(("a", "b", "y", "qty", "tax")) for z in ("a", "b", "y", "qty", "tax")[i:]),
)
def corr_matrix(spark, sf_dir):
    return stats.correlations(paired(spark, sf_dir), ["a", "b", "y", "qty", "tax"]).withColumn("r", r6("r"))


@query(
    "spearman",
    f"""WITH {PAIRED}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT round(corr(ra, ry), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r""",
)
def spearman(spark, sf_dir):
    return stats.spearman(paired(spark, sf_dir), "a", "y").withColumn("rho", r6("rho"))


_F_SQL = lambda c: f"""SELECT '{c}' AS feature, ((sum(s * s / n) - sum(s) ** 2 / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f
  FROM (SELECT count(*)::DOUBLE AS n, sum({c} - m) AS s, sum(({c} - m) ** 2) AS q FROM f, (SELECT avg({c}) AS m FROM f) GROUP BY y0)"""  # noqa: E731


@query("anova_f", f"WITH {FOLDED} SELECT feature, round(f, 4) AS f FROM (" + " UNION ALL ".join(_F_SQL(c) for c in ("a", "b", "qty", "tax")) + ")")
def anova_f(spark, sf_dir):
    return stats.anova_f(folded(spark, sf_dir), ["a", "b", "qty", "tax"], "y0").withColumn("f", F.round("f", 4))


@query("topk_features", f"WITH {FOLDED} SELECT feature, round(f, 4) AS f, CAST(row_number() OVER (ORDER BY f DESC, feature) AS INT) AS rank FROM (" + " UNION ALL ".join(_F_SQL(c) for c in ("a", "b", "qty", "tax")) + ") QUALIFY rank <= 2")
def topk_features(spark, sf_dir):
    return stats.top_k(stats.anova_f(folded(spark, sf_dir), ["a", "b", "qty", "tax"], "y0"), "f", 2).withColumn("f", F.round("f", 4))


@query(
    "describe",
    f"WITH {PAIRED} " + " UNION ALL ".join(f"""SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM p""" for c in ("a", "y", "qty")),
)
def describe(spark, sf_dir):
    out = rollup.describe(paired(spark, sf_dir), ["a", "y", "qty"])
    return out.select("feature", "n", *[r6(c).alias(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max")])


@query(
    "histogram",
    f"WITH {PAIRED}, m AS (SELECT min(a) AS lo, max(a) AS hi FROM p) SELECT CAST(least(floor((a - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM p, m GROUP BY 1",
)
def histogram(spark, sf_dir):
    return rollup.histogram(paired(spark, sf_dir), "a", 30)


@query(
    "boxplot",
    f"WITH {PAIRED} SELECT flag, round(quantile_cont(a, 0.25), 6) AS q1, round(quantile_cont(a, 0.5), 6) AS median, round(quantile_cont(a, 0.75), 6) AS q3 FROM p GROUP BY flag",
)
def boxplot(spark, sf_dir):
    out = ranking.percentiles(paired(spark, sf_dir), ["flag"], "a", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return out.select("flag", *[r6(c).alias(c) for c in ("q1", "median", "q3")])


@query(
    "wilcoxon_w",
    """WITH d AS (SELECT o_custkey, o_orderpriority, CAST(round(o_totalprice) AS BIGINT) % 1000 - 500 AS d FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY abs(d)) + (count(*) OVER (PARTITION BY o_orderpriority, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d WHERE d <> 0)
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w FROM r GROUP BY o_orderpriority""",
)
def wilcoxon_w(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_orderpriority", (F.round("o_totalprice").cast("long") % 1000 - 500).alias("d"))
    return stats.wilcoxon(o, ["o_orderpriority"], "d").select("o_orderpriority", "n", "w")


# -- resampling and roll-ups -------------------------------------------------

BOOTS = 10


@query(
    "row_bootstrap_ci",
    f"""WITH {PAIRED}, r AS (SELECT a, row_number() OVER (ORDER BY {uniform_sql("rid", seed=SEED)}, rid) - 1 AS i FROM p), n AS (SELECT count(*) AS n FROM p),
d AS (SELECT b.range AS boot_id, CAST(floor({uniform_sql("b.range", "x.range", seed=SEED)} * n) AS BIGINT) AS i FROM range({BOOTS}) b, (SELECT unnest(range(n)) AS range FROM n) x, n),
m AS (SELECT boot_id, avg(a) AS m FROM d JOIN r USING (i) GROUP BY boot_id)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m""",
)
def row_bootstrap_ci(spark, sf_dir):
    b = resample.row_bootstrap(paired(spark, sf_dir).select("rid", "a"), ["rid"], BOOTS, SEED)
    means = b.groupBy("boot_id").agg(resample.weighted_mean("a").alias("m"))
    return rollup.summary(means, [], "m").select("n", *[r6(c).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query(
    "subject_bootstrap_oob",
    f"""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY {uniform_sql("user_id", seed=SEED)}, user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)), n AS (SELECT count(*) AS n FROM u),
d AS (SELECT b.range AS boot_id, CAST(floor({uniform_sql("b.range", "x.range", seed=SEED)} * n) AS BIGINT) AS i FROM range({BOOTS}) b, (SELECT unnest(range(n)) AS range FROM n) x, n),
picks AS (SELECT boot_id, user_id FROM d JOIN u USING (i)),
i AS (SELECT boot_id, count(*) AS n_in, avg(value) AS mean_in FROM picks JOIN events USING (user_id) GROUP BY boot_id),
o AS (SELECT b.range AS boot_id, count(DISTINCT user_id) AS oob_users, count(*) AS n_out, avg(value) AS mean_out FROM range({BOOTS}) b, events e WHERE NOT EXISTS (SELECT 1 FROM picks p WHERE p.boot_id = b.range AND p.user_id = e.user_id) GROUP BY 1)
SELECT boot_id, CAST(n_in AS BIGINT) AS n_in, round(mean_in, 6) AS mean_in, CAST(oob_users AS BIGINT) AS oob_users, CAST(n_out AS BIGINT) AS n_out, round(mean_out, 6) AS mean_out FROM i JOIN o USING (boot_id) WHERE oob_users >= 5""",
)
def subject_bootstrap_oob(spark, sf_dir):
    bag, out = resample.group_bootstrap(parquet(spark, sf_dir, "events").select("user_id", "value"), "user_id", BOOTS, SEED)
    a = bag.groupBy("boot_id").agg(F.count(F.lit(1)).alias("n_in"), r6(F.avg("value")).alias("mean_in"))
    b = out.groupBy("boot_id").agg(F.count_distinct("user_id").alias("oob_users"), F.count(F.lit(1)).alias("n_out"), r6(F.avg("value")).alias("mean_out"))
    return a.join(b, "boot_id").where("oob_users >= 5")


@query(
    "loso",
    """WITH u AS (SELECT user_id, count(*) AS n, sum(CAST(event_type = 'purchase' AS INT)) AS pos FROM events GROUP BY user_id), t AS (SELECT sum(n) AS n, sum(pos) AS pos FROM u)
SELECT user_id, CAST(u.n AS BIGINT) AS n_test, CAST(u.pos AS BIGINT) AS pos_test, CAST(t.n - u.n AS BIGINT) AS n_train, CAST(t.pos - u.pos AS BIGINT) AS pos_train,
       (u.pos > 0 AND u.pos < u.n AND t.pos - u.pos > 0 AND t.pos - u.pos < t.n - u.n) AS usable FROM u, t""",
)
def loso(spark, sf_dir):
    e = parquet(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return splits.leave_one_group_out(e, "user_id", "y")


SEEDS = 5
SEED_SQL = f"""{FOLDED}, sr AS (SELECT CAST(range AS INT) AS seed, rid, y0 AS label, unnest(['clean', 'follow_up']) AS pipeline, unnest([-a, b]) AS score FROM f, range({SEEDS}) WHERE {uniform_sql("rid", "range", seed="half")} < 0.5),
seeds AS ({_auroc_sql("sr", "pipeline, seed")})"""


def seed_records(spark, sf_dir) -> DataFrame:
    """AUROC of each pipeline on hashed halves of the rows, one record a seed."""
    f = folded(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)))).where(uniform("rid", "seed", seed="half") < 0.5)
    rows = F.array(F.struct(F.lit("clean").alias("pipeline"), (-F.col("a")).alias("score")), F.struct(F.lit("follow_up").alias("pipeline"), F.col("b").alias("score")))
    out = metrics.auroc(f.select("seed", F.col("y0").alias("label"), F.inline(rows)), ["pipeline", "seed"], "score", "label")
    return out.withColumn("auroc", r6("auroc"))


@query(
    "seed_rollup",
    f"""WITH {SEED_SQL} SELECT pipeline, CAST(count(*) AS BIGINT) AS n, round(avg(auroc), 6) AS mean, round(coalesce(stddev_samp(auroc), 0), 6) AS sd, round(median(auroc), 6) AS median,
  round(quantile_cont(auroc, 0.025), 6) AS ci_low, round(quantile_cont(auroc, 0.975), 6) AS ci_high, round(avg(CAST(auroc BETWEEN 0.45 AND 0.55 AS INT)) * 100, 6) AS pct_in_band,
  (quantile_cont(auroc, 0.025) >= 0.40 AND quantile_cont(auroc, 0.975) <= 0.60) AS equivalent FROM seeds GROUP BY pipeline""",
)
def seed_rollup(spark, sf_dir):
    out = rollup.summary(seed_records(spark, sf_dir), ["pipeline"], "auroc").withColumn("equivalent", rollup.equivalence())
    return out.select("pipeline", "n", *[r6(c).alias(c) for c in ("mean", "sd", "median", "ci_low", "ci_high", "pct_in_band")], "equivalent")


@query(
    "pivot_bias",
    f"""WITH {SEED_SQL}, w AS (SELECT seed, avg(auroc) FILTER (pipeline = 'clean') AS clean, avg(auroc) FILTER (pipeline = 'follow_up') AS follow_up FROM seeds GROUP BY seed)
SELECT seed, round(clean, 6) AS clean, round(follow_up, 6) AS follow_up, CASE WHEN follow_up - clean > 0.01 THEN 'INFLATION' ELSE 'OK' END AS leak,
  CASE WHEN clean < 0.44 THEN 'DEGRADED' WHEN clean > 0.56 THEN 'INFLATED' ELSE 'OK' END AS clean_state, CASE WHEN follow_up > 0.70 THEN 'STABLE' ELSE 'DEGRADED' END AS leaky_state FROM w""",
)
def pivot_bias(spark, sf_dir):
    w = rollup.pivot(seed_records(spark, sf_dir), ["seed"], "pipeline", ["clean", "follow_up"], "auroc")
    return w.select(
        "seed", r6("clean").alias("clean"), r6("follow_up").alias("follow_up"), rollup.leak_flag(F.col("follow_up") - F.col("clean")).alias("leak"),
        rollup.clean_flag(F.col("clean")).alias("clean_state"), rollup.leaky_flag(F.col("follow_up")).alias("leaky_state"),
    )


@query(
    "best_worst",
    f"WITH {SEED_SQL} SELECT pipeline, arg_min(seed, abs(auroc - 0.5)) AS best, arg_max(seed, abs(auroc - 0.5)) AS worst FROM (SELECT * FROM seeds ORDER BY seed) GROUP BY pipeline",
)
def best_worst(spark, sf_dir):
    return rollup.nearest(seed_records(spark, sf_dir), ["pipeline"], "seed", "auroc", 0.5)


@query(
    "category_order",
    "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS INT) AS place FROM orders GROUP BY o_orderpriority",
)
def category_order(spark, sf_dir):
    c = parquet(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", rollup.category_order("o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])).orderBy("place")


@query(
    "resume_todo",
    """WITH g AS (SELECT s.range AS seed, m.m AS model, p.p AS priority FROM range(20) s, (SELECT unnest(['lr', 'rf']) AS m) m, (SELECT DISTINCT o_orderpriority AS p FROM orders) p),
d AS (SELECT DISTINCT o_orderkey % 20 AS seed, 'lr' AS model, o_orderpriority AS priority FROM orders WHERE o_totalprice > 440000)
SELECT CAST(seed AS INT) AS seed, model, priority FROM g WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.seed = g.seed AND d.model = g.model AND d.priority = g.priority)""",
)
def resume_todo(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders")
    grid = rollup.grid(spark, seed=list(range(20)), model=["lr", "rf"]).crossJoin(o.select(F.col("o_orderpriority").alias("priority")).distinct())
    done = o.where("o_totalprice > 440000").select((F.col("o_orderkey") % 20).cast("int").alias("seed"), F.lit("lr").alias("model"), F.col("o_orderpriority").alias("priority"))
    return rollup.todo(grid, done, ["seed", "model", "priority"])


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 50), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 50)
SELECT 'both' AS part, user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', user_id FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'only_first', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def set_operations(spark, sf_dir):
    e = parquet(spark, sf_dir, "events").where("value > 50")
    a, b = (e.where(F.col("event_type") == t).select("user_id") for t in ("purchase", "error"))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "only_first": a.subtract(b)}
    out = None
    for name, t in parts.items():
        one = t.select(F.lit(name).alias("part"), "user_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dedup_groups",
    """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT CAST(count(*) AS BIGINT) AS n_users, round(avg(n), 6) AS mean_n, CAST(min(n) AS BIGINT) AS min_n, CAST(max(n) AS BIGINT) AS max_n FROM u""",
)
def dedup_groups(spark, sf_dir):
    per = parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_users"), r6(F.avg("n")).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


@query(
    "meal_types",
    """WITH m AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' BreakFast ' WHEN '2-HIGH' THEN 'late lunch' WHEN '3-MEDIUM' THEN 'DINNER' WHEN '5-LOW' THEN NULL ELSE 'apple' END AS raw FROM orders),
t AS (SELECT CASE WHEN lower(trim(coalesce(raw, ''))) LIKE '%breakfast%' THEN 'breakfast' WHEN lower(raw) LIKE '%lunch%' THEN 'lunch' WHEN lower(raw) LIKE '%dinner%' THEN 'dinner' ELSE 'snack' END AS meal FROM m)
SELECT meal, CAST(CASE meal WHEN 'breakfast' THEN 0 WHEN 'lunch' THEN 1 WHEN 'dinner' THEN 2 ELSE 3 END AS INT) AS code, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY meal""",
)
def meal_types(spark, sf_dir):
    raw = fx.mapped(F.col("o_orderpriority"), {"1-URGENT": " BreakFast ", "2-HIGH": "late lunch", "3-MEDIUM": "DINNER", "4-NOT SPECIFIED": "apple"})
    m = parquet(spark, sf_dir, "orders").select(fx.meal_type(raw).alias("meal"))
    return m.groupBy("meal").agg(F.count(F.lit(1)).alias("n")).withColumn("code", fx.mapped(F.col("meal"), fx.MEAL_CODES, 3))


@query(
    "null_handling",
    f"""WITH {ORDERS_FOLDED} SELECT fold, CAST(sum(CASE WHEN priority IS NULL THEN NULL ELSE CAST(priority = '1-URGENT' AS INT) END) AS BIGINT) AS n_urgent,
  CAST(count(priority) AS BIGINT) AS n_known, round(avg(CAST(priority IS NULL AS INT)), 6) AS missing_rate FROM o GROUP BY fold""",
)
def null_handling(spark, sf_dir):
    o = orders_folded(spark, sf_dir)
    urgent = F.sum(fx.indicator(F.col("priority"), "1-URGENT"))
    return o.groupBy("fold").agg(urgent.alias("n_urgent"), F.count("priority").alias("n_known"), r6(contaminate.missing_rate(["priority"])).alias("missing_rate"))


# -- attribution -------------------------------------------------------------

FEATURES, LEAK = ("a", "qty", "tax"), "b"
_IMPORTANCE_SQL = f"""{FOLDED}, br AS (SELECT CAST(range AS INT) AS boot_id, f.* FROM f, range({BOOTS}) WHERE {uniform_sql("rid", "range", seed="boot")} < 0.5),
imp AS (SELECT boot_id, classifier, feature, round(abs(r), 9) AS mean_abs FROM (
  """ + " UNION ALL ".join(f"SELECT boot_id, '{c}' AS classifier, '{x}' AS feature, corr({x}, {y}) AS r FROM br GROUP BY boot_id" for c, y in (("label", "y0"), ("target", "y")) for x in (*FEATURES, LEAK)) + f""")),
rk AS (SELECT boot_id, classifier, 'leaky' AS pipeline, feature, row_number() OVER (PARTITION BY boot_id, classifier ORDER BY mean_abs DESC, feature) AS rank FROM imp
       UNION ALL SELECT boot_id, classifier, 'clean', feature, row_number() OVER (PARTITION BY boot_id, classifier ORDER BY mean_abs DESC, feature) FROM imp WHERE feature <> '{LEAK}'),
adi AS (SELECT l.boot_id, l.classifier, l.feature, c.rank AS rank_clean, l.rank AS rank_leaky, c.rank - l.rank AS adi FROM rk l LEFT JOIN rk c
        ON c.pipeline = 'clean' AND l.boot_id = c.boot_id AND l.classifier = c.classifier AND l.feature = c.feature WHERE l.pipeline = 'leaky')"""


def importance_runs(spark, sf_dir) -> DataFrame:
    """``boot_id, classifier, pipeline, feature, rank``: |correlation| as importance, on hashed halves of the rows."""
    f = folded(spark, sf_dir).withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(BOOTS - 1)))).where(uniform("rid", "boot_id", seed="boot") < 0.5)
    parts = [F.struct(F.lit(c).alias("classifier"), F.lit(x).alias("feature"), F.round(F.abs(F.corr(x, y)), 9).alias("mean_abs")) for c, y in (("label", "y0"), ("target", "y")) for x in (*FEATURES, LEAK)]
    imp = f.groupBy("boot_id").agg(F.array(*parts).alias("r")).select("boot_id", F.inline("r"))
    leaky = attribution.importance_ranks(imp, ["boot_id", "classifier"]).withColumn("pipeline", F.lit("leaky"))
    clean = attribution.importance_ranks(imp.where(F.col("feature") != LEAK), ["boot_id", "classifier"]).withColumn("pipeline", F.lit("clean"))
    return leaky.unionByName(clean)


def distortions(spark, sf_dir) -> DataFrame:
    runs = importance_runs(spark, sf_dir)
    keys = ["boot_id", "classifier", "feature"]
    clean = runs.where("pipeline = 'clean'").select(*keys, F.col("rank").alias("rank_clean"))
    leaky = runs.where("pipeline = 'leaky'").select(*keys, F.col("rank").alias("rank_leaky"))
    return leaky.join(clean, keys, "left").withColumn("adi", F.col("rank_clean") - F.col("rank_leaky"))


@query("rank_adi", f"WITH {_IMPORTANCE_SQL} SELECT boot_id, classifier, feature, CAST(rank_clean AS INT) AS rank_clean, CAST(rank_leaky AS INT) AS rank_leaky, CAST(adi AS INT) AS adi FROM adi")
def rank_adi(spark, sf_dir):
    return distortions(spark, sf_dir).select("boot_id", "classifier", "feature", "rank_clean", "rank_leaky", "adi")


@query(
    "rank_outer",
    f"""WITH {_IMPORTANCE_SQL}, one AS (SELECT feature, rank_clean, rank_leaky FROM adi WHERE boot_id = 0 AND classifier = 'label'), w AS (SELECT greatest(max(rank_clean), max(rank_leaky)) + 1 AS w FROM one)
SELECT feature, CAST(coalesce(rank_clean, w) AS INT) AS rank_clean, CAST(rank_leaky AS INT) AS rank_leaky, CAST(coalesce(rank_clean, w) - rank_leaky AS INT) AS adi, (rank_clean IS NULL) AS leaky_only FROM one, w""",
)
def rank_outer(spark, sf_dir):
    runs = importance_runs(spark, sf_dir).where("boot_id = 0 and classifier = 'label'")
    out = attribution.attribution_distortion(runs.where("pipeline = 'clean'"), runs.where("pipeline = 'leaky'"))
    return out.select("feature", "rank_clean", "rank_leaky", "adi", "leaky_only")


@query(
    "adi_summary",
    f"""WITH {_IMPORTANCE_SQL} SELECT classifier, feature, CAST(count(*) AS BIGINT) AS n, round(avg(adi), 6) AS mean, round(coalesce(stddev_samp(adi), 0), 6) AS sd, round(quantile_cont(adi, 0.025), 6) AS ci_low, round(quantile_cont(adi, 0.975), 6) AS ci_high,
  round(avg(CAST(adi < 0 AS INT)) * 100, 6) AS pct_neg, round(avg(CAST(adi = 0 AS INT)) * 100, 6) AS pct_zero, round(avg(CAST(adi > 0 AS INT)) * 100, 6) AS pct_pos FROM adi WHERE adi IS NOT NULL GROUP BY classifier, feature""",
)
def adi_summary(spark, sf_dir):
    out = attribution.distortion_summary(distortions(spark, sf_dir), ["classifier", "feature"])
    return out.select("classifier", "feature", "n", *[r6(c).alias(c) for c in ("mean", "sd", "ci_low", "ci_high", "pct_neg", "pct_zero", "pct_pos")])


@query(
    "sign_concordance",
    f"""WITH {_IMPORTANCE_SQL} SELECT x.feature, x.classifier AS a, z.classifier AS b, round(avg(CAST(sign(x.adi) = sign(z.adi) AS INT)) * 100, 6) AS pct
FROM adi x JOIN adi z ON x.boot_id = z.boot_id AND x.feature = z.feature AND x.classifier < z.classifier WHERE x.adi IS NOT NULL AND z.adi IS NOT NULL GROUP BY 1, 2, 3""",
)
def sign_concordance(spark, sf_dir):
    return attribution.sign_concordance(distortions(spark, sf_dir), "boot_id", "classifier").withColumn("pct", r6("pct"))


EXPECTED = {"b": 1, "a": 2}


@query("rank_stability", f"WITH {_IMPORTANCE_SQL} SELECT classifier, feature, round(avg(CAST(rank_leaky = CASE feature WHEN 'b' THEN 1 ELSE 2 END AS INT)) * 100, 6) AS pct_stable FROM adi WHERE feature IN ('a', 'b') GROUP BY 1, 2")
def rank_stability(spark, sf_dir):
    return attribution.rank_stability(distortions(spark, sf_dir), EXPECTED, ["classifier"], "rank_leaky").withColumn("pct_stable", r6("pct_stable"))


@query("false_attribution", f"WITH {_IMPORTANCE_SQL} SELECT classifier, pipeline, round(avg(CAST(rank <= 2 AS INT)), 6) AS far FROM rk WHERE feature = 'a' GROUP BY 1, 2")
def false_attribution(spark, sf_dir):
    return attribution.false_attribution_rate(importance_runs(spark, sf_dir), "a", 2, ["classifier", "pipeline"]).withColumn("far", r6("far"))


@query("top_feature", f"WITH {_IMPORTANCE_SQL} SELECT boot_id, classifier, arg_max(feature, mean_abs) AS top_feature FROM imp GROUP BY 1, 2")
def top_feature(spark, sf_dir):
    runs = importance_runs(spark, sf_dir).where("pipeline = 'leaky'")
    return attribution.top_feature(runs, ["boot_id", "classifier"])


@query(
    "bonferroni",
    """WITH t AS (SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE count(*) / (SELECT count(*) FROM orders) / 2.0::DOUBLE END AS p FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1, p * count(p) OVER ()) END, 6) AS p_adjusted FROM t""",
)
def bonferroni(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders")
    n = o.count()
    t = o.groupBy("o_orderpriority").agg((F.count(F.lit(1)) / F.lit(n) / 2.0).alias("p")).withColumn("p", F.when(F.col("o_orderpriority") != "5-LOW", F.col("p")))
    return stats.bonferroni(t).select("o_orderpriority", r6("p").alias("p"), r6("p_adjusted").alias("p_adjusted"))


WEIGHTS = {"a": 0.0001, "qty": -0.05, "tax": 2.0}


@query(
    "linear_shap",
    f"""WITH {PAIRED}, m AS (SELECT avg(a) AS ma, avg(qty) AS mq, avg(tax) AS mt FROM p), x AS (SELECT 'a' AS feature, 0.0001::DOUBLE * (a - ma) AS phi FROM p, m
UNION ALL SELECT 'qty', -0.05::DOUBLE * (qty - mq) FROM p, m UNION ALL SELECT 'tax', 2.0::DOUBLE * (tax - mt) FROM p, m),
i AS (SELECT feature, avg(abs(phi)) AS mean_abs FROM x GROUP BY feature) SELECT feature, round(mean_abs, 6) AS mean_abs, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INT) AS rank FROM i""",
)
def linear_shap(spark, sf_dir):
    phi = attribution.linear_contributions(paired(spark, sf_dir), WEIGHTS, ["rid"])
    return attribution.importance_ranks(attribution.mean_abs(phi)).withColumn("mean_abs", r6("mean_abs"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold-sealed AUROC of the clean, leaky and oracle pipelines, with what leakage adds."""
    return auc_inflation(spark, sf_dir)
