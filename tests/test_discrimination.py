"""AUROC and average precision come from scores that are counted once."""

from foldwise.operators import metrics


def test_scores_are_counted_once(spark, monkeypatch):
    d = spark.createDataFrame([(k, (i * 7 % 10) / 10, int(i * (k + 1) % 3 == 0)) for k in (0, 1) for i in range(40)], "k int, s double, y int")
    one = {r["k"]: (r["n"], r["n_pos"], r["auroc"]) for r in metrics.auroc(d, ["k"], "s", "y").collect()}
    two = {r["k"]: r["average_precision"] for r in metrics.average_precision(d, ["k"], "s", "y").collect()}
    counted, real = [], metrics.score_counts
    monkeypatch.setattr(metrics, "score_counts", lambda *a: counted.append(1) or real(*a))
    got = metrics.discrimination(d, ["k"], "s", "y").collect()
    assert {r["k"]: (r["n"], r["n_pos"], r["auroc"]) for r in got} == one and {r["k"]: r["average_precision"] for r in got} == two and len(counted) == 1
