"""Joins without pairs of rows, resumed grids and table functions against plain Python."""

import collections
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import joins
from foldwise.sources import sinks, table_functions

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    """Ties, nulls, repeated rows, and one user with most rows."""
    rng = np.random.default_rng(4)
    rows = [(i, int(u) if u else None, T0 + datetime.timedelta(minutes=int(rng.integers(0, 6000)) // 5 * 5), float(v) if v > 3 else None) for i, (u, v) in enumerate(zip(rng.choice([0, 1, 1, 1, 2, 3], 400), rng.integers(0, 90, 400)))]
    rows += rows[:5]
    return rows, spark.createDataFrame(rows, "id long, u long, ts timestamp_ntz, value double")


def test_window_extremes(events):
    rows, e = events
    got = joins.interval_extremes(e, e.select("u", "ts", "value"), ["u"], "ts", "15 minutes", "24 hours", "value", 2).collect()
    want = collections.Counter()
    for i, u, t, v in rows:
        inside = [b for _, a, s, b in rows if u is not None and a == u and b is not None and t + datetime.timedelta(minutes=15) < s <= t + datetime.timedelta(hours=24)]
        if len(inside) >= 2:
            want[i, len(inside), min(inside), max(inside)] = 1
    assert collections.Counter((r["id"], r["n_readings"], r["low"], r["peak"]) for r in got if r["u"] is not None) == want


@pytest.mark.parametrize("hours", [1, 30, 90])
def test_uninterrupted_pairs(events, hours):
    rows, e = events
    p = e.withColumn("end", F.col("ts") + F.expr(f"interval {hours} hours"))
    got = joins.no_event_between(p, e, ["u"], "ts", "end", "ts")
    assert got.columns == p.columns
    want = sorted(i for i, u, t, _ in rows if not any(a == u and u is not None and t < s < t + datetime.timedelta(hours=hours) for _, a, s, _ in rows))
    assert sorted(r["id"] for r in got.collect()) == want


def test_empty_sides(events):
    _, e = events
    p = e.withColumn("end", F.col("ts"))
    assert joins.no_event_between(p, e.where("false"), ["u"], "ts", "end", "ts").count() == e.count()
    assert joins.no_event_between(p.where("false"), e, ["u"], "ts", "end", "ts").count() == 0
    assert joins.interval_extremes(e, e.where("false"), ["u"], "ts", "15 minutes", "24 hours", "value").count() == 0


def test_a_run_stopped_halfway_neither_repeats_nor_loses_a_cell(spark, tmp_path):
    grid = spark.range(40).select((F.col("id") % 8).cast("int").alias("a"), F.concat(F.lit("k/"), (F.col("id") % 5).cast("string")).alias("b"))
    done = []

    def work(cells):
        keys = [tuple(r) for r in cells.collect()]
        done.append(keys)
        return cells.withColumn("x", F.explode(F.array(*[F.lit(i) for i in range(3)])))

    def dies(cells):
        if len(done) == 3:
            raise RuntimeError("lost")
        return work(cells)

    want = sorted((r["a"], r["b"], i) for r in grid.collect() for i in range(3))
    with pytest.raises(RuntimeError):
        sinks.resume_cells(grid, ["a", "b"], dies, str(tmp_path / "g"), 6)
    before = len(done)
    # what an interrupted batch wrote without its mark doesn't count, and is replaced
    grid.where("a = 1").withColumn("x", F.lit(99)).write.mode("append").partitionBy("a", "b").parquet(str(tmp_path / "g2/cells"))
    assert sorted(map(tuple, sinks.resume_cells(grid, ["a", "b"], work, str(tmp_path / "g2"), 6).select("a", "b", "x").collect())) == want
    del done[before:]
    got = sinks.resume_cells(grid, ["a", "b"], work, str(tmp_path / "g"), 6).select("a", "b", "x").collect()
    assert sorted(map(tuple, got)) == want
    cells = [c for keys in done for c in keys]
    assert len(cells) == len(set(cells)) == 40


def test_table_functions(spark):
    table_functions.register(spark)
    got = spark.sql("SELECT r.* FROM VALUES ('a'), ('b'), (NULL) t(k), LATERAL fold_rounds(k, 5, '7') r").collect()
    assert len(got) == 10 and sum(r["is_test"] for r in got) == 2
    n = spark.sql("SELECT sum(n_drawn) AS n, count_if(n_drawn < 1) AS z FROM range(2000) t(k), LATERAL draws(CAST(k AS STRING), 3, '1')").first()
    assert abs(n["n"] - 6000) < 300 and n["z"] == 0
