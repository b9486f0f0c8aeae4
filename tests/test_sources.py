"""Every reader and writer on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from foldwise.sources import sinks, tables


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("dialect,nulls", [("strict", {"NA", "nan", ""}), ("plain", {"NA", "nan", "", "NULL", "n/a"}), ("default_plus", {"NA", "nan", "", "NULL", "n/a"}), ("eicu", {"NA", "nan", "", "NULL", "n/a", "Unknown", "Other"})])
def test_null_tokens_of_dialects(spark, tmp_path, dialect, nulls):
    words = ["NA", "nan", "", "NULL", "n/a", "Unknown", "Other", "x", "0"]
    path = put(tmp_path / "a.csv", "i,v\n" + "".join(f"{i},{w}\n" for i, w in enumerate(words)))
    got = {r["i"]: r["v"] for r in tables.csv(spark, path, dialect=dialect).collect()}
    assert {w for i, w in enumerate(words) if got[str(i)] is None} == nulls


def test_csv_casts_and_bad_values_are_null(spark, tmp_path):
    path = put(tmp_path / "a.csv", "lab (x),t,n\n1.5,2024-01-02 03:04:05,7\nbad,never,8.5\nNA,,\n")
    got = tables.csv(spark, path, "`lab (x)` double, t timestamp, n int").collect()
    assert [r[0] for r in got] == [1.5, None, None] and [r[2] for r in got] == [7, None, None]
    assert got[0][1] == datetime.datetime(2024, 1, 2, 3, 4, 5) and got[1][1] is None
    plain = tables.csv(spark, path)
    assert dict(plain.dtypes) == {"lab (x)": "string", "t": "string", "n": "string"}
    assert dict(tables.infer(plain).dtypes) == {"lab (x)": "string", "t": "string", "n": "double"}


def test_subject_folders_read_columns_by_name(spark, tmp_path):
    put(tmp_path / "CGMacros-001" / "CGMacros-001.csv", "Libre GL,Dexcom GL\n1,2\n3,NA\n")
    put(tmp_path / "CGMacros-002" / "CGMacros-002.csv", "Dexcom GL,Libre GL,HR\n20,10,70\n")
    put(tmp_path / "CGMacros-003" / "CGMacros-003.csv", "﻿Libre GL,Dexcom GL\n5,6\n")
    (tmp_path / "CGMacros-004").mkdir()
    got = {(r["subject_id"], r["Libre GL"], r["Dexcom GL"], r["HR"]) for r in tables.subject_folders(spark, str(tmp_path)).collect()}
    assert got == {(1, "1", "2", None), (1, "3", None, None), (2, "10", "20", "70"), (3, "5", "6", None)}


def test_checkpoints_are_resumed(spark, tmp_path):
    path, schema = f"{tmp_path}/c", "seed int, model string, auroc double"
    grid = spark.createDataFrame([(s, m) for s in range(3) for m in ("lr", "rf")], "seed int, model string")
    done = lambda: tables.jsonl(spark, path, schema)
    assert done().count() == 0
    work = lambda todo: todo.withColumn("auroc", F.lit(0.5))
    sinks.append_jsonl(work(grid.where("seed = 0")), path)
    left = sinks.resume(grid, done(), ["seed", "model"], work, path)
    assert done().count() == 6 and done().select("seed", "model").distinct().count() == 6
    assert sinks.todo(grid, done(), ["seed", "model"]).count() == 0 and left.columns == ["seed", "model"]


def test_missing_path_is_an_empty_table_but_other_errors_are_raised(spark, tmp_path):
    assert tables.if_there(lambda: spark.read.parquet(f"{tmp_path}/none"), spark, "a int").columns == ["a"]
    with pytest.raises(Exception):
        tables.if_there(lambda: spark.sql("select nothing from nowhere"), spark, "a int")


def test_configurations(tmp_path):
    text = "n: 1500\nname: 'a: b'\nshare: 0.25  # of rows\nflag: true\nnone: null\ninner:\n  x: 1\n  deep:\n    y: -2.5\nlast: z\n"
    want = {"n": 1500, "name": "a: b", "share": 0.25, "flag": True, "none": None, "inner": {"x": 1, "deep": {"y": -2.5}}, "last": "z"}
    assert tables.config(put(tmp_path / "c.yaml", text)) == want == tables._flat_yaml(text)
    assert tables.config(put(tmp_path / "c.json", json.dumps(want))) == want


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 4.0, None)], "id long, v double, s string")
    assert sinks.verified_csv(df, f"{tmp_path}/v") == 3
    back = tables.csv(spark, f"{tmp_path}/v", "id long, v double, s string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    sinks.json_report(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    sinks.sidecar(df, f"{tmp_path}/s", ["v"], cohort="x")
    row = spark.read.json(f"{tmp_path}/s").first()
    assert (row["n_rows"], row["cohort"], row["v"]["n"], row["v"]["mean"], row["v"]["max"]) == (3, "x", 2, 3.0, 4.0)
    sinks.summary_and_raw(df, df.limit(1), f"{tmp_path}/both")
    assert spark.read.option("header", True).csv(f"{tmp_path}/both_raw").count() == 3 and spark.read.option("header", True).csv(f"{tmp_path}/both").count() == 1
    folds = spark.createDataFrame([("lr", [0.5, 0.6], "hidden")], "model string, aurocs array<double>, _note string")
    sinks.fold_rows(folds, ["aurocs"], f"{tmp_path}/f")
    got = spark.read.option("header", True).csv(f"{tmp_path}/f")
    assert got.columns == ["model", "fold", "aurocs"] and got.count() == 2
    assert [r["line"] for r in sinks.text_report(df.where("id = 1"), "%d & %s \\\\", ["id", "s"]).collect()] == ["1 & a \\\\"]
