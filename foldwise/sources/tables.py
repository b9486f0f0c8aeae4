"""Readers: dialects of CSV, partitioned folders, YAML, checkpoints; and parquet, the default."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Tokens read as null, by dialect.
STRICT = ("NA", "NaN", "nan", "")
PANDAS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
EICU = (*PANDAS, "Unknown", "Other")
DIALECTS = {"strict": STRICT, "plain": PANDAS, "default_plus": PANDAS, "eicu": EICU}


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, dialect: str = "plain") -> DataFrame:
    """A CSV table whose null tokens are those of the dialect.

    Columns are read as strings, nulled, then cast to the schema; a value that does not fit becomes null. Without a
    schema columns stay strings (:func:`infer` finds types in one more pass).
    """
    raw = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    tokens = DIALECTS[dialect]
    raw = raw.select([F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is None:
        return raw
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    return raw.select([F.try_to_timestamp(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def infer(df: DataFrame) -> DataFrame:
    """Cast string columns to double where every value is a number."""
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in df.columns]).first()
    return df.select([F.col(f"`{c}`").try_cast("double").alias(c) if bad[c] == 0 else F.col(f"`{c}`") for c in df.columns])


def subject_folders(spark: SparkSession, root: str, pattern: str = r"CGMacros-(\d+)", id_col: str = "subject_id", dialect: str = "plain") -> DataFrame:
    """One table of all ``<root>/*/*.csv``, with the id from each file's folder name; folders without a file are not there.

    Columns go by name: files may have them in any order, and lack some. Files are grouped by their header lines, few
    whatever the number of files, and each group is read under its own header.
    """
    # of each file the first line, which is the one at its start
    lines = spark.read.text(f"{root}/*/*.csv").select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
    out = None
    for group in heads.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect():
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(group["files"])
        clean = [F.when(~F.col(f"`{c}`").isin(*DIALECTS[dialect]), F.col(f"`{c}`")).alias(c.replace("\ufeff", "").strip()) for c in raw.columns]
        one = raw.select(*clean, F.regexp_extract(F.input_file_name(), pattern, 1).cast("int").alias(id_col))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A checkpoint of records; empty where nothing has been written yet."""
    return if_there(lambda: spark.read.schema(schema).json(path), spark, schema)


def if_there(read, spark: SparkSession, schema) -> DataFrame:
    """What ``read`` returns, or an empty table of the schema where the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def config(path: str) -> dict:
    """A flat or nested configuration from YAML (where the library is installed) or JSON."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return _flat_yaml(text)
    return yaml.safe_load(text)


def _flat_yaml(text: str) -> dict:
    """``key: value`` lines, nested by two-space indents; numbers, booleans, null and strings."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip()
        if not value:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
            continue
        quoted = value[0] in "\"'" and value[-1] == value[0]
        if quoted:
            stack[-1][1][key] = value[1:-1]
            continue
        try:
            stack[-1][1][key] = json.loads(value)
        except ValueError:
            stack[-1][1][key] = None if value == "~" else value
    return root
