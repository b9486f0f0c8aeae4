"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.sources.scratch import forget, shared_dir, written

__all__ = ["forget", "let", "shared_dir", "table", "text_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, use) -> Column:
    """Bind an expression once inside a larger one."""
    return F.transform(F.array(value), use)[0]
