"""Writers: CSV, JSON and append-only checkpoints, through Spark's committers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.rollup import exploded_folds, todo


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header. ``single`` gives one file, for small result tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def verified_csv(df: DataFrame, path: str, single: bool = False) -> int:
    """Write, read the rows back and compare their number; the committer makes the write all or nothing."""
    n = df.count()
    csv(df, path, single)
    got = df.sparkSession.read.option("header", True).csv(path).count()
    if got != n:
        raise OSError(f"{path} has {got} rows of {n}")
    return n


def json_report(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines; small reports make one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def resume(grid: DataFrame, done: DataFrame, keys: Sequence[str], work, path: str) -> DataFrame:
    """Do the cells that the checkpoint lacks and append their records; returns the cells that were to do."""
    left = todo(grid, done, keys)
    append_jsonl(work(left), path)
    return left


def resume_cells(grid: DataFrame, keys: Sequence[str], work, path: str, batches: int = 8) -> DataFrame:
    """Do the cells of a grid that aren't done and return all cells' records; each cell counts once, whatever was interrupted.

    ``work(cells)`` gives records with the keys. A batch of cells is written under its keys, replacing what an interrupted run
    left there, and then marked as done under the same keys; only marked cells are read. A task or an executor that is lost
    is Spark's to repeat, and a run that is stopped loses at most its last batch. Keys must not be null.
    """
    spark = grid.sparkSession
    data, marks = f"{path}/cells", f"{path}/done"
    grid = grid.select(*keys).distinct()

    def put(df: DataFrame, at: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(at)

    def marked() -> DataFrame:
        types = dict(grid.dtypes)
        try:
            return spark.read.parquet(marks).select(*[F.col(k).cast(types[k]).alias(k) for k in keys])
        except AnalysisException:  # nothing is done yet
            return grid.where(F.lit(False))

    def under(df: DataFrame) -> DataFrame:
        return df.repartition(*keys)

    batch = F.pmod(F.xxhash64(*keys), F.lit(batches))
    for b in range(batches):
        left = grid.where(batch == b).join(marked(), list(keys), "left_anti")
        if left.limit(1).count():
            put(under(work(left)), data)
            put(under(left.withColumn("done", F.lit(True))), marks)
    records = spark.read.parquet(data)
    types = dict(grid.dtypes)
    records = records.withColumns({k: F.col(k).cast(types[k]) for k in keys})
    return records.join(marked(), list(keys), "left_semi")


def sidecar(df: DataFrame, path: str, columns: Sequence[str], **facts) -> None:
    """A one-row JSON beside a table: its facts and each column's count, mean, sd, minimum and maximum."""
    stats = [F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns]
    json_report(df.agg(F.count(F.lit(1)).alias("n_rows"), *stats).withColumns({k: F.lit(v) for k, v in facts.items()}), path)


def summary_and_raw(raw: DataFrame, summary: DataFrame, stem: str) -> None:
    csv(raw, f"{stem}_raw", single=True)
    csv(summary, stem, single=True)


def fold_rows(df: DataFrame, arrays: Sequence[str], path: str) -> None:
    """Per-fold arrays as rows."""
    csv(exploded_folds(df, arrays), path, single=True)


def text_report(df: DataFrame, template: str, columns: Sequence[str]) -> DataFrame:
    """A ``line`` for each row by a printf template: plain text, or rows of a LaTeX table."""
    return df.select(F.format_string(template, *columns).alias("line"))
