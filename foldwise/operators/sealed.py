"""Preprocessing fitted on training rows only (``scope="fold"``) or, leakily, on all rows (``scope="global"``).

Fitted parameters are tables keyed by fold; applying them is a join with a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.formulas import clip
from foldwise.operators.ranking import train_percentiles
from foldwise.sources.scratch import written

FOLDS = 5


def _folds(df: DataFrame, folds: int, fold: str) -> DataFrame:
    return df.sparkSession.range(folds).select(F.col("id").cast("int").alias(fold))


def _per_fold(row: DataFrame, folds: int, fold: str) -> DataFrame:
    """A one-row table of global parameters, once for each fold."""
    return _folds(row, folds, fold).join(F.broadcast(row))


def fit_percentiles(df: DataFrame, columns: str | Sequence[str], probs: dict[str, float], scope: str = "fold", fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """``fold, <names>`` of one column, or ``fold, <column>__<name>...`` of several, all in one pass; a row for each fold."""
    several = [columns] if isinstance(columns, str) else list(columns)
    if scope == "fold":
        fitted = train_percentiles(df, several, probs, fold, folds)
    else:
        fitted = train_percentiles(df.withColumn(fold, F.lit(-1)), several, probs, fold, folds)
    got = {(r[fold], r["feature"]): r for r in fitted.collect()}
    names = [(c, n, n if isinstance(columns, str) else f"{c}__{n}") for c in several for n in probs]
    rows = [(f, *[got[f, c][n] for c, n, _ in names]) for f in range(folds)]
    return df.sparkSession.createDataFrame(rows, ", ".join([f"{fold} int", *[f"`{x}` double" for _, _, x in names]]))


def fit_threshold(df: DataFrame, column: str, q: float = 0.25, scope: str = "fold", fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """``fold, threshold``."""
    return fit_percentiles(df, column, {"threshold": q}, scope, fold, folds)


def fit_winsor(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, scope: str = "fold", fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """``fold, lo, hi``."""
    return fit_percentiles(df, column, {"lo": low, "hi": high}, scope, fold, folds)


def fit_median(df: DataFrame, column: str, scope: str = "fold", fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """``fold, median``."""
    return fit_percentiles(df, column, {"median": 0.5}, scope, fold, folds)


def fit_scaler(df: DataFrame, columns: Sequence[str], scope: str = "fold", fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """``fold, feature, mean, sd``: population standard deviation, a zero one counts as 1.

    Training moments are the total's less the fold's own, from counts, sums and squares about each column's overall
    mean, so one pass fits all folds.
    """
    centre = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    parts = []
    for c in columns:
        x = F.col(c) - F.lit(float(centre[c] or 0.0))
        parts += [F.count(c).alias(f"n_{c}"), F.sum(x).alias(f"s_{c}"), F.sum(x * x).alias(f"q_{c}")]
    own = df.groupBy(fold).agg(*parts)
    stats = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(centre[c] or 0.0)).alias("m"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("s"), F.col(f"q_{c}").alias("q")) for c in columns]))
    own = own.select(fold, stats.alias("r")).select(fold, "r.*")
    if scope == "fold":
        whole = Window.partitionBy("feature")
        own = own.select(fold, "feature", "m", *[(F.sum(x).over(whole) - F.coalesce(F.col(x), F.lit(0))).alias(x) for x in ("n", "s", "q")])
    else:
        own = own.groupBy("feature", "m").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q")])
        own = _per_fold(own, folds, fold)
    mean = F.try_divide(F.col("s"), F.col("n"))
    var = F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))
    sd = F.when(var > 0, F.sqrt(var)).otherwise(1.0)
    return own.select(fold, "feature", (F.col("m") + mean).alias("mean"), sd.alias("sd"))


def fit_mode(df: DataFrame, column: str, scope: str = "fold", fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """``fold, mode``: the most frequent training value, of ties the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(fold, column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(column).agg(F.sum("n").alias("all"))
    each = totals.join(F.broadcast(_folds(df, folds, fold)))
    own = counts.select(F.col(fold).alias("__f"), F.col(column).alias("__v"), "n")
    each = each.join(own, (F.col(fold) == F.col("__f")) & (F.col(column) == F.col("__v")), "left")
    n = F.col("all") - F.coalesce("n", F.lit(0)) if scope == "fold" else F.col("all")
    best = F.max(F.struct(n.alias("n"))).over(Window.partitionBy(fold))["n"]
    return each.select(fold, column, n.alias("n"), best.alias("best")).where("n = best and n > 0").groupBy(fold).agg(F.min(column).alias("mode"))


def fit_ordinal(df: DataFrame, column: str, scope: str = "fold", fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """``fold, category, code``: codes from 0 in sorted order of the training categories."""
    counts = df.where(F.col(column).isNotNull()).groupBy(fold, column).agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy(column).agg(F.count_distinct(fold).alias("in_folds"), F.min(fold).alias("only"))
    each = kinds.join(F.broadcast(_folds(df, folds, fold)))
    if scope == "fold":  # a category of one fold only is unknown to that fold's training rows
        each = each.where((F.col("in_folds") > 1) | (F.col("only") != F.col(fold)))
    code = F.dense_rank().over(Window.partitionBy(fold).orderBy(column)) - 1
    return each.select(fold, F.col(column).alias("category"), code.cast("int").alias("code"))


def apply_threshold(df: DataFrame, params: DataFrame, column: str, name: str = "label", side: str = "low", fold: str = "fold") -> DataFrame:
    hit = F.col(column) <= F.col("threshold") if side == "low" else F.col(column) >= F.col("threshold")
    return df.join(F.broadcast(params), fold).withColumn(name, hit.cast("int"))


def apply_winsor(df: DataFrame, params: DataFrame, column: str, name: str | None = None, fold: str = "fold") -> DataFrame:
    return df.join(F.broadcast(params), fold).withColumn(name or column, clip(F.col(column), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def apply_scaler(df: DataFrame, params: DataFrame, columns: Sequence[str], suffix: str = "_z", fold: str = "fold") -> DataFrame:
    wide = params.groupBy(fold).agg(
        *[F.max(F.when(F.col("feature") == c, F.col(x))).alias(f"__{x}_{c}") for c in columns for x in ("mean", "sd")]
    )
    out = df.join(F.broadcast(wide), fold)
    out = out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__sd_{c}") for c in columns})
    return out.drop(*[f"__{x}_{c}" for c in columns for x in ("mean", "sd")])


def apply_fill(df: DataFrame, params: DataFrame, column: str, value: str, name: str | None = None, fold: str = "fold") -> DataFrame:
    """Replace nulls by the fold's fitted value (median or mode)."""
    return df.join(F.broadcast(params), fold, "left").withColumn(name or column, F.coalesce(F.col(column), F.col(value))).drop(value)


def apply_ordinal(df: DataFrame, params: DataFrame, column: str, name: str, fold: str = "fold") -> DataFrame:
    """Codes; categories that training has not seen, and nulls, are -1. A dimension join, broadcast if Spark finds it small."""
    known = params.select(F.col(fold).alias("__f"), F.col("category").alias("__c"), "code")
    out = df.join(known, (F.col(fold) == F.col("__f")) & (F.col(column) == F.col("__c")), "left")
    return out.withColumn(name, F.coalesce("code", F.lit(-1))).drop("__f", "__c", "code")


class FoldSealedPreprocessor:
    """Impute, encode, winsorize (encoded columns too), then scale; each step fitted on what the last one made.

    ``scope="global"`` fits the same steps on all rows: the leak. All columns of a step are fitted in one pass, and
    fitted parameters are tables of a row for each fold (and category).
    """

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str] = (), scope: str = "fold", fold: str = "fold", folds: int = FOLDS):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.at = {"scope": scope, "fold": fold, "folds": folds}
        self.fold = fold
        self.params: dict[tuple[str, str], DataFrame] = {}

    @property
    def _columns(self) -> list[str]:
        return self.numeric + [f"{c}_code" for c in self.categorical]

    def _fill(self, df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(self.params["median", "*"]), self.fold, "left")
        return df.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__median")) for c in self.numeric}).drop(*[f"{c}__median" for c in self.numeric])

    def _encode(self, df: DataFrame, c: str) -> DataFrame:
        df = apply_fill(df, self.params["mode", c], c, "mode", fold=self.fold)
        df = apply_ordinal(df, self.params["ordinal", c], c, f"{c}_code", self.fold)
        return df.withColumn(f"{c}_code", F.col(f"{c}_code").cast("double"))

    def _clip(self, df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(self.params["winsor", "*"]), self.fold)
        return df.withColumns({c: clip(F.col(c), F.col(f"{c}__lo"), F.col(f"{c}__hi")) for c in self._columns}).drop(*[f"{c}__{x}" for c in self._columns for x in ("lo", "hi")])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        if self.numeric:
            self.params["median", "*"] = fit_percentiles(df, self.numeric, {"median": 0.5}, **self.at)
            df = self._fill(df)
        for c in self.categorical:
            self.params["mode", c] = written(fit_mode(df, c, **self.at), "mode")
            filled = apply_fill(df, self.params["mode", c], c, "mode", fold=self.fold)
            self.params["ordinal", c] = written(fit_ordinal(filled, c, **self.at), "ordinal")
            df = self._encode(df, c)
        df = written(df, "encoded")
        self.params["winsor", "*"] = fit_percentiles(df, self._columns, {"lo": 0.01, "hi": 0.99}, **self.at)
        df = self._clip(df)
        self.params["scaler", "*"] = written(fit_scaler(df, self._columns, **self.at), "scaler")
        return apply_scaler(df, self.params["scaler", "*"], self._columns, fold=self.fold)

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply what was fitted to other rows that carry a fold."""
        if not self.params:
            raise RuntimeError("fit_transform comes first")
        if self.numeric:
            df = self._fill(df)
        for c in self.categorical:
            df = self._encode(df, c)
        return apply_scaler(self._clip(df), self.params["scaler", "*"], self._columns, fold=self.fold)
