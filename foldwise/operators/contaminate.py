"""Missingness, outliers, noise and shifts, placed by hash so that every engine can place them alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.formulas import clip, wbv
from foldwise.functions.hashing import uniform
from foldwise.operators.ranking import by_uniform, row_numbers

#: Plausible ranges of the paired-outcome table.
PLAUSIBLE = {
    "age": (18.0, 90.0),
    "bmi": (14.0, 60.0),
    "hct": (20.0, 65.0),
    "tp": (4.0, 10.0),
    "wbv": (2.0, 10.0),
    "hdl": (10.0, 120.0),
    "ldl": (30.0, 300.0),
    "tg0h": (50.0, 3000.0),
    "tg4h": (0.0, 2000.0),
    "tcr": (-50.0, 100.0),
}


def _chosen(df: DataFrame, keys: Sequence[Column | str], seed, least: int, rate: float, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank by hash within ``by``, and the number of rows to choose there."""
    df = df.withColumn("__u", uniform(*keys, seed=seed))
    order = [F.col("__u"), *[F.col(k) if isinstance(k, str) else k for k in keys]]
    if not by:
        n = df.count()
        df = row_numbers(df, [], order, by_uniform(F.col("__u"), n), name)
        return df.withColumn("__most", F.lit(max(least, int(n * rate)))).drop("__u")
    sizes = df.groupBy(*by).agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * rate + 1e-9)).alias("__most"))
    df = row_numbers(df, list(by), order, by_uniform(F.col("__u")), name)
    return df.join(F.broadcast(sizes), list(by)).drop("__u")


def missing_at_random(df: DataFrame, column: str, rate: float, keys: Sequence[Column | str], seed=0, by: Sequence[str] = ()) -> DataFrame:
    """MCAR: exactly the rate's share of rows (of each of ``by``), rounded down, lose the value."""
    out = _chosen(df, keys, f"{seed}:{column}", 0, rate, "__rn", by)
    return out.withColumn(column, F.when(F.col("__rn") > F.col("__most"), F.col(column))).drop("__rn", "__most")


def missing_by(df: DataFrame, column: str, driver: str, rate: float, keys: Sequence[Column | str], seed=0, by: Sequence[str] = ()) -> DataFrame:
    """MAR: the chance grows with the driver column, and is rescaled to the rate on average (of each of ``by``, few)."""
    lows = df.groupBy(*by).agg(F.min(driver).alias("__lo"), F.max(driver).alias("__hi"))
    near = lambda t, x: t.join(F.broadcast(x), list(by)) if by else t.join(F.broadcast(x))
    scaled = F.coalesce((F.col(driver) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-9), F.lit(0.0))
    chance = near(df, lows).withColumn("__p", clip(scaled * 2 * rate, 0.02, min(0.5, 2 * rate)))
    means = chance.groupBy(*by).agg(F.avg("__p").alias("__mean"))
    chance = near(chance, means).withColumn("__p", clip(F.col("__p") * F.lit(rate) / F.col("__mean"), 0.0, 0.9))
    gone = uniform(*keys, seed=f"{seed}:{column}") < F.col("__p")
    return chance.withColumn(column, F.when(~F.coalesce(gone, F.lit(False)), F.col(column))).select(*df.columns)


def _between(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + u * F.lit(high - low)


#: Intervals of implausible values, by kind: the column and one or two intervals (half of the rows each).
INJECTED = {
    "neg_tg4h": ("tg4h", (-200.0, -1.0)),
    "extreme_tg4h": ("tg4h", (1500.0, 3000.0)),
    "extreme_hct": ("hct", (8.0, 19.9), (65.1, 80.0)),
    "extreme_tp": ("tp", (1.0, 3.9), (10.1, 14.0)),
}


def inject_outliers(df: DataFrame, kinds: Sequence[str], rate: float, keys: Sequence[Column | str], seed=0, by: Sequence[str] = ()) -> DataFrame:
    """Implausible values in max(1, n * rate) rows (of each of ``by``) of each kind; viscosity is recomputed where its parts change."""
    if not rate:
        return df
    for kind in kinds:
        if kind not in INJECTED:
            raise ValueError(kind)
        column, low, *high = INJECTED[kind]
        df = _chosen(df, keys, f"{seed}:{kind}", 1, rate, "__rn", by)
        u = uniform(*keys, seed=f"{seed}:{kind}:value")
        hit, half = F.col("__rn") <= F.col("__most"), F.col("__rn") <= F.floor(F.col("__most") / 2)
        value = F.when(half, _between(u, *low)).otherwise(_between(u, *high[0])) if high else _between(u, *low)
        df = df.withColumn(column, F.when(hit, value).otherwise(F.col(column)))
        if column in ("hct", "tp"):
            df = df.withColumn("wbv", F.when(hit, F.bround(wbv(F.col("hct"), F.col("tp")), 3)).otherwise(F.col("wbv")))
        df = df.drop("__rn", "__most")
    return df


def out_of_range(bounds: dict[str, tuple[float, float]]) -> list[Column]:
    """Aggregates: for each column the rows outside its bounds."""
    return [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_out") for c, (lo, hi) in bounds.items()]


def cleaned(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns clipped to their bounds, where the table has them."""
    return df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def with_noise(df: DataFrame, column: str, sd: float, seed: int = 0) -> DataFrame:
    return df.withColumn(column, F.col(column) + F.randn(seed) * F.lit(float(sd)))


def missing_rate(columns: Sequence[str]) -> Column:
    """Aggregate: the mean over columns of their share of nulls."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.avg(F.col(c).isNull().cast("double"))
    return total / F.lit(float(len(columns)))


#: Configuration shifts: parameter -> change, applied before simulating.
SHIFTS = {
    "tg0h_shift": {"tg0h_mu_log": lambda x: x + 0.3, "tg0h_shift": lambda x: x + 100.0},
    "bmi_shift": {"bmi_mu": lambda x: x + 2 * 3.0},
    "noise_shift": {"tcr_sd": lambda x: x * 1.5},
    "prevalence_shift": {"label_quantile": lambda x: 0.35},
}
NOISE_LEVELS = (0.5, 1.0, 1.5, 2.0, 3.0)


def shifted(config: dict, kind: str) -> dict:
    """A copy of a simulation's configuration with the named shift, or ``noise_x<level>``."""
    out = dict(config)
    if kind.startswith("noise_x"):
        out["tcr_sd"] = out["tcr_sd"] * float(kind.removeprefix("noise_x"))
        return out
    for k, f in SHIFTS.get(kind, {}).items():
        out[k] = f(out.get(k, 0.25))
    return out
