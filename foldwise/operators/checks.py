"""Data-quality checks as one aggregate, told as rows ``check, passed, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.formulas import wbv
from foldwise.operators.stats import tost

#: Ranges a simulated table keeps.
RANGES = {
    "age": (18.0, 75.0),
    "bmi": (16.0, 33.0),
    "hct": (30.0, 55.0),
    "tp": (5.0, 8.9),
    "hdl": (25.0, 87.0),
    "ldl": (70.0, 215.0),
    "tg0h": (350.0, 1750.0),
    "tg4h": (1.0, 1300.0),
    "tcr": (-10.0, 99.9),
}
#: Target means and standard deviations.
TARGETS = {
    "age": (53.0, 10.0),
    "bmi": (24.0, 3.0),
    "hct": (41.7, 3.75),
    "tp": (6.88, 0.62),
    "hdl": (50.5, 9.7),
    "ldl": (131.0, 28.0),
    "wbv": (5.85, 0.46),
    "tg0h": (617.0, 130.0),
    "tcr": (52.2, 18.6),
}
MALE_SHARE = 0.485


def report(df: DataFrame, checks: dict[str, tuple]) -> DataFrame:
    """``{name: (aggregate, passes of it)}`` evaluated in one pass; a null value does not pass."""
    row = df.agg(*[value.cast("double").alias(f"v{i}") for i, (value, _) in enumerate(checks.values())])
    parts = [F.struct(F.lit(n).alias("check"), F.coalesce(rule(F.col(f"v{i}")), F.lit(False)).alias("passed"), F.col(f"v{i}").alias("value")) for i, (n, (_, rule)) in enumerate(checks.items())]
    return row.select(F.inline(F.array(*parts)))


def simulated_checks(scenario: str = "null") -> dict[str, tuple]:
    """Checks of a simulated paired-outcome table; independence only where the scenario has none."""
    near = lambda most: lambda v: v < most
    none = lambda v: v == 0
    out = {
        "wbv_formula": (F.max(F.abs(F.col("wbv") - wbv(F.col("hct"), F.col("tp")))), near(0.01)),
        "follow_up_positive": (F.count_if(F.col("tg4h") <= 0), none),
        "follow_up_derived": (F.max(F.abs(F.col("tg4h") - F.col("tg0h") * (1 - F.col("tcr") / 100))), near(1.0)),
    }
    if scenario == "null":
        out["independence"] = (F.abs(F.corr("wbv", "tcr")), near(0.10))
    for c, (lo, hi) in RANGES.items():
        out[f"range_{c}"] = (F.count_if((F.col(c) < lo) | (F.col(c) > hi)), none)
    out["sex_share"] = (F.abs(F.avg("sex") - MALE_SHARE), near(0.05))
    return out


def validation_report(df: DataFrame, scenario: str = "null") -> DataFrame:
    return report(df, simulated_checks(scenario))


def equivalence_report(df: DataFrame, share: float = 0.15) -> list[dict]:
    """Equivalence tests of the means to their targets; told beside the checks, not among them."""
    return [tost(df, c, m, s, share) for c, (m, s) in TARGETS.items()]


def reconstruction_error(pre: str, post: str, change: str) -> list[Column]:
    gap = F.abs(F.col(post) - F.col(pre) - F.col(change))
    return [F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error")]


#: Pre-specified bands of the confirmatory simulations, by scenario and pipeline.
CONFIRM = {
    ("null", "clean"): (0.44, 0.56),
    ("null", "follow_up"): (0.85, 1.0),
    ("null", "target"): (0.95, 1.0),
    ("wbv_positive", "clean"): (0.75, 1.0),
}


def confirmed(scenario: str, pipeline: str, value: Column) -> Column:
    lo, hi = CONFIRM[scenario, pipeline]
    return (value >= lo) & (value <= hi)


#: The rank that viscosity has to have at least without a signal, and at most with one.
RANK_RULES = {"null": (4, None), "wbv_positive": (None, 3)}


def rank_at_least(rank: Column, least: int) -> Column:
    return rank >= least


def rank_at_most(rank: Column, most: int) -> Column:
    return rank <= most


def rank_confirmed(scenario: str, rank: Column) -> Column:
    """Whether a scenario's rank rule holds."""
    least, most = RANK_RULES[scenario]
    return rank_at_least(rank, least) if least is not None else rank_at_most(rank, most)


def checklist_score(df: DataFrame, answer: str = "answer", least: float = 83.3) -> DataFrame:
    """Yes answers over applicable ones, in percent, and whether they suffice."""
    a = F.lower(F.trim(answer))
    score = F.try_divide(100.0 * F.count_if(a == "yes"), (F.count(F.lit(1)) - F.count_if(a.isin("n/a", "na"))).cast("double"))
    return df.agg(score.alias("score")).withColumn("passed", F.col("score") >= least)
