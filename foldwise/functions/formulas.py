"""Derived columns of the paired-outcome tables, and null-aware scalar helpers."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREDICTORS = ["age", "sex", "bmi", "hct", "tp", "hdl", "ldl", "wbv", "tg0h"]
FOLLOW_UP, TARGET = "tg4h", "tcr"


def wbv(hct: Column, tp: Column) -> Column:
    """Whole blood viscosity from haematocrit and total protein."""
    return F.lit(0.12) * hct + F.lit(0.17) * (tp - F.lit(2.07))


def follow_up(baseline: Column, relative: Column, low: float = 1.0, high: float = 1300.0) -> Column:
    """Follow-up from baseline and relative change, brought into range where it is not plausible."""
    raw = baseline * (F.lit(1.0) - relative / F.lit(100.0))
    return F.when((raw <= 0) | (raw > high), clip(raw, low, high)).otherwise(raw)


#: outcome -> (formula of baseline and follow-up, side of the threshold that is positive, quantile)
OUTCOMES = {
    "relative": (lambda a, b: F.lit(100.0) * (a - b) / a, "low", 0.25),
    "difference": (lambda a, b: a - b, "high", 0.75),
    "ratio": (lambda a, b: b / a, "high", 0.75),
    "rise": (lambda a, b: b - a, "high", 0.75),
    "drop": (lambda a, b: a - b, "high", 0.75),
}


def outcome(name: str, a: Column, b: Column) -> Column:
    return OUTCOMES[name][0](a, b)


def binarise(value: Column, threshold: Column, side: str = "low") -> Column:
    """1 on the named side of the threshold, ties included; null stays null."""
    return (value <= threshold if side == "low" else value >= threshold).cast("int")


def clip(value: Column, low, high) -> Column:
    """Between bounds, numbers or columns. least and greatest skip nulls, so null is guarded."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, lo), hi))


def finite(value: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(~F.isnan(value) & (F.abs(value) != math.inf), value)


def indicator(value: Column, equal_to) -> Column:
    """0/1 for equality; null stays null."""
    return F.when(value.isNotNull(), (value == F.lit(equal_to)).cast("int"))


def fill(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def mapped(value: Column, table: dict, default=None) -> Column:
    """Look up in a small literal table; unmapped values get the default or null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, value)
    return found if default is None else F.coalesce(found, F.lit(default))


#: Meal types in the order their names are looked for, and their codes.
MEAL_CODES = {"breakfast": 0, "lunch": 1, "dinner": 2, "snack": 3}


def meal_type(raw: Column) -> Column:
    s = F.lower(F.trim(raw.cast("string")))
    out = F.lit("snack")
    for name in ("dinner", "lunch", "breakfast"):
        out = F.when(s.contains(name), name).otherwise(out)
    return out


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def present(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that the table has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix))


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks and byte-order marks."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def renamed(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """Rename what exists, unless the new name is there already."""
    return df.withColumnsRenamed({a: b for a, b in table.items() if a in df.columns and b not in df.columns})


def gut_name(column: str) -> str:
    """Column name of a gut-health score."""
    return "gut_" + column.lower().replace(" ", "_").replace(",", "").replace("/", "_")
