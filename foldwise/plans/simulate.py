"""Simulated paired-outcome tables, drawn column by column from seeded uniforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.formulas import clip, follow_up, wbv
from foldwise.functions.special import normal_cdf, normal_ppf_col

#: The population's parameters.
POPULATION = {
    "scenario": "null",
    "n": 1500,
    "age_mu": 53.0,
    "age_sd": 10.0,
    "age_low": 18.0,
    "age_high": 75.0,
    "p_male": 0.485,
    "bmi_mu": 24.0,
    "bmi_sd": 3.0,
    "bmi_low": 16.0,
    "bmi_high": 33.0,
    "hct_mu": 41.7,
    "hct_sd": 3.75,
    "hct_low": 30.0,
    "hct_high": 55.0,
    "tp_mu": 6.88,
    "tp_sd": 0.62,
    "tp_low": 5.0,
    "tp_high": 8.9,
    "hdl_mu": 50.5,
    "hdl_sd": 9.7,
    "hdl_low": 25.0,
    "hdl_high": 87.0,
    "ldl_mu": 131.0,
    "ldl_sd": 28.0,
    "ldl_low": 70.0,
    "ldl_high": 215.0,
    "tg0h_shift": 350.0,
    "tg0h_mu_log": 5.5,
    "tg0h_sigma_log": 0.45,
    "tg0h_low": 350.0,
    "tg0h_high": 1750.0,
    "tcr_mu": 52.2,
    "tcr_sd": 18.6,
    "tcr_low": -10.0,
    "tcr_high": 99.9,
}
#: scenario -> (effects per standard deviation, factor of the noise); the null scenario has a truncated normal.
SCENARIOS = {
    "null": ({}, 1.0),
    "weak_signal": ({"age": -2.0, "hdl": 2.5, "bmi": -2.0}, 1.0),
    "moderate_signal": ({"tg0h": -3.5, "bmi": -3.0, "age": -2.5}, 0.70),
    "wbv_positive": ({"wbv": 7.0}, 0.40),
}
#: Decimals of the written columns.
DECIMALS = {"age": 1, "bmi": 1, "hct": 1, "tp": 2, "hdl": 1, "ldl": 1, "wbv": 3, "tg0h": 1, "tcr": 2, "tg4h": 1}


def truncated_normal(u: Column, mu: float, sd: float, low: float, high: float) -> Column:
    """Inverse distribution function between the bounds' probabilities."""
    a, b = normal_cdf((low - mu) / sd), normal_cdf((high - mu) / sd)
    return clip(F.lit(mu) + F.lit(sd) * normal_ppf_col(F.lit(a) + u * F.lit(b - a)), low, high)


def shifted_lognormal(u: Column, shift: float, mu: float, sigma: float, low: float, high: float) -> Column:
    """exp(N(mu, sigma)) + shift, kept between the bounds by inverting within them."""
    import math

    cdf = lambda x: normal_cdf((math.log(x) - mu) / sigma) if x > 0 else 0.0
    a, b = cdf(low - shift), cdf(high - shift)
    return clip(F.exp(F.lit(mu) + F.lit(sigma) * normal_ppf_col(F.lit(a) + u * F.lit(b - a))) + shift, low, high)


def simulate(spark: SparkSession, config: dict | None = None, seed: int | Sequence[int] = 0, n: int | None = None) -> DataFrame:
    """``[seed,] record_id, age, sex, bmi, hct, tp, hdl, ldl, wbv, tg0h, tcr, tg4h``; no label, which is for the folds to fit.

    Same seed, same rows. Several seeds give as many tables, told apart by ``seed``, in one plan. An unknown scenario raises ValueError; an empty one is the null scenario.
    """
    c = POPULATION | (config or {})
    scenario = c.get("scenario") or "null"
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario {scenario!r} is not one of {sorted(SCENARIOS)}")
    n = n or c["n"]
    seeds = [seed] if isinstance(seed, int) else list(seed)
    rows = spark.range(n * len(seeds)).select((F.col("id") % n).alias("id"), F.array(*[F.lit(s) for s in seeds])[F.floor(F.col("id") / n).cast("int")].alias("seed"))

    def u(column: str) -> Column:
        """A uniform that belongs to the row, the column and the seed, wherever the row is computed."""
        h = F.xxhash64(F.col("id"), F.lit(column), F.col("seed").cast("long"))
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)

    normal = lambda x: truncated_normal(u(x), c[f"{x}_mu"], c[f"{x}_sd"], c[f"{x}_low"], c[f"{x}_high"])
    rows = rows.withColumns({x: normal(x) for x in ("age", "bmi", "hct", "tp", "hdl", "ldl")})
    rows = rows.withColumn("sex", (u("sex") < c["p_male"]).cast("int"))
    rows = rows.withColumn("tg0h", shifted_lognormal(u("tg0h"), c["tg0h_shift"], c["tg0h_mu_log"], c["tg0h_sigma_log"], c["tg0h_low"], c["tg0h_high"]))
    rows = rows.withColumn("wbv", wbv(F.col("hct"), F.col("tp")))
    effects, factor = SCENARIOS[scenario]
    if effects:
        effects = {x: c.get(f"beta_{x}", b) for x, b in effects.items()}
        moments = rows.groupBy("seed").agg(*[f(x).alias(f"{k}_{x}") for x in effects for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        rows = rows.join(F.broadcast(moments), "seed")
        mean = F.lit(c["tcr_mu"])
        for x, b in effects.items():
            mean = mean + F.lit(b) * (F.col(x) - F.col(f"m_{x}")) / (F.col(f"s_{x}") + 1e-8)
        rows = rows.withColumn("tcr", clip(mean + normal_ppf_col(u("noise")) * F.lit(c["tcr_sd"] * factor), c["tcr_low"], c["tcr_high"]))
    else:
        rows = rows.withColumn("tcr", truncated_normal(u("tcr"), c["tcr_mu"], c["tcr_sd"], c["tcr_low"], c["tcr_high"]))
    rows = rows.withColumn("tg4h", follow_up(F.col("tg0h"), F.col("tcr")))
    out = [] if isinstance(seed, int) else [F.col("seed")]
    out.append(F.format_string("SYN%05d", F.col("id") + 1).alias("record_id"))
    for x in ("age", "sex", "bmi", "hct", "tp", "hdl", "ldl", "wbv", "tg0h", "tcr", "tg4h"):
        out.append(F.bround(x, DECIMALS[x]).alias(x) if x in DECIMALS else F.col(x))
    return rows.select(*out)
