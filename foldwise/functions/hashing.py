"""A portable uniform number: the same in Spark, DuckDB or anything else with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys, seed) -> Column:
    """In [0, 1): the first 52 bits of md5 of the keys and the seed, joined by colons."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def uniform_sql(*keys: str, seed) -> str:
    """The same for DuckDB."""
    joined = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5(concat_ws(':', {joined}, '{seed}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
