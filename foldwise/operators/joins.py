"""Event joins: as-of, interval, theta-anti, and small lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(interval: str) -> int:
    """Whole seconds of an interval such as ``48 hours``."""
    n, unit = interval.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def _slot(df: DataFrame, time: Column, like: str, width: int) -> Column:
    """The number of the time slot of ``width`` seconds; ``like`` names a column of the time's type."""
    if dict(df.dtypes)[like] == "timestamp":
        micros = F.unix_micros(time)
    else:  # without a zone: days and time of day, as a zone's clock may repeat hours
        day = F.unix_date(time.cast("date")).cast("long") * F.lit(86_400_000_000)
        micros = day + (F.hour(time) * 3600 + F.minute(time) * 60).cast("long") * F.lit(1_000_000) + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")
    return F.floor(micros / F.lit(width * 1_000_000)).cast("long")


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, tolerance: str, gap: str = "1 second", tie: str | None = None, prefix: str = "next_") -> DataFrame:
    """Each left row with the first right row of its group from ``on + gap`` to ``on + gap + tolerance``, inclusive.

    Unmatched left rows are dropped; of equal right times the smallest ``tie`` (else all columns) wins. Time is cut
    into slots as wide as the tolerance, so a match lies in the left row's slot or the next one. Both sides are stacked
    and each left row looks down a window over its group's slot; where that has none, it takes the next slot's first
    right row, of which there is one a slot. So a group of any size is spread over its slots.
    """
    payload = [c for c in right.columns if c not in by]
    order = [tie or on] + [c for c in payload if c not in (tie, on)]
    width = max(1, seconds(tolerance))
    picked = F.struct(F.col(on).alias("__at"), *[F.col(c) for c in order if c != on])
    r = right.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), picked.alias("__r"), F.lit(None).alias("__l"), _slot(right, F.col(on), on, width).alias("__slot"))
    first = F.col(on) + F.expr(f"interval {gap}")
    l = left.select(*by, first.alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__r"), F.struct(*left.columns).alias("__l"), _slot(left, first, on, width).alias("__slot"))
    both = l.unionByName(r)
    ties = [F.col(f"__r.{c}") for c in order if c != on]
    ahead = Window.partitionBy(*by, "__slot").orderBy("__t", "__side", *ties).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("__n", F.first("__r", ignorenulls=True).over(ahead)).where(F.col("__side") == 0)
    heads = r.groupBy(*[F.col(k).alias(f"__h_{k}") for k in by], (F.col("__slot") - 1).alias("__h_slot")).agg(F.min("__r").alias("__h"))
    same = F.col("__slot") == F.col("__h_slot")
    for k in by:
        same = same & (F.col(k) == F.col(f"__h_{k}"))
    found = found.join(heads, same, "left").withColumn("__n", F.coalesce("__n", "__h"))
    found = found.where(F.col("__n.__at") <= F.col("__t") + F.expr(f"interval {tolerance}"))
    named = [F.col("__n.__at").alias(f"{prefix}{on}")] + [F.col(f"__n.{c}").alias(f"{prefix}{c}") for c in payload if c != on]
    return found.select("__l.*", *named)


def interval_join(index: DataFrame, readings: DataFrame, by: Sequence[str], on: str, after: str, until: str, aggregates: Sequence[Column], least: int = 1) -> DataFrame:
    """Index rows with aggregates over readings of their group in ``(on + after, on + until]``.

    Readings' columns are named ``r_<name>`` in the aggregates; rows with fewer than ``least`` readings are dropped.
    Rows meet by group and time slot of the window's width, of which a window touches two.
    """
    keys = list(index.columns)
    width = max(1, seconds(until) - seconds(after))
    r = readings.toDF(*[f"r_{c}" for c in readings.columns]).withColumn("__r_slot", _slot(readings, F.col(f"r_{on}"), on, width))
    low, high = F.col(on) + F.expr(f"interval {after}"), F.col(on) + F.expr(f"interval {until}")
    i = index.withColumn("__slot", F.explode(F.sequence(_slot(index, low, on, width), _slot(index, high, on, width))))
    same = F.col("__slot") == F.col("__r_slot")
    for k in by:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    inside = (F.col(f"r_{on}") > low) & (F.col(f"r_{on}") <= high)
    out = i.join(r, same & inside).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_readings"), *aggregates)
    return out.where(F.col("n_readings") >= least)


def interval_extremes(index: DataFrame, readings: DataFrame, by: Sequence[str], on: str, after: str, until: str, value: str, least: int = 1) -> DataFrame:
    """Index rows with ``n_readings, low, peak`` of their group's values in ``(on + after, on + until]``; like :func:`interval_join`, without pairs.

    Time is cut into slots as wide as the window, so a window is the end of one slot and the beginning of the next. Both ends are
    stacked with the readings, and each takes the running count and extremes of its slot, from its end or up to it. A group of
    any size is spread over its slots, and no row is multiplied. Null values don't count.
    """
    keys, width = list(index.columns), max(1, seconds(until) - seconds(after))
    known = readings.where(F.col(value).isNotNull())
    r = known.select(*by, F.col(on).alias("__t"), _slot(known, F.col(on), on, width).alias("__slot"), F.lit(1).alias("__side"), F.col(value).alias("__v"))
    ends = []
    for side, at in ((0, F.col(on) + F.expr(f"interval {after}")), (2, F.col(on) + F.expr(f"interval {until}"))):
        ends.append(index.select(*by, at.alias("__t"), _slot(index, at, on, width).alias("__slot"), F.lit(side).alias("__side"), F.struct(*keys).alias("__i")))
    both = r.unionByName(ends[0].unionByName(ends[1]), allowMissingColumns=True)
    slot = Window.partitionBy(*by, "__slot")
    # of equal times a reading is no part of what begins there, which comes before it, but part of what ends there, which comes after
    later = slot.orderBy(F.desc("__t"), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sooner = slot.orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.col("__side") == 0
    pick = lambda f: F.when(begin, f.over(later)).otherwise(f.over(sooner))
    found = both.withColumns({"__n": pick(F.count("__v")), "__low": pick(F.min("__v")), "__peak": pick(F.max("__v"))}).where(F.col("__side") != 1)
    out = found.groupBy("__i").agg(F.sum("__n").alias("n_readings"), F.min("__low").alias("low"), F.max("__peak").alias("peak"))
    # rows that repeat all columns have each counted the same readings
    times = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("__times")).select(F.struct(*keys).alias("__j"), "__times")
    out = out.join(times, F.col("__i").eqNullSafe(F.col("__j"))).withColumn("n_readings", (F.col("n_readings") / F.col("__times")).cast("long"))
    return out.where(F.col("n_readings") >= least).select("__i.*", "n_readings", "low", "peak")


def no_event_between(pairs: DataFrame, events: DataFrame, by: Sequence[str], start: str, end: str, on: str, slot: str = "1 day") -> DataFrame:
    """Pairs without another event of their group strictly between start and end.

    The group's first event after the start tells: it is in the start's slot, or heads the group's next slot that has any. So a
    pair is looked up twice, however long it is. Pairs with a null in the group have no event.
    """
    width, columns = seconds(slot), pairs.columns
    e = events.select(*by, F.col(on).alias("__t"), _slot(events, F.col(on), on, width).alias("__slot"), F.lit(0).alias("__side"), F.col(on).alias("__e")).dropna()
    p = pairs.select(*by, F.col(start).alias("__t"), _slot(pairs, F.col(start), start, width).alias("__slot"), F.lit(1).alias("__side"), F.struct(*columns).alias("__p"))
    ahead = Window.partitionBy(*by, "__slot").orderBy("__t", "__side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = e.unionByName(p, allowMissingColumns=True).withColumn("__next", F.first("__e", ignorenulls=True).over(ahead)).where(F.col("__side") == 1)
    # a row for each slot of a group, with the first event of a later slot
    slots = e.groupBy(*by, "__slot").agg(F.min("__e").alias("__head")).unionByName(p.select(*by, "__slot"), allowMissingColumns=True).groupBy(*by, "__slot").agg(F.min("__head").alias("__head"))
    beyond = Window.partitionBy(*by).orderBy("__slot").rowsBetween(1, Window.unboundedFollowing)
    heads = slots.withColumn("__later", F.first("__head", ignorenulls=True).over(beyond)).select(*[F.col(k).alias(f"__h_{k}") for k in by], F.col("__slot").alias("__h_slot"), "__later")
    same = F.col("__slot").eqNullSafe(F.col("__h_slot"))
    known = F.lit(True)
    for k in by:
        same, known = same & F.col(k).eqNullSafe(F.col(f"__h_{k}")), known & F.col(k).isNotNull()
    found = found.join(heads, same, "left").withColumn("__next", F.when(known, F.coalesce("__next", "__later")))
    return found.where(F.col("__next").isNull() | ~F.coalesce(F.col("__next") < F.col(f"__p.{end}"), F.lit(False))).select("__p.*")


def first_in_group(df: DataFrame, by: Sequence[str], on: str, name: str) -> DataFrame:
    """The group's earliest time on every row."""
    first = df.groupBy(*by).agg(F.min(on).alias(name))
    return df.join(first, list(by))


def against_baseline(df: DataFrame, value: str, by: Sequence[str], pipeline: str = "pipeline", baseline: str = "clean", name: str = "delta") -> DataFrame:
    """Value less the baseline pipeline's in the same group; 0 where either is missing."""
    base = F.max(F.when(F.col(pipeline) == baseline, F.col(value))).over(Window.partitionBy(*by))
    return df.withColumn(f"{baseline}_{value}", base).withColumn(name, F.coalesce(F.col(value) - F.col(f"{baseline}_{value}"), F.lit(0.0)))


def headroom(df: DataFrame, delta: str = "delta", clean: str = "clean_auroc", name: str = "headroom_pct") -> DataFrame:
    """Delta as a percentage of what the clean value leaves up to 1; null where nothing is left."""
    left = F.lit(1.0) - F.col(clean)
    return df.withColumn(name, F.when(left > 0, F.col(delta) / F.when(left > 0, left) * 100.0))


def denser_column(df: DataFrame, by: str, first: str, second: str, name: str) -> DataFrame:
    """Of two columns the one with more values in the row's group; a tie takes the first."""
    counts = df.groupBy(by).agg(F.count(first).alias("__a"), F.count(second).alias("__b"))
    out = df.join(counts, by)
    return out.withColumn(name, F.when(F.col("__a") >= F.col("__b"), F.col(first)).otherwise(F.col(second))).drop("__a", "__b")


def aligned_ranks(clean: DataFrame, leaky: DataFrame, how: str = "full", key: str = "feature") -> DataFrame:
    """Clean and leaky ranks side by side, and the distortion clean less leaky.

    With ``full`` a missing rank is one past the largest of either side; with ``inner`` only shared features stay.
    """
    c = clean.select(F.col(key), F.col("rank").alias("rank_clean"))
    l = leaky.select(F.col(key), F.col("rank").alias("rank_leaky"))
    out = c.join(l, key, how)
    worst = F.greatest(F.max("rank_clean").over(Window.partitionBy()), F.max("rank_leaky").over(Window.partitionBy())) + 1
    if how == "full":
        out = out.withColumns({"leaky_only": F.col("rank_clean").isNull(), "__w": worst})
        out = out.withColumns({"rank_clean": F.coalesce("rank_clean", "__w"), "rank_leaky": F.coalesce("rank_leaky", "__w")}).drop("__w")
    return out.withColumn("distortion", F.col("rank_clean") - F.col("rank_leaky"))
