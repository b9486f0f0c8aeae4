"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import let, text_of, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Documents rounded together in one step of the reduction tree.
BLOCK = 128
SEED = 20_24


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target``: one row per source, from rows of ``source, size``.

    Sources take the weights in turn, by code point and null last, and share the sum of all sizes. A target
    stops at ``max_repeat`` times its source's size and the excess goes to the others by weight: with sources
    in order of cap over weight, that is one level, the largest of (total - caps before) / (weights from here).
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_cap = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything).cast("double") - before) / onward
    src = src.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return src.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """Move words between the open document of ``acc`` and ``x`` until one has a whole number of copies.

    The words the two take together stay the same, and each one's expected copies as well.
    """
    a = acc["open"]
    room_a, room_b = (1 - a["p"]) * a["size"], (1 - x["p"]) * x["size"]
    has_a, has_b = a["p"] * a["size"], x["p"] * x["size"]

    def moved(m: Column) -> Column:
        to_a = m["u"] * (m["up"] + m["down"]) < m["down"]
        a_done = F.when(to_a, room_a <= has_b).otherwise(has_a <= room_b)
        move = F.when(to_a, m["up"]).otherwise(-m["down"])
        inside = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        done = F.when(a_done, F.struct(a["id"].alias("id"), a["h"].alias("h"), a["size"].alias("size"), (a["base"] + to_a.cast("int")).alias("copies"))).otherwise(
            F.struct(x["id"].alias("id"), x["h"].alias("h"), x["size"].alias("size"), (x["base"] + (~to_a).cast("int")).alias("copies"))
        )
        rest = lambda s, p: F.struct(s["o"].alias("o"), s["h"].alias("h"), s["id"].alias("id"), s["size"].alias("size"), p.alias("p"), s["base"].alias("base"))
        left = F.when(a_done, rest(x, inside(x["p"] - move / x["size"]))).otherwise(rest(a, inside(a["p"] + move / a["size"])))
        return F.struct(left.alias("open"), F.array_append(acc["done"], done).alias("done"))

    unit = F.pmod(F.xxhash64(a["id"], x["id"], a["h"], x["h"], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chances = F.struct(F.least(room_a, has_b).alias("up"), F.least(has_a, room_b).alias("down"), unit.alias("u"))
    first = F.struct(x.alias("open"), acc["done"].alias("done"))
    return F.when(a.isNull(), first).otherwise(let(chances, moved))


ITEM = "struct<o:bigint,h:bigint,id:bigint,size:bigint,p:double,base:bigint>"
DONE = "array<struct<id:bigint,h:bigint,size:bigint,copies:bigint>>"


def _level(rows: DataFrame, seed: int) -> DataFrame:
    """Round each block of a source, large documents first; the last open document of the block goes on."""
    start = F.struct(F.lit(None).cast(ITEM).alias("open"), F.array().cast(DONE).alias("done"))
    blocks = rows.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "h", "id", "size", "p", "base"))).alias("items"))
    return written(blocks.select("source", "block", F.aggregate("items", start, lambda acc, x: _pair(acc, x, seed)).alias("r")), "mix-level")


def _segments(rows: DataFrame) -> DataFrame:
    """``source, cls, seg, w, n``: each source's open documents in three ranges of size, large ones first.

    A later range has room for what is left open of the one before: twice its largest document fits into what
    its documents' chances leave, so only a small document is left open at the end. One row per source and
    doubling of size at most.
    """
    cls = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    by = rows.groupBy("source", cls.alias("cls")).agg(F.sum(F.col("size") * F.col("c")).alias("w"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    upto = Window.partitionBy("source").orderBy("cls").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    by = by.withColumn("room", F.least(F.col("p"), 1 - F.col("p")) * F.sum("w").over(upto)).withColumn("first", F.max("most").over(whole))
    # where no range has the room, the largest doubling alone comes first
    top = F.max("cls").over(whole) - 1
    by = by.withColumn("cut1", F.least(F.coalesce(F.min(F.when(F.col("room") >= 2 * F.col("first"), F.col("cls"))).over(whole), top), top))
    by = by.withColumn("second", F.max(F.when(F.col("cls") <= F.col("cut1"), F.col("most"))).over(whole))
    top = F.max(F.when(F.col("cls") <= F.col("cut1"), F.col("cls"))).over(whole) - 1
    by = by.withColumn("cut2", F.least(F.coalesce(F.min(F.when(F.col("room") >= 2 * F.col("second"), F.col("cls"))).over(whole), top), top))
    seg = F.when(F.col("cls") > F.col("cut1"), 0).when(F.coalesce(F.col("cls") > F.col("cut2"), F.lit(True)), 1).otherwise(2)
    return by.select("source", "cls", seg.alias("seg"), "w", F.sum("n").over(Window.partitionBy("source", seg)).alias("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: one row per input row.

    Each document of a source has target / source_size expected copies. The whole part is taken as it is; the
    fractions are rounded by pivotal pairing of words in blocks of a hash of the row, and what each block
    leaves open is paired again in the next level, until one document is left. A source's large documents are
    rounded first; the words that their last open document gains or loses are taken from or given to the chances
    of smaller ones, before those are rounded in turn. That document goes by chance where smaller ones can make up for
    either way, else the way that comes nearer the target. So a source's taken words differ from its target by
    about a small document, and no document is taken over ``max_repeat`` times. All randomness is a hash of ids and
    texts: reruns agree.

    Null text is size 0; a document without words takes nothing. Null sources are one source, the last. Null
    and repeated ids are rows like others; rows that repeat id, source and text share their copies evenly, and so
    are any number of them one item. Sources are taken to be few enough for one task to sort (one row each).
    An empty table gives an empty result.
    """
    items, targets = _mixed(docs, id_col, text_col, source_col, weights, max_repeat, seed)
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    rows = items.join(t, F.col("source").eqNullSafe(F.col("s")))
    # a repeated row's copies, in two steps so that no array has as many elements as there are repeats
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / 1000))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("lot") * 1000 + 1, F.least(F.col("c"), F.col("lot") * 1000 + 1000))))
    return rows.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", _share("copies", "c", "k").alias("copies"), (_share("copies", "c", "k") * F.col("size")).alias("taken")
    )


def _share(total: str, rows: str, k: str) -> Column:
    """The k-th row's part of a total dealt evenly over rows."""
    return (F.floor(F.col(total) / F.col(rows)) + (F.col(k) <= F.col(total) % F.col(rows)).cast("long")).cast("int")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_repeat: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``id, source, th, size, c, copies``: one row per distinct id, source and text, with its rows' total copies; and the targets."""
    each = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_of(text_col)).alias("th"))
    sizes = written(each.groupBy("id", "source", "size", "th").agg(F.count(F.lit(1)).alias("c")), "mix-sizes")
    targets = written(source_targets(sizes.select("source", (F.col("size") * F.col("c")).alias("size")), weights, max_repeat), "mix-targets")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(F.col("factor") + 1e-12).cast("int")
    plan = targets.select(F.col("source").alias("s"), factor.alias("factor")).withColumn("base", base)
    plan = plan.withColumn("p", F.greatest(F.col("factor") - F.col("base"), F.lit(0.0))).drop("factor")
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    h = F.xxhash64(F.lit(seed), "id", "size", "th")
    rows = rows.withColumn("h", h).withColumn("cls", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    open_rows = (F.col("size") > 0) & (F.col("p") > 0)

    segments = written(_segments(rows.where(open_rows)), "mix-segments")
    most = {r["seg"]: r["n"] for r in segments.groupBy("seg").agg(F.max("n").alias("n")).collect()}
    here = segments.select(F.col("source").alias("s"), F.col("cls").alias("z"), "seg", "n")
    rows_at = rows.where(open_rows).join(here, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("z"))).drop("s", "z")
    parts, over = [], None  # over: words that a source has taken beyond its share so far
    for seg, n in sorted(most.items()):
        # the chance in this range once it has taken in what is over, what is left over, and the words of later ranges
        state = segments.groupBy("source").agg(F.sum(F.when(F.col("seg") == seg, F.col("w")).otherwise(0)).alias("words"), F.sum(F.when(F.col("seg") > seg, F.col("w")).otherwise(0)).alias("later"))
        state = state.join(plan.select("s", F.col("p").alias("plan_p")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        if over is None:
            state = state.withColumn("over", F.lit(0.0))
        else:
            state = state.join(over, F.col("source").eqNullSafe(F.col("o"))).drop("o")
        here_p = F.when(F.col("words") > 0, F.least(F.greatest(F.col("plan_p") - F.col("over") / F.col("words"), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("plan_p"))
        state = state.withColumn("here_p", here_p).withColumn("over", F.col("over") - (F.col("plan_p") - F.col("here_p")) * F.col("words"))
        state = written(state.withColumnRenamed("source", "o"), "mix-state")

        level = rows_at.where(F.col("seg") == seg).join(state.select("o", "here_p"), F.col("source").eqNullSafe(F.col("o"))).drop("o")
        # c rows alike with chance p: the whole part of c * p at once, the rest as one document
        alike = F.col("c") * F.col("here_p")
        sure = F.floor(alike + 1e-9).cast("long")
        level = level.withColumn("p", F.greatest(alike - sure, F.lit(0.0))).withColumn("given", F.col("c") * F.col("base") + sure)
        level = level.select("source", "id", "size", "p", F.col("given").alias("base"), "h", F.pmod("h", F.ceil(F.col("n") / BLOCK)).alias("block"))
        blocks, step = math.ceil(n / BLOCK), 0
        while blocks:
            rounded = _level(level, seed + step)
            parts.append(rounded.select("source", F.inline("r.done")))
            level = rounded.where("r.open is not null").select("source", F.floor(F.col("block") / BLOCK).alias("block"), "r.open.*").drop("o")
            blocks, step = (0 if blocks == 1 else math.ceil(blocks / BLOCK)), step + 1
        # a source's last open document goes by chance, if later ranges can make up for either way; else the better way
        last = level.join(state, F.col("source").eqNullSafe(F.col("o"))).drop("o")
        missed = lambda e: F.greatest(e - F.col("plan_p") * F.col("later"), -e - (1 - F.col("plan_p")) * F.col("later"), F.lit(0.0))
        up, down = missed(F.col("over") + (1 - F.col("p")) * F.col("size")), missed(F.col("over") - F.col("p") * F.col("size"))
        chance = F.pmod(F.xxhash64("id", "h", F.lit(seed + step)), F.lit(1 << 30)) / float(1 << 30) < F.col("p")
        one = F.when(up < down, True).when(up > down, False).otherwise(chance).cast("int")
        last = written(last.select("source", "id", "h", "size", (F.col("base") + one).alias("copies"), ((one - F.col("p")) * F.col("size")).alias("error")), "mix-last")
        parts.append(last.drop("error"))
        over = state.join(last.select("source", "error"), F.col("o").eqNullSafe(F.col("source")), "left")
        over = written(over.select("o", (F.col("over") + F.coalesce(F.col("error"), F.lit(0.0))).alias("over")), "mix-over")

    copies = F.when(F.col("size") > 0, F.col("base") * F.col("c")).otherwise(0).cast("long")
    out = rows.where(~open_rows).select("id", "source", "th", "size", "c", copies.alias("copies"))
    if parts:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.select(F.col("h").alias("g"), F.col("id").alias("i"), F.col("source").alias("s"), F.col("copies").cast("long").alias("copies"))
        same = (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s"))
        out = out.unionByName(rows.where(open_rows).join(found, same).select("id", "source", "th", "size", "c", "copies"))
    return out, targets


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The input's rows and columns, each row as often as :func:`mix` takes it; texts are shuffled once.

    Of rows that repeat id, source and text, which one is taken once more than another follows a hash of all their
    columns.
    """
    items, _ = _mixed(docs, id_col, text_col, source_col, weights, max_repeat, seed)
    items = written(items.where("copies > 0").select(F.col("id").alias("__fw_i"), F.col("source").alias("__fw_s"), F.col("th").alias("__fw_t"), F.col("c").alias("__fw_c"), F.col("copies").alias("__fw_n")), "mix-taken")
    rows = docs.withColumn("__fw_th", F.xxhash64(text_of(text_col)))
    same = (F.col("__fw_th") == F.col("__fw_t")) & F.col(id_col).cast("long").eqNullSafe(F.col("__fw_i")) & F.col(source_col).cast("string").eqNullSafe(F.col("__fw_s"))
    once = rows.join(items.where("__fw_c = 1"), same).withColumn("__fw_k", F.col("__fw_n"))
    repeats = items.where("__fw_c > 1")
    if repeats.limit(1).count():
        order = Window.partitionBy("__fw_th", id_col, source_col).orderBy(F.xxhash64(*docs.columns))
        again = rows.join(repeats, same).withColumn("__fw_r", F.row_number().over(order))
        once = once.unionByName(again.withColumn("__fw_k", _share("__fw_n", "__fw_c", "__fw_r").cast("long")).drop("__fw_r").where("__fw_k > 0"))
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__fw_k"))).alias("__fw_copy")).drop("__fw_copy")


#: Sizes and targets in SQL.
TARGET_ORACLE = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][i % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""
