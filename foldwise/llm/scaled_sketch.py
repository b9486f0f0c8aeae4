"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch holds every shingle hash below a fixed share of the hash space, so sketches of texts of any length
compare and merge: shared hashes over one sketch's hashes estimate how much of that text the other contains. Where
a short text has too few hashes there, its threshold is raised until LEAST of them (or all) are below, and a sketch tells
its threshold; two sketches are compared below the lower of theirs. Column expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import let, text_of

SHINGLE_WORDS = 5
#: One of so many hashes is retained.
SCALE = 4
HASH_BITS = 40
#: A sketch has at least so many hashes, or all of a text's.
LEAST = 32
#: Documents dealt to one bucket of neighbours, about, and most buckets.
BUCKET_DOCS, MOST_BUCKETS = 500, 10_000


def sketch(text: Column, scale: int = SCALE, size: int = SHINGLE_WORDS, least: int = LEAST) -> Column:
    """``struct<limit bigint, hashes array<bigint>>``: a text's distinct shingle hashes below the limit, sorted.

    The limit is the fixed share of the hash space; for a text with fewer than ``least`` hashes there it is the
    lowest that retains so many, and the whole space for one that has no more in all. The words are those between
    white space, with ``size - 1`` empty ones at either end, so that even a text of one word has ``size``
    shingles. A text without words has none.
    """
    pad = F.array(*[F.lit("")] * (size - 1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def hashed(padded: Column) -> Column:
        shingle = lambda last, i: F.xxhash64(*[F.get(padded, i + k) for k in range(size - 1)], last)
        lasts = F.slice(padded, F.lit(size), F.size(padded) - (size - 1))
        return F.transform(lasts, lambda last, i: F.shiftrightunsigned(shingle(last, i), 64 - HASH_BITS))

    hashes = let(words, lambda w: F.when(F.size(w) > 0, let(F.concat(pad, w, pad), hashed)))
    share, space = F.lit((1 << HASH_BITS) // scale), F.lit(1 << HASH_BITS)

    ordered = lambda h: F.sort_array(F.array_distinct(h))

    def lowest(h: Column) -> Column:
        # in order: a slice, as a filter would work the limit out for every hash
        limit = F.when(F.size(h) <= least, space).otherwise(F.get(h, F.lit(least - 1)) + 1)
        return F.struct(limit.alias("limit"), F.slice(h, 1, least).alias("hashes"))

    def limited(h: Column) -> Column:
        # texts of any length: only those with few distinct hashes below the share are sorted in full
        enough = lambda below: F.when(F.size(below) >= least, F.struct(share.alias("limit"), below.alias("hashes"))).otherwise(let(ordered(h), lowest))
        return let(ordered(F.filter(h, lambda x: x < share)), enough)

    return let(F.coalesce(hashes, F.array().cast("array<bigint>")), limited)


def as_string(s: Column) -> Column:
    """The limit in eleven hexadecimal digits and each hash in ten; empty for a text without words."""
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    joined = F.array_join(F.transform(s["hashes"], lambda h: digits(h, HASH_BITS // 4)), "")
    return F.when(F.size(s["hashes"]) > 0, F.lower(F.concat(digits(s["limit"], HASH_BITS // 4 + 1), joined))).otherwise("")


def _below(s: Column, limit: Column) -> Column:
    return F.when(s["limit"] > limit, F.filter(s["hashes"], lambda h: h < limit)).otherwise(s["hashes"])


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    limit = F.least(a["limit"], b["limit"])
    return F.struct(limit.alias("limit"), F.array_sort(F.array_union(_below(a, limit), _below(b, limit))).alias("hashes"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a has none below the lower limit."""
    limit = F.least(a["limit"], b["limit"])
    return F.try_divide(F.size(F.array_intersect(_below(a, limit), _below(b, limit))).cast("double"), F.size(_below(a, limit)).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 where both texts have no words, and 0 where one has none."""
    limit = F.least(a["limit"], b["limit"])
    shared = F.size(F.array_intersect(_below(a, limit), _below(b, limit))).cast("double")
    some = F.try_divide(shared, F.size(_below(a, limit)) + F.size(_below(b, limit)) - shared)
    empty = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    return F.when(empty, 1.0).otherwise(F.coalesce(some, F.lit(0.0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """``doc_id, limit, hashes``: one sketch per input row. Null text counts as empty and has an empty sketch."""
    return docs.select(F.col(id_col).alias("doc_id"), sketch(text_of(text_col), scale).alias("s")).select("doc_id", "s.limit", "s.hashes")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, bucket, ghost, key, tie`` and ``next_text``, the text of the next document by id.

    Ids are cut at percentiles into buckets of about BUCKET_DOCS documents, and each bucket gets its successor's
    first document as a ghost row at its end (the last bucket gets the first's). So the text is shuffled once
    and no window spans the table.
    """
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, math.ceil(n / BUCKET_DOCS)))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    cuts = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        got = docs.select(F.percentile_approx(F.col(id_col).cast("long"), shares, 10 * MOST_BUCKETS)).first()[0]
        cuts = sorted(set(got or []))
    # two looks, over groups of cuts and within one
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if groups:
        outer = F.array(*[F.lit(g[0]) for g in groups])
        inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
        outer_at = F.size(F.filter(outer, lambda c: c < F.col("key")))
        inner_at = F.size(F.filter(F.get(inner, F.col("group") - 1), lambda c: c < F.col("key")))
        bucket = F.when(F.col("group") == 0, 0).otherwise((F.col("group") - 1) * wide + inner_at)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), key.alias("key"))
    if groups:
        rows = rows.withColumn("group", outer_at).withColumn("bucket", bucket.cast("int")).drop("group")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("ghost", F.lit(False))
    heads = rows.groupBy("bucket").agg(F.min_by(F.struct("text", "key", "tie"), F.struct("key", "tie")).alias("head"))
    names = rows.select("bucket").distinct()
    order = Window.orderBy("bucket")  # at most MOST_BUCKETS rows
    last = F.max("bucket").over(Window.partitionBy())
    before = names.select("bucket", F.coalesce(F.lag("bucket").over(order), last).alias("prior"))
    ghosts = heads.join(before, "bucket").select(F.col("prior").alias("bucket"), "head.*", F.lit(True).alias("ghost"))
    rows = rows.unionByName(ghosts, allowMissingColumns=True)
    here = Window.partitionBy("bucket").orderBy("ghost", "key", "tie")
    return rows.withColumn("next_text", F.lead("text").over(here))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses: one row per input row.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited``. The
    edited text has its last quarter replaced by the start of the next document by id (after the last, the
    first). Likeness is estimated Jaccard similarity, by the sketches alone: exact between texts of up to LEAST
    shingles, and 1 between texts without words. ``in_edited`` is the estimated share of the text that the
    edited text contains, null without words. Null text counts as empty; rows that repeat an id follow each other by a hash of the text;
    null ids come last. A single row is its own next. An empty table gives an empty result.
    """
    rows = with_next(docs, id_col, text_col)
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited))
    rows = rows.withColumn("own", sketch(F.col("text"), scale)).withColumn("other", sketch(F.col("edited"), scale))
    here = Window.partitionBy("bucket").orderBy("ghost", "key", "tie")
    rows = rows.withColumn("following", F.lead("own").over(here)).where("not ghost")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        containment(F.col("own"), F.col("other")).alias("in_edited"),
    )


#: Lengths and edited texts in SQL.
EDIT_ORACLE = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM t)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(substring(text, 1, length(text) - length(text) // 4) || substring(following, 1, length(text) // 4)) AS edited_sha256 FROM n"""
