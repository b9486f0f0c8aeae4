"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import forget, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 128
#: Up to so many surviving (length, prefix) keys are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def normalised(text: str = "text") -> Column:
    return F.translate(text_of(text), UPPER, LOWER)


def _length(text: str) -> Column:
    return F.octet_length(text_of(text)).cast("long")


def _prefix(text: str) -> Column:
    return F.xxhash64(F.translate(F.substring(text_of(text), 1, PREFIX_CHARS), UPPER, LOWER))


def full_hash(text: str = "text") -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, len, prefix, sha`` of the rows whose length and prefix hash occur again.

    Lengths that occur once go first, then (length, prefix hash) pairs that occur once. Only what is
    left is read in full. Every count is a partial aggregate, so a group of any size stays cheap.
    """
    sig = written(docs.select(F.col(id_col).alias("id"), _length(text_col).alias("len"), _prefix(text_col).alias("prefix")), "exact-keys")
    lengths = sig.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    keys = written(
        sig.join(lengths, "len", "left_semi").groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", "prefix"),
        "exact-prefixes",
    )
    rows = docs.select(F.col(id_col).alias("id"), _length(text_col).alias("len"), _prefix(text_col).alias("prefix"), F.col(text_col).alias("text"))
    # the two plans give the same rows
    if keys.count() <= BROADCAST_KEYS:
        hashed = rows.join(F.broadcast(keys), ["len", "prefix"], "left_semi").select("id", "len", "prefix", full_hash().alias("sha"))
    else:  # hash first, so that the shuffle moves hashes and not texts
        hashed = rows.select("id", "len", "prefix", full_hash().alias("sha")).join(keys, ["len", "prefix"], "left_semi")
    hashed = written(hashed.select("id", "len", "prefix", "sha"), "exact-survivors")
    forget(sig, keys)
    return hashed


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """Groups of two or more rows with equal text: ``sha``, ``keep_id``, ``group_size``, of :func:`survivors`' rows."""
    return written(hashed.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "exact-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays; rows that
    repeat that id with an equal text are the same document and all are marked as kept. Null text counts as
    empty, and all empty texts are one group. A null id never wins against another; a group of null ids only keeps
    them. An empty table gives an empty result; other columns are ignored.
    """
    hashed = survivors(docs, id_col, text_col)
    groups = duplicate_groups(hashed)
    forget(hashed)
    rows = docs.select(F.col(id_col).alias("doc_id"), full_hash(text_col).alias("sha"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "sha", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the copies that :func:`exact_dedup` drops, one row for each text.

    Of rows that repeat both the kept id and its text any one stays. Rows go by id, length and prefix hash, four numbers
    with 64 bits of the full hash; a text is hashed in full only where the first three agree.
    """
    hashed = survivors(docs, id_col, text_col)
    groups = duplicate_groups(hashed)
    rows = hashed.join(groups, "sha")
    named = [F.col("id").alias("__fw_id"), F.col("len").alias("__fw_len"), F.col("prefix").alias("__fw_prefix"), F.xxhash64("sha").alias("__fw_sha")]
    gone = written(rows.where(~F.col("keep_id").eqNullSafe(F.col("id"))).select(*named).distinct(), "exact-gone")
    again = rows.where(F.col("keep_id").eqNullSafe(F.col("id"))).groupBy("id", "len", "prefix", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select(*named), "exact-again")
    forget(hashed, groups)
    marked = docs.withColumns({"__fw_l": _length(text_col), "__fw_p": _prefix(text_col)})
    same = F.col(id_col).eqNullSafe(F.col("__fw_id")) & (F.col("__fw_l") == F.col("__fw_len")) & (F.col("__fw_p") == F.col("__fw_prefix"))
    same = same & (F.xxhash64(full_hash(text_col)) == F.col("__fw_sha"))
    # the same plan at every size, a shuffle by id, length and prefix
    kept = marked.join(gone.hint("merge"), same, "left_anti")
    if again.limit(1).count():
        once = kept.join(again, same, "left_semi").withColumn("__fw_h", full_hash(text_col)).dropDuplicates([id_col, "__fw_h"]).drop("__fw_h")
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop("__fw_l", "__fw_p")


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       (t.doc_id IS NOT DISTINCT FROM g.keep_id) AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
