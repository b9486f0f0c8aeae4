"""Repeated passages by suffix arrays: bytes covered by a string of 200 bytes that also starts anywhere else.

Every window of 200 bytes has an anchor, its run of 64 bytes with the least hash, and equal windows have equal
anchors. So only anchors that occur twice matter, and segments (the windows around an occurrence of an anchor)
need comparing with segments of the same anchor only. Equal segments are counted as one; the different ones of an
anchor meet in one shard, where a suffix array by Larsson-Sadakane refinement and Kasai's common prefixes tell which
windows occur again. An anchor with very many different segments is dealt over several shards, and what is left
single in each is merged across them by binary search.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import shared_dir, text_of, written

MIN_MATCH = 200
#: Anchors are the least of consecutive hashes of so many bytes.
GRAM = 64
#: Bytes of segments in a shard, about, and different segments of one anchor in a shard.
SHARD_BYTES, SHARD_SEGMENTS = 1_000_000, 2_000
#: Windows merged in one task, about.
MERGE_ROWS = 500_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(256, dtype=np.uint64))
_PLACE = np.uint64((1 << 20) - 1)
_CHUNK = 1 << 19


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes, by doubling."""
    x, size = _BYTE[data], 1
    while size < GRAM:
        x = x[:-size] * (_M1 + np.uint64(2 * size)) + x[size:]
        size *= 2
    return _mix(x)


def anchors(data: np.ndarray, match: int = MIN_MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window and number of windows of each anchor of a text.

    A window is a string of ``match`` bytes; its anchor is its run of GRAM bytes with the least hash, the first of
    equals. That depends on the window's bytes alone, so equal windows have equal anchors wherever they are.
    """
    hashes, firsts, counts = [], [], []
    span = match - GRAM + 1
    for lo in range(0, len(data) - match + 1, _CHUNK):
        part = data[lo : lo + _CHUNK + match - 1]
        h = gram_hashes(part)
        m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < span:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        hashes.append(h[(m[first] & _PLACE).astype(np.int64)])
        firsts.append(first + lo)
        counts.append(np.diff(np.r_[first, len(m)]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts)


def suffix_array(text: np.ndarray, seg: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of all segments in order; a suffix ends with its segment, and equal ones go by segment.

    ``text`` is the segments in turn, ``seg`` each byte's segment and ``left`` its distance from the segment's end.
    Larsson-Sadakane: suffixes are grouped by their first bytes; a round orders each unfinished group by the group
    of what follows, which doubles the bytes that count, and suffixes that are alone are left alone.
    """
    n = len(text)
    padded = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    depth = 7  # nine bits a byte, so that a segment's end sorts before any byte
    for j in range(depth):
        key = (key << np.uint64(9)) | np.where(left > j, padded[j : n + j], 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sa = order
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = start
    longest = int(left.max(initial=0))
    todo = _unfinished(new)
    while len(todo) and depth < longest:
        at = sa[todo]
        follow = at + depth
        inside = left[at] > depth
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        first = rank[at]
        by = np.argsort(first * (n + 1) + second, kind="stable")
        at, first, second = at[by], first[by], second[by]
        sa[todo] = at
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[at] = todo[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        single = fresh & np.r_[fresh[1:], True]
        todo = todo[~single]
        depth *= 2
    if len(todo):  # suffixes equal to the end: by segment
        by = np.lexsort((seg[sa[todo]], rank[sa[todo]]))
        sa[todo] = sa[todo][by]
    return sa


def _unfinished(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~(new & np.r_[new[1:], True]))


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Kasai: for each suffix the bytes it shares with the one before it in ``sa``, within both segments.

    Going through a segment, a suffix shares at least one byte less than the suffix before it did, so the
    comparison goes on from there. All segments are gone through in step.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    end = np.repeat(starts + lengths, lengths)
    shared = np.zeros(n, np.int64)
    live = np.argsort(-lengths, kind="stable")
    have = np.zeros(len(starts), np.int64)
    for t in range(int(lengths.max(initial=0))):
        live = live[: np.searchsorted(-lengths[live], -t, "left")]
        i = starts[live] + t
        j = before[i]
        h = np.where(j >= 0, np.maximum(have[live] - 1, 0), 0)
        most = np.where(j >= 0, np.minimum(end[i] - i, end[np.maximum(j, 0)] - j), 0)
        go = np.flatnonzero(h < most)
        while len(go):
            same = text[i[go] + h[go]] == text[j[go] + h[go]]
            go = go[same]
            h[go] += 1
            go = go[h[go] < most[go]]
        shared[i] = h
        have[live] = h
    return shared


def repeated_windows(segments: list[bytes], counts: np.ndarray, match: int = MIN_MATCH) -> list[np.ndarray]:
    """For each of different segments, which of its windows occur elsewhere; ``counts`` is how often it occurs.

    A segment that occurs twice has all its windows repeated.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join(segments), np.uint8)
    seg = np.repeat(np.arange(len(segments)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(text))
    sa = suffix_array(text, seg, left)
    shared = common_prefixes(text, sa, starts, lengths)
    again = np.zeros(len(text), bool)
    hit = shared[sa] >= match
    again[sa[hit]] = True
    again[sa[np.flatnonzero(hit) - 1]] = True
    again |= np.repeat(counts > 1, lengths)
    return [again[a : a + n - match + 1] for a, n in zip(starts, lengths)]


def _runs(flags: np.ndarray) -> list[int]:
    """Start and end of each run of true flags, in turn."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).tolist()


def _digest(hash_: int, data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data, seed=hash_ & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _window_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _anchor_rows(match: int):
    def rows(batches):
        for b in batches:
            ids, ties, hashes, packed = [], [], [], []
            for row, tie, text in zip(b["row"], b["tie"], b["text"]):
                h, first, count = anchors(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), match)
                ids.append(np.full(len(h), row))
                ties.append(np.full(len(h), tie))
                hashes.append(h)
                packed.append(first * 1024 + count)
            if ids:
                yield pd.DataFrame({"row": np.concatenate(ids), "tie": np.concatenate(ties), "hash": np.concatenate(hashes).view(np.int64), "packed": np.concatenate(packed)})

    return rows


def _anchor_counts(match: int):
    def rows(batches):
        for part in _anchor_rows(match)(batches):
            hashes, n = np.unique(part["hash"], return_counts=True)
            yield pd.DataFrame({"hash": hashes, "n": n})

    return rows


def _cut_segments(match: int):
    """A document without repeated anchors is done; the others keep their text and name their segments."""

    def rows(batches):
        for b in batches:
            out = []
            for row, tie, doc, text, hashes, packed in zip(b["row"], b["tie"], b["doc_id"], b["text"], b["hashes"], b["packed"]):
                data = text.encode("utf-8", "replace")
                if hashes is None or not len(hashes):
                    out.append((row, tie, doc, len(data), hashlib.sha256(data).hexdigest(), None, None, None, None))
                    continue
                by = np.argsort(packed)
                hashes, packed = np.asarray(hashes)[by], np.asarray(packed)[by]
                digests = [_digest(int(h), data[p >> 10 : (p >> 10) + (p & 1023) + match - 1]) for h, p in zip(hashes.tolist(), packed.tolist())]
                out.append((row, tie, doc, len(data), None, data, hashes, digests, packed))
            yield pd.DataFrame(out, columns=["row", "tie", "doc_id", "n_bytes", "sha", "data", "hashes", "digests", "packed"])

    return rows


def _take_segments(match: int):
    def rows(batches):
        for b in batches:
            out = []
            for data, wanted in zip(b["data"], b["wanted"]):
                for w in wanted:
                    at = w["packed"] >> 10
                    out.append((w["hash"], w["digest"], w["n"], w["salts"], bytes(data[at : at + (w["packed"] & 1023) + match - 1])))
            yield pd.DataFrame(out, columns=["hash", "digest", "n", "salts", "bytes"])

    return rows


def _shard(match: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["hash", "digest"])
        flags = repeated_windows(group["bytes"].tolist(), group["n"].to_numpy(), match)
        runs, single, places = [], [], []
        for f, salts, data in zip(flags, group["salts"], group["bytes"]):
            runs.append(_runs(f))
            at = np.arange(len(f)) if salts > 1 else np.zeros(0, np.int64)  # others may be single in their shard
            places.append(at.tolist())
            single.append([_window_hash(data[i : i + match]) for i in at])
        return pd.DataFrame({"hash": group["hash"], "digest": group["digest"], "runs": runs, "at": places, "windows": single})

    return work


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of shards' sorted lists that another shard has, found by binary search in its list."""
    keys = np.array(group["window"].tolist(), dtype="S16")
    shard = group["shard"].to_numpy()
    found = np.zeros(len(group), bool)
    lists = {s: np.sort(keys[shard == s]) for s in np.unique(shard)}
    for s, own in lists.items():
        mine = shard == s
        for t, other in lists.items():
            if s != t:
                i = np.minimum(np.searchsorted(other, keys[mine]), len(other) - 1)
                found[mine] |= other[i] == keys[mine]
    return group.loc[found, ["hash", "digest", "at"]]


def _finish(match: int):
    def rows(batches):
        for b in batches:
            out = []
            for doc, data, spans in zip(b["doc_id"], b["data"], b["spans"]):
                n = len(data)
                at = np.asarray(spans if spans is not None else (), np.int64)
                edge = np.bincount(at[0::2], minlength=n + 1) - np.bincount(at[1::2] + match - 1, minlength=n + 1)
                gone = np.cumsum(edge)[:n] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                runs = _runs(gone)
                out.append((doc, n, int(gone.sum()), len(runs) // 2, hashlib.sha256(kept).hexdigest(), runs))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return rows


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MIN_MATCH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed``: one row per input row.

    ``removed`` has start and end of each removed run, in turn, in bytes of the UTF-8 text. Null text counts as
    empty; texts under ``match`` bytes lose nothing. Rows that repeat an id are documents of their own, and a
    row that repeats id and text repeats that text. Null ids are kept as they are. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    key = ["row", "tie"]  # tells rows apart that repeat an id
    # ids go through pandas as strings: beside a null, whole numbers would be rounded to floats
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text.alias("text"))
    texts = texts.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1))).alias("row"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # of rows that repeat id and text all is repeated, or they are too short: one of them stands for them in what follows
    repeats = written(texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "repeats")
    everything, some = texts, repeats.limit(1).count() > 0
    if some:
        texts = written(texts.join(repeats, key, "left_anti").unionByName(texts.join(repeats, key, "left_semi").dropDuplicates(key)), "distinct")

    again = texts.select("text").withColumns({k: F.lit(0) for k in key}).mapInPandas(_anchor_counts(match), "hash long, n long")
    again = again.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    live = texts.drop("doc_id").mapInPandas(_anchor_rows(match), "row long, tie long, hash long, packed long").join(again, "hash")
    live = live.groupBy(key).agg(F.collect_list(F.struct("hash", "packed")).alias("l"))
    live = live.select(*key, F.col("l.hash").alias("hashes"), F.col("l.packed").alias("packed"))
    joined = texts.repartition(n_tasks, *key).join(live.repartition(n_tasks, *key).hint("merge"), key, "left")
    cut = joined.mapInPandas(
        _cut_segments(match), "row long, tie long, doc_id string, n_bytes long, sha string, data binary, hashes array<long>, digests array<long>, packed array<long>"
    )
    name = f"foldwise_cut_{uuid.uuid4().hex}"
    cut.write.bucketBy(n_tasks, *key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    cut = spark.table(name)
    told = cut.join(repeats, key, "left_anti") if some else cut

    member = cut.where("hashes is not null").select(*key, F.inline(F.arrays_zip("hashes", "digests", "packed"))).toDF(*key, "hash", "digest", "packed")
    kinds = member.groupBy("hash", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*key, "packed")).alias("one"))
    kinds = written(kinds, "segments")
    apart = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    salts = F.ceil(F.col("different") / SHARD_SEGMENTS).cast("int")
    wanted = kinds.join(apart, "hash").select("hash", "digest", "n", salts.alias("salts"), "one.*")
    wanted = written(wanted, "wanted")
    total = wanted.agg(F.sum((F.col("packed") % 1024) + match - 1)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    by_doc = wanted.groupBy(key).agg(F.collect_list(F.struct("hash", "digest", "n", "salts", "packed")).alias("wanted"))
    segments = cut.select(*key, "data").join(by_doc, key).select("data", "wanted")
    segments = segments.mapInPandas(_take_segments(match), "hash long, digest long, n long, salts int, bytes binary")
    shard = F.pmod(F.xxhash64("hash", F.pmod("digest", "salts")), F.lit(shards))
    found = segments.withColumn("shard", shard).groupBy("shard").applyInPandas(_shard(match), "hash long, digest long, runs array<int>, at array<int>, windows array<binary>")
    found = written(found, "found")
    own = found.select("hash", "digest", "runs")
    crowded = found.where("size(at) > 0").join(wanted.select("hash", "digest", "salts"), ["hash", "digest"])
    window = crowded.select("hash", "digest", F.pmod("digest", "salts").alias("shard"), F.inline(F.arrays_zip("at", "windows"))).withColumnRenamed("windows", "window")
    n_windows = found.agg(F.sum(F.size("at"))).first()[0] or 0
    if n_windows:
        part = F.pmod(F.xxhash64("window"), F.lit(max(1, math.ceil(n_windows / MERGE_ROWS))))
        # a window of many segments of one shard is known there; one of each shard meets the others'
        one = window.groupBy("window", "shard").agg(F.min_by(F.struct("hash", "digest", "at"), F.struct("digest", "at")).alias("w")).select("window", "shard", "w.*")
        merged = one.withColumn("part", part).groupBy("part").applyInPandas(_merge, "hash long, digest long, at int")
        across = merged.join(one, ["hash", "digest", "at"]).select("window").distinct()
        more = window.join(across, "window", "left_semi").groupBy("hash", "digest").agg(F.collect_list(F.array(F.col("at"), F.col("at") + 1)).alias("x"))
        more = more.select("hash", "digest", F.flatten("x").alias("more"))
        own = own.join(more, ["hash", "digest"], "left").select("hash", "digest", F.concat("runs", F.coalesce("more", F.array().cast("array<int>"))).alias("runs"))
    hits = kinds.join(own, ["hash", "digest"], "left").select("hash", "digest", "n", "runs").where("n > 1 or size(runs) > 0")
    whole = F.array(F.lit(0), (F.col("packed") % 1024).cast("int"))
    first = F.shiftright("packed", 10)  # of the segment in its text
    runs = F.transform(F.when(F.col("n") > 1, whole).otherwise(F.col("runs")), lambda x: x + first)
    spans = member.join(hits, ["hash", "digest"]).select(*key, runs.alias("runs"))
    spans = spans.groupBy(key).agg(F.flatten(F.collect_list("runs")).alias("spans"))
    cleaned = told.where("hashes is not null").select(*key, "doc_id", "data").join(spans, key, "left")
    cleaned = cleaned.mapInPandas(_finish(match), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>")
    zero = F.lit(0).cast("long")
    clean = told.where("hashes is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast("array<int>").alias("removed"))
    out = clean.unionByName(cleaned)
    if some:
        n = F.octet_length("text").cast("long")
        gone = n >= match
        whole = everything.join(repeats, key, "left_semi").select(
            "doc_id", n.alias("n_bytes"), F.when(gone, n).otherwise(zero).alias("n_removed"), gone.cast("long").alias("n_spans"),
            F.sha2(F.when(gone, "").otherwise(F.col("text")), 256).alias("kept_sha256"), F.when(gone, F.array(F.lit(0), n.cast("int"))).otherwise(F.array().cast("array<int>")).alias("removed"),
        )
        out = out.unionByName(whole)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


#: The whole result in SQL, by a hash of each window; slow.
ORACLE = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, unnest(range(greatest(length(h) // 2 - 199, 0))) AS place, unnest(list_transform(range(greatest(length(h) // 2 - 199, 0)), lambda i: md5_number(substring(h, 2 * i + 1, 400)))) AS d FROM t),
r AS (SELECT d FROM x GROUP BY d HAVING count(*) > 1),
y AS (SELECT doc_id, place, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM x SEMI JOIN r USING (d)),
z AS (SELECT doc_id, place, sum(CASE WHEN before IS NULL OR place > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM y),
s AS (SELECT doc_id, run, min(place) AS lo, max(place) + 200 AS hi FROM z GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_ FROM s),
g AS (SELECT k.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substring(h, 2 * from_ + 1, 2 * (lo - from_)), '' ORDER BY lo) || substring(any_value(h), 2 * max(hi) + 1) AS kept FROM k JOIN t USING (doc_id) GROUP BY k.doc_id)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN g USING (doc_id)"""
