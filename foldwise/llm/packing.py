"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Lengths are whole numbers up to the sequence length, so the packing is planned on the histogram of
lengths (at most ``seq_len`` numbers, however many documents there are) and documents take the planned
places by their rank within their length.
"""

from __future__ import annotations

import base64
import re
import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import text_of, written

SEQ_LEN = 2048
SEPARATOR = 0
#: Rows ranked in one window partition, about.
RANK_ROWS = 50_000

LONG_BLANKS = re.compile(r"\s{50000}")
_encoders: dict = {}


def encoder(path: str):
    """A function from text to ids, equal to tokenizers' with ``add_special_tokens=False``.

    The rank file beside the JSON file is the same vocabulary, and merging by rank gives the same ids several
    times faster. A text that holds the special token's string goes through the JSON file itself, and so does one with a very
    long run of white space, on which the fast way recurses too deeply.
    """
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(path)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]

        def encode(text: str):
            if any(s in text for s in special) or LONG_BLANKS.search(text):
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    Documents longer than ``seq_len`` are cut into pieces of that length; the first may be shorter.
    """
    path = tokenizer or _default_tokenizer()
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text), SEPARATOR], "<u4")
                first = len(ids) % seq_len or seq_len
                lo = 0
                for k, hi in enumerate(range(first, len(ids) + 1, seq_len)):
                    part = ids[lo:hi]
                    row = (doc_id, k, lo, hi - lo, zlib.crc32(part.tobytes()))
                    out.append((*row, part.astype("i4")) if with_ids else row)
                    lo = hi
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            yield frame.astype({"piece": "int32"})

    # ids go through pandas as strings: beside a null, whole numbers would be rounded to floats
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


#: Parts of exact complements tried, for documents over half a sequence and for the others.
PASSES = (((1, 2, 3), (1, 2, 3)), ((1, 2, 3), (1, 3)), ((1, 2, 3), (1,)), ((1,), (1, 2, 3)), ((1,), (1, 3)), ((1,), (1,)))


def plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(how often, lengths)`` that use exactly ``counts`` documents of each length.

    A pair or triple that fills one gap exactly can be missed elsewhere, so the lengths are planned with each of
    PASSES and the plan with the fewest sequences is taken (of equal ones the earliest).
    """
    return min((_plan(counts, seq_len, *p) for p in PASSES), key=lambda found: sum(m for m, _ in found))


def _plan(counts: dict[int, int], seq_len: int, long_parts: tuple[int, ...], short_parts: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    """One plan: exact complements of the given numbers of parts, then best fit.

    From the longest length down, the gap it leaves is looked up among the single lengths that are still
    available, then again among pair sums, then among triple sums; each hit takes as many sequences at once as
    the counts allow. Short documents make sequences of their own only while the long ones can't take them in. What
    has no exact complement is packed best fit, decreasing.
    """
    n = np.zeros(seq_len + 1, np.int64)
    for length, c in counts.items():
        n[length] = c
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        uses = {x: lengths.count(x) for x in lengths}
        m = int(min(n[x] // k for x, k in uses.items()))
        if m:
            out.append((m, lengths))
            for x, k in uses.items():
                n[x] -= m * k
        return m > 0

    def pair(gap: int, top: int) -> tuple[int, int] | None:
        """The available pair with that sum whose larger length is largest, at most ``top``."""
        lo, hi = (gap + 1) // 2, min(gap - 1, top)
        if hi < lo:
            return None
        a = np.arange(hi, lo - 1, -1)
        b = gap - a
        good = np.flatnonzero((n[a] > 0) & (n[b] > (a == b)))
        return (int(a[good[0]]), int(b[good[0]])) if len(good) else None

    def complement(length: int, parts: int) -> tuple[int, ...] | None:
        gap = seq_len - length
        if gap == 0:
            return ()
        n[length] -= 1  # this document's own place
        try:
            if parts == 1:
                return (gap,) if gap <= length and n[gap] > 0 else None
            if parts == 2:
                return pair(gap, length)
            for x in np.flatnonzero(n[: min(gap - 2, length) + 1])[::-1]:
                x = int(x)
                if 3 * x < gap:
                    break
                n[x] -= 1
                found = pair(gap - x, x)
                n[x] += 1
                if found:
                    return (x, *found)
            return None
        finally:
            n[length] += 1

    sizes, half = np.arange(seq_len + 1), seq_len // 2

    def spare() -> bool:
        """Whether the short documents are more than what the long ones, each in a sequence of its own, have room for."""
        return int(n[: half + 1] @ sizes[: half + 1]) > int(n[half + 1 :] @ (seq_len - sizes[half + 1 :]))

    for lengths, parts in ((range(seq_len, half, -1), long_parts), (range(half, 0, -1), short_parts)):
        for k in parts:  # triples last: they use up the short documents that fill other gaps
            for length in lengths:
                while n[length] > 0 and (length > half or spare()):
                    rest = complement(length, k)
                    if rest is None or not take((length, *rest)):
                        break
    # best fit, decreasing, in bulk: sequences of one pattern are filled together, by what they have left
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps: list[int] = []  # of open_, in order
    for length in np.flatnonzero(n)[::-1].tolist():
        left = int(n[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):  # none has room: new ones, each with as many of this length as fit
                each = min(seq_len // length, left)
                m, lengths, gap = left // each, (length,) * each, seq_len - length * each
                left -= m * each
            else:
                gap = gaps[at]
                m, lengths = open_[gap].pop()
                if m > left:
                    open_[gap].append((m - left, lengths))
                    m = left
                if not open_[gap]:
                    del open_[gap], gaps[at]
                left, lengths, gap = left - m, (*lengths, length), gap - length
            if not gap:
                out.append((m, lengths))
                continue
            if gap not in open_:
                bisect.insort(gaps, gap)
            open_.setdefault(gap, []).append((m, lengths))
    out += [x for gap in gaps for x in open_[gap]]
    return out


def pack(cut: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Give each row of ``cut`` (with ``doc_id, piece, length``) its ``sequence_id`` and ``offset``.

    The lengths' histogram has at most ``seq_len`` rows; the plan on it is made on the driver. Rows are ranked
    within their length in salted blocks, so a length of any frequency is dealt over many tasks.
    """
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, used, base = [], dict.fromkeys(hist, 0), 0
    for m, lengths in plan(hist, seq_len):
        at = 0
        for x in lengths:
            slots.append((x, used[x], base, at))
            used[x] += m
            at += x
        base += m
    slots.sort()
    length, first, seq, at = (np.array(x, np.int64) for x in zip(*slots)) if slots else (np.zeros(0, np.int64),) * 4
    lengths, starts = np.unique(length, return_index=True)
    ends = np.append(starts[1:], len(length))

    salts = max(1, -(-max(hist.values(), default=0) // RANK_ROWS))
    rows = cut.withColumn("__fw_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("__fw_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("length", "__fw_salt").agg(F.count(F.lit(1)).alias("c"))
    shift = shift.select("length", "__fw_salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__fw_shift"))
    within = Window.partitionBy("length", "__fw_salt").orderBy("doc_id", "piece")
    rows = rows.withColumn("__fw_rank", F.row_number().over(within) - 1)
    rows = rows.join(shift, ["length", "__fw_salt"]).withColumn("__fw_rank", F.col("__fw_rank") + F.col("__fw_shift"))

    def place(batches):
        for b in batches:
            x, r = b["length"].to_numpy(np.int64), b["__fw_rank"].to_numpy(np.int64)
            k = np.searchsorted(lengths, x)
            slot = np.empty(len(x), np.int64)
            for u in np.unique(k):
                mine = k == u
                slot[mine] = starts[u] + np.searchsorted(first[starts[u] : ends[u]], r[mine], "right") - 1
            yield b.assign(sequence_id=seq[slot] + r - first[slot], offset=at[slot])[names]

    kept = [c for c in cut.columns]
    names = [*kept, "sequence_id", "offset"]
    # ids go through pandas as strings: beside a null, whole numbers would be rounded to floats
    types = {f.name: f.dataType.simpleString() for f in cut.schema} | {"doc_id": "string"}
    schema = ", ".join(f"`{k}` {t}" for k, t in types.items()) + ", sequence_id long, offset long"
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).select(*kept, "__fw_rank")
    return rows.mapInPandas(place, schema).withColumn("doc_id", F.col("doc_id").cast(cut.schema["doc_id"].dataType))


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    Null and empty texts are one separator token. Repeated rows are packed each on its own. Null ids stay null.
    An empty table gives an empty result; other columns are ignored.
    """
    return pack(written(pieces(docs, id_col, text_col, seq_len, tokenizer, with_ids), "pieces"), seq_len)
