"""Fill-in-the-middle: documents cut at token borders and written prefix-suffix-middle or suffix-prefix-middle.

A text is read by a four-state automaton that counts token starts and complete markers. A stretch of text is a function
from the state before it to the state after it, with counts for each state before. Such functions compose associatively,
so stretches are summed up by themselves, in any order and on any executor; composing them tells each one's entry state,
and a count is then found by going down the tree of sums. A four-state function is one byte, and composing two is a look-up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import text_of, written

#: Fixed values of the format: the markers, the share of documents left plain and the share written suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

#: States: outside a word, in a word, after ``<``, after ``<`` and a marker's letter.
OUT, WORD, LT, TAG = range(4)
STATES = 4
#: Classes of characters: any other, a letter, a marker's letter, ``<``, ``>``.
OTHER, LETTER, MARK, OPEN, CLOSE = range(5)
#: Code points summed up at once below one tree; code points of a chunk of a giant document; what counts as giant.
BLOCK, CHUNK, GIANT = 4096, 1 << 16, 1 << 20
#: Counts of both kinds share a number: token starts below, complete markers above.
MARKER = 1 << 40


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """The next state and what is counted, by class and state."""
    after = np.zeros((5, STATES), np.int64)
    after[OTHER], after[LETTER], after[MARK], after[OPEN], after[CLOSE] = OUT, WORD, WORD, LT, OUT
    after[MARK, LT] = TAG
    counted = np.ones((5, STATES), np.int64)
    counted[np.ix_([LETTER, MARK], [WORD, TAG])] = 0  # a letter within a word starts no token
    counted[CLOSE, TAG] += MARKER
    return after, counted


AFTER, COUNTED = _automaton()
_SHIFTS = 2 * np.arange(STATES)
#: A class as a function: a byte, two bits for each state before.
STEP = (AFTER << _SHIFTS).sum(1).astype(np.uint8)
IDENTITY = np.uint8((np.arange(STATES) << _SHIFTS).sum())


def _compositions() -> np.ndarray:
    """``[f, g]``: the byte of f and then g, for all functions of four states."""
    f = np.arange(256)[:, None] >> _SHIFTS & 3
    g = np.arange(256)[:, None] >> _SHIFTS & 3
    return (g[:, f].transpose(1, 0, 2) << _SHIFTS).sum(2).astype(np.uint8)


THEN = _compositions()


def _classes() -> np.ndarray:
    out = np.full(129, OTHER, np.uint8)
    for a, z in ("AZ", "az"):
        out[ord(a) : ord(z) + 1] = LETTER
    for marker in (PREFIX, SUFFIX, MIDDLE):
        out[ord(marker[1])] = MARK
    out[ord("<")], out[ord(">")] = OPEN, CLOSE
    return out


CLASSES = _classes()


def classes_of(text: str) -> np.ndarray:
    """The class of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(codes, 128)]


def _pairs(f: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours composed: functions ``[..., m]`` and counts ``[..., m, states]`` of half as many stretches."""
    left, right = f[..., 0::2], f[..., 1::2]
    entry = left[..., None] >> _SHIFTS & 3
    return THEN[left, right], counts[..., 0::2, :] + np.take_along_axis(counts[..., 1::2, :], entry, -1)


def _padded(classes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each code point's function and counts, as rows of a block, filled up with the identity."""
    n = len(classes)
    rows = max(1, -(-n // block))
    f, counts = np.full(rows * block, IDENTITY, np.uint8), np.zeros((rows * block, STATES), np.int64)
    f[:n], counts[:n] = STEP[classes], COUNTED[classes]
    return f.reshape(rows, block), counts.reshape(rows, block, STATES)


def _block_for(n: int) -> int:
    return min(BLOCK, 1 << max(0, n - 1).bit_length())


def block_sums(classes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Function and counts of each block of a text; blocks are summed up some at a time, so that memory stays small."""
    at_once = 64 * block
    parts = []
    for lo in range(0, max(1, len(classes)), at_once):
        f, counts = _padded(classes[lo : lo + at_once], block)
        while f.shape[1] > 1:
            f, counts = _pairs(f, counts)
        parts.append((f[:, 0], counts[:, 0]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def compose(f: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Function and counts of consecutive stretches together."""
    while len(f) > 1:
        if len(f) % 2:
            f, counts = np.append(f, IDENTITY), np.vstack([counts, np.zeros((1, STATES), np.int64)])
        f, counts = _pairs(f, counts)
    return int(f[0]), counts[0]


def entries(f: np.ndarray, counts: np.ndarray, state: int = OUT) -> tuple[np.ndarray, np.ndarray]:
    """The state before each of consecutive stretches, and what is counted before each and after the last."""
    states, before = np.zeros(len(f), np.int64), np.zeros(len(f) + 1, np.int64)
    for i in range(len(f)):
        states[i] = state
        before[i + 1] = before[i] + counts[i, state]
        state = f[i] >> 2 * state & 3
    return states, before


def _descend(classes: np.ndarray, block: int, state: int, nth: int) -> int:
    """Where in a block, entered in ``state``, its token start number ``nth`` (from 0) is."""
    f, counts = _padded(classes, block)
    levels = [(f[0], counts[0])]
    while len(levels[-1][0]) > 1:
        levels.append(_pairs(*levels[-1]))
    at = 0
    for f, counts in levels[-2::-1]:
        at *= 2
        here = int(counts[at, state] % MARKER)
        if nth >= here:
            nth, state, at = nth - here, int(f[at]) >> 2 * state & 3, at + 1
    return at


def locate(classes: np.ndarray, nth: int, state: int = OUT, sums: tuple | None = None) -> int:
    """Code points before token start ``nth`` of a stretch entered in ``state``; all of them if it has no more."""
    block = _block_for(len(classes))
    f, counts = sums or block_sums(classes, block)
    states, before = entries(f, counts, state)
    before = before % MARKER
    if nth >= before[-1]:
        return len(classes)
    i = int(np.searchsorted(before, nth, "right")) - 1
    return i * block + _descend(classes[i * block : (i + 1) * block], block, int(states[i]), nth - int(before[i]))


def cut(text: str, h1: int, h2: int) -> tuple[int, bool, int, int]:
    """Tokens, whether a marker occurs, and the code points before the middle and before the suffix."""
    classes = classes_of(text)
    sums = block_sums(classes, _block_for(len(classes)))
    total = int(entries(*sums)[1][-1])
    n, marked = total % MARKER, total >= MARKER
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, marked, locate(classes, lo, OUT, sums), locate(classes, hi, OUT, sums)


CUT = "n long, marked boolean, first long, second long"


def _draws(id_col: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__fw_h{i + 1}") for i in range(4)]


def _cut_ordinary(rows: DataFrame) -> DataFrame:
    @F.pandas_udf(CUT)
    def cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(*x) for x in zip(text, h1, h2)], columns=["n", "marked", "first", "second"])

    return rows.withColumn("__fw_cut", cuts("__fw_text", "__fw_h1", "__fw_h2"))


def _cut_giants(rows: DataFrame, chunk: int) -> DataFrame:
    """The same for giant documents, whose chunks are dealt to all executors.

    What comes together for one document is a row of a few numbers for each of its chunks (a text has at most 2^31 bytes,
    so at most 2^31 / ``chunk``), never its text.
    """
    key = F.sha2(F.concat_ws(":", F.sha2("__fw_text", 256), "__fw_h1", "__fw_h2"), 256)
    rows = written(rows.withColumn("__fw_key", key), "giants")
    parts = F.posexplode(F.regexp_extract_all("__fw_text", F.lit(f"(?s).{{1,{chunk}}}+"), F.lit(0))).alias("no", "part")
    chunks = rows.select(F.col("__fw_key").alias("key"), F.col("__fw_h1").alias("h1"), F.col("__fw_h2").alias("h2"), parts).repartition("key", "no")
    chunks = written(chunks, "chunks")

    @F.pandas_udf("f int, chars long, " + ", ".join(f"c{s} long" for s in range(STATES)))
    def emitted(part: pd.Series) -> pd.DataFrame:
        out = []
        for text in part:
            classes = classes_of(text)
            f, counts = compose(*block_sums(classes, _block_for(len(classes))))
            out.append((f, len(classes), *counts.tolist()))
        return pd.DataFrame(out, columns=["f", "chars", *[f"c{s}" for s in range(STATES)]])

    sums = chunks.select("key", "no", "h1", "h2", emitted("part").alias("s")).select("key", "no", "h1", "h2", "s.*").dropDuplicates(["key", "no"])

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        states, before = entries(pdf["f"].to_numpy(np.uint8), pdf[[f"c{s}" for s in range(STATES)]].to_numpy(np.int64))
        chars = np.r_[0, pdf["chars"].cumsum().to_numpy()]
        n, marked, starts = int(before[-1] % MARKER), bool(before[-1] >= MARKER), before % MARKER
        out = []
        for which, t in enumerate(sorted(int(h) % (n + 1) for h in (pdf["h1"].iloc[0], pdf["h2"].iloc[0]))):
            i = min(int(np.searchsorted(starts, t, "right")) - 1, len(pdf) - 1)
            out.append((pdf["key"].iloc[0], which, i, n, marked, int(chars[i]), int(states[i]), t - int(starts[i])))
        return pd.DataFrame(out, columns=["key", "which", "no", "n", "marked", "base", "state", "nth"])

    asked = sums.groupBy("key").applyInPandas(resolve, "key string, which int, no int, n long, marked boolean, base long, state int, nth long")

    @F.pandas_udf("long")
    def found(part: pd.Series, state: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series([locate(classes_of(t), int(k), int(s)) for t, s, k in zip(part, state, nth)], dtype="int64")

    at = asked.join(chunks.select("key", "no", "part"), ["key", "no"]).withColumn("at", F.col("base") + found("part", "state", "nth"))
    place = lambda which: F.max(F.when(F.col("which") == which, F.col("at")))
    cuts = at.groupBy("key").agg(F.struct(F.max("n").alias("n"), F.max("marked").alias("marked"), place(0).alias("first"), place(1).alias("second")).alias("__fw_cut"))
    return rows.join(cuts.withColumnRenamed("key", "__fw_key"), "__fw_key").drop("__fw_key")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row per input row, with its text as training text.

    Cuts and forms are drawn by a hash of the id; a null id is drawn as an empty one, and rows that repeat an id are cut
    alike where their texts are alike. A null text counts as empty, and an empty one stays plain. Documents over ``giant``
    code points are cut chunk by chunk on all executors, with the same result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__fw_text"), *_draws(id_col))
    length = F.char_length("__fw_text")
    cuts = _cut_ordinary(rows.where(length <= giant)).unionByName(_cut_giants(rows.where(length > giant), chunk))
    text, a, b = F.col("__fw_text"), F.col("__fw_cut.first"), F.col("__fw_cut.second")
    form = F.when((text == "") | F.col("__fw_cut.marked") | (F.col("__fw_h3") % 100 >= PLAIN_FROM), "plain").when(F.col("__fw_h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    out = cuts.withColumn("form", form)
    part = lambda start, n: text.substr((start + 1).cast("int"), n.cast("int"))
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.lit(2**31 - 1))
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return out.select("doc_id", F.col("__fw_cut.n").alias("n"), "form", cut_only(a).alias("prefix_chars"), cut_only(b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The exact text again, from the output and its form alone: a text that is cut has no marker of its own."""
    after = lambda c, marker: c.substr(F.instr(c, marker) + 3, F.lit(2**31 - 1))
    before = lambda c, marker: c.substr(F.lit(1), F.instr(c, marker) - 1)
    head = after(output, PREFIX)
    psm = F.concat(before(head, SUFFIX), after(head, MIDDLE), before(after(head, SUFFIX), MIDDLE))
    spm = F.concat(before(head, MIDDLE), after(head, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(rows: DataFrame) -> DataFrame:
    """The query's columns: hashes in place of the texts."""
    sha = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as d
  from documents
), h as (
  select *, len(u) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from h
), p as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
