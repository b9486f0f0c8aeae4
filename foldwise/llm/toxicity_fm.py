"""Toxicity: a factorization machine over hashed terms of short windows, pooled over the whole text.

A window's terms are its words and their beginnings, hashed. The machine adds a weight for each term and, for each pair of
terms, the product of their factors, so that a word that is harmless alone can count beside another one. A document is
scored by its worst window, so one insult isn't diluted by a long text around it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import text_of

#: Buckets of the hash; words of a window, which overlaps the next by half; beginnings of words, in bytes, that are terms as well.
DIMS, WINDOW, STEMS = 1 << 20, 32, (4, 5, 6)
#: At most so many labelled documents of each class are learnt from, with at most so many terms together.
SAMPLE_PER_CLASS, SAMPLE_TERMS = 2500, 3_000_000
#: A term is learnt if it is in so many documents of the sample, and either tells the classes apart (log-likelihood ratio)
#: or is in so large a share of documents that it can matter in pairs.
LEAST_DOCS, LEAST_RATIO, COMMON = 3, 20.0, 0.1
#: Documents of the sample that agree in a band of min-hashes of their terms are copies and are learnt from once.
BANDS, BAND_ROWS = 8, 6
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 8, 64, 0.1, 1e-3, 11
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings (of so many bytes), each kind with a hash of its own."""
    data = word.encode("utf-8", "replace")
    return [zlib.crc32(data) % DIMS, *[zlib.crc32(data[:k], k) % DIMS for k in STEMS if len(data) >= k]]


class Terms:
    """Words' terms, remembered for words seen lately; with a model's known terms only those, as places in the model."""

    MOST = 200_000

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.at = None if known is None else {t: i for i, t in enumerate(known.tolist())}
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, word: str) -> tuple[int, ...]:
        if len(self.seen) >= self.MOST:
            self.seen.clear()
        got = terms_of(word)
        if self.at is not None:
            got = [self.at[t] for t in got if t in self.at]
        got = self.seen[word] = tuple(got)
        return got


def windows(text: str, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """``(window, term)`` pairs of a whole text, each once, sorted; windows of WINDOW words start every half of it."""
    half = WINDOW // 2
    rows, ids, seen = [], [], terms.seen
    at = -1
    for at, word in enumerate(WORD.findall(text.lower())):
        got = seen.get(word)
        if got is None:
            got = terms(word)
        if got:
            rows.append((at // half, len(got)))
            ids.extend(got)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    halves, ids = np.repeat(*np.array(rows, np.int64).T), np.array(ids, np.int64)
    last = max(0, at // half - 1)  # the window that ends the text
    pairs = np.concatenate([np.minimum(halves, last) * DIMS + ids, (halves[halves > 0] - 1) * DIMS + ids[halves > 0]])
    pairs = np.unique(pairs)
    return pairs // DIMS, pairs % DIMS


def logits(window: np.ndarray, term: np.ndarray, model: dict) -> np.ndarray:
    """The machine's value of each window of a text that has known terms."""
    starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    v = model["v"][term]
    linear = np.add.reduceat(model["w"][term], starts)
    sums, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
    return model["b"] + linear + 0.5 * (sums * sums - squares).sum(1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def predict(text: str, model: dict, terms: Terms) -> float:
    """Probability of label 1 of the worst window; a text without known terms has the machine's constant."""
    window, term = windows(text, terms)
    best = float(model["b"]) if not len(term) else max(float(model["b"]), float(logits(window, term, model).max()))
    return float(_sigmoid(best))


def _first_copies(sets: list[np.ndarray], y: np.ndarray, seed: int) -> np.ndarray:
    """For each document the first one of its class that it is a near copy of, or itself."""
    a = np.random.default_rng(seed).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    first, seen = np.arange(len(sets)), {}
    for i, terms in enumerate(sets):
        if not len(terms):
            continue
        sketch = np.array([((terms.astype(np.uint64) + np.uint64(1)) * m >> np.uint64(24)).min() for m in a]).reshape(BANDS, BAND_ROWS)
        bands = [(k, y[i], row.tobytes()) for k, row in enumerate(sketch)]
        first[i] = min((seen[b] for b in bands if b in seen), default=i)
        for b in bands:
            seen.setdefault(b, first[i])
    return first


def _told_apart(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms worth learning, sorted, and in how many documents of each class each is."""
    known, back = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(y.astype(int), [len(s) for s in sets])
    inside = np.stack([np.bincount(back[of == c], minlength=len(known)) for c in (0, 1)]).astype(float)
    size = np.array([(y == 0).sum(), (y == 1).sum()], float)[:, None]
    ratio = np.zeros(len(known))
    for got, of_class in ((inside, size), (size - inside, size)):
        expected = got.sum(0) * of_class / size.sum()
        ratio += 2 * np.where(got > 0, got * np.log(np.maximum(got, 1) / np.maximum(expected, 1e-300)), 0).sum(0)
    n = inside.sum(0)
    keep = (n >= LEAST_DOCS) & ((ratio >= LEAST_RATIO) | (n >= COMMON * len(sets)))
    return known[keep], inside[:, keep]


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weights: list[float] | None = None, seed: int = SEED, epochs: int = EPOCHS, factors: int = FACTORS) -> dict:
    """Learn from documents as ``(window, bucket)`` pairs by AdaGrad on the weighted log loss of each one's worst window.

    Linear weights start at the terms' smoothed log odds. Without documents, or with one class only, the score is constant.
    """
    y = np.array(labels, np.float64)
    empty = {"known": np.zeros(0, np.int64), "w": np.zeros(0, np.float32), "v": np.zeros((0, factors), np.float32)}
    if not len(y) or y.min() == y.max():
        return empty | {"b": np.float32(0 if not len(y) else 4 if y[0] else -4)}
    wt = np.ones(len(y)) if weights is None else np.array(weights, np.float64)
    rng = np.random.default_rng(seed)
    sets = [np.unique(t) for _, t in docs]
    first = _first_copies(sets, y, seed)
    wt = np.bincount(first, wt, len(y))
    alone = np.flatnonzero(first == np.arange(len(y)))
    docs, sets, y, wt = [docs[i] for i in alone], [sets[i] for i in alone], y[alone], wt[alone]
    known, inside = _told_apart(sets, y)
    if not len(known):
        return empty | {"b": np.float32(np.log((wt * y).sum() / (wt * (1 - y)).sum()))}

    def placed(window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        ok = known[at] == term
        return window[ok], at[ok]

    data = [placed(*d) for d in docs]
    share = (inside + 0.5) / (np.array([(1 - y).sum(), y.sum()])[:, None] + 1)
    w = np.log(share[1] / share[0])
    v, b = rng.normal(0, 0.05, (len(known), factors)), float(np.log((wt * y).sum() / (wt * (1 - y)).sum()))
    gw, gv, gb = np.full(len(known), 1e-2), np.full((len(known), factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            total, terms, grads_w, grads_v, grad_b = wt[batch].sum(), [], [], [], 0.0
            model = {"w": w, "v": v, "b": b}
            for i in batch:
                window, term = data[i]
                best = np.zeros(0, np.int64)
                value = b
                if len(term):
                    z = logits(window, term, model)
                    k = int(z.argmax())
                    value, best = float(z[k]), term[window == np.unique(window)[k]]
                g = (_sigmoid(value) - y[i]) * wt[i] / total
                grad_b += g
                vb = v[best]
                terms.append(best)
                grads_w.append(np.full(len(best), g))
                grads_v.append(g * (vb.sum(0) - vb))
            at, back = np.unique(np.concatenate(terms), return_inverse=True)
            dw = np.bincount(back, np.concatenate(grads_w), len(at)) + DECAY * w[at]
            dv = np.zeros((len(at), factors))
            np.add.at(dv, back, np.concatenate(grads_v))
            dv += DECAY * v[at]
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += grad_b * grad_b
            w[at] -= RATE * dw / np.sqrt(gw[at])
            v[at] -= RATE * dv / np.sqrt(gv[at])
            b -= RATE * grad_b / np.sqrt(gb)
    return {"known": known, "w": w.astype(np.float32), "v": v.astype(np.float32), "b": np.float32(b)}


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, most_terms: int = SAMPLE_TERMS) -> dict:
    """Train on labelled rows that are not held out, from a bounded sample by a hash of the id.

    Of each class at most ``per_class`` documents reach the driver, as hashed terms of their whole texts made by the
    executors, and in the order of the hash no more than have ``most_terms`` terms together (the first one always); texts
    of any length can be drawn. Weights restore the classes' shares. Null ids and labels are left out, and labels without a
    document don't count.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    there = docs.select(F.col(id_col).alias("id")).join(known, "id")
    counts = {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], [])
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, int(min(1.0, 1.2 * per_class / n) * (1 << 20)) + 1)])
    drawn = there.where(u < share[F.col("y")]).distinct()
    first = Window.partitionBy("y").orderBy(u, "id")  # a few thousand rows of a class, whatever the corpus
    drawn = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_class).drop("r")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(drawn), "id")

    @F.pandas_udf("windows binary, terms binary, n long")
    def hashed(text: pd.Series) -> pd.DataFrame:
        terms, out = Terms(), []
        for t in text:
            w, k = windows(t, terms)
            out.append((w.astype(np.int32).tobytes(), k.astype(np.int32).tobytes(), len(k)))
        return pd.DataFrame(out, columns=["windows", "terms", "n"])

    # a text may be there several times; the sample is a few thousand rows, so one window a class can order it
    so_far = Window.partitionBy("y").orderBy(u, "id", "terms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = texts.select("id", "y", hashed("text").alias("h")).select("id", "y", "h.*")
    rows = rows.withColumn("sum", F.sum("n").over(so_far)).withColumn("r", F.row_number().over(so_far)).where((F.col("sum") <= most_terms) | (F.col("r") == 1))
    got = rows.where(F.col("r") <= 2 * per_class).drop("sum", "r", "n").collect()
    got.sort(key=lambda r: (r["id"], r["y"], r["terms"]))
    used = {y: sum(r["y"] == y for r in got) for y in counts}
    read = lambda x: np.frombuffer(x, np.int32).astype(np.int64)
    return train([(read(r["windows"]), read(r["terms"])) for r in got], [r["y"] for r in got], [counts[r["y"]] / used[r["y"]] for r in got])


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """The input's columns and a score between 0 and 1 of the whole text. Null text counts as empty."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        terms = Terms(model["known"])
        return pd.Series([predict(t or "", model, terms) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(text_of(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per input row.

    Repeated rows get equal scores; null ids are not held out. An empty table gives an empty result, and without labels
    every score is 0.5. Only the text enters a score.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
