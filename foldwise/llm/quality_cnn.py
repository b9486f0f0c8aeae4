"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import text_of

FILTERS, WIDTH = 16, 5
#: A chunk is CHUNK_CELLS cells of CELL bytes; neighbours share one cell.
CELL, CHUNK_CELLS = 64, 4
#: At most so many labelled rows of each class are learnt from, each of at most so many bytes.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 900, 20_000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 32, 0.01, 1e-4, 7
THRESHOLD = 0.3
#: Bytes convolved at once, in whole cells.
SLICE = 512 * CELL


def _cells(data: np.ndarray, tables: np.ndarray, bias: np.ndarray, argmax: bool = False):
    """Filter responses of one text, pooled over cells; with the places of the maxima if asked for.

    A one-hot byte times a filter is a row of a table, so the convolution is WIDTH look-ups and sums.
    """
    n = len(data)
    k = max(1, -(-n // CELL))
    pooled, places = np.empty((k, FILTERS), np.float32), np.empty((k, FILTERS), np.int64) if argmax else None
    for lo in range(0, k * CELL, SLICE):
        hi = min(lo + SLICE, k * CELL)
        part = np.zeros(hi - lo + WIDTH - 1, np.uint8)
        got = data[lo : hi + WIDTH - 1]
        part[: len(got)] = got
        a = tables[0][part[: hi - lo]]
        for j in range(1, WIDTH):
            a += tables[j][part[j : hi - lo + j]]
        if hi > n:
            a[max(0, n - lo) :] = -1e9 if n > lo else 0
        a = a.reshape(-1, CELL, FILTERS)
        at = slice(lo // CELL, hi // CELL)
        if argmax:
            places[at] = a.argmax(1) + np.arange(lo, hi, CELL)[:, None]
        pooled[at] = a.max(1)
    return np.maximum(pooled + bias, 0), places


def _chunks(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks' maxima, and the cell that each came from."""
    step = CHUNK_CELLS - 1
    starts = np.arange(0, max(1, len(cells) - 1), step)
    index = np.minimum(starts[:, None] + np.arange(CHUNK_CELLS), len(cells) - 1)
    best = cells[index].argmax(1)
    source = np.take_along_axis(index, best, 1)
    return np.take_along_axis(cells, source, 0), source


def _features(chunks: np.ndarray) -> np.ndarray:
    """Over the whole text: the mean and the largest of the chunks' maxima."""
    return np.concatenate([chunks.mean(0), chunks.max(0)])


def _logit(features: np.ndarray, model: dict) -> float:
    return float(features @ model["w"] + model["b"])


def predict(text: str, model: dict) -> float:
    """Probability of label 1; every byte of the text is seen. An empty text has one cell of zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    cells, _ = _cells(data, model["tables"], model["bias"])
    return float(1 / (1 + np.exp(-np.clip(_logit(_features(_chunks(cells)[0]), model), -30, 30))))


def train(texts: list[str], labels: list[int], weights: list[float] | None = None, seed: int = SEED, epochs: int = EPOCHS) -> dict:
    """Learn filters and output weights by Adam on the weighted log loss. One class only: a constant score."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    wt = np.ones(len(y)) if weights is None else np.array(weights, np.float64)
    model = {
        "tables": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "w": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "b": np.float32(0),
    }
    if len(y) == 0 or y.min() == y.max():
        model["w"] = np.zeros(2 * FILTERS, np.float32)
        model["b"] = np.float32(0 if len(y) == 0 else 4 if y[0] else -4)
        return model
    data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), BATCH):
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            batch = order[lo : lo + BATCH]
            total = wt[batch].sum()
            for i in batch:
                cells, places = _cells(data[i], model["tables"], model["bias"], argmax=True)
                chunks, source = _chunks(cells)
                f = _features(chunks)
                p = 1 / (1 + np.exp(-np.clip(_logit(f, model), -30, 30)))
                g = np.float32((p - y[i]) * wt[i] / total)
                grad["w"] += g * f
                grad["b"] += g
                up = np.repeat(g * model["w"][None, :FILTERS] / len(chunks), len(chunks), 0)
                up[chunks.argmax(0), np.arange(FILTERS)] += g * model["w"][FILTERS:]
                up = np.where(chunks > 0, up, 0)
                at = np.take_along_axis(places, source, 0)
                grad["bias"] += up.sum(0)
                filters = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(WIDTH):
                    ok = at + j < len(data[i])
                    np.add.at(grad["tables"][j], (data[i][at[ok] + j], filters[ok]), up[ok])
            step += 1
            for k, v in model.items():
                g = grad[k] + (DECAY * v if k in ("tables", "w") else 0)
                m, s = moments[k]
                m = 0.9 * m + 0.1 * g
                s = 0.999 * s + 0.001 * g * g
                moments[k] = m, s
                model[k] = (v - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, max_bytes: int = SAMPLE_BYTES) -> dict:
    """Train on labelled rows that are not held out, from a bounded sample by a hash of the id.

    At most ``per_class`` rows of each class, of texts of at most ``max_bytes`` (longer ones aren't cut but left out,
    before the draw), reach the driver; weights restore the classes' shares. Of a class all of whose texts are longer, rows
    reach it in the order of the hash while they have at most ``per_class * max_bytes`` bytes together, and one always.
    Null ids and labels are left out; labels without a document don't count.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    fits = F.octet_length(text_of(text_col)) <= max_bytes
    sized = docs.select(F.col(id_col).alias("id"), fits.alias("fits"), F.octet_length(text_of(text_col)).cast("long").alias("bytes")).join(known, "id")
    counts = {r["y"]: (r["n"], r["m"]) for r in sized.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("m")).collect()}
    parts = []
    for y, (_, m) in sorted(counts.items()):
        if not m:
            first = sized.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
            so_far = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            first = first.withColumn("sum", F.sum("bytes").over(so_far)).withColumn("r", F.row_number().over(so_far))
            parts.append(first.where((F.col("sum") <= per_class * max_bytes) | (F.col("r") == 1)).select("id", "y").distinct())
            continue
        share = min(1.0, per_class / m)
        dealt = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
        parts.append(sized.where(F.col("fits") & (F.col("y") == y) & dealt).select("id", "y").distinct().limit(per_class + per_class // 4))
    if not parts:
        return train([], [])
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if all(m for _, m in counts.values()):
        rows = rows.where(F.octet_length("text") <= max_bytes)
    got = rows.join(F.broadcast(sample), "id").limit(4 * per_class).collect()
    got = sorted({(r["id"], r["text"], r["y"]) for r in got})
    used = {y: sum(r[2] == y for r in got) for y in counts}
    return train([r[1] for r in got], [r[2] for r in got], [counts[r[2]][0] / used[r[2]] for r in got])


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """The input's columns and a score between 0 and 1 of the whole text. Null text counts as empty."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([predict(t or "", model) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(text_of(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per input row.

    Repeated rows get equal scores; null ids are not held out. An empty table gives an empty result, and
    without labels every score is 0.5. Only the text enters a score.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns without the documents scored below the threshold."""
    model = fit(docs, labels, id_col, text_col)
    return score(docs, model, text_col, "__fw_score").where(F.col("__fw_score") >= threshold).drop("__fw_score")
