"""Near-duplicate detection with DartMinHash signatures over weighted five-word shingles.

Darts fall on the plane of (element, height) as a Poisson process in time. A document keeps the darts that
fall below its elements' weights, and in each coordinate the earliest one; two documents agree in a coordinate
with the probability of their weighted Jaccard similarity. Only as many darts are thrown as fill the
coordinates, whatever the document's length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import forget, text_of, written

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: 24 bands of 5: a pair at 0.8 shares a band with probability 0.9999, one at 0.3 with 0.06.
BANDS, BAND_ROWS = 24, 5
#: Words whose darts are thrown together, and documents; a longer document goes by itself.
WORDS_AT_ONCE, DOCS_AT_ONCE = 1 << 16, 64

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same on every executor."""
    import xxhash

    cache: dict[str, int] = {}
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter((cache[w] for w in words), np.uint64, len(words))


def shingles(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` lower-case words, in text order; a shorter text is one shingle."""
    h = word_hashes(re.findall(r"\S+", text.lower()))
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = _mix(out ^ h[j : len(h) - k + 1 + j])
    return out


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """For each of ``n_docs`` documents the k coordinates' earliest darts, of elements with positive weights.

    Heights are cut into the layers [0,1), [1,2), [2,4), [4,8) ...; each (element, layer) throws its own darts
    at the rate of the layer's height, so a dart does not depend on the document, and a dart above the weight
    is dropped. Time is opened up to where 2 k + k ln k darts are expected, and further for documents with
    coordinates still empty. A document without elements has zeros.
    """
    best_t, best_d = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    layers = np.maximum(np.ceil(np.log2(weights)), 0).astype(np.int64) + 1
    cell = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(cell)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, np.exp2(layer - 1.0))
    span = np.where(layer == 0, 1.0, low)
    state = _mix(elements[cell] ^ _mix(layer.astype(np.uint64)))
    owner, weight, time = doc[cell], weights[cell], np.zeros(len(cell))
    mass = np.bincount(doc, weights, n_docs)
    opened = (k * np.log(k) + 2 * k) / np.where(mass > 0, mass, 1)
    active = np.arange(len(cell))
    while len(active):
        at, s, t = active, state[active], time[active]
        found = []
        while len(at):
            s = _mix(s)
            t = t - np.log(_unit(s)) / span[at]
            on = t <= opened[owner[at]]
            # the last dart before the border is the state to go on from, should more time be needed
            s, t, at = s[on], t[on], at[on]
            state[at], time[at] = s, t
            place = owner[at] * k + (_mix(s ^ _M1) % np.uint64(k)).astype(np.int64)
            ok = (low[at] + _unit(_mix(s ^ _M2)) * span[at] <= weight[at]) & (t < best_t[place])
            found.append((place[ok], t[ok], s[ok]))
        place, t, s = (np.concatenate(x) for x in zip(*found))
        late_first = np.argsort(-t, kind="stable")  # of repeated places the last assignment stays, the earliest dart
        place = place[late_first]
        best_t[place], best_d[place] = t[late_first], s[late_first]
        short = ~np.isfinite(best_t.reshape(n_docs, k)).all(1) & (mass > 0)
        opened = np.where(short, opened * 2, opened)
        active = active[short[owner[active]]]
    return best_d.reshape(n_docs, k)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_rows: int = BAND_ROWS, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, th, node, bands``: a hash of the text, one of its shingles in order, and one hash for each band.

    Texts with the same shingles are one node. A text without words has no bands.
    """

    def sketch(batches):
        for b in batches:
            for part, bags in _together(b, size):
                counted = [np.unique(s, return_counts=True) for s in bags]
                doc = np.repeat(np.arange(len(bags)), [len(e) for e, _ in counted])
                elements, weights = (np.concatenate(x) for x in zip(*counted))
                sig = dart_signatures(elements, weights.astype(np.float64), doc, len(bags), bands * band_rows).reshape(len(bags), bands, band_rows)
                h = np.broadcast_to(np.arange(bands).astype(np.uint64), sig.shape[:2])
                for r in range(band_rows):
                    h = _mix(h ^ sig[:, :, r])
                out = _lists([x if len(s) else x[:0] for x, s in zip(h.view(np.int64), bags)])
                nodes = pa.array([_digest(s) for s in bags], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), nodes, out], ["doc_id", "th", "node", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(sketch, "doc_id long, th long, node binary, bands array<long>")


def _together(b, size: int):
    """Slices of a batch with their documents' shingles."""
    texts, lo, bags, words = b.column("text"), 0, [], 0
    for i in range(b.num_rows):
        s = shingles(texts[i].as_py(), size)
        if bags and (words + len(s) > WORDS_AT_ONCE or len(bags) == DOCS_AT_ONCE):
            yield b.slice(lo, len(bags)), bags
            lo, bags, words = i, [], 0
        bags.append(s)
        words += len(s)
    if bags:
        yield b.slice(lo, len(bags)), bags


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _cells(texts: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``node, cells`` of rows with a ``text``: a hash for each (shingle, how many before it), so that bags meet as sets."""

    def build(batches):
        for _, bags in (x for b in batches for x in _together(b, size)):
            nodes, out = [_digest(s) for s in bags], []
            for s in map(np.sort, bags):
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
                nth = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
                out.append(_mix(s ^ _mix(nth.astype(np.uint64))).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), _lists(out)], ["node", "cells"])

    return texts.select("text").mapInArrow(build, "node binary, cells array<long>")


def _met(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with ``shared``, the cells that both have, and both sizes."""
    left, right = cells.toDF("a", "cells_a"), cells.toDF("b", "cells_b")
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", F.size(F.array_intersect("cells_a", "cells_b")).alias("shared"), F.size("cells_a").alias("size_a"), F.size("cells_b").alias("size_b"))


def _reaches(shared: Column, size_a: str, size_b: str, similarity: float) -> Column:
    """Whether so many shared cells of two bags make their weighted Jaccard similarity at least the threshold."""
    return shared >= F.lit(similarity) * (F.col(size_a) + F.col(size_b) - shared)


def components(edges: DataFrame) -> DataFrame:
    """``id, label``: the smallest id of each connected component, by neighbours' minima and pointer jumping."""
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).toDF("id", "other"), "edges")
    labels = written(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new = written(new.join(jump, "label", "left").select("id", F.least("label", F.coalesce("root", "label")).alias("label"), "old"), "labels")
        forget(labels)
        labels = new
        if not new.where("label <> old").limit(1).count():
            forget(both)
            return labels.select("id", "label")


def _candidates(met: DataFrame, labels: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of texts that met the same leader, that may be linked and aren't known to belong together.

    Of two bags s and m and their leader c no more than ``min(|s & c|, |m & c|) + |(s - c) & (m - c)|`` cells are
    shared. So either what both share with c suffices by itself (first kind; since one of the two lies outside c's
    component, the other is then shorter than c), or they share a cell that c lacks (second kind, an equality
    join on such cells). Texts that differ from their leader each in its own way meet in neither.
    """
    known = labels.select(F.col("id").alias("x"), "label")
    lead = met.groupBy("b").agg(F.max("size_b").alias("size"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = lead.select(F.col("b").alias("lead"), F.col("b").alias("x"), F.col("size").alias("k"), "size", F.col("size").alias("lead_size"))
    rows = met.join(lead.select("b"), "b", "left_semi").select(F.col("b").alias("lead"), F.col("a").alias("x"), F.col("shared").alias("k"), F.col("size_a").alias("size"), F.col("size_b").alias("lead_size"))
    rows = written(rows.unionByName(own).join(known, "x", "left").select("lead", "x", "k", "size", "lead_size", F.coalesce("label", "x").alias("comp")), "met-rows")
    comps = rows.groupBy("lead").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("x") == F.col("lead"), F.col("comp"))).alias("main")).where("lo <> hi")
    met_rows, rows = rows, written(rows.join(comps.select("lead", "main"), "lead"), "open")

    # either text of a candidate pair is a stray, outside the leader's component
    stray = rows.where("comp <> main")
    shorter = stray.groupBy("lead").agg(F.max(F.col("k") * (1 + similarity) / similarity - F.col("size")).alias("room"))
    short = rows.join(shorter, "lead").where(F.col("size") <= F.col("room") + 1e-6)
    s = stray.select("lead", F.col("x").alias("a"), F.col("k").alias("k_a"), F.col("size").alias("size_a"), F.col("comp").alias("comp_a"))
    m = short.select("lead", F.col("x").alias("b"), F.col("k").alias("k_b"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b"), "main")
    enough = _reaches(F.least("k_a", "k_b"), "size_a", "size_b", similarity)
    once = (F.col("comp_b") == F.col("main")) | (F.col("a") < F.col("b"))
    first = s.join(m, "lead").where((F.col("comp_a") != F.col("comp_b")) & once & enough)

    bags = rows.where("x <> lead").join(cells.withColumnRenamed("node", "x"), "x").join(cells.toDF("lead", "lead_cells"), "lead")
    other = F.array_except("cells", "lead_cells")
    apart = bags.select("lead", "x", "k", "size", "comp", "main", F.explode(other).alias("cell"))
    every = written(apart.select(F.xxhash64("lead", "cell").alias("group"), "lead", "x", "k", "size", "comp", "main"), "apart")
    # a cell that one component only has brings nobody together; the rest are counted for each text
    several = every.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("group")
    common = written(every.join(several, "group", "left_semi"), "common")
    extra = common.groupBy("lead", "x").agg(F.count(F.lit(1)).alias("extra"))
    apart = written(common.join(extra, ["lead", "x"]), "counted")
    s = apart.where("comp <> main").select("group", F.col("x").alias("a"), F.col("k").alias("k_a"), F.col("size").alias("size_a"), F.col("comp").alias("comp_a"), F.col("extra").alias("e_a"))
    m = apart.select("group", F.col("x").alias("b"), F.col("k").alias("k_b"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b"), F.col("extra").alias("e_b"), "main")
    enough = _reaches(F.least("k_a", "k_b") + F.least("e_a", "e_b"), "size_a", "size_b", similarity)
    second = s.join(m, "group").where((F.col("comp_a") != F.col("comp_b")) & once & enough)
    pairs = first.select("a", "b").unionByName(second.select("a", "b"))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    forget(met_rows, rows, every, common, apart)
    return pairs


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Membership ``doc_id, th, node`` and ``node, class_id, class_th, rep_id``, one row a node.

    Rows with the same shingles are one node, so copies of any number are one text; all links are verified on
    the nodes' full shingles. Texts of a bucket first meet one leader, the one with most company over all
    its buckets, and components are formed. Texts of different components that met the same leader are compared
    wherever :func:`_candidates` can't rule a link out, so none is lost between texts that share a bucket, and
    no bucket is ever paired with itself.
    """
    sig = written(sketches(docs, id_col, text_col), "sketches")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    texts = written(sig.groupBy("node").agg(F.min(who).alias("who"), F.first("bands").alias("bands")), "texts")
    rows = texts.select("node", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("key"), "node")
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    rows = written(rows.join(shared, "key").select("key", "node", "n"), "buckets")
    company = written(rows.groupBy("node").agg(F.sum("n").alias("company")), "company")

    # the same plan at every size, a shuffle by id
    wanted = texts.join(company.select("node"), "node", "left_semi").select(F.col("who.doc_id").alias("__fw_id"), F.col("who.th").alias("__fw_th"))
    candidates = _texts(docs, id_col, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("__fw_id")) & (F.col("th") == F.col("__fw_th"))
    candidates = candidates.join(wanted.hint("merge"), same, "left_semi")
    cells = written(_cells(candidates).dropDuplicates(["node"]), "cells")

    ranked = rows.join(company, "node")
    lead = ranked.groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("b"))
    pairs = rows.select("key", F.col("node").alias("a")).join(lead, "key").where("a <> b").select("a", "b").distinct()
    met = written(_met(pairs, cells), "met")
    links = met.where(_reaches(F.col("shared"), "size_a", "size_b", similarity)).select("a", "b")
    labels = components(links)
    more = _met(_candidates(met, labels, cells, similarity), cells)
    more = written(more.where(_reaches(F.col("shared"), "size_a", "size_b", similarity)).select("a", "b"), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    forget(shared, rows, company, cells, met, more)

    known = labels.toDF("node", "label")
    nodes = texts.select("node", "who").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = nodes.groupBy("label").agg(F.min("who").alias("first"))
    nodes = nodes.join(first, "label").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.th").alias("class_th"), F.col("who.doc_id").alias("rep_id"))
    return sig.select("doc_id", "th", "node"), written(nodes, "classes")


def _classed(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    members, nodes = near_classes(docs, id_col, text_col, similarity)
    kept = F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("class_th") == F.col("th"))
    return members.join(nodes, "node").select("doc_id", "th", "class_id", "rep_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, rep_id, kept``: one row per input row.

    ``class_id`` is the smallest id of the connected component of links with weighted Jaccard similarity of
    five-word shingles (lower case, split at white space) of at least ``similarity``; ``rep_id`` is the smallest id
    with the same shingles. The smallest id of a class is kept.

    Null and empty texts have no words and are one class of copies. A text of fewer than five words is one
    shingle. Rows are told apart by their texts, not by ids: rows that repeat an id, and rows of null ids, are each
    in the class of their own text. A null id is never a class's id beside others; a class of null ids only has a
    null class_id. Of rows in a class that repeat its id one text is kept (the smallest hash), and rows that
    repeat the text too are all marked as kept. An empty table gives an empty result; other columns are ignored.
    """
    return _classed(docs, id_col, text_col, similarity).drop("th")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows and columns, one row of each class: that of the smallest id, as :func:`near_duplicates` has it.

    Of rows that repeat both the kept id and its text any one stays.
    """
    found = written(_classed(docs, id_col, text_col, similarity), "near-rows")
    gone = written(found.where("not kept").select(F.col("doc_id").alias("__fw_gone"), F.col("th").alias("__fw_gone_th")).distinct(), "near-gone")
    again = found.where("kept").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select(F.col("doc_id").alias("__fw_gone"), F.col("th").alias("__fw_gone_th")), "near-again")
    forget(found)
    marked = docs.withColumn("__fw_th", F.xxhash64(text_of(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__fw_gone")) & (F.col("__fw_th") == F.col("__fw_gone_th"))
    kept = marked.join(gone, same, "left_anti")
    if again.limit(1).count():
        once = kept.join(again, same, "left_semi").dropDuplicates([id_col, "__fw_th"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop("__fw_th")
