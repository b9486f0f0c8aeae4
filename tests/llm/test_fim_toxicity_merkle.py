"""Fill-in-the-middle, toxicity and the Merkle manifest against plain Python, on odd rows too."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import fill_in_middle, merkle_manifest, toxicity_fm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank string, pos string, h string, n string, form string, score string, known string"
TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab Mé<\n.𝄞") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "", "x<P>y", "<M>", "<S", "<SS>", " <", "word", "?", "ab " * 30_000, "w" * 70_000, "𝄞 q" * 20_000]
    langs = ["en", "de", None, "", "é", "z"]
    out = [(i * 3, t, langs[i % 5 if i < 120 else 0], "s", len(t or ""), *["x"] * 8) for i, t in enumerate(texts)]
    out += [(None, "null id", None, None, None, *[None] * 8), (None, "null id", None, None, None, *[None] * 8), out[0], out[7], (9, "other text of this id", "en", None, 3, *[None] * 8)]
    return [*out, (10_001, "alone", "single", "s", None, *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('docs')}/d.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# -- fill-in-the-middle --------------------------------------------------------


def fim(doc_id, text):
    text = text or ""
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    u = TOKEN.findall(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(u), form, len(pre), len(mid), out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("giant,chunk", [(1 << 20, 1 << 16), (10, 7), (0, 1000)])
def test_cuts_equal_plain_python(docs, rows, giant, chunk):
    """Whole documents and giant ones in chunks, with the same rows for repeats, nulls, empty texts and markers."""
    got = fill_in_middle.fill_in_middle(docs, giant=giant, chunk=chunk)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert order(map(tuple, got.collect())) == order(fim(r[0], r[1]) for r in rows)


def test_texts_come_back(docs, rows):
    got = fill_in_middle.digest(fill_in_middle.fill_in_middle(docs)).collect()
    assert sorted(r["restored_sha256"] for r in got) == sorted(sha(r[1] or "") for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_stretches_compose_in_any_order():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 5, 3000).astype(np.uint8)
    for state in range(4):
        s, tokens, marks = state, 0, 0
        for c in classes:
            counted = int(fill_in_middle.COUNTED[c, s])
            tokens, marks, s = tokens + counted % fill_in_middle.MARKER, marks + counted // fill_in_middle.MARKER, int(fill_in_middle.AFTER[c, s])
        for cuts in ([], [1500], [1, 2, 999, 2998]):
            sums = [fill_in_middle.compose(*fill_in_middle.block_sums(p, 64)) for p in np.split(classes, cuts)]
            f, counts = fill_in_middle.compose(np.array([x[0] for x in sums], np.uint8), np.array([x[1] for x in sums]))
            assert (f >> 2 * state & 3, counts[state] % fill_in_middle.MARKER, counts[state] // fill_in_middle.MARKER) == (s, tokens, marks)


def test_a_word_across_all_chunks_is_one_token(spark):
    d = spark.createDataFrame([(1, "a" * 5000 + " " + "b" * 5000)], "doc_id long, text string")
    assert fill_in_middle.fill_in_middle(d, giant=100, chunk=300).first()["n"] == 3


# -- Merkle --------------------------------------------------------------------


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return sha("".join(map(part, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))


def climb(nodes):
    """All levels, and for each node the siblings up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    proofs = []
    for i in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            j = i ^ 1
            steps.append((level[j] if j < len(level) else "", j < i))
            i //= 2
        proofs.append(steps)
    return levels[-1][0], proofs


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    of = {}
    for g in names:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        of[g] = (members, *climb([leaf(r) for r in members]))
    root, tops = climb([of[g][1] for g in names])
    out = []
    for g, top in zip(names, tops):
        members, subroot, proofs = of[g]
        for r, inner in zip(members, proofs):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, int(hit))
            for s, left in inner + top:
                h = sha(s + h if left else h + s)
            out.append((r[0], leaf(r), subroot, root, sha("".join(s for s, _ in inner + top)), h, h == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_equals_plain_python(docs, rows, height):
    """Buckets of two, four and all leaves give one tree: nulls, empty names, repeated rows, lone leaves and odd ends."""
    got = merkle_manifest.manifest(docs, height=height).drop("rank", "proof")
    want = plain_manifest(rows)
    assert order(map(tuple, got.collect())) == order(want)
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_small_groups(spark, n):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert order(map(tuple, merkle_manifest.manifest(d, height=2).drop("rank", "proof").collect())) == order(plain_manifest(rows))


def test_ranks_have_no_gaps(spark):
    d = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), (F.col("id") % 50).alias("x"))
    got = merkle_manifest.ranked(d, "key", ["x"], "rank").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in got)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert fill_in_middle.fill_in_middle(none).count() == 0
    assert merkle_manifest.manifest(none).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity_fm.classify(none, labels).count() == 0


# -- toxicity ------------------------------------------------------------------


def test_machine_value_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = {"w": rng.normal(size=9), "v": rng.normal(size=(9, 4)), "b": 0.5}
    window, term = np.array([0, 0, 0, 2, 2]), np.array([1, 4, 8, 0, 3])
    want = []
    for members in ([1, 4, 8], [0, 3]):
        pairs = sum(model["v"][i] @ model["v"][j] for k, i in enumerate(members) for j in members[k + 1 :])
        want.append(0.5 + model["w"][members].sum() + pairs)
    assert np.allclose(toxicity_fm.logits(window, term, model), want)


def test_windows_cover_all_words():
    words = [f"word{i}" for i in range(200)]
    terms = toxicity_fm.Terms()
    window, term = toxicity_fm.windows(" ".join(words), terms)
    of = {}
    for w, t in zip(window.tolist(), term.tolist()):
        of.setdefault(w, set()).add(t)
    half = toxicity_fm.WINDOW // 2
    for start in range(0, 200 - half, half):
        want = {t for w in words[start : start + toxicity_fm.WINDOW] for t in toxicity_fm.terms_of(w)}
        assert of[start // half] == want
    assert toxicity_fm.windows("", terms)[0].size == 0


def test_pairs_are_learnt_that_single_terms_do_not_tell():
    """Toxic only where the insult stands beside a group: each word alone is as frequent in both classes."""
    rng = random.Random(4)
    filler = [f"filler{i}" for i in range(30)]
    texts, labels = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        words = [rng.choice(filler) for _ in range(10)] + [("insult", "praise")[a], ("people", "objects")[b]]
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(a == b))
    terms = toxicity_fm.Terms()
    docs = [toxicity_fm.windows(t, terms) for t in texts]
    model = toxicity_fm.train(docs[:800], labels[:800], epochs=40)
    known = toxicity_fm.Terms(model["known"])
    right = [(toxicity_fm.predict(t, model, known) >= 0.5) == bool(y) for t, y in zip(texts[800:], labels[800:])]
    assert np.mean(right) > 0.95
    flat = model | {"v": np.zeros_like(model["v"])}
    assert np.mean([(toxicity_fm.predict(t, flat, known) >= 0.5) == bool(y) for t, y in zip(texts[800:], labels[800:])]) < 0.8


def test_one_insult_counts_in_a_long_text(spark):
    rng = random.Random(6)
    vocabulary = [f"plain{i}" for i in range(500)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        words, y = prose(rng.choice([20, 100, 3000 if i % 40 == 0 else 50])), int(i % 4 == 0)
        if y:
            words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "villain"]))
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    rows += [(1000, " ".join([*prose(9000), "scoundrel", *prose(9000)])), (1001, " ".join(prose(18_000))), (1002, None), (1003, ""), (None, "villain")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, terms string")
    got = {r["doc_id"]: r for r in toxicity_fm.classify(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    assert got[1000]["predicted"] == 1 and got[None]["predicted"] == 1
    assert got[1001]["predicted"] == got[1002]["predicted"] == got[1003]["predicted"] == 0
    assert [r["held_out"] for i, r in sorted(got.items(), key=str) if i is not None] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in sorted(got, key=str) if i is not None]
    assert got[None]["held_out"] is False
    right = [got[i]["predicted"] == y for i, y in labels if got[i]["held_out"]]
    assert np.mean(right) > 0.97


def test_constant_scores(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity_fm.classify(docs, labels.where("false")).collect()} == {0.5}
    one = spark.createDataFrame([(i * 3, 0) for i in range(40)] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity_fm.classify(docs, one).collect())


def test_sample_takes_texts_of_any_length(spark):
    """All toxic texts are long, and the bound on terms still leaves the class its first one."""
    rows = [(i, "calm words here " * 3 + f"w{i % 9}") for i in range(60)] + [(100 + i, "wicked " * 20_000) for i in range(6)]
    labels = spark.createDataFrame([(r[0], int(r[0] >= 100)) for r in rows], "doc_id long, toxic int")
    model = toxicity_fm.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, most_terms=10)
    assert np.isfinite(model["b"])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity_fm.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9
    assert sum(r["predicted"] and not r["toxic"] for r in got) <= 2


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    from foldwise.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name]).df()[got.columns]
    assert order(map(tuple, got.collect())) == order(tuple(None if v is None or v != v else v for v in r) for r in want.astype(object).itertuples(index=False))
