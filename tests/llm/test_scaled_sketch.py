"""Sketches of long texts, in time proportional to their words, and of texts that repeat themselves."""

import time

from foldwise.llm import scaled_sketch


def seconds(df):
    start = time.perf_counter()
    scaled_sketch.fingerprints(df).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_one_long_text_takes_as_long_as_many_short_ones(spark):
    def texts(n, words):
        rows = [(i, " ".join(f"w{j}" for j in range(words))) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()
        df.count()
        return df

    short, long = texts(100, 1000), texts(1, 100_000)
    runs = [(seconds(short), seconds(long)) for _ in range(3)][1:]
    assert min(b for _, b in runs) < 3 * min(a for a, _ in runs)


def test_repeated_lines_count_once(spark):
    """A text has as many distinct shingles however often its lines are repeated, and a sketch of few holds all."""
    line = "one two three four five six\n"
    rows = [(i, line * n) for i, n in enumerate([2, 9, 12, 60, 400])]
    rows += [(10 + i, " ".join(f"w{j}" for j in range(29)) + f" {line * n}") for i, n in enumerate([3, 400])]
    got = scaled_sketch.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    full = {r["doc_id"]: r for r in got}
    words = {i: [""] * 4 + t.split() + [""] * 4 for i, t in rows}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}
    assert [len(shingles[i]) for i, _ in rows] == [14] * 5 + [43] * 2
    for i, _ in rows:
        assert len(full[i]["fingerprint"]) == 11 + 10 * min(32, len(shingles[i]))
    assert len({full[i]["fingerprint"] for i in range(5)}) == 1 == len({full[i]["fingerprint"] for i in (10, 11)})
    assert [full[i]["near_next"] for i in (0, 1, 2, 3, 10)] == [1.0] * 5
