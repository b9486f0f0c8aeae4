"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Column expressions only. A long token is a candidate. Its encoding is inferred from its characters, and it must
look random (chi-squared uniformity over the encoding's alphabet, runs above and below the alphabet's middle,
serial correlation). How rarely an ordinary token of its length looks as even, and changes as often between kinds of
characters (lower, upper, digit, other), is its p-value by Fisher's method, and Benjamini-Hochberg's step-up procedure
picks the findings among candidates of one encoding and like length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import let, text_of, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEY = r"(?i:password|passwd|secret|token|api_?key)"
#: A run that is long enough is the same run whether its length is asked for within the pattern or after it.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings in the order tried: characters, alphabet, the chance that two characters of an ordinary token agree, and the
#: chance that two neighbours of one are of different kinds (none where a random one has one kind).
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789", 0.2, None),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.125, 0.2),
    ("base32", r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 0.065, 0.1),
    ("letters", r"^([a-z]+|[A-Z]?[a-z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.065, None),
    ("alnum", r"^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.065, 0.2),
    ("base64", r".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065, 0.35),
)
#: Characters of candidates and their kinds.
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
CHAR_KINDS = "a" * 26 + "A" * 26 + "0" * 10 + "+" * 5
#: A candidate that a random string would look like this rarely is not random; false discoveries among findings.
RANDOM_ALPHA, FALSE_DISCOVERIES = 0.001, 0.01
#: p-values are counted in bins of a 20th of a decade.
BINS_A_DECADE, MOST_BIN = 20, 400

SPANS = "array<struct<start:int,stop:int>>"


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, stop>>`` of leftmost non-overlapping matches, in code points.

    The text is the pieces between matches and the matches in turn, so running sums of lengths are positions.
    With ``group``, matches whose group is shorter than ASSIGN_CHARS are dropped after matching.
    """
    pat = F.lit(pattern)
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pat, F.lit(0)).alias("all"),
        F.regexp_extract_all(text, pat, F.lit(group)).alias("part"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, m):
        start = acc["at"] + F.length(m["gap"])
        stop = start + F.length(m["all"])
        wanted = m["all"].isNotNull() & ((F.length(m["part"]) >= ASSIGN_CHARS) if group else F.lit(True))
        out = F.when(wanted, F.array_append(acc["out"], F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))).otherwise(acc["out"])
        return F.struct(F.coalesce(stop, start).cast("int").alias("at"), out.alias("out"))

    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def _guarded(text: Column, pattern: str, guard: str, group: int = 0) -> Column:
    return F.when(text.rlike(guard), _spans(text, pattern, group)).otherwise(F.array().cast(SPANS))


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by the five-term rational approximation (absolute error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.least(F.lit(0.5), F.exp(-a * a / 2) * 0.3989422804014327 * poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _tested(token: Column) -> Column:
    """``struct<p, random, encoding>``: how rarely an ordinary token is like it, whether it passes as random, and its encoding."""
    code = alphabet = chance = turn = which = None
    for at, (name, pattern, letters, share, change) in reversed(list(enumerate(ENCODINGS))):
        is_it = token.rlike(pattern)
        one, two = F.lit(letters), F.lit(change).cast("double")
        folded = F.translate(token, "-_=", "+/") if name == "base64" else F.translate(F.lower(token), "=", "")
        if code is None:
            code, alphabet, chance, turn, which = folded, one, F.lit(share), two, F.lit(at)
            continue
        pick = lambda new, old: F.when(is_it, new).otherwise(old)  # noqa: B023, E731
        code, alphabet, chance, turn, which = pick(folded, code), pick(one, alphabet), pick(F.lit(share), chance), pick(two, turn), pick(F.lit(at), which)

    kinds = F.regexp_replace(F.translate(token, CHARS, CHAR_KINDS), r"(.)\1+", "$1")
    parts = F.struct(code.alias("code"), alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("k"), chance.alias("chance"), turn.alias("turn"), (F.length(kinds) - 1).cast("double").alias("changes"), (F.length(token) - 1).cast("double").alias("steps"), which.alias("encoding"))
    return let(parts, _battery)


def _battery(t: Column) -> Column:
    n, k = F.length(t["code"]).cast("double"), t["k"]
    places = F.transform(F.split(t["code"], ""), lambda c: F.call_function("instr", t["alphabet"], c).cast("double"))

    def sums(x: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        squares = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
        mean = total(x) / n
        high = total(F.transform(x, lambda v: (v > k / 2).cast("double")))
        follow = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = total(F.transform(follow, lambda p: ((p["a"] > k / 2) != (p["b"] > k / 2)).cast("double")))
        lag = total(F.transform(follow, lambda p: (p["a"] - mean) * (p["b"] - mean)))
        spread = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
        return F.struct(squares.alias("squares"), high.alias("high"), turns.alias("turns"), lag.alias("lag"), spread.alias("spread"))

    def judged(s: Column) -> Column:
        chi = k / n * s["squares"] - n
        df = k - 1
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        low = n - s["high"]
        both = 2 * s["high"] * low
        var = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(var > 0, F.abs(s["turns"] - both / n) / F.sqrt(var)).otherwise(F.lit(99.0))
        z_lag = F.when(s["spread"] > 0, F.abs(s["lag"] / s["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        worst = F.least(upper_tail(z_chi), 2 * upper_tail(z_runs), 2 * upper_tail(z_lag))
        extra = n * (k * t["chance"] - 1)
        z_plain = (df + extra - chi) / F.sqrt(2 * (df + 2 * extra))
        even = F.greatest(upper_tail(z_plain), F.lit(1e-18))
        z_turn = (t["changes"] - 0.5 - t["steps"] * t["turn"]) / F.sqrt(t["steps"] * t["turn"] * (1 - t["turn"]))
        both = even * F.greatest(upper_tail(z_turn), F.lit(1e-18))
        p = F.coalesce(both * (1 - F.log(both)), even)  # Fisher's method for two
        return F.struct(p.alias("p"), (3 * worst >= RANDOM_ALPHA).alias("random"), t["encoding"].alias("encoding"))

    return let(let(places, sums), judged)


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: base spans by kind, and tested candidates; the text is left behind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id",
        _guarded(text, ASSIGN, ASSIGN_KEY, group=2).alias("assign"),
        _guarded(text, ACCESS, ACCESS).alias("access"),
        _guarded(text, HEX, HEX).alias("hex"),
        F.when(text.rlike(CANDIDATE), F.arrays_zip(_spans(text, CANDIDATE).alias("span"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("token"))).alias("tokens"),
    )

    def candidate(m: Column) -> Column:
        r = _tested(m["token"])
        n = F.length(m["token"])
        fine = F.floor(-F.log10(F.greatest(r["p"], F.lit(1e-20))) * BINS_A_DECADE)
        bin_ = F.when(r["random"], F.least(F.lit(MOST_BIN), fine)).otherwise(-1).cast("int")
        return F.struct(m["span"]["start"].alias("start"), m["span"]["stop"].alias("stop"), (r["encoding"] * 32 + F.floor(F.log2(n.cast("double")))).cast("int").alias("stratum"), bin_.alias("bin"))

    none = F.array().cast("array<struct<start:int,stop:int,stratum:int,bin:int>>")
    return rows.select("doc_id", "assign", "access", "hex", F.when(F.col("tokens").isNull(), none).otherwise(F.transform("tokens", candidate)).alias("candidates"))


def thresholds(candidates: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each stratum of encoding and length the least significant bin that step-up control at ``q`` admits.

    ``candidates`` has ``stratum, bin``; bin -1 (not random) counts as p = 1. The counts are at most a few
    thousand rows, whatever the corpus.
    """
    counts = candidates.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    stratum = Window.partitionBy("stratum")
    counts = counts.withColumn("m", F.sum("n").over(stratum)).withColumn("above", F.sum("n").over(stratum.orderBy(F.desc("bin"))))
    p = F.pow(F.lit(10.0), -F.col("bin") / float(BINS_A_DECADE))
    passed = counts.where((F.col("bin") >= 0) & (p <= q * F.col("above") / F.col("m"))).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in passed.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = FALSE_DISCOVERIES) -> DataFrame:
    """``doc_id, spans``: all spans of a document, ``array<struct<start, kind, stop>>`` by start and kind.

    Kinds are 0 assign, 1 access, 2 hex, 3 random. A random span that overlaps a span of the other kinds is
    not told again. Null and empty texts have no spans; repeated rows are each scanned; an empty table gives
    an empty result, and other columns are ignored.
    """
    rows = written(_scanned(docs, id_col, text_col), "secrets")
    limit = thresholds(rows.select(F.explode("candidates").alias("c")).select("c.stratum", "c.bin"), q)
    if limit:
        at = F.create_map(*[F.lit(x) for pair in sorted(limit.items()) for x in pair])
        passed = lambda c: F.coalesce((c["bin"] >= 0) & (c["bin"] >= at[c["stratum"]]), F.lit(False))
        found = F.filter("candidates", passed)
    else:
        found = F.filter("candidates", lambda c: F.lit(False))
    of = lambda array, kind: F.transform(array, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))
    rows = rows.select("doc_id", F.concat(of("assign", 0), of("access", 1), of("hex", 2)).alias("base"), of(found, 3).alias("found"))
    apart = F.filter("found", lambda f: ~F.exists("base", lambda b: (b["start"] < f["stop"]) & (f["start"] < b["stop"])))
    return rows.select("doc_id", F.array_sort(F.concat("base", apart)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` from :func:`scan`'s rows."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


#: The base spans in SQL: pieces between matches and the matches in turn give the places.
_ASSIGN_SQL = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
BASE_ORACLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, 0 AS k, 'assign' AS kind, 12 AS least, regexp_split_to_array(text, '{_ASSIGN_SQL}') AS gaps, regexp_extract_all(text, '{_ASSIGN_SQL}', 0) AS hits, regexp_extract_all(text, '{_ASSIGN_SQL}', 2) AS parts FROM t
  UNION ALL SELECT doc_id, 1, 'access', 18, regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM t
  UNION ALL SELECT doc_id, 2, 'hex', 16, regexp_split_to_array(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM t),
e AS (SELECT doc_id, k, kind, least, unnest(range(len(hits))) AS i, gaps, hits, parts FROM m),
s AS (SELECT doc_id, k, kind, length(hits[i + 1]) AS n, length(parts[i + 1]) AS z, least, list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0) AS place FROM e),
f AS (SELECT * FROM s WHERE z >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h, string_agg(kind || ':' || CAST(place AS BIGINT) || ':' || CAST(place + n AS BIGINT), ',' ORDER BY place, k) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)"""
