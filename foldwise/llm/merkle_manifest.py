"""Merkle manifest of a dataset: a tree of hashes for each group, one over the groups, and a proof for every row.

Leaves are ranked within their group and cut into aligned buckets of ``2^height`` ranks, so that a bucket is a whole
subtree. An executor runs one bucket's levels as DuckDB queries (``string_agg`` in order, ``sha256``) on its Arrow table.
Spark ranks, takes the buckets' roots as the leaves of the next tree, round by round, and joins the proofs above a bucket to
the proofs within it.
"""

from __future__ import annotations

from collections.abc import Sequence

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldwise.llm.common import forget, written

#: Levels of a bucket's subtree: 4096 leaves at most are in one DuckDB table.
HEIGHT = 12
#: A row whose crc32 of the id is divisible by this is tampered with in the check.
TAMPERED = 7
#: Siblings from a node up: none (``''``) where the node is alone in its run; ``left`` where the sibling comes first.
PROOF = "array<struct<h:string,left:boolean>>"


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A group's name so that keys order as names do by bytes, null first and apart from the empty name."""
    return F.coalesce(F.concat(F.lit("."), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Ranks from 0 within ``key`` in the given order, by range partitions and their counts; no task sees a whole group.

    Rows that tie in everything have consecutive ranks. The result is written.
    """
    parts = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    at = F.monotonically_increasing_id()  # the partition above, the place in it below
    placed = written(parts.withColumns({"__fw_part": F.shiftright(at, 33), "__fw_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    runs = placed.groupBy(key, "__fw_part").agg(F.count(F.lit(1)).alias("__fw_n"), F.min("__fw_at").alias("__fw_first"))
    before = Window.partitionBy(key).orderBy("__fw_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__fw_n").over(before), F.lit(0)) - F.col("__fw_first")
    shifts = written(runs.select(key, "__fw_part", shift.alias("__fw_shift")), "shifts")
    out = placed.join(shifts, [key, "__fw_part"]).withColumn(name, F.col("__fw_at") + F.col("__fw_shift"))
    out = written(out.drop("__fw_part", "__fw_at", "__fw_shift"), "ranked")
    forget(placed, shifts)
    return out


def _levels(con, depth: int) -> None:
    """``nodes(level, pos, h)`` of levels 0 to depth above the table ``leaves``."""
    con.execute("create or replace temp table nodes as select 0 as level, pos, h from leaves")
    for level in range(depth):
        con.execute(f"insert into nodes select {level + 1}, pos // 2, sha256(string_agg(h, '' order by pos)) from nodes where level = {level} group by pos // 2")


def _connect():
    con = duckdb.connect(":memory:")
    con.execute("set threads = 1")
    con.execute("set memory_limit = '256MB'")
    return con


def bucket_roots(bucket: pa.Table) -> pa.Table:
    """One row with the root of one bucket's subtree."""
    depth = bucket["depth"][0].as_py()
    with _connect() as con:
        con.register("leaves", bucket.select(["pos", "h"]))
        _levels(con, depth)
        root = con.execute(f"select h from nodes where level = {depth}").fetchone()[0]
    return pa.table({"key": [bucket["key"][0].as_py()], "bucket": [bucket["bucket"][0].as_py()], "h": [root]})


def bucket_proofs(bucket: pa.Table) -> pa.Table:
    """The bucket's rows with their siblings up to the bucket's root."""
    depth = bucket["depth"][0].as_py()
    with _connect() as con:
        con.register("leaves", bucket.select(["pos", "h"]))
        _levels(con, depth)
        got = con.sql(
            f"""
            with steps as (select pos, level, xor(pos >> level, 1) as other from leaves, range({depth}) r(level))
            select s.pos, list({{'h': coalesce(n.h, ''), 'left': s.other % 2 = 0}} order by s.level) as proof
            from steps s left join nodes n on n.level = s.level and n.pos = s.other group by s.pos
            """
        ).to_arrow_table()
    proofs = dict(zip(got["pos"].to_pylist(), got["proof"].to_pylist()))
    kind = pa.list_(pa.struct([("h", pa.string()), ("left", pa.bool_())]))
    made = pa.array([proofs.get(p, []) for p in bucket["pos"].to_pylist()], kind)
    return bucket.drop_columns(["h", "depth"]).append_column("proof", made)


def _in_buckets(nodes: DataFrame, height: int) -> DataFrame:
    """``key, rank, h`` and more with bucket, place and the number of levels to hash there: all, or as many as a small group has."""
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    depth = sum(((F.col("n") > (1 << i)).cast("int") for i in range(height)), F.lit(0))  # the fewest levels that leave one node
    cut = nodes.join(sizes.select("key", depth.alias("depth")), "key")
    return cut.withColumns({"bucket": F.shiftright("rank", height), "pos": F.col("rank").bitwiseAND(F.lit((1 << height) - 1))})


def tree(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Trees over ``key, rank, h`` (ranks from 0 without gaps): ``(key, root)``, and the nodes, without ``h``, with their ``proof``.

    Other columns stay with their node, so that none has to be joined back. Each round leaves a node for every ``2^height``; rounds go on until each key has one, which the largest rank tells.
    """
    rounds, level = [], nodes
    while True:
        cut = written(_in_buckets(level, height), "buckets")
        rounds.append(cut)
        if level is not nodes:
            forget(level)
        roots = cut.select("key", "bucket", "pos", "h", "depth").groupBy("key", "bucket").applyInArrow(bucket_roots, "key string, bucket long, h string")
        level = written(roots.select("key", F.col("bucket").alias("rank"), "h"), "roots")
        if not level.where("rank > 0").limit(1).count():
            break
    roots, above = level.select("key", F.col("h").alias("root")), None
    for cut in reversed(rounds):
        kept = ", ".join(f"{name} {kind}" for name, kind in cut.dtypes if name not in ("h", "depth"))
        proofs = cut.groupBy("key", "bucket").applyInArrow(bucket_proofs, f"{kept}, proof {PROOF}")
        if above is not None:
            proofs = proofs.join(above.select("key", F.col("rank").alias("bucket"), F.col("proof").alias("__fw_above")), ["key", "bucket"])
            proofs = proofs.withColumn("proof", F.concat("proof", "__fw_above")).drop("__fw_above")
        above = proofs.drop("bucket", "pos")
        if cut is not rounds[0]:
            above = written(above, "proofs")
    return roots, above


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.when(s["left"], F.concat(s["h"], h)).otherwise(F.concat(h, s["h"])), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", source_col: str = "source", n_chars_col: str = "n_chars", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, and the rank within the group and the proof.

    One row per input row. Within a group leaves ascend by id, null first; rows that repeat an id by their hash. A null group
    is a group of its own, before all others. ``folded_root`` is what the row's proof gives for the row as it would be after
    tampering (one more in ``n_chars`` where 7 divides the id's crc32; a null stays, and a null id is never tampered with).
    An empty table gives an empty result. Other columns are ignored.
    """
    ident, n = F.col(id_col), F.col(n_chars_col)
    hit = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    values = lambda count: leaf_hash([ident, F.col(source_col), F.col(group_col), count, F.col(text_col)])
    rows = docs.select(
        ident.alias("doc_id"), group_key(F.col(group_col)).alias("key"), values(n).alias("leaf"),
        F.when(hit & n.isNotNull(), values(n + 1)).alias("tampered"),
    )
    leaves = ranked(rows, "key", ["doc_id", "leaf"], "rank")
    subroots, inner = tree(leaves.withColumn("h", F.col("leaf")), height)
    groups = ranked(subroots.withColumn("all", F.lit("")), "all", ["key"], "__fw_group")
    top, outer = tree(groups.select(F.col("all").alias("key"), F.col("__fw_group").alias("rank"), F.col("root").alias("h")), height)
    root = top.select(F.col("root").alias("top")).first()
    above = groups.join(outer.select(F.col("rank").alias("__fw_group"), F.col("proof").alias("outer")), "__fw_group").select("key", F.col("root").alias("subroot"), "outer")
    # a row for each group: Spark broadcasts it when its size allows
    out = inner.join(above, "key").withColumn("proof", F.concat("proof", "outer")).withColumn("root", F.lit(root["top"] if root else None).cast("string"))
    out = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    siblings = F.sha2(F.array_join(F.transform("proof", lambda s: s["h"]), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", siblings.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "rank", "proof")


def _climb(name: str, levels: int) -> str:
    """Levels 1 and up above ``<name>0(k, pos, h, n)``, and all nodes that have a run to share, as ``<name>_nodes``."""
    node = "case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by pos)) end"
    up = [f"{name}{i + 1} as materialized (select k, pos // 2 as pos, {node} as h, (any_value(n) + 1) // 2 as n from {name}{i} group by k, pos // 2)" for i in range(levels)]
    nodes = " union all ".join(f"select {i} as level, k, pos, h from {name}{i} where n > 1" for i in range(levels))
    return ",\n".join([*up, f"{name}_nodes as materialized ({nodes})"])


def _steps(name: str, levels: int) -> str:
    """Each row's siblings up its tree, ``L`` or ``R`` before their hash."""
    return f"""{name}_proof as materialized (
  select r.rid, list(case when (r.pos >> l.level) % 2 = 1 then 'L' else 'R' end || coalesce(s.h, '') order by l.level) as p
  from {name}_rows r join range({levels}) l(level) on ((r.n + (1::bigint << l.level) - 1) >> l.level) > 1
  left join {name}_nodes s on s.level = l.level and s.k = r.k and s.pos = xor(r.pos >> l.level, 1::bigint) group by r.rid)"""


def _oracle(levels: int = 24, group_levels: int = 12) -> str:
    """The same with each level written out, for ``2^levels`` rows of a group at most. There is no crc32, so its bits are."""
    part = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda n: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: {byte}))"
    return f"""
with a as materialized (
  select row_number() over () as rid, doc_id, case when lang is null then '' else '.' || lang end as k, {leaf("n_chars")} as h,
    case when {crc} % 7 = 0 and n_chars is not null then {leaf("(n_chars + 1)")} end as tampered from documents),
g_rows as materialized (select *, row_number() over (partition by k order by doc_id nulls first, h, rid) - 1 as pos, count(*) over (partition by k) as n from a),
g0 as materialized (select k, pos, h, n from g_rows),
{_climb("g", levels)},
t_rows as materialized (select k as rid, '' as k, row_number() over (order by k) - 1 as pos, h, count(*) over () as n from g{levels}),
t0 as materialized (select k, pos, h, n from t_rows),
{_climb("t", group_levels)},
{_steps("g", levels)},
{_steps("t", group_levels)},
j as (select a.*, sub.h as subroot, top.h as root, coalesce(g.p, []) || coalesce(t.p, []) as p
  from g_rows a left join g_proof g on g.rid = a.rid left join t_proof t on t.rid = a.k join g{levels} sub on sub.k = a.k cross join t{group_levels} top),
f as (select *, list_reduce(list_prepend(coalesce(tampered, h), p), lambda acc, s: sha256(case when s[1] = 'L' then s[2:] || acc else acc || s[2:] end)) as folded from j)
select doc_id, h as leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s[2:]), '')) as proof_sha256, folded as folded_root, folded = root as verified from f
"""


ORACLE = _oracle()
