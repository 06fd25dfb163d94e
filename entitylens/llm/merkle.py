"""A Merkle manifest of a dataset, and proofs by coordinate lookup.

Each row is a leaf: the SHA-256 of its fields, each written with its length. The
leaves of a group (a source) stand in order of id; every ``FAN`` consecutive nodes
become one node, level by level, until one remains, and the groups' last nodes are
folded into the root in the same way, in order of the groups.

The node table is materialised by runs: a row for each (tree, level, run) holds the
digests of its up to ``FAN`` consecutive nodes as one string. All siblings that the
leaves of one run need above their own level are the same, so each run of leaves
explodes the coordinates (tree, level, run, place) of its ancestors from its index
and its group's size, looks them up in the node table, and puts them in order. A
leaf's proof is its run without itself and then those lookups. Folding puts a leaf
back in its places and hashes its way up.

Indexes come from a range partitioning by (group, id, leaf), a rank within each
range and prefix sums over ranges, so no group is gathered in one task. Upper
levels, where many leaves ask for one row, are broadcast as long as they have
``MOST_TOP`` rows at most (about 1 kB each); from there on down no row is asked
for by more than a small share of all runs, and the lookup is a shuffled join.

Defined cases: null and empty fields have different leaves; a null group is one
group, before all others; null ids come first in their group and are never
tampered with; equal ids stand in order of their leaves, and rows that are equal in
all fields take consecutive places; very long texts are hashed whole; empty input
gives no rows; columns beyond the named fields, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylens.llm.common import discard, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Consecutive nodes that become one.
FAN = 16
#: Rows of the upper levels of the node table that are broadcast at most.
MOST_TOP = 4096
HEX = 64
#: The place of the top tree's lowest level in the order of steps.
GROUPS = 1000
STEPS = "array<struct<ord:int,left:string,own:string,right:string>>"


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 over fields, each '-' if null and else its byte count, ':' and itself."""
    written = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with _at, the rows before each in its group, and _n, the rows of the group; and a stored table to discard later.

    df must be stored, as it is read twice; rows equal in group and order may be
    numbered in any way. group and order are compared as Spark sorts them, nulls first.
    """
    schema = "_part int, _rank long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    where = df.columns.index(group)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, seen = TaskContext.get().partitionId(), object(), 0
        for b in (b for b in batches if b.num_rows):
            key = b.column(where)
            # A group's rows stand together: a new run begins where neighbours differ.
            starts = np.flatnonzero(np.diff(np.asarray(key.dictionary_encode().indices.fill_null(-1)), prepend=-2))
            rank = np.arange(b.num_rows) - np.repeat(starts, np.diff(starts, append=b.num_rows))
            if key[0].as_py() == now:
                rank[: starts[1] if len(starts) > 1 else b.num_rows] += seen
            now, seen = key[b.num_rows - 1].as_py(), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(rank.astype(np.int64)), *b.columns], names=["_part", "_rank", *b.schema.names])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows that are equal in all of these are dealt apart by where they lie in the stored table.
    by = [F.col(group), *map(F.col, order), F.col("_salt")]
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    rows = stored(salted.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_salt").mapInArrow(ranked, schema), "ranked")
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_c"))
    mine = Window.partitionBy(group)
    before = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A group has a row for each range that it reaches into.
    places = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(mine).alias("_n"))
    met = rows.join(places, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*df.columns, (F.col("_base") + F.col("_rank")).alias("_at"), "_n"), rows


def levels(n: int) -> int:
    """How often n nodes are folded until one remains."""
    found = 0
    while n > 1:
        n, found = -(-n // FAN), found + 1
    return found


def folded(first: DataFrame, most: int) -> tuple[dict[int, DataFrame], DataFrame]:
    """The runs of the levels above the first, and each tree's last node: (tree, node).

    first: runs of the lowest level (tree, run, n, digests), n the nodes of the tree at that level;
    most: the nodes of the largest tree.
    """
    tables, now = {}, first
    ends = first.where("n = 1").select("tree", F.col("digests").alias("node"))
    for level in range(1, levels(most) + 1):
        nodes = now.where("n > 1").select("tree", "run", fewer(F.col("n"), 1).alias("n"), F.sha2(F.col("digests").cast("binary"), 256).alias("node"))
        up = nodes.groupBy("tree", over(F.col("run"), 1).alias("run")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("run", "node"))).alias("_x"))
        now = tables[level] = stored(up.select("tree", "run", "n", F.array_join("_x.node", "").alias("digests")), f"nodes-{level}")
        ends = ends.unionByName(now.where("n = 1").select("tree", F.col("digests").alias("node")))
    return tables, ends


def over(index: Column, up: int) -> Column:
    """The index of the node that lies up levels above another."""
    return F.floor(index / F.lit(FAN**up)).cast("long") if up else index


def fewer(n: Column, up: int) -> Column:
    """How many nodes lie up levels above n."""
    return F.ceil(n / F.lit(FAN**up)).cast("long")


def without(digests: Column, place: Column) -> tuple[Column, Column]:
    """The digests of a run left and right of a place."""
    at = (place * HEX).cast("int")
    return F.substring(digests, F.lit(1), at), F.substr(digests, at + HEX + 1)


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """leaf, subroot, root, proof (siblings' digests from the leaf's run up to the root, in order) and the root folded for each row.

    tampered: rows whose text has its capital letters A-Z made small before folding.
    """
    forged = leaf_of([lower_ascii(F.col(f)) if f == text_col else F.col(f) for f in fields])
    whole = leaf_of([F.col(f) for f in fields])
    to_forge = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = stored(df.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("_group"), whole.alias("leaf"), F.when(to_forge, forged).alias("forged")), "leaves")
    placed, ranked = numbered(leaves, "_group", ["doc_id", "leaf"])

    # One row for each run of leaves; a group's tree is named by its place among the groups.
    member = F.struct("_at", "doc_id", "leaf", "forged")
    runs = stored(placed.groupBy("_group", over(F.col("_at"), 1).alias("run")).agg(F.first("_n").alias("n"), F.array_sort(F.collect_list(member)).alias("members")), "leaf-runs")
    discard(leaves, ranked)
    groups = stored(runs.where("run = 0").select(F.lit(0).alias("_all"), "_group", "n"), "groups")
    trees, ranked = numbered(groups, "_all", ["_group"])
    trees = stored(trees.select(F.col("_group").alias("_g"), F.col("_at").alias("tree"), F.col("_n").alias("groups"), F.col("n").alias("_m")), "trees")
    discard(groups, ranked)
    size = trees.agg(F.coalesce(F.max("_m"), F.lit(0)).alias("most"), F.coalesce(F.max("groups"), F.lit(0)).alias("groups")).first()
    # Many runs of a large group meet one row here: Spark splits their partition, as both sides are plain exchanges.
    first = stored(runs.join(trees, F.col("_group").eqNullSafe(F.col("_g"))).select("tree", "run", "n", F.array_join("members.leaf", "").alias("digests"), "members"), "first-level")
    discard(runs)
    inner, subroots = folded(first.drop("members"), size["most"])
    last = subroots.groupBy(over(F.col("tree"), 1).alias("run")).agg(F.array_sort(F.collect_list(F.struct("tree", "node"))).alias("_x"))
    lowest = stored(last.select(F.lit(0).cast("long").alias("tree"), "run", F.lit(size["groups"]).cast("long").alias("n"), F.array_join("_x.node", "").alias("digests")), "top-level")
    upper, root = folded(lowest, size["groups"])
    root = next((r["node"] for r in root.collect()), "")  # one row, or none of an empty table

    tables = {(False, level): d for level, d in inner.items()} | {(True, 0): lowest} | {(True, level): d for level, d in upper.items()}
    met = first.join(looked_up(first, tables, size["most"], size["groups"]), ["tree", "run"], "left")
    each = met.select("n", "digests", F.coalesce("steps", F.array().cast(STEPS)).alias("steps"), F.posexplode("members").alias("place", "m"))
    left, right = without(F.col("digests"), F.col("place"))
    # A lone leaf is its group's last node: it isn't folded there.
    own = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("ord"), left.alias("left"), F.col("m.leaf").alias("own"), right.alias("right"))))
    steps = F.concat(F.coalesce(own, F.array().cast(STEPS)), "steps")
    proof = F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")
    up = F.aggregate(steps, F.coalesce("m.forged", "m.leaf"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))
    # A group's last node stands among its siblings at the lowest level of the top tree; an only group's is the root.
    subroot = F.coalesce(F.get(F.filter("steps", lambda s: s["ord"] == GROUPS), F.lit(0))["own"], F.lit(root))
    return each.select("m.doc_id", "m.leaf", subroot.alias("subroot"), F.lit(root).alias("root"), proof.alias("proof"), up.alias("folded_root"))


def looked_up(first: DataFrame, tables: dict[tuple[bool, int], DataFrame], most: int, groups: int) -> DataFrame:
    """For each run of leaves its steps up to the root: at each level the node it lies under, and that node's siblings.

    tables: the node table, by whether a level belongs to the top tree, and which it is.
    """
    wanted = []
    for top, level in tables:
        if level >= (levels(groups) if top else levels(most)):
            continue  # a last node has no siblings
        node = over(F.col("tree"), level) if top else over(F.col("run"), level - 1)
        there = F.lit(True) if top else fewer(F.col("n"), level) > 1
        key = [F.lit(top).alias("top"), F.lit(level).alias("level"), (F.lit(0).cast("long") if top else F.col("tree")).alias("t")]
        wanted.append(F.when(there, F.struct(*key, over(node, 1).alias("r"), (node % FAN).cast("int").alias("place"))))
    if not wanted:
        return first.select("tree", "run", F.array().cast(STEPS).alias("steps")).where("false")
    asked = first.select("tree", "run", F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("c")).select("tree", "run", "c.*")

    room, upper, lower = MOST_TOP, [], []
    for key in sorted(tables, reverse=True):
        room -= tables[key].count() if room > 0 else 0
        (upper if room >= 0 else lower).append(key)

    def matched(keys: list[tuple[bool, int]], small: bool) -> DataFrame:
        rows = [tables[k].select(F.lit(k[0]).alias("top"), F.lit(k[1]).alias("level"), F.col("tree").alias("t"), F.col("run").alias("r"), "digests") for k in keys]
        nodes = reduce(DataFrame.unionByName, rows)
        mine = reduce(lambda a, b: a | b, [(F.col("top") == k[0]) & (F.col("level") == k[1]) for k in keys])
        found = asked.where(mine).join(F.broadcast(nodes) if small else nodes, ["top", "level", "t", "r"])
        left, right = without(F.col("digests"), F.col("place"))
        own = F.substring("digests", F.col("place") * HEX + 1, F.lit(HEX))
        order = F.col("level") + F.when(F.col("top"), GROUPS).otherwise(0)
        return found.select("tree", "run", F.struct(order.alias("ord"), left.alias("left"), own.alias("own"), right.alias("right")).alias("s"))

    parts = [matched(keys, small) for keys, small in ((upper, True), (lower, False)) if keys]
    return reduce(DataFrame.unionByName, parts).groupBy("tree", "run").agg(F.array_sort(F.collect_list("s")).alias("steps"))


def op11(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, verified with every fifth one by checksum tampered with."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = manifest(table(spark, sf_dir, "documents"), tampered=picked)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEVELS = 7


def _levels_sql(first: str, name: str) -> str:
    """Levels of nodes (k, idx, n, node) above the table first, in CTEs name0, name1, ..."""
    out = [f"{name}0 AS MATERIALIZED ({first})"]
    out += [
        f"{name}{i} AS MATERIALIZED (SELECT k, idx // {FAN} AS idx, (n + {FAN - 1}) // {FAN} AS n, sha256(string_agg(node, '' ORDER BY idx)) AS node FROM {name}{i - 1} WHERE n > 1 GROUP BY k, idx // {FAN}, (n + {FAN - 1}) // {FAN})"
        for i in range(1, _LEVELS)
    ]
    last = " UNION ALL ".join(f"SELECT k, node FROM {name}{i} WHERE n = 1" for i in range(_LEVELS))
    return ",\n".join([*out, f"{name}_end AS MATERIALIZED ({last})"])


def _steps_sql(name: str, before: str, key: str, at: str) -> str:
    """CTEs that fold one level after another: x, the value, and p, the siblings so far."""
    out = []
    for i in range(_LEVELS):
        place = f"(({before}.{at} // {FAN**i}) % {FAN})"
        runs = f"SELECT k, idx // {FAN} AS run, list(node ORDER BY idx) AS nodes FROM {name}{i} WHERE n > 1 GROUP BY k, idx // {FAN}"
        left, right = f"array_to_string(nodes[1:{place}], '')", f"array_to_string(nodes[{place} + 2:], '')"
        out.append(
            f"{name}_s{i} AS MATERIALIZED (SELECT {before}.* EXCLUDE (x, p), CASE WHEN nodes IS NULL THEN x ELSE sha256({left} || x || {right}) END AS x, CASE WHEN nodes IS NULL THEN p ELSE p || {left} || {right} END AS p "
            f"FROM {before} LEFT JOIN ({runs}) r ON r.k = {before}.{key} AND r.run = {before}.{at} // {FAN ** (i + 1)})"
        )
        before = f"{name}_s{i}"
    return ",\n".join(out)


def _field_sql(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"


#: Plain levels and folds for up to 16**6 nodes of a tree; groups are named so that null comes first.
OP11_SQL = f"""
WITH RECURSIVE rem(i, s, r) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, s + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END FROM rem WHERE s < 8
), lut AS (SELECT list(r ORDER BY i) AS l FROM rem WHERE s = 8),
doc AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)),
    lambda c, b: xor(c // 256, lut.l[(xor(c % 256, b) + 1)::BIGINT]))) % 5 = 0 AS picked
  FROM documents, lut
), leafs AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf_sql("text")} AS leaf,
    CASE WHEN picked THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged FROM doc
), put AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM leafs
),
{_levels_sql("SELECT k, idx, n, leaf AS node FROM put", "a")},
{_levels_sql("SELECT 0 AS k, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n, node FROM a_end", "b")},
named AS (SELECT k, node AS subroot, row_number() OVER (ORDER BY k) - 1 AS g, 0 AS zero FROM a_end),
start AS (SELECT put.*, subroot, g, zero, coalesce(forged, leaf) AS x, '' AS p FROM put JOIN named ON named.k = put.k),
{_steps_sql("a", "start", "k", "idx")},
{_steps_sql("b", f"a_s{_LEVELS - 1}", "zero", "g")}
SELECT doc_id, leaf, subroot, b_end.node AS root, sha256(p) AS proof_sha256, x AS folded_root, x = b_end.node AS verified
FROM b_s{_LEVELS - 1}, b_end
"""
