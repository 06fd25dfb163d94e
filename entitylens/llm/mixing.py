"""Mixing sources to target weights by hierarchical budgeting, in SQL expressions alone.

The leaves are (domain, language, source). Integer weights run down the tree: a
node's budget goes to its children in proportion to their weights, and no child
gets more than its subtree can give (its tokens times ``max_epochs``). What a
child can't use goes to its siblings by weight; as a parent's own limit is the
sum of its children's, only what all siblings together can't use reaches the
level above. Shares are rounded down to whole tokens.

A leaf with budget b and t tokens gives b div t whole epochs, and of the next
epoch the longest prefix that fits. Each epoch's order is that of
md5(seed:epoch:id), so it is fixed by the seed. The prefix's end is found from
sums over 4096 hash cells of each leaf; only the cell that holds the end is read
row by row, so no leaf is gathered in one task, however large. The selection is
then a comparison of each row with its leaf's plan, without moving texts.

Tokens are counted as a quarter of the UTF-8 bytes, rounded up (``tokens``
takes another expression).

Defined cases: a null language or source is a leaf named '?'; a null or empty
text has no tokens and comes with the prefix that reaches it; rows with the same
id stand or fall together in an epoch's prefix; a tree without tokens gets
nothing; other columns pass through ``mixed`` unless named like its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylens.llm.common import stored, table

LEVELS = ["domain", "language", "origin"]
DOMAINS = ["web", "books", "news", "code"]
WEIGHTS = {"domain": {"web": 5, "books": 2, "news": 2, "code": 1}, "language": {"en": 6, "fr": 2, "de": 1, "es": 1}, "origin": {}}
CELLS = 4096


def domain_of(source: Column) -> Column:
    """A domain from the number in a source's name; other names are 'other'."""
    number = F.regexp_extract(source, r"^src(\d{1,9})$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.when(number != "", F.get(names, (number.try_cast("int") % len(DOMAINS)).cast("int"))).otherwise("other")


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """Children that are not named weigh 1."""
    known = weights.get(level, {})
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``given`` to children with columns parent..., child, w, cap and budget (the parent's)."""
    order = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col(child))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent, F.lit(0))
    sums = children.withColumns({"_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_rest": F.sum("w").over(after)})
    # By rising cap / weight, a child is full if its part of what is left covers its cap.
    full = sums.withColumn("_full", F.col("cap") * F.col("_rest") <= (F.col("budget") - F.col("_before")) * F.col("w"))
    left = full.withColumns({"_used": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole), "_open": F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("w"))).over(whole)})
    given = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("((budget - _used) * w) div nullif(_open, 0)"))
    return left.withColumn("given", given).drop("_before", "_rest", "_full", "_used", "_open", "budget")


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (LEVELS, tokens) with ``given``, the leaf's budget."""
    caps = leaves.where(F.col("tokens") > 0).withColumn("cap", F.col("tokens") * max_epochs)
    top = caps.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("long").alias("budget"))
    plan = None
    for depth, level in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = caps.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", weight(level, weights))
        # The first level has one parent row; the others meet theirs by name.
        above = nodes.crossJoin(F.broadcast(top)) if plan is None else nodes.join(plan.withColumnRenamed("given", "budget"), parent)
        plan = share_out(above, parent, level).select(*LEVELS[: depth + 1], "given")
    return caps.join(plan, LEVELS)


def mixed(df: DataFrame, share: float = 0.8, max_epochs: int = 3, seed: int = 42, weights: dict[str, dict[str, int]] = WEIGHTS, id_col: str = "doc_id", tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """The rows of df that are selected, with LEVELS, n_tokens and ``copies``.

    share: the budget as a part of all tokens.
    """
    size = F.expr("(coalesce(octet_length(text), 0) + 3) div 4") if tokens is None else tokens
    named = {
        "domain": domain_of(F.col("source")) if domain is None else domain,
        "language": F.coalesce(F.col("lang"), F.lit("?")),
        "origin": F.coalesce(F.col("source"), F.lit("?")),
        "n_tokens": size.cast("long"),
    }
    rows = df.withColumns(named)
    narrow = rows.select(*LEVELS, "n_tokens", F.col(id_col).cast("string").alias("_id"))
    place = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id"), F.lit("null"))).cast("binary"))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, share, max_epochs, weights).withColumns({"_epochs": F.expr("given div tokens"), "_left": F.expr("given % tokens")})
    plan = stored(budgets.select(*LEVELS, "_epochs", "_left"), "mix-budgets")
    cell = F.conv(F.substring("_place", 1, 3), 16, 10).cast("int")
    placed = narrow.join(plan, LEVELS).withColumn("_place", place(F.col("_epochs"))).withColumn("_cell", cell)
    cells = placed.groupBy(*LEVELS, "_cell", "_left").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*LEVELS).orderBy("_cell")
    ends = stored(cells.withColumn("_end", F.sum("n").over(running)).where((F.col("_end") > F.col("_left")) & (F.col("_end") - F.col("n") <= F.col("_left"))).select(*LEVELS, "_cell", (F.col("_end") - F.col("n")).alias("_start")), "mix-cells")
    # The cell that the prefix ends in: rows with one place are taken together.
    peers = Window.partitionBy(*LEVELS, "_cell").orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = placed.join(ends, [*LEVELS, "_cell"]).withColumn("_end", F.col("_start") + F.sum("n_tokens").over(peers)).where(F.col("_end") <= F.col("_left"))
    cuts = last.groupBy(*LEVELS).agg(F.max("_place").alias("_in_cell"))
    # All places of the cells before are smaller than the cell's own first one.
    floor = F.lpad(F.lower(F.conv(F.col("_cell").cast("string"), 10, 16)), 3, "0")
    full_plan = plan.join(ends.select(*LEVELS, floor.alias("_floor")), LEVELS, "left").join(cuts, LEVELS, "left")
    cut = stored(full_plan.select(*LEVELS, "_epochs", F.coalesce("_in_cell", "_floor").alias("_cut")), "mix-plan")
    met = rows.withColumn("_id", F.col(id_col).cast("string")).join(cut, LEVELS)
    copies = F.col("_epochs") + (F.col("_cut").isNull() | (place(F.col("_epochs")) <= F.col("_cut"))).cast("long")
    return met.withColumn("copies", copies).where(F.col("copies") > 0).drop("_id", "_epochs", "_cut")


def op8(spark, sf_dir: str) -> DataFrame:
    """The documents picked for the target weights, with their copies."""
    picked = mixed(table(spark, sf_dir, "documents"))
    return picked.select("doc_id", "domain", "language", "origin", "n_tokens", "copies")


def _level_sql(depth: int) -> str:
    parent, keys = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth + 1])
    level = LEVELS[depth]
    w = "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"
    part = f"PARTITION BY {parent} " if parent else ""
    above = "(SELECT floor(sum(tokens) * 0.8::DOUBLE)::BIGINT AS given FROM leaves)" if not depth else f"g{depth - 1}"
    using = f"USING ({parent})" if depth else "ON true"
    return f"""n{depth} AS (SELECT {keys}, sum(tokens * 3)::BIGINT AS cap, {w} AS w FROM leaves WHERE tokens > 0 GROUP BY {keys}),
s{depth} AS (SELECT n.*, p.given AS budget, coalesce(sum(cap) OVER ({part}ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
  sum(w) OVER ({part}ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n{depth} n JOIN {above} p {using}),
f{depth} AS (SELECT *, cap * rest <= (budget - pre) * w AS filled FROM s{depth}),
g{depth} AS (SELECT {keys}, CASE WHEN filled THEN cap ELSE ((budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part})) * w) // sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}) END AS given FROM f{depth})"""


OP8_SQL = f"""
WITH rows AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]{{1,9}}$') THEN ['{"','".join(DOMAINS)}'][substr(source, 4)::INT % 4 + 1] ELSE 'other' END AS domain,
  coalesce(lang, '?') AS language, coalesce(source, '?') AS origin, (coalesce(octet_length(encode(text)), 0) + 3) // 4 AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
plan AS (SELECT domain, language, origin, (given // tokens)::BIGINT AS epochs, (given % tokens)::BIGINT AS rest FROM g2 JOIN leaves USING (domain, language, origin)),
ordered AS (SELECT r.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('42:' || epochs || ':' || doc_id)) AS upto FROM rows r JOIN plan USING (domain, language, origin))
SELECT doc_id, domain, language, origin, n_tokens::BIGINT AS n_tokens, (epochs + (upto <= rest)::BIGINT)::BIGINT AS copies FROM ordered WHERE epochs + (upto <= rest)::BIGINT > 0
"""
