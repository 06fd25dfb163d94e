"""Secret scan with multipart credential linking, in SQL expressions alone.

Three base kinds are found in each whole text. On top of them the method looks
for weak parts that mean little alone: identifiers of an access key, long mixed
strings that may be its secret, and endpoints. Under the rule ``all`` (op9, as its
SQL has it) weak parts are reported only when all three meet: between the candidate secret and an identifier, and between it and
an endpoint, there must be at most ``REACH`` code points (from the end of the first
to the start of the later one), in one scope (a text). The parts of all texts are
joined by intervals: each part stands in all cells of ``REACH`` code points that it
covers, and looks in those and the neighbouring ones. Under the rule ``any`` (the
pipeline's stage) one identifier, from a longer list, or one endpoint is enough for
a secret of mixed characters that is not itself a piece of either.

Positions come from splitting at the matches, so each text is scanned a few
times for each kind that it holds and stays where it is; only parts of texts that hold the kinds
the rule asks for are shuffled. A position counts code points, and an end is exclusive.

Defined cases: a null text is an empty one, with no spans; repeated rows are
scanned each; very long texts are scanned whole; rows with equal id and text get equal results; empty input gives
no rows; other columns are left out by ``scan`` and kept by ``redacted``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylens.llm.common import stored, table

#: Base kinds in their order: (name, pattern, group whose length counts, least length, what a text must hold).
#: For runs of one class, asking for the length in the pattern finds the same runs as filtering later.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("=", ":")),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20, ("AKIA",)),
    ("hex", r"([0-9a-f]{24,})", 1, 24, ()),
]
#: Weak parts, in their order behind the base kinds.
WEAK = [
    ("part_id", r"((?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{8,})", 1, 12, ("AKIA", "ASIA", "AGPA", "AIDA", "AROA")),
    ("part_secret", r"([A-Za-z0-9+/_-]{32,})", 1, 32, ()),
    ("part_endpoint", r"((?:https?|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9._:@/-]+)", 1, 8, ("://",)),
]
#: Under the rule ``any``, identifiers of other providers too, and named ones; they hold WEAK's.
WIDE_IDS = (
    r"((?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{8,}|(?:ABIA|ACCA|AIPA|ANPA|ANVA|APKA|LTAI|AKID)[A-Za-z0-9]{12,}"
    r"|GOOG1?[A-Z0-9]{10,}|AC[0-9a-f]{32}|pk_(?:live|test)_[0-9A-Za-z]{10,}|Iv1\.[0-9a-f]{16}|[0-9]{6,}-[0-9a-z]{8,}\.apps\.googleusercontent\.com"
    r"|(?<![0-9A-Fa-f])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9A-Fa-f])"
    r"|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.iam\.gserviceaccount\.com"
    r"|(?i:access_?key_?id|client_?id|tenant_?id|account_?(?:id|name|sid)|app_?id|user_?(?:id|name)|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,})"
)
_C = "[A-Za-z0-9+/_-]"
#: part_secret's runs that hold two of small letters, capitals and digits, as made keys do and rules or slugs don't.
MIXED = rf"((?<!{_C})(?=[+/_-]*+(?:[a-z][a-z+/_-]*+[A-Z0-9]|[A-Z][A-Z+/_-]*+[a-z0-9]|[0-9][0-9+/_-]*+[A-Za-z])){_C}{{32,}})"
#: What is searched under each rule: (name, pattern, group, least length, what a text must hold).
SEARCHED = {"all": WEAK, "any": [("part_id", WIDE_IDS, 1, 3, ()), *WEAK[1:], ("part_mixed", MIXED, 1, 32, ())]}
REACH = 400
SPANS = "array<struct<s:int,e:int>>"
ROW = ["_k1", "_k2"]


def spans(text: Column, pattern: str, group: int, least: int, holds: tuple[str, ...] = ()) -> Column:
    """array<struct<s, e>> of the matches whose group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.zip_with(F.slice(gap, 1, F.size(whole)), whole, lambda g, m: F.struct(g.alias("g"), F.char_length(m).alias("m")))
    each = F.zip_with(sizes, inner, lambda x, i: F.struct(x["g"].alias("g"), x["m"].alias("m"), (F.char_length(i) >= least).alias("ok")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        one = F.struct(s.alias("s"), (s + x["m"]).alias("e"))
        return F.struct((s + x["m"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(each, state, step, lambda acc: acc["out"])
    there = text.rlike(pattern)
    if holds:
        # Cheap searches spare most texts the pattern.
        there = reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in holds]) & there
    return F.when(there, found).otherwise(F.array().cast(SPANS))


def has_parts(text: Column, rule: str = "all") -> Column:
    """Whether a text holds all three weak kinds, or under ``any`` a secret and one of the others."""
    order = [SEARCHED[rule][i] for i in (2, 0, 1)]
    end, key, secret = [reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in w[4]]) & text.rlike(w[1]) if w[4] else text.rlike(w[1]) for w in order]
    if rule == "any":
        # From the starts of runs only: the same texts, and no run is begun anew at each of its letters.
        secret = text.rlike(rf"(?<!{_C}){_C}{{32}}")
        return F.when(secret, F.when(end, True).otherwise(key)).otherwise(False)
    return reduce(lambda a, b: F.when(a, b).otherwise(False), [end, key, secret])


def labelled(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def linked_parts(parts: DataFrame, rule: str = "all") -> DataFrame:
    """The weak parts of each text that co-occur: ROW columns and an array of labelled spans.

    parts has ROW and one array of spans for each kind that is searched under the rule.
    """

    def flat(name: str, i: int) -> DataFrame:
        kind = F.lit(WEAK[i][0]).alias("k")
        return parts.select(*ROW, F.explode(name).alias("x")).select(*ROW, F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.lit(len(BASE) + i).alias("o"), kind).distinct()

    ids, secrets, ends = (flat(kind, i) for i, (kind, *_) in enumerate(WEAK))

    def in_cells(one: DataFrame, reach: int) -> DataFrame:
        """A row for each cell that a part covers when it is longer by reach at both ends."""
        return one.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("s") - reach) / REACH), F.floor((F.col("e") + reach) / REACH))))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """left's parts with at most REACH code points between them and one of right's."""
        names, a = left.columns, in_cells(left, 0)
        r = in_cells(right, REACH).select(F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), F.col("_cell").alias("_rcell"), F.col("s").alias("_rs"), F.col("e").alias("_re"))
        gap = F.greatest(a["s"] - r["_re"], r["_rs"] - a["e"])
        met = (a["_k1"] == r["_r1"]) & (a["_k2"] == r["_r2"]) & (a["_cell"] == r["_rcell"]) & (gap <= REACH)
        return a.join(r, met, "left_semi").select(*names).distinct()

    def apart(left: DataFrame, right: DataFrame, overlap) -> DataFrame:
        """left's parts that overlap none of right's in that way."""
        names, a = left.columns, left.withColumn("_cell", F.floor(F.col("s") / REACH))
        r = in_cells(right, REACH).select(F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), F.col("_cell").alias("_rcell"), F.col("s").alias("_rs"), F.col("e").alias("_re"))
        return a.join(r, (a["_k1"] == r["_r1"]) & (a["_k2"] == r["_r2"]) & (a["_cell"] == r["_rcell"]) & overlap(a["s"], a["e"], r["_rs"], r["_re"]), "left_anti").select(*names)

    met = near(near(secrets, ids), ends)
    if rule == "any":
        # A long path in an address, or an identifier's own letters, are no second part.
        whole = apart(flat("part_mixed", 1), ids, lambda s, e, rs, re: (rs <= s) & (e <= re))
        # An address that starts inside a run is the run's tail; one that reaches its start holds its head.
        free = apart(whole, ends, lambda s, e, rs, re: (rs <= s) & (s < re))
        met = met.unionByName(near(free, ids.unionByName(ends))).distinct()
    every = met.unionByName(near(ids, met)).unionByName(near(ends, met))
    return every.groupBy(*ROW).agg(F.collect_set(F.struct("s", "o", "e", "k")).alias("_linked"))


def _written(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "all") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    base = {kind: spans(F.col("_text"), *rest) for kind, *rest in BASE}
    weak = {kind: F.when(F.col("_parts"), spans(F.col("_text"), *rest)) for kind, *rest in SEARCHED[rule]}
    found = stored(
        rows.withColumn("_parts", has_parts(F.col("_text"), rule))
        .select("doc_id", F.xxhash64("doc_id", "_text").alias("_k1"), F.xxhash64("_text", "doc_id", F.lit(7)).alias("_k2"), "_parts", *[c.alias(k) for k, c in base.items()], *[c.alias(k) for k, c in weak.items()]),
        "secret-spans",
    )
    parts = found.where("_parts")
    every = F.concat(*[labelled(F.col(k), k, i) for i, (k, *_) in enumerate(BASE)])
    out = found.join(linked_parts(parts, rule), ROW, "left").withColumn("_base", every)
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("_base", F.coalesce("_linked", F.array().cast("array<struct<s:int,o:int,e:int,k:string>>")))).alias("spans"),
    )


def _without(text: Column, found: Column, mark: str) -> Column:
    """text with the union of the spans replaced by mark."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.array(F.concat(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))
    return F.aggregate(F.array_sort(found), state, step, end)


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", rule: str = "all") -> DataFrame:
    """df with every reported span replaced in its text; no row is dropped.

    Texts without the weak kinds that the rule asks for are rewritten where they stand; only the
    others meet their linked parts in a join.
    """
    names = df.columns
    text = F.col(text_col)
    base = F.concat(*[labelled(spans(text, *rest), kind, i) for i, (kind, *rest) in enumerate(BASE)])
    keyed = df.withColumn("_parts", F.coalesce(has_parts(text, rule), F.lit(False))).withColumn("_found", base)
    plain = keyed.where(~F.col("_parts"))
    some = keyed.where(F.col("_parts")).withColumns({"_k1": F.xxhash64(id_col, text_col), "_k2": F.xxhash64(text_col, id_col, F.lit(7))})
    weak = stored(some.select(*ROW, *[spans(text, *rest).alias(kind) for kind, *rest in SEARCHED[rule]]), "secret-parts")
    linked = some.join(linked_parts(weak, rule), ROW, "left").withColumn("_found", F.when(F.col("_linked").isNull(), F.col("_found")).otherwise(F.concat("_found", "_linked")))
    both = plain.select(*names, "_found").unionByName(linked.select(*names, "_found"))
    changed = F.when(text.isNotNull() & (F.size("_found") > 0), _without(text, F.col("_found"), mark)).otherwise(text)
    return both.withColumn(text_col, changed).select(*names)


def op9(spark, sf_dir: str) -> DataFrame:
    """The secrets of each document, by kind and place."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS o, '{kind}' AS k, s[i]::INTEGER AS s, (s[i] + len(w[i]))::INTEGER AS e FROM (
    SELECT doc_id, w, n, list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(g[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(w[:i-1], lambda x: len(x))), 0)) AS s, unnest(range(1, len(w) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS w, regexp_extract_all(t, '{quoted}', {group}) AS n, string_split_regex(t, '{quoted}') AS g
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{quoted}')))
  WHERE len(n[i]) >= {least}"""


OP9_SQL = (
    "WITH base AS MATERIALIZED ("
    + " UNION ALL ".join(_sql_spans(k, i, *rest[:3]) for i, (k, *rest) in enumerate(BASE))
    + "), part AS MATERIALIZED ("
    + " UNION ALL ".join(_sql_spans(k, 3 + i, *rest[:3]) for i, (k, *rest) in enumerate(WEAK))
    + f"""), met AS (
  SELECT DISTINCT s.* FROM part s JOIN part a ON a.doc_id = s.doc_id AND a.o = 3 AND greatest(a.s - s.e, s.s - a.e) <= {REACH}
  JOIN part b ON b.doc_id = s.doc_id AND b.o = 5 AND greatest(b.s - s.e, s.s - b.e) <= {REACH} WHERE s.o = 4
), added AS (
  SELECT * FROM met UNION
  SELECT p.* FROM part p JOIN met ON met.doc_id = p.doc_id AND greatest(met.s - p.e, p.s - met.e) <= {REACH} WHERE p.o <> 4
), b AS (SELECT doc_id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS x, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2 FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id"""
)
