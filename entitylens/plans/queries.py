"""Registered queries, one for each operator, each beside its plain DuckDB form.

All run over the entities derived from the customer table, or over a driver
table as it is. The SQL spells the operators' definitions out again; only
vocabulary data is shared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entitylens.functions import vocab
from entitylens.functions.scalars import bucket_for_amount, buckets_meeting, canonical, l2_normalized, literal_map, revenue_max, revenue_min
from entitylens.functions.text import KEEP, index_text, normalize_col, singular_col, tokens_col
from entitylens.operators import bitmaps, blocks, ingest, lexical, metrics, rank, vectors
from entitylens.operators.filters import Explicit, Filters, Range
from entitylens.operators.vector_cells import VectorCells
from entitylens.plans import batch
from entitylens.plans.engine import Engine, Request
from entitylens.plans.nlq import parse
from entitylens.plans.questions import QUESTIONS
from entitylens.shared import stored
from entitylens.shipping import ship
from entitylens.sources.companies import coalesced, customer_entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- shared inputs -----------------------------------------------------------


#: Rows whose topics and words one task derives.
ROWS_A_TASK = 20_000


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities, derived where they are read.

    A table of few row groups is few tasks, so its narrow rows are dealt out first: to
    more tasks for more rows, as Spark merges parts that are small in bytes, not in work.
    """
    raw = customer_entities(spark, sf_dir)
    tasks = -(-raw.count() // ROWS_A_TASK)  # Parquet's footers know it
    raw = raw.repartition(max(tasks, spark.sparkContext.defaultParallelism), "id")
    return ingest.indexed(ingest.enriched(raw.withColumn("revenue_range", bucket_for_amount(F.col("revenue_amount")))))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities as a store has them: written once and read again.

    Filters on derived columns then read them. Over the derivation itself, Spark
    pushes a filter below it and so finds a row's topics once more for each place
    where the filter names topics, industry or words, in every branch of a plan.
    """
    return stored(entities(spark, sf_dir), "entities")


def entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = e.count()
    ids = customer_entities(spark, sf_dir).select("id", (F.col("id") % n).alias("vec_id"))
    return ids.join(e, "vec_id").select("id", "embedding")


def seventh(spark: SparkSession, sf_dir: str) -> list[float]:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 7").first()["embedding"]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^a-z0-9_\s+]', ' ', 'g'), '\s+', ' ', 'g'))"


_KEEP = "(" + ", ".join(f"'{w}'" for w in KEEP) + ")"


def _sql_tokens(x: str) -> str:
    return (
        f"list_transform(string_split({_sql_norm(x)}, ' '), lambda w: CASE WHEN len(w) > 3 AND ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN len(w) > 3 AND ends_with(w, 'sses') THEN w[:-3] "
        f"WHEN len(w) <= 3 OR w IN {_KEEP} OR NOT ends_with(w, 's') OR ends_with(w, 'ss') THEN w ELSE w[:-2] END)"
    )


_PHRASES = sorted(vocab.TOPIC_TABLE, key=lambda p: (-len(p), p))
_TOPIC_RE = " (" + "|".join("  ".join(re.escape(w) for w in p) for p in _PHRASES) + ") "
_TOPIC_MAP = "MAP {" + ", ".join(f"'{'  '.join(p)}': '{t}'" for p, t in vocab.TOPIC_TABLE.items()) + "}"
_INDUSTRY_MAP = "MAP {" + ", ".join(f"'{t}': '{i}'" for t, i in vocab.TOPIC_INDUSTRY.items()) + "}"
_BUCKET = "CASE " + " ".join(f"WHEN {{x}} >= {lo} AND {{x}} < {hi} THEN '{b}'" if hi != float("inf") else f"WHEN {{x}} >= {lo} THEN '{b}'" for b, (lo, hi) in vocab.REVENUE_BUCKETS.items()) + " END"


def _words(x: str) -> str:
    return rf"' ' || replace(trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' '"


#: The entities, as SQL.
BASE = f"""WITH raw AS (
  SELECT c_custkey + 1 AS id, c_name AS name,
    {_sql_list(vocab.HEAD_MODIFIERS)}[c_custkey % 8 + 1] || ' ' || {_sql_list(vocab.HEAD_NOUNS)}[c_custkey % 6 + 1] || ' for ' || {_sql_list(vocab.TOPICS)}[c_custkey % 27 + 1]
      || CASE WHEN c_custkey % 50 = 0 THEN ' and ' || {_sql_list(vocab.TOPICS)}[(c_custkey + 1) % 27 + 1] ELSE '' END || '.' AS description,
    {_sql_list(vocab.LOCATIONS)}[c_nationkey % 8 + 1] AS location,
    CASE WHEN c_custkey % 41 <> 0 THEN (1995 + (7 * c_custkey) % 30)::INTEGER END AS founded_year,
    CASE WHEN c_custkey % 43 <> 0 THEN 5 + (7919 * c_custkey) % 4996 END AS employee_count,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal * 60000 END AS revenue_amount
  FROM customer
), hits AS (
  SELECT *, list_transform(regexp_extract_all(' ' || array_to_string({_sql_tokens("name || '. ' || description")}, '  ') || ' ', '{_TOPIC_RE}', 1), lambda h: {_TOPIC_MAP}[h]) AS h FROM raw
), companies AS (
  SELECT id, name, description, location, founded_year, employee_count, revenue_amount, {_BUCKET.format(x="revenue_amount")} AS revenue_range,
    list_filter(h, lambda x, i: list_position(h, x) = i) AS topics, coalesce({_INDUSTRY_MAP}[h[1]], '') AS industry
  FROM hits
), words AS (
  SELECT *, {_words("name")} AS wn, {_words("description")} AS wd, {_words("array_to_string(topics, ' ')")} AS wt FROM companies
), vec AS (
  SELECT c.id, e.embedding::DOUBLE[] AS v FROM companies c JOIN embeddings e ON e.vec_id = c.id % (SELECT count(*) FROM embeddings)
), q7 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)
"""
FIELDS = ["id", "name", "description", "industry", "location", "founded_year", "employee_count", "revenue_range"]


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Columns for a comparison; lists as text."""
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(c, "|").alias(c) if kinds[c].startswith("array<string") else F.col(c) for c in columns])


def _select(sql: str) -> str:
    return BASE + sql


_ALL = "SELECT id, name, description, industry, location, founded_year, employee_count, revenue_range FROM companies"


# -- scans, projections ------------------------------------------------------


@query(_select(_ALL))
def scan_companies(spark, d):
    return entities(spark, d).select(*FIELDS)


@query(_select(_ALL + " WHERE id = 42"))
def point_lookup(spark, d):
    return entities(spark, d).where("id = 42").select(*FIELDS)


@query(_select(_ALL + " WHERE id IN (3, 7, 11, 99999999)"))
def multi_get(spark, d):
    wanted = spark.createDataFrame([(3,), (7,), (11,), (99999999,)], "id long")
    return entities(spark, d).join(F.broadcast(wanted), "id").select(*FIELDS)


@query(_select("SELECT id, name, description, industry, location, founded_year, employee_count, revenue_range, array_to_string(topics, '|') AS topics FROM companies"))
def project_output(spark, d):
    return flat(entities(spark, d), *FIELDS, "topics")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'b' || c_name ELSE 'c' || c_name END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS industry FROM customer""")
def alias_coalesce(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k, n = F.col("c_custkey"), F.col("c_name")
    raw = c.select(k.alias("id"), F.when(k % 3 == 0, n).alias("name"), F.when(k % 3 <= 1, F.concat(F.lit("b"), n)).alias("company_name"), F.concat(F.lit("c"), n).alias("company"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("vertical"))
    return coalesced(raw).select(F.col("id").cast("long"), "name", "industry")


@query(_select("SELECT id, array_to_string(topics, '|') AS topics, len(topics)::BIGINT AS n FROM companies"))
def enrich_topics(spark, d):
    return flat(entities(spark, d), "id", "topics").withColumn("n", F.when(F.col("topics") == "", 0).otherwise(F.size(F.split("topics", r"\|"))).cast("long"))


@query(_select("SELECT id, CASE WHEN id % 2 = 0 THEN 'Given' ELSE industry END AS industry FROM companies"))
def enrich_industry_backfill(spark, d):
    raw = customer_entities(spark, d).withColumns({"industry": F.when(F.col("id") % 2 == 0, "Given").otherwise(""), "revenue_range": F.lit(None).cast("string")})
    return ingest.enriched(raw).select("id", "industry")


@query(_select("SELECT id, name || '. ' || description || CASE WHEN len(topics) > 0 THEN ' Focus: ' || array_to_string(topics, ', ') || '.' ELSE '' END || CASE WHEN industry <> '' THEN ' Sector: ' || industry || '.' ELSE '' END AS text FROM companies"))
def embedding_text(spark, d):
    return entities(spark, d).select("id", ingest.embedding_text().alias("text"))


@query(_select("SELECT id, to_json(topics)::VARCHAR AS topics FROM companies"))
def topics_json(spark, d):
    return entities(spark, d).select("id", F.to_json("topics").alias("topics"))


# -- filters -----------------------------------------------------------------


def _filtered(f: Filters):
    return lambda spark, d: snapshot(ship(spark), d).where(f.predicate()).select(*FIELDS)


FILTERS = {
    "filter_location": (Filters(locations=("Finland", "Sweden")), "location IN ('Finland', 'Sweden')"),
    "filter_industry": (Filters(industries=("Fintech",)), "industry = 'Fintech'"),
    "filter_topics_any": (Filters(topics=("fraud detection", "payments")), "(list_contains(topics, 'fraud detection') OR list_contains(topics, 'payments'))"),
    "filter_range_inclusive": (Filters(employees=Range(50, 250)), "employee_count BETWEEN 50 AND 250"),
    "filter_range_exclusive": (Filters(founded=Range(2015, 2020, False, False)), "founded_year > 2015 AND founded_year < 2020"),
    "filter_missing_excluded": (Filters(founded=Range(0), employees=Range(None, 10**9)), "founded_year IS NOT NULL AND employee_count IS NOT NULL"),
    "filter_revenue_buckets": (Filters(revenue_buckets=("100M-500M", "50M-100M", "unheard of")), "revenue_range IN ('100M-500M', '50M-100M')"),
    "filter_exclude_ids": (Filters(exclude_ids=(1, 2, 3)), "id NOT IN (1, 2, 3)"),
    "filter_full_conjunction": (
        Filters(("Germany", "France", "UK"), ("Fintech", "Healthcare", "Retail"), ("payments", "diagnostics", "lending", "demand forecasting"), Range(2000, None), Range(None, 4000), ("10M-50M", "100M-500M", "50M-100M"), (5, 6)),
        "location IN ('Germany', 'France', 'UK') AND industry IN ('Fintech', 'Healthcare', 'Retail') AND list_has_any(topics, ['payments', 'diagnostics', 'lending', 'demand forecasting']) AND founded_year >= 2000 AND employee_count <= 4000 AND revenue_range IN ('10M-50M', '100M-500M', '50M-100M') AND id NOT IN (5, 6)",
    ),
    "filter_unknown_category": (Filters(locations=("Atlantis",)), "false"),
    "filter_explicit_override": (
        Explicit(locations=["Norway"], industries=[], founded_after=2010, min_revenue=2e7).over(parse("German fintech companies founded after 2015 with fewer than 3000 employees").filters),
        "location = 'Norway' AND founded_year >= 2010 AND employee_count < 3000 AND revenue_range IN ('10M-50M', '50M-100M', '100M-500M', '500M+')",
    ),
}
for _name, (_f, _sql) in FILTERS.items():
    QUERIES[_name] = _filtered(_f)
    ORACLES[_name] = _select(f"{_ALL} WHERE {_sql}")


@query(
    "WITH b(bucket, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {lo}::DOUBLE, {hi if hi != float('inf') else 1e300}::DOUBLE)" for b, (lo, hi) in vocab.REVENUE_BUCKETS.items()) + """),
  r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice * 100 END::DOUBLE AS qlo,
    CASE WHEN o_orderkey % 5 = 0 THEN 1e300 WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN o_totalprice * 100 WHEN o_orderkey % 11 = 0 THEN 50.0 ELSE o_totalprice * 2000 END::DOUBLE AS qhi FROM orders)
SELECT bucket, count(*) AS n, sum(id)::BIGINT AS ids FROM r JOIN b ON CASE WHEN qlo = qhi THEN lo <= qlo AND qlo < hi ELSE qlo < qhi AND lo < qhi AND qlo < hi END GROUP BY bucket"""
)
def revenue_bucket_overlap(spark, d):
    """Ranges around the orders' prices, some open, some single amounts, some empty: how many meet each bucket."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    low = F.when(k % 7 != 0, price * 100)
    high = F.when(k % 5 != 0, F.when((k % 3 == 0) & (k % 7 != 0), price * 100).when(k % 11 == 0, 50.0).otherwise(price * 2000))
    met = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), F.explode(buckets_meeting(low, high)).alias("bucket"))
    return met.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'name must not be empty'
  WHEN c_custkey % 7 = 0 THEN 'founded_year must be between 1600 and 2100' WHEN c_custkey % 5 = 0 THEN 'employee_count must be between 0 and 10000000'
  WHEN c_custkey % 3 = 0 THEN 'revenue_range must be a known bucket or an amount' END AS error FROM customer""")
def validate_rows(spark, d):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet")
    raw = c.select(
        k.alias("id"),
        F.when(k % 11 == 0, "  ").otherwise(F.col("c_name")).alias("company"),
        F.when(k % 7 == 0, "1492").otherwise("2001").alias("founded"),
        F.when(k % 5 == 0, "-3").otherwise("30").alias("staff"),
        F.when(k % 3 == 0, "much").otherwise(F.when(k % 2 == 0, "10m - 50m").otherwise("7000000")).alias("revenue"),
    )
    return ingest.validated(raw).select("id", "error")


# -- aggregates --------------------------------------------------------------


@query(_select("SELECT count(*) AS n FROM companies"))
def agg_count(spark, d):
    return customer_entities(spark, d).agg(F.count("*").alias("n"))


@query(_select("SELECT (coalesce(max(id), 0) + 1)::BIGINT AS next_id FROM companies"))
def agg_next_id(spark, d):
    return customer_entities(spark, d).agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


@query(_select("SELECT count(*) FILTER (location = 'Germany' AND employee_count > 500) AS total FROM companies"))
def exact_total(spark, d):
    f = Filters(locations=("Germany",), employees=Range(500, None, False))
    return entities(spark, d).agg(F.count_if(F.coalesce(f.predicate(), F.lit(False))).alias("total"))


@query(_select("SELECT topic, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS n FROM (SELECT id, unnest(topics) AS topic FROM companies) GROUP BY topic"))
def topic_postings(spark, d):
    each = snapshot(spark, d).select("id", F.explode("topics").alias("topic"))
    return each.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"), F.count("*").alias("n"))


@query(_select("SELECT topic, any_value(m) AS industry, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM companies) t, LATERAL (SELECT " + _INDUSTRY_MAP + "[topic] AS m) GROUP BY topic"))
def topic_industry_join(spark, d):
    names = spark.createDataFrame(list(vocab.TOPIC_INDUSTRY.items()), "topic string, industry string")
    each = snapshot(spark, d).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(names), "topic").select("topic", "industry", "n")


_PCT = ", ".join(f"list_sort(list(value))[CAST(round_even({p} / 100.0 * (count(value) - 1), 0) AS INTEGER) + 1] AS p{p}" for p in metrics.POINTS)


@query(f"SELECT event_type, count(value) AS n, max(value) AS max, round(avg(value), 6) AS mean, {_PCT} FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark, d):
    return metrics.percentiles(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 4096")
def metrics_recent_window(spark, d):
    return metrics.recent(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").select("event_id", "event_type")


@query("SELECT 'events{kind=' || event_type || ',odd=' || (user_id % 2) || '}' AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def metrics_counters(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("kind"), (F.col("user_id") % 2).alias("odd"), "value")
    return e.groupBy(metrics.counter_key("events", ["odd", "kind"]).alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type AS stage, median(value) AS median FROM events GROUP BY event_type")
def stage_median(spark, d):
    return metrics.median(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "stage"), "stage", "value")


@query("SELECT count(*) AS read, count(*) FILTER (c_custkey % 11 <> 0) AS written, count(*) FILTER (c_custkey % 11 = 0) AS invalid FROM customer")
def ingest_stats(spark, d):
    k = F.col("c_custkey")
    raw = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), F.when(k % 11 != 0, F.col("c_name")).alias("name"))
    return ingest.ingest_stats(ingest.validated(raw))


@query(_select("""SELECT count(*) FILTER (location <> 'Germany') AS location, count(*) FILTER (NOT list_has_any(topics, ['drug discovery'])) AS topic,
  count(*) FILTER (NOT (founded_year > 2018)) AS founded, count(*) FILTER (NOT (employee_count < 100)) AS employees, count(*) AS n FROM companies"""))
def constraint_violations(spark, d):
    f = parse("Show German companies founded after 2018 with fewer than 100 employees working on drug discovery.").filters
    return metrics.violations(snapshot(spark, d), f)


#: What the example questions ask for, written down by hand; bounds of numbers are inclusive.
_ASKED = """asked(q, locations, industries, topics, founded_from, founded_to, employees_from, employees_to, buckets) AS (VALUES
  (1, 'Finland', 'Fintech', 'fraud detection|banking analytics', NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, ''),
  (2, 'Germany', 'Healthcare', 'diagnostics|patient monitoring', NULL, NULL, NULL, NULL, ''),
  (3, 'Germany', 'Biotech', 'drug discovery', NULL, NULL, NULL, NULL, ''),
  (4, 'Sweden', 'Energy', 'smart grid|energy forecasting', NULL, NULL, NULL, NULL, ''),
  (5, 'USA', 'Technology', 'data pipelines|observability', NULL, NULL, NULL, NULL, ''),
  (6, 'Finland', 'Healthcare', 'diagnostics', NULL, 2004, NULL, NULL, ''),
  (7, 'UK', 'Telecom', '5g analytics', NULL, NULL, NULL, 19, ''),
  (8, 'France', 'Retail', 'pricing optimization|demand forecasting', NULL, NULL, NULL, NULL, ''),
  (9, 'UK', 'Education', 'personalized learning', NULL, NULL, NULL, NULL, ''),
  (10, 'Germany', 'Automotive', 'autonomous driving', NULL, NULL, NULL, NULL, ''),
  (11, 'Germany', 'Fintech', 'fraud detection', NULL, NULL, NULL, NULL, '500M+'),
  (12, 'Sweden', '', 'energy forecasting', NULL, NULL, 50, 250, ''),
  (13, 'Finland', 'Fintech', '', 2016, NULL, NULL, NULL, '10M-50M|50M-100M'),
  (14, 'Germany', '', 'drug discovery', 2019, NULL, NULL, 99, ''),
  (15, 'UK', 'Education', '', 2020, NULL, NULL, NULL, '0-1M|1M-10M'),
  (16, 'Germany', 'Biotech', '', 2023, NULL, 501, NULL, ''),
  (17, 'Norway', 'Retail', 'pricing optimization', NULL, NULL, NULL, NULL, '100M-500M|500M+'))"""


@query(BASE + ", " + _ASKED + f""", met AS (
  SELECT a.q, coalesce(employee_count BETWEEN coalesce(employees_from, 0) AND coalesce(employees_to, 1000000000), coalesce(employees_from, employees_to) IS NULL) AS e,
    buckets = '' OR coalesce(list_contains(string_split(buckets, '|'), revenue_range), false) AS r,
    coalesce(founded_year BETWEEN coalesce(founded_from, 0) AND coalesce(founded_to, 9999), coalesce(founded_from, founded_to) IS NULL) AS f,
    industries = '' OR list_contains(string_split(industries, '|'), industry) AS i
  FROM asked a JOIN companies c ON list_contains(string_split(a.locations, '|'), c.location) AND (a.topics = '' OR list_has_any(string_split(a.topics, '|'), c.topics))
), steps AS (
  SELECT a.q, count(*) FILTER (e AND r AND f AND i) AS s0, count(*) FILTER (r AND f AND i) AS s1, count(*) FILTER (f AND i) AS s2, count(*) FILTER (i) AS s3, count(met.q) AS s4
  FROM asked a LEFT JOIN met ON met.q = a.q GROUP BY a.q
), shown AS (SELECT s0, list_filter([s0, s1, s2, s3, s4], lambda s: s >= {rank.ENOUGH})[1] AS enough, s4 FROM steps)
SELECT count(*) AS questions, count(*) FILTER (coalesce(enough, s4) > 0) AS non_empty, count(*) FILTER (coalesce(enough, s4) > s0) AS relaxed, sum(s0)::BIGINT AS exact_matches, sum(coalesce(enough, s4))::BIGINT AS shown_matches FROM shown""")
def correctness_rollup(spark, d):
    """The example questions searched in one pass: how many find something, how many are relaxed, and their matches."""
    steps = [rank.relaxation_steps(parse(q).filters) for q in QUESTIONS]
    count = lambda f: F.count_if(F.coalesce(f.predicate(), F.lit(False)))
    per = snapshot(spark, d).agg(*[F.array(*[count(f) for _, f in s]).alias(f"q{i}") for i, s in enumerate(steps)])
    counts = per.select(F.explode(F.array(*per.columns)).alias("c"))
    shown = F.coalesce(F.get(F.filter("c", lambda n: n >= rank.ENOUGH), F.lit(0)), F.element_at("c", -1))
    each = counts.select(F.element_at("c", 1).alias("exact"), shown.alias("shown"))
    return each.agg(
        F.count("*").alias("questions"), F.count_if(F.col("shown") > 0).alias("non_empty"), F.count_if(F.col("shown") > F.col("exact")).alias("relaxed"),
        F.sum("exact").alias("exact_matches"), F.sum("shown").alias("shown_matches"),
    )


@query("WITH " + _ASKED + " SELECT q::BIGINT AS q, locations, industries, topics, founded_from, founded_to, employees_from, employees_to, buckets FROM asked")
def parse_questions(spark, d):
    """What the parser reads in each example question."""
    asked = spark.createDataFrame(list(enumerate(QUESTIONS, 1)), "q long, text string")

    def bounds(found: list[Range]) -> tuple[list, list]:
        low = [None if r.min is None else int(r.min) + (not r.min_inclusive) for r in found]
        return low, [None if r.max is None else int(r.max) - (not r.max_inclusive) for r in found]

    def run(frames):
        import pandas as pd

        for frame in frames:
            found = [parse(t).filters for t in frame["text"]]
            out = {"q": frame["q"]} | {k: ["|".join(getattr(f, k)) for f in found] for k in ("locations", "industries", "topics")}
            for k in ("founded", "employees"):
                low, high = bounds([getattr(f, k) for f in found])
                out |= {f"{k}_from": pd.array(low, dtype="Int64"), f"{k}_to": pd.array(high, dtype="Int64")}
            yield pd.DataFrame(out | {"buckets": ["|".join(f.revenue_buckets or ()) for f in found]})

    return asked.mapInPandas(run, "q long, locations string, industries string, topics string, founded_from long, founded_to long, employees_from long, employees_to long, buckets string")


# -- words -------------------------------------------------------------------


def _sql_bm25(terms: list[str], where: str = "true", name: str = "bm") -> str:
    """CTEs up to ``name`` (id, bm25), from the CTE words."""
    ps = ["  ".join(p) for p in lexical.phrases(terms)]
    f = [" + ".join(f"{w} * len(regexp_extract_all({c}, ' {p} '))" for c, w in (("wn", 2.0), ("wd", 1.0), ("wt", 4.0))) for p in ps]
    cols = ", ".join(f"({x})::DOUBLE AS f{i}" for i, x in enumerate(f))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(ps)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * nw / avgw))" for i in range(len(ps)))
    some = " + ".join(f"f{i}" for i in range(len(ps)))
    return f"""freq AS (SELECT *, (len(regexp_extract_all(wn, '[^ ]+')) + len(regexp_extract_all(wd, '[^ ]+')) + len(regexp_extract_all(wt, '[^ ]+')))::DOUBLE AS nw, {cols} FROM words),
st AS (SELECT count(*)::DOUBLE AS n, sum(nw) / count(*) AS avgw, {df} FROM freq),
{name} AS (SELECT id, round({score}, 9) AS bm25 FROM freq, st WHERE ({some}) > 0 AND ({where}))
"""


def _bm_select(terms, where, rest) -> str:
    return BASE.rstrip() + ", " + _sql_bm25(terms, where) + rest


FRAUD = ["fraud detection", "analytics"]


@query(_bm_select(FRAUD, "true", "SELECT id, round(bm25, 6) AS bm25 FROM bm"))
def keyword_bm25(spark, d):
    return lexical.bm25(snapshot(spark, d), FRAUD, F.lit(True)).select("id", F.round("bm25", 6).alias("bm25"))


@query(_bm_select([*FRAUD, "payments"], "industry = 'Fintech'", "SELECT id, round(bm25, 6) AS bm25 FROM bm"))
def keyword_index_bm25(spark, d):
    """The same scores from the inverted table."""
    e = snapshot(spark, d)
    return lexical.KeywordIndex.of(e).bm25(e, [*FRAUD, "payments"], Filters(industries=("Fintech",)).predicate()).select("id", F.round("bm25", 6).alias("bm25"))


@query(_bm_select(FRAUD, "location = 'Finland'", "SELECT id, round(bm25, 6) AS bm25 FROM bm"))
def keyword_filtered(spark, d):
    return lexical.bm25(snapshot(spark, d), FRAUD, Filters(locations=("Finland",)).predicate()).select("id", F.round("bm25", 6).alias("bm25"))


@query(_bm_select(["smart-grid", "x", "renewable energy"], "true", "SELECT id, round(bm25, 6) AS bm25 FROM bm"))
def keyword_phrase_or(spark, d):
    return lexical.bm25(snapshot(spark, d), ["smart-grid", "x", "?", "renewable energy"], F.lit(True)).select("id", F.round("bm25", 6).alias("bm25"))


@query(_bm_select(FRAUD, "true", "SELECT id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25 DESC, id LIMIT 10"))
def keyword_topk(spark, d):
    return lexical.bm25(snapshot(spark, d), FRAUD, F.lit(True)).orderBy(F.desc("bm25"), "id").limit(10).select("id", F.round("bm25", 6).alias("bm25"))


@query(_bm_select(FRAUD, "true", "SELECT id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25 DESC, id LIMIT 10"))
def keyword_topk_blocks(spark, d):
    """The same best rows from block-max postings."""
    made = blocks.BlockIndex.of(snapshot(spark, d))
    # Read three times: for shares, for the threshold, and for what can beat it.
    index = blocks.BlockIndex(stored(made.blocks, "blocks"), made.words)
    return index.top(FRAUD, 10).select("id", F.round("bm25", 6).alias("bm25"))


@query(_bm_select(FRAUD, "industry = 'Fintech'", "SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS keyword_rank FROM bm ORDER BY keyword_rank LIMIT 50"))
def keyword_rank(spark, d):
    scored = lexical.bm25(snapshot(spark, d), FRAUD, Filters(industries=("Fintech",)).predicate())
    return lexical.top_ranked(scored, "bm25", "keyword_rank", 50).select("id", "keyword_rank")


@query(_bm_select(FRAUD, "true", "SELECT n::BIGINT AS n_rows, round(avgw, 6) AS mean_words, df0, df1 FROM st"))
def bm25_stats(spark, d):
    return lexical.corpus_stats(snapshot(spark, d), lexical.phrases(FRAUD)).withColumn("mean_words", F.round("mean_words", 6))


@query(_bm_select(FRAUD, "true", "SELECT c.id, name, industry, round(bm25, 6) AS bm25 FROM bm JOIN companies c USING (id)"))
def join_keyword_hydrate(spark, d):
    e = snapshot(spark, d)
    return e.join(lexical.bm25(e, FRAUD, F.lit(True)), "id").select("id", "name", "industry", F.round("bm25", 6).alias("bm25"))


@query(_bm_select(FRAUD, "true", "SELECT id, round(bm25, 6) AS bm25 FROM bm SEMI JOIN (SELECT c_custkey + 1 AS id FROM customer WHERE c_mktsegment = 'BUILDING') USING (id)"))
def join_semi_candidates(spark, d):
    allowed = spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1).alias("id"))
    return lexical.bm25(snapshot(spark, d), FRAUD, F.lit(True)).join(allowed, "id", "left_semi").select("id", F.round("bm25", 6).alias("bm25"))


@query(_select("SELECT term, count(DISTINCT id) AS df, sum(w) AS weight FROM (SELECT id, unnest(regexp_extract_all(wn, '[^ ]+')) AS term, 2.0::DOUBLE AS w FROM words UNION ALL SELECT id, unnest(regexp_extract_all(wd, '[^ ]+')), 1.0 FROM words UNION ALL SELECT id, unnest(regexp_extract_all(wt, '[^ ]+')), 4.0 FROM words) GROUP BY term"))
def fts_postings(spark, d):
    return lexical.postings(snapshot(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum(lexical.weight_of(F.col("places"))).alias("weight"))


# -- vectors -----------------------------------------------------------------


@query(_select("SELECT id, round(list_dot_product(v, q), 6) AS cosine FROM vec, q7 ORDER BY round(list_dot_product(v, q), 9) DESC, id LIMIT 20"))
def vector_topk(spark, d):
    return vectors.cosine(entity_vectors(spark, d), seventh(spark, d)).orderBy(F.desc("cosine"), "id").limit(20).select("id", F.round("cosine", 6).alias("cosine"))


@query(_select("SELECT id, round(list_dot_product(v, q), 6) AS cosine FROM vec, q7 ORDER BY round(list_dot_product(v, q), 9) DESC, id LIMIT 20"))
def vector_topk_cells(spark, d):
    """The same best vectors, from the cells that can hold them."""
    return VectorCells.of(entity_vectors(spark, d), cell_rows=256).top(seventh(spark, d), 20).select("id", F.round("cosine", 6).alias("cosine"))


@query(_select("SELECT id, round(list_dot_product(v, q), 6) AS cosine FROM vec JOIN companies USING (id), q7 WHERE location = 'France' ORDER BY round(list_dot_product(v, q), 9) DESC, id LIMIT 20"))
def vector_topk_filtered(spark, d):
    met = snapshot(spark, d).where(Filters(locations=("France",)).predicate()).select("id").join(entity_vectors(spark, d), "id")
    return vectors.cosine(met, seventh(spark, d)).orderBy(F.desc("cosine"), "id").limit(20).select("id", F.round("cosine", 6).alias("cosine"))


@query(_select("SELECT id, row_number() OVER (ORDER BY round(list_dot_product(v, q), 9) DESC, id) - 1 AS vector_rank FROM vec, q7 ORDER BY vector_rank LIMIT 100"))
def vector_rank(spark, d):
    return lexical.top_ranked(vectors.cosine(entity_vectors(spark, d), seventh(spark, d)), "cosine", "vector_rank", 100).select("id", "vector_rank")


@query("SELECT round(avg((vec_id IS NOT NULL)::INT::DOUBLE), 9) AS coverage, count(*) AS n FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id")
def rowmap_coverage(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"))
    vecs = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.coverage(docs, vecs).withColumn("coverage", F.round("coverage", 9))


@query("SELECT vec_id, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS n FROM embeddings)")
def l2_normalize(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", l2_normalized(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


# -- fusion, relaxation, pages -----------------------------------------------

QUESTION = "Find fintech companies in Finland or Germany working on fraud detection founded after 2000."
RELAXED = "Find telecom companies in the UK working on 5G analytics with fewer than 20 employees."


def engine(spark, d) -> Engine:
    q = seventh(spark, d)
    return Engine(snapshot(spark, d), entity_vectors(spark, d), lambda text: q, check_coverage=False)


def _retrieved(spark, d, e: DataFrame, filters: Filters, terms: list[str], pool: int = 400) -> DataFrame:
    keyword = lexical.top_ranked(lexical.bm25(e, terms, filters.predicate()), "bm25", "keyword_rank", pool)
    near = vectors.cosine(vectors.matching(entity_vectors(spark, d), e, filters.predicate()), seventh(spark, d))
    return rank.fused(keyword, lexical.top_ranked(near, "cosine", "vector_rank", pool))


def _sql_fused(terms: list[str], where: str, keyword: bool = True, vector: bool = True) -> str:
    return (
        BASE.rstrip() + ", " + _sql_bm25(terms, where) + f""", kw AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS keyword_rank FROM bm ORDER BY keyword_rank LIMIT {400 if keyword else 0}),
cs AS (SELECT id, round(list_dot_product(v, q), 9) AS cosine FROM vec JOIN words USING (id), q7 WHERE {where}),
vk AS (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) - 1 AS vector_rank FROM cs ORDER BY vector_rank LIMIT {400 if vector else 0}),
fu AS (SELECT id, keyword_rank, vector_rank, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS cosine, coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS keyword_score, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS vector_score FROM kw FULL JOIN vk USING (id))
"""
    )


_GERMAN = "location = 'Germany'"


@query(_sql_fused(FRAUD, _GERMAN) + "SELECT id, keyword_rank, vector_rank, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score FROM fu")
def rrf_fusion(spark, d):
    f = _retrieved(spark, d, snapshot(spark, d), Filters(locations=("Germany",)), FRAUD)
    return f.select("id", "keyword_rank", "vector_rank", F.round("keyword_score", 6).alias("keyword_score"), F.round("vector_score", 6).alias("vector_score"))


@query(_select("SELECT id, round(2.0 * len(list_intersect(topics, ['fraud detection', 'banking analytics', 'lending'])) / 3.0 / 60, 6) AS boost FROM companies"))
def topic_boost(spark, d):
    return entities(spark, d).select("id", F.round(rank.topic_boost(("fraud detection", "banking analytics", "lending")), 6).alias("boost"))


@query(_select("SELECT id, len(list_intersect(topics, ['payments', 'lending']))::BIGINT AS shared FROM companies"))
def topic_overlap(spark, d):
    return entities(spark, d).select("id", F.size(F.array_intersect("topics", F.array(F.lit("payments"), F.lit("lending")))).cast("long").alias("shared"))


@query(_select("""SELECT id, round((CASE WHEN employee_count IS NULL THEN 0 WHEN employee_count > 20 THEN 0.05 / (1 + (employee_count - 20) / 20.0::DOUBLE) ELSE 0.05 END)
  + (CASE WHEN founded_year IS NULL THEN 0 WHEN founded_year < 2018 THEN 0.05 / (1 + (2018 - founded_year) / 10.0::DOUBLE) ELSE 0.05 END), 6) AS proximity FROM companies"""))
def relax_proximity(spark, d):
    f = Filters(employees=Range(None, 20, True, False), founded=Range(2018, None, False))
    return entities(spark, d).select("id", F.round(rank.proximity(f, ("employees", "founded")), 6).alias("proximity"))


_RELAX = "location = 'UK' AND list_has_any(topics, ['5g analytics'])"


@query(_select(f"SELECT count(*) FILTER ({_RELAX} AND industry = 'Telecom' AND employee_count < 20) AS step0, count(*) FILTER ({_RELAX} AND industry = 'Telecom') AS step1, count(*) FILTER ({_RELAX}) AS step2 FROM companies"))
def relax_counts(spark, d):
    return rank.relaxation_counts(entities(spark, d), parse(RELAXED).filters)


_TOTAL = "round(keyword_score + vector_score + topic_score + exact_bonus + proximity, 9)"


def _sql_search(terms, where, topics, bonus="0.0::DOUBLE", near="0.0::DOUBLE", keyword=True, vector=True) -> str:
    boost = f"2.0::DOUBLE * (len(list_intersect(topics, {_sql_list(topics)}))::DOUBLE / {len(topics)}) / 60" if topics else "0.0::DOUBLE"
    return _sql_fused(terms, where, keyword, vector) + f""", sc AS (SELECT c.*, fu.* EXCLUDE (id), {boost} AS topic_score, {bonus} AS exact_bonus, {near} AS proximity FROM fu JOIN companies c USING (id)),
so AS (SELECT *, {_TOTAL} AS score FROM sc)
"""


_PAGE = "ORDER BY so.score DESC, bm25 DESC, cosine DESC, id LIMIT 10"
_FRAUD_ASKED = "location IN ('Finland', 'Germany') AND industry = 'Fintech' AND list_has_any(topics, ['fraud detection']) AND founded_year > 2000"


def _page(response) -> DataFrame:
    return response.results.select("id", "name", "location", "industry", F.round("score", 6).alias("score"))


@query(_sql_search(["fraud detection"], _FRAUD_ASKED, ["fraud detection"]) + f"SELECT id, name, location, industry, round(score, 6) AS score FROM so {_PAGE}")
def hybrid_search(spark, d):
    return _page(engine(spark, d).search(Request(QUESTION, allow_relaxation=False)))


@query(_sql_search(["fraud detection"], _FRAUD_ASKED, ["fraud detection"], vector=False) + f"SELECT id, name, location, industry, round(score, 6) AS score FROM so {_PAGE}")
def mode_keyword(spark, d):
    return _page(engine(spark, d).search(Request(QUESTION, mode="keyword", allow_relaxation=False)))


@query(_sql_search(["fraud detection"], _FRAUD_ASKED, ["fraud detection"], keyword=False) + f"SELECT id, name, location, industry, round(score, 6) AS score FROM so {_PAGE}")
def mode_semantic(spark, d):
    return _page(engine(spark, d).search(Request(QUESTION, mode="semantic", allow_relaxation=False)))


@query(_sql_search(["fraud detection"], _FRAUD_ASKED, ["fraud detection"]) + f"SELECT id, array_to_string(list_filter(['topic: fraud detection', 'location: ' || location, 'industry: ' || industry, 'keyword rank ' || (keyword_rank + 1), 'semantic rank ' || (vector_rank + 1)], lambda x: x IS NOT NULL), '|') AS matched_on FROM so {_PAGE}")
def explain_matched_on(spark, d):
    return flat(engine(spark, d).search(Request(QUESTION, allow_relaxation=False)).results, "id", "matched_on")


@query(_sql_search(["fraud detection"], _FRAUD_ASKED, ["fraud detection"]) + f"SELECT id, round(keyword_score, 6) AS keyword, round(vector_score, 6) AS vector, round(topic_score, 6) AS topic, keyword_rank, vector_rank FROM so {_PAGE}")
def explain_breakdown(spark, d):
    return engine(spark, d).search(Request(QUESTION, allow_relaxation=False)).results.select("id", "score_breakdown.*")


@query(_sql_search(["payments"], "industry = 'Fintech'", ["payments"]) + "SELECT id, row_number() OVER (ORDER BY score DESC, bm25 DESC, cosine DESC, id) AS place FROM so QUALIFY place <= 50")
def fused_order(spark, d):
    e, f = snapshot(spark, d), Filters(industries=("Fintech",))
    s = rank.scored(_retrieved(spark, d, e, f, ["payments"]), e, ("payments",), f, rank.Relaxation(False, 0, 0, (), f))
    by = Window.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in rank.ORDER])
    return rank.in_order(s, 50).select("id", F.row_number().over(by).cast("long").alias("place"))


@query(_sql_search(["payments"], "industry = 'Fintech'", ["payments"]) + "SELECT id, name, round(score, 6) AS score FROM so ORDER BY so.score DESC, bm25 DESC, cosine DESC, id LIMIT 10 OFFSET 20")
def pagination(spark, d):
    e, f = snapshot(spark, d), Filters(industries=("Fintech",))
    s = rank.scored(_retrieved(spark, d, e, f, ["payments"]), e, ("payments",), f, rank.Relaxation(False, 0, 0, (), f))
    page = rank.in_order(s, 10, 20).select("id", "score")
    return e.join(F.broadcast(page), "id").select("id", "name", F.round("score", 6).alias("score"))


@query(_select("SELECT id, name FROM companies WHERE id > 30 ORDER BY id LIMIT 25"))
def keyset_page(spark, d):
    return customer_entities(spark, d).where("id > 30").orderBy("id").limit(25).select("id", "name")


@query(_sql_search(["payments"], "industry = 'Fintech'", ["payments"]) + f"SELECT id, name, description, array_to_string(topics, '|') AS topics FROM so {_PAGE}")
def hydrate_page(spark, d):
    e, f = snapshot(spark, d), Filters(industries=("Fintech",))
    s = rank.scored(_retrieved(spark, d, e, f, ["payments"]), e, ("payments",), f, rank.Relaxation(False, 0, 0, (), f))
    return flat(e.join(F.broadcast(rank.in_order(s, 10).select("id")), "id"), "id", "name", "description", "topics")


@query(_select("SELECT id, name, 0.0::DOUBLE AS score FROM companies WHERE location = 'Norway' ORDER BY id LIMIT 10"))
def filter_only_fallback(spark, d):
    return Engine(snapshot(spark, d)).search(Request("companies in Norway")).results.select("id", "name", "score")


_NEAR = "CASE WHEN employee_count IS NULL THEN 0.0 WHEN employee_count > 20 THEN 0.05::DOUBLE / (1.0::DOUBLE + (employee_count - 20.0::DOUBLE) / 20.0::DOUBLE) ELSE 0.05 END::DOUBLE"
_STRICT = f"({_RELAX} AND industry = 'Telecom' AND employee_count < 20)"


def _relaxing(spark, d):
    # The question without its industry needs a second step on small tables only; both steps are in the SQL.
    return engine(spark, d).search(Request(RELAXED))


@query(_sql_search(["5g analytics"], f"{_RELAX} AND industry = 'Telecom'", ["5g analytics"], f"CASE WHEN {_STRICT} THEN 1.0 ELSE 0.0 END::DOUBLE", _NEAR) + f"SELECT id, name, location, industry, round(score, 6) AS score FROM so {_PAGE}")
def relax_search(spark, d):
    return _page(_relaxing(spark, d))


@query(_sql_search(["5g analytics"], f"{_RELAX} AND industry = 'Telecom'", ["5g analytics"], f"CASE WHEN {_STRICT} THEN 1.0 ELSE 0.0 END::DOUBLE", _NEAR) + f"SELECT id, exact_bonus > 0 AS exact FROM so {_PAGE}")
def relax_exact_first(spark, d):
    return _relaxing(spark, d).results.select("id", F.array_contains("matched_on", "matches every requested constraint").alias("exact"))


# -- similar -----------------------------------------------------------------

_SEED = ", seed AS (SELECT c.*, v FROM companies c JOIN vec USING (id) WHERE c.id = 5)"


def _sql_similar(where: str) -> str:
    return BASE.rstrip() + _SEED + f" SELECT c.id, c.name, round(list_dot_product(vec.v, seed.v), 6) AS score FROM companies c JOIN vec ON vec.id = c.id, seed WHERE c.id <> 5 AND {where} ORDER BY round(list_dot_product(vec.v, seed.v), 9) DESC, c.id LIMIT 10"


@query(_sql_similar("true"))
def similar_vector(spark, d):
    return engine(spark, d).similar(5)[0].select("id", "name", "score")


@query(_sql_similar("c.industry = seed.industry"))
def similar_same_industry(spark, d):
    return engine(spark, d).similar(5, same_industry=True)[0].select("id", "name", "score")


@query(_select("SELECT id FROM companies WHERE id <> 5"))
def similar_excludes_seed(spark, d):
    e = entities(spark, d)
    return e.join(spark.createDataFrame([(5,)], "id long"), "id", "left_anti").select("id")


@query(_select("SELECT c.id, array_to_string(list_filter(c.topics, lambda t: list_contains(s.topics, t)), '|') AS shared FROM companies c, (SELECT topics FROM companies WHERE id = 1) s WHERE c.id <> 1 AND list_has_any(c.topics, s.topics) ORDER BY c.id LIMIT 10"))
def similar_topic_fallback(spark, d):
    page = Engine(snapshot(spark, d)).similar(1)[0]
    return page.select("id", F.array_join(F.transform("matched_on", lambda m: F.replace(m, F.lit("shared topic: "), F.lit(""))), "|").alias("shared"))


# -- scalar functions --------------------------------------------------------


@query("SELECT p_partkey AS id, " + _sql_norm("'É' || p_name || ' (Größe) +' || p_brand || '!'").replace("strip_accents(lower(", "replace(strip_accents(lower(").replace(")), '[^a-z0-9_", ")), 'ß', 'ss'), '[^a-z0-9_") + " AS text FROM part")
def text_normalize(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), normalize_col(F.concat(F.lit("É"), "p_name", F.lit(" (Größe) +"), "p_brand", F.lit("!"))).alias("text"))


@query("SELECT w, list_transform([w], lambda w: " + _sql_tokens("x").split("lambda w: ")[1][:-1] + ")[1] AS one FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]+')")
def text_singularize(spark, d):
    w = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct().where(F.col("w").rlike("^[a-z]+$"))
    return w.select("w", singular_col(F.col("w")).alias("one"))


@query(f"SELECT p_partkey AS id, array_to_string({_sql_tokens('p_name')}, '|') AS tokens FROM part")
def text_tokens(spark, d):
    return flat(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), tokens_col(F.col("p_name")).alias("tokens")), "id", "tokens")


@query(f"SELECT p_partkey AS id, {_words('p_name || p_brand')} AS words FROM part")
def fts_tokens(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), index_text(F.concat("p_name", "p_brand")).alias("words"))


@query("SELECT o_orderkey AS id, " + _BUCKET.format(x="(o_totalprice * 1000 - 1000000)") + " AS bucket FROM orders")
def revenue_bucketize(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), bucket_for_amount(F.col("o_totalprice") * 1000 - 1000000).alias("bucket"))


@query(_select("SELECT id, MAP {" + ", ".join(f"'{b}': {lo}::DOUBLE" for b, (lo, _) in vocab.REVENUE_BUCKETS.items()) + "}[revenue_range] AS lo, CASE WHEN revenue_range IS NOT NULL THEN least(MAP {" + ", ".join(f"'{b}': {hi if hi != float('inf') else 1e18}::DOUBLE" for b, (_, hi) in vocab.REVENUE_BUCKETS.items()) + "}[revenue_range], 1e18) END AS hi FROM companies"))
def revenue_bounds(spark, d):
    e = entities(spark, d)
    return e.select("id", revenue_min(F.col("revenue_range")).alias("lo"), F.when(F.col("revenue_range").isNotNull(), F.least(revenue_max(F.col("revenue_range")), F.lit(1e18))).alias("hi"))


@query("SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 5 WHEN 0 THEN 'Germany' WHEN 1 THEN 'USA' WHEN 2 THEN 'UK' WHEN 3 THEN n_name ELSE 'Netherlands' END AS location FROM nation")
def canonicalize_location(spark, d):
    k = F.col("n_nationkey")
    spelt = F.when(k % 5 == 0, "GERMAN").when(k % 5 == 1, "u.s.a").when(k % 5 == 2, "Great  Britain").when(k % 5 == 4, "the Netherlands").otherwise(F.col("n_name"))
    return spark.read.parquet(f"{d}/nation.parquet").select(k.cast("long").alias("id"), canonical(spelt, vocab.LOCATION_NAMES).alias("location"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '10M-50M' WHEN c_acctbal >= 0 THEN " + _BUCKET.format(x="(c_acctbal * 60000)") + " END AS revenue_range FROM customer")
def revenue_coerce(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey is not null")
    raw = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, " 10m-50M ").otherwise((F.col("c_acctbal") * 60000).cast("string")).alias("revenue"))
    return ingest.validated(raw).select("id", "revenue_range")


_ALIASES = [(t, p) for t, ps in vocab.TOPIC_PHRASES.items() for p in ps]


@query(
    BASE + ", aliases AS (SELECT topic, " + _sql_tokens("phrase") + " AS w FROM (VALUES " + ", ".join(f"('{t}', '{p.replace(chr(39), chr(39) * 2)}')" for t, p in _ALIASES) + ") v(topic, phrase)), "
    "heads AS (SELECT DISTINCT " + _sql_tokens("string_split(description, ' for ')[1]") + " AS t FROM companies), "
    "starts AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM heads), runs AS (SELECT DISTINCT t[i:j] AS w FROM (SELECT t, i, unnest(range(i, len(t) + 1)) AS j FROM starts)) "
    "SELECT topic, count(*) AS n_phrases, count(r.w) AS n_noisy, (SELECT count(*) FROM runs) AS n_runs FROM aliases a LEFT JOIN runs r ON r.w = a.w GROUP BY topic"
)
def alias_noise_audit(spark, d):
    """Each topic's phrases, and how many are word runs of the descriptions' openings, which would fire on any description."""
    aliases = spark.createDataFrame(_ALIASES, "topic string, phrase string").select("topic", tokens_col(F.col("phrase")).alias("w"))
    opening = F.get(F.split("description", " for "), F.lit(0))
    heads = customer_entities(spark, d).select(tokens_col(opening).alias("t")).distinct()
    starts = heads.select("t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i"))
    runs = starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("i") + 1), lambda n: F.slice("t", F.col("i"), n))).alias("w")).distinct()
    per = aliases.join(runs.withColumn("_run", F.lit(True)), "w", "left").groupBy("topic").agg(F.count("*").alias("n_phrases"), F.count("_run").alias("n_noisy"))
    return per.crossJoin(F.broadcast(runs.agg(F.count("*").alias("n_runs"))))  # one row


@query()
def parse_batch(spark, d):
    """Each benchmark text as a question: what the parser reads in it."""
    questions = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")

    def run(frames):
        import pandas as pd

        from entitylens.plans.nlq import parse

        for f in frames:
            found = [parse(t or "") for t in f["text"]]
            yield pd.DataFrame({"item_id": f["item_id"], "terms": ["|".join(p.text_terms) for p in found], "notes": ["|".join(p.notes) for p in found]})

    return questions.mapInPandas(run, "item_id long, terms string, notes string")


# -- bitmap index and many questions at once ------------------------------------


@query(_select("SELECT count(*) FILTER (location = 'Germany' AND employee_count > 500) AS total FROM companies"))
def bitmap_total(spark, d):
    """An exact total from the bitmap index alone: OR of intervals, AND of constraints, a count of bits."""
    a = bitmaps.asked(Filters(locations=("Germany",), employees=Range(500, None, False)))
    keys = spark.createDataFrame([(0, *k) for k in a.keys], "q int, field string, value string, until int")
    return bitmaps.step_counts(keys, bitmaps.bitmap_index(snapshot(spark, d)), "q").where("step = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


@query(_select("SELECT f.field, f.value, count(DISTINCT id) AS n FROM (SELECT id, unnest([{'field': 'location', 'value': location}, {'field': 'industry', 'value': industry}, {'field': 'revenue', 'value': revenue_range}] || list_transform(topics, lambda t: {'field': 'topic', 'value': t})) AS f FROM companies) WHERE f.value IS NOT NULL GROUP BY f.field, f.value"))
def bitmap_values(spark, d):
    """The rows of each value, added up over the index's blocks."""
    index = bitmaps.bitmap_index(snapshot(spark, d)).where(F.col("field").isin("location", "industry", "revenue", "topic"))
    return index.groupBy("field", "value").agg(F.sum(F.coalesce(F.bitmap_count("bits"), F.size("places").cast("long"))).alias("n"))


@query(_select("SELECT count(*) FILTER (NOT list_contains(topics, 'fraud detection')) AS without, count(*) AS n FROM companies"))
def bitmap_not(spark, d):
    """Rows without a topic: the complement of its blocks, met with the set of all rows."""
    # Read twice: for all rows, and for the topic's.
    index = stored(bitmaps.bitmap_index(snapshot(spark, d)), "bitmaps")
    asked = spark.createDataFrame([(0, bitmaps.ALL, ""), (1, "topic", "fraud detection")], "s int, field string, value string")
    sets = bitmaps.any_of(asked, index, ["s"])
    every, held = (sets.where(F.col("s") == s).select("layer", "block", F.col("bits").alias(f"bits{s}")) for s in (0, 1))
    both = every.join(held, ["layer", "block"], "left").withColumn("bits", F.explode(F.filter(F.array("bits0", bitmaps.complement(F.col("bits1"))), lambda b: b.isNotNull())))
    rest = both.groupBy("layer", "block").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("without"), F.bitmap_count(F.first("bits0")).alias("n"))
    return rest.agg(F.sum("without").alias("without"), F.sum("n").alias("n"))


def asked_of_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """A question for each benchmark row: an example question, and the row's own words behind it."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    example = F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("item_id") % len(QUESTIONS)).cast("int"))
    return items.select(F.col("item_id").alias("q"), F.concat_ws(" ", example, "text").alias("text"))


_BATCH_PHRASES = ", ".join(f"({q}, {i}, '{'  '.join(p)}')" for q, text in enumerate(QUESTIONS, 1) for i, p in enumerate(lexical.phrases(parse(text).lexical_terms())))
_BOUNDS = ", ".join("(" + ", ".join([str(q)] + ["NULL::DOUBLE" if x is None else f"{x}::DOUBLE" for x in (f.employees.min, f.employees.max, f.founded.min, f.founded.max)]) + ")" for q, f in ((q, parse(t).filters) for q, t in enumerate(QUESTIONS, 1)))


#: Words of the rows that name a place.
_PLACES = ", ".join(f"('{w[0]}', '{name}')" for w, name in vocab.LOCATION_TABLE.items() if len(w) == 1)


def _far(c: str, low: str, high: str, scale: str | None) -> str:
    unit = lambda b: f"{scale}::DOUBLE" if scale else f"greatest(abs({b}), 1.0::DOUBLE)"
    return f"CASE WHEN {c} IS NULL THEN 0.0::DOUBLE ELSE 0.05::DOUBLE / (1.0::DOUBLE + CASE WHEN {high} IS NOT NULL AND {c} > {high} THEN ({c} - {high}) / {unit(high)} WHEN {low} IS NOT NULL AND {c} < {low} THEN ({low} - {c}) / {unit(low)} ELSE 0.0::DOUBLE END) END"


@query(BASE + ", " + _ASKED + f""", phr(q, i, p) AS (VALUES {_BATCH_PHRASES}), bound(q, e0, e1, f0, f1) AS (VALUES {_BOUNDS}), place(word, location) AS (VALUES {_PLACES}),
spoken AS (SELECT item_id, list(DISTINCT location) AS more FROM (SELECT item_id, unnest({_sql_tokens("text")}) AS word FROM benchmark) JOIN place USING (word) GROUP BY item_id),
item AS (SELECT b.item_id, asked.*, string_split(asked.locations, '|') || coalesce(more, []) AS places FROM benchmark b JOIN asked ON asked.q = b.item_id % {len(QUESTIONS)} + 1 LEFT JOIN spoken USING (item_id)),
met AS (
  SELECT a.item_id, a.q, c.*, coalesce(employee_count BETWEEN coalesce(employees_from, 0) AND coalesce(employees_to, 1000000000), coalesce(employees_from, employees_to) IS NULL) AS e,
    buckets = '' OR coalesce(list_contains(string_split(buckets, '|'), revenue_range), false) AS r,
    coalesce(founded_year BETWEEN coalesce(founded_from, 0) AND coalesce(founded_to, 9999), coalesce(founded_from, founded_to) IS NULL) AS f,
    a.industries = '' OR list_contains(string_split(a.industries, '|'), industry) AS i,
    CASE WHEN a.topics = '' THEN [] ELSE string_split(a.topics, '|') END AS want, coalesce(employees_from, employees_to) IS NOT NULL AS by_e, coalesce(founded_from, founded_to) IS NOT NULL AS by_f
  FROM item a JOIN companies c ON list_contains(a.places, c.location) AND (a.topics = '' OR list_has_any(string_split(a.topics, '|'), c.topics))
), steps AS (
  SELECT a.item_id, [count(*) FILTER (e AND r AND f AND i), count(*) FILTER (r AND f AND i), count(*) FILTER (f AND i), count(*) FILTER (i), count(met.q)] AS s FROM item a LEFT JOIN met USING (item_id) GROUP BY a.item_id
), chosen AS (
  SELECT item_id, s[1] AS strict_count, CASE WHEN s[lvl] > s[1] THEN s[lvl] ELSE s[1] END AS shown_count, CASE WHEN s[lvl] > s[1] THEN lvl - 1 ELSE 0 END AS lvl
  FROM (SELECT item_id, s, coalesce(list_filter(range(1, 6), lambda k: s[k] >= {rank.ENOUGH})[1], 5) AS lvl FROM steps)
), size AS (SELECT *, (len(regexp_extract_all(wn, '[^ ]+')) + len(regexp_extract_all(wd, '[^ ]+')) + len(regexp_extract_all(wt, '[^ ]+')))::DOUBLE AS nw FROM words
), st AS (SELECT count(*)::DOUBLE AS n, sum(nw) / count(*) AS avgw FROM size),
freq AS (SELECT p, id, nw, (2.0 * len(regexp_extract_all(wn, ' ' || p || ' ')) + 1.0 * len(regexp_extract_all(wd, ' ' || p || ' ')) + 4.0 * len(regexp_extract_all(wt, ' ' || p || ' ')))::DOUBLE AS f FROM (SELECT DISTINCT p FROM phr), size),
df AS (SELECT p, count(*)::DOUBLE AS df FROM freq WHERE f > 0 GROUP BY p),
part AS (SELECT p, id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * nw / avgw)) AS part FROM freq JOIN df USING (p), st WHERE f > 0),
bm AS (SELECT q, id, round(list_sum(list(part ORDER BY i)), 9) AS bm25 FROM phr JOIN part USING (p) GROUP BY q, id),
ranked AS (
  SELECT m.*, c.lvl, bm25, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, id) - 1 AS kr FROM met m JOIN chosen c USING (item_id) JOIN bm USING (q, id)
  WHERE (e OR lvl >= 1) AND (r OR lvl >= 2) AND (f OR lvl >= 3) AND (i OR lvl >= 4)
), so AS (
  SELECT item_id, id, bm25, round(1.0::DOUBLE / (60 + kr) + CASE WHEN len(want) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (len(list_intersect(want, topics))::DOUBLE / len(want)) / 60 END + CASE WHEN lvl > 0 AND e AND r AND f AND i THEN 1.0 ELSE 0.0 END::DOUBLE
    + CASE WHEN lvl >= 1 AND by_e THEN {_far("employee_count", "e0", "e1", None)} ELSE 0.0::DOUBLE END + CASE WHEN lvl >= 3 AND by_f THEN {_far("founded_year", "f0", "f1", "10.0")} ELSE 0.0::DOUBLE END, 9) AS score
  FROM ranked JOIN bound USING (q) WHERE kr < 400
), page AS (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY so.score DESC, bm25 DESC, id) AS place FROM so QUALIFY place <= 10)
SELECT item_id, strict_count, shown_count, place::INTEGER AS place, id, round(score, 6) AS score
FROM chosen LEFT JOIN page USING (item_id)""")
def batch_search(spark, d):
    """Each benchmark row's question answered in one plan, with its counts; one without results has one row."""
    # Kept, as the plan reads them several times; a store has all three as files.
    e = snapshot(spark, d)
    words = lexical.KeywordIndex.of(e)
    index = lexical.KeywordIndex(stored(words.postings, "postings"), words.n_rows, words.mean_words)
    found = batch.search(asked_of_benchmark(spark, d), e, index, stored(bitmaps.bitmap_index(e), "bitmaps"), mode="keyword")
    counts = found.questions.select(F.col("q").alias("item_id"), "strict_count", F.col("count").alias("shown_count"))
    page = found.results.select(F.col("q").alias("item_id"), "place", "id", F.round("score", 6).alias("score"))
    return counts.join(page, "item_id", "left").select("item_id", "strict_count", "shown_count", "place", "id", "score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies working on fraud detection, the best ten by words."""
    asked = parse("companies working on fraud detection")
    e = snapshot(ship(spark), sf_dir)
    found = lexical.bm25(e, asked.lexical_terms(), asked.filters.predicate())
    best = found.orderBy(F.desc("bm25"), "id").limit(10)
    return e.join(F.broadcast(best), "id").select("id", "name", "description", "location", "bm25").orderBy(F.desc("bm25"), "id")
