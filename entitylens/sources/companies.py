"""Readers of entity records, and the view of the customer table as entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylens.functions import vocab

#: Field -> accepted names, the first that is present counts.
ALIASES = {
    "name": ["name", "company_name", "company"],
    "description": ["description", "summary", "about", "overview"],
    "industry": ["industry", "sector", "vertical"],
    "location": ["location", "country", "hq", "headquarters"],
    "founded_year": ["founded_year", "founded", "year_founded", "founding_year"],
    "employee_count": ["employee_count", "employees", "headcount", "staff"],
    "revenue_range": ["revenue_range", "revenue", "revenue_band", "turnover"],
}
CORRUPT = "_corrupt"
RAW_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(n, T.StringType()) for names in ALIASES.values() for n in names]
    + [T.StructField(CORRUPT, T.StringType())]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array (.json) or JSON lines (.jsonl); every field as text.

    JSON lines are split among tasks; a line that can't be read keeps its text in
    ``_corrupt`` and is counted as invalid later. An array is one document, which a
    task reads as a stream; a malformed one fails the load.
    """
    reader = spark.read.schema(RAW_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT)
    if path.endswith(".jsonl"):
        return reader.option("mode", "PERMISSIVE").json(path)
    return reader.option("multiLine", True).option("mode", "FAILFAST").json(path)


def coalesced(raw: DataFrame) -> DataFrame:
    """id and one column for each field, from the first of its names that holds a value."""
    have = set(raw.columns)
    fields = []
    for name, names in ALIASES.items():
        present = [F.col(n).cast("string") for n in names if n in have]
        fields.append((F.coalesce(*present) if present else F.lit(None).cast("string")).alias(name))
    kept = [F.col("id").cast("string").alias("id") if "id" in have else F.lit(None).cast("string").alias("id")]
    kept += [F.col(c) for c in (CORRUPT, "_seq") if c in have]
    return raw.select(*kept, *fields)


def customer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table as raw entities: one synthetic company for each customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    topic = lambda i: pick(vocab.TOPICS, i % len(vocab.TOPICS))
    second = F.when(k % 50 == 0, F.concat(F.lit(" and "), topic(k + 1))).otherwise("")
    text = F.concat(pick(vocab.HEAD_MODIFIERS, k % 8), F.lit(" "), pick(vocab.HEAD_NOUNS, k % 6), F.lit(" for "), topic(k), second, F.lit("."))
    return c.select(
        (k + 1).alias("id"),
        F.col("c_name").alias("name"),
        text.alias("description"),
        F.lit("").alias("industry"),
        pick(vocab.LOCATIONS, F.col("c_nationkey") % 8).alias("location"),
        F.when(k % 41 != 0, (1995 + (7 * k) % 30).cast("int")).alias("founded_year"),
        F.when(k % 43 != 0, 5 + (7919 * k) % 4996).alias("employee_count"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") * 60000).alias("revenue_amount"),
    )
