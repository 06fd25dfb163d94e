"""From raw records to enriched ones: validate, canonicalise, enrich, number, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylens.functions import vocab
from entitylens.functions.scalars import bucket_for_amount, bucket_label, canonical, literal_map, revenue_max, revenue_min
from entitylens.functions.text import found_names, index_text, tokens_col
from entitylens.sources.companies import ALIASES, CORRUPT, coalesced

# Limits of a record's fields.
NAME_CHARS, DESCRIPTION_CHARS, YEARS, EMPLOYEES = 512, 8000, (1600, 2100), (0, 10_000_000)


def revenue_field(have: list[str]) -> Column:
    """The first name's value, unless one of the numeric-capable names holds a number: that is bucketed first."""
    amounts = [F.col(n).cast("string").try_cast("double") for n in ("revenue_range", "revenue", "turnover") if n in have]
    texts = [F.col(n).cast("string") for n in ALIASES["revenue_range"] if n in have]
    amount = F.coalesce(*amounts) if amounts else F.lit(None).cast("double")
    return F.when(amount.isNotNull(), F.coalesce(bucket_for_amount(amount), F.lit("?"))).otherwise(F.coalesce(*texts) if texts else F.lit(None).cast("string"))


def validated(raw: DataFrame) -> DataFrame:
    """Typed fields and ``error`` (null if the record is valid). Nothing is thrown and no row is lost."""
    with_revenue = raw.withColumn("revenue_range", revenue_field(raw.columns)).drop(*[n for n in ALIASES["revenue_range"][1:]])
    r = coalesced(with_revenue)
    name = F.trim(F.coalesce("name", F.lit("")))
    text = F.trim(F.coalesce("description", F.lit("")))
    year, staff, key = F.col("founded_year").try_cast("int"), F.col("employee_count").try_cast("long"), F.col("id").try_cast("long")
    bad_number = lambda c, v: F.col(c).isNotNull() & v.isNull()
    label = F.nullif(F.trim("revenue_range"), F.lit(""))
    checks = [
        (F.col(CORRUPT).isNotNull() if CORRUPT in r.columns else F.lit(False), "record can't be read"),
        (bad_number("id", key), "id must be a whole number"),
        (name == "", "name must not be empty"),
        (F.char_length(name) > NAME_CHARS, f"name must have at most {NAME_CHARS} characters"),
        (F.char_length(text) > DESCRIPTION_CHARS, f"description must have at most {DESCRIPTION_CHARS} characters"),
        (bad_number("founded_year", year) | ~year.between(*YEARS), f"founded_year must be between {YEARS[0]} and {YEARS[1]}"),
        (bad_number("employee_count", staff) | ~staff.between(*EMPLOYEES), f"employee_count must be between {EMPLOYEES[0]} and {EMPLOYEES[1]}"),
        (label.isNotNull() & bucket_label(label).isNull(), "revenue_range must be a known bucket or an amount"),
    ]
    error = F.coalesce(*[F.when(cond, F.lit(message)) for cond, message in checks])
    return r.select(
        key.alias("id"),
        *[c for c in ("_seq",) if c in r.columns],
        name.alias("name"),
        text.alias("description"),
        canonical(F.trim(F.coalesce("industry", F.lit(""))), vocab.INDUSTRY_NAMES).alias("industry"),
        canonical(F.trim(F.coalesce("location", F.lit(""))), vocab.LOCATION_NAMES).alias("location"),
        year.alias("founded_year"),
        staff.alias("employee_count"),
        bucket_label(label).alias("revenue_range"),
        error.alias("error"),
    )


def enriched(records: DataFrame) -> DataFrame:
    """Adds topics, a missing industry (the first topic's), revenue bounds and the index's words."""
    about = F.concat_ws(". ", "name", "description")
    known = records.withColumn("topics", found_names(tokens_col(about), vocab.TOPIC_TABLE))
    first = F.try_element_at(literal_map(vocab.TOPIC_INDUSTRY), F.get("topics", F.lit(0)))
    return known.withColumns({
        "industry": F.when(F.coalesce("industry", F.lit("")) == "", F.coalesce(first, F.lit(""))).otherwise(F.col("industry")),
        "revenue_min": revenue_min(F.col("revenue_range")),
        "revenue_max": revenue_max(F.col("revenue_range")),
    })


def embedding_text() -> Column:
    """What is embedded: name and description, topics, sector; empty parts are left out."""
    return F.concat_ws(
        " ",
        F.when(F.col("name") != "", F.concat("name", F.lit("."))),
        F.nullif("description", F.lit("")),
        F.when(F.size("topics") > 0, F.concat(F.lit("Focus: "), F.array_join("topics", ", "), F.lit("."))),
        F.when(F.col("industry") != "", F.concat(F.lit("Sector: "), F.col("industry"), F.lit("."))),
    )


def indexed(records: DataFrame) -> DataFrame:
    """Adds the spaced words of the three searched fields and their number."""
    words = {"w_name": index_text(F.col("name")), "w_description": index_text(F.col("description")), "w_topics": index_text(F.array_join("topics", " "))}
    count = sum((F.regexp_count(c, F.lit("[^ ]+")) for c in words), F.lit(0))
    return records.withColumns(words).withColumn("n_words", count)


def numbered(new: DataFrame, highest: int) -> DataFrame:
    """Gives ids to rows without one, in the order of _seq: one more than the highest id before.

    An explicit id pushes the counter up. With the missing ids counted up to a row,
    an id given there is that count plus the greatest (explicit id - count) so far:
    two prefix functions. They run inside the input partitions (the upper bits of
    _seq, as monotonically_increasing_id sets them), then over one row for each.
    """
    rows = new.withColumn("_part", F.shiftright("_seq", 33))
    run = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("_missing", F.count_if(F.col("id").isNull()).over(run)).withColumn("_above", F.col("id") - F.col("_missing"))
    parts = counted.groupBy("_part").agg(F.max("_missing").alias("m"), F.max("_above").alias("b"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_m", F.coalesce(F.sum("m").over(before), F.lit(0)))
    starts = placed.select("_part", "_m", F.coalesce(F.max(F.col("b") - F.col("_m")).over(before), F.lit(highest)).alias("_b"))
    met = counted.join(starts, "_part")
    count = F.col("_m") + F.col("_missing")
    base = F.greatest(F.lit(highest), F.col("_b"), F.max("_above").over(run) - F.col("_m"))
    return met.withColumn("id", F.coalesce("id", base + count)).drop("_part", "_missing", "_above", "_m", "_b")


def latest(new: DataFrame) -> DataFrame:
    """Of rows with one id the last by _seq."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_seq")))
    return new.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_seq")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's rows in place of those with their ids."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def ingest_stats(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("read"), F.count_if(F.col("error").isNull()).alias("written"), F.count_if(F.col("error").isNotNull()).alias("invalid"))
