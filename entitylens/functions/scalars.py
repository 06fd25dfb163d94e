"""Scalar functions of the entity model, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from entitylens.functions.text import normalize_col
from entitylens.functions.vocab import REVENUE_BUCKETS


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def bucket_for_amount(amount: Column) -> Column:
    """The bucket that holds an amount; negative, missing and NaN amounts have none."""
    steps = [F.when((amount >= lo) & ((amount < hi) if hi != float("inf") else F.lit(True)), b) for b, (lo, hi) in REVENUE_BUCKETS.items()]
    return F.when(amount.isNull() | F.isnan(amount) | (amount < 0), F.lit(None).cast("string")).otherwise(F.coalesce(*steps))


def bucket_label(label: Column) -> Column:
    """The bucket named by a label in any spacing and case; null if there is none."""
    squashed = F.upper(F.replace(label, F.lit(" "), F.lit("")))
    return F.try_element_at(literal_map({b.upper(): b for b in REVENUE_BUCKETS}), squashed)


def buckets_meeting(low: Column, high: Column) -> Column:
    """The buckets that meet [low, high), null being open; a single amount meets the bucket that holds it."""
    lo, hi = F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(float("inf")))
    one = lambda b0, b1: F.when(lo == hi, (lo >= b0) & (lo < b1)).otherwise((lo < hi) & (hi > b0) & (lo < b1))
    return F.array_compact(F.array(*[F.when(one(b0, b1), F.lit(b)) for b, (b0, b1) in REVENUE_BUCKETS.items()]))


def revenue_min(bucket: Column) -> Column:
    return F.try_element_at(literal_map({b: lo for b, (lo, _) in REVENUE_BUCKETS.items()}), bucket)


def revenue_max(bucket: Column) -> Column:
    return F.try_element_at(literal_map({b: hi for b, (_, hi) in REVENUE_BUCKETS.items()}), bucket)


def canonical(value: Column, names: dict[str, str]) -> Column:
    """The canonical spelling of a known name, else the value as it is."""
    return F.coalesce(F.try_element_at(literal_map(names), normalize_col(value)), value)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, from the first component to the last."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
