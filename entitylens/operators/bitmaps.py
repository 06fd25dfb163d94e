"""A compressed bitmap index: the ids of each value of a field, in blocks.

A row holds the ids of one (field, value) in one block of 32,768 ids: a sorted array of
places if they are few, else the block's bits. Sets are combined by aggregates of Spark
itself: OR over the values of a constraint, AND over constraints, NOT by a complement of
the digits, and a count of bits. A value with any share of the rows is many rows, one for
each block, so nothing is hot.

Numbers are indexed by intervals: a value lies in one interval of each width 1, 16, 256
and so on, and a range of numbers is a union of few of them, so a range is a list of
values like any other and meets the index by an equi-join. Numbers are whole and from 0 to
16**6 - 1, as validation has it (years, head counts); null ones are in no range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylens.operators.filters import RELAXABLE, Filters, Range

#: Places in a block up to which an array of them is stored; a block's bits have 4 kB.
SPARSE = 1024
BLOCK = 32_768
FAN, WIDTHS = 16, 6
LISTS = {"location": "location", "industry": "industry", "revenue": "revenue_range"}
NUMBERS = {"founded": "founded_year", "employees": "employee_count"}
#: Every id; all sets are met with it, so that it alone says which rows count.
ALL = "all"


def interval_keys(r: Range) -> list[str]:
    """The intervals whose union is a range of whole numbers."""
    low = 0 if r.min is None else int(np.floor(r.min)) + (0 if r.min_inclusive and float(r.min).is_integer() else 1)
    high = FAN**WIDTHS - 1 if r.max is None else int(np.ceil(r.max)) - (0 if r.max_inclusive and float(r.max).is_integer() else 1)
    low, high, out = max(low, 0), min(high, FAN**WIDTHS - 1), []
    for width in range(WIDTHS):
        last = width == WIDTHS - 1
        while low <= high and (last or low % FAN):
            out.append(f"{width}:{low}")
            low += 1
        while low <= high and high % FAN != FAN - 1:
            out.append(f"{width}:{high}")
            high -= 1
        low, high = low // FAN, (high + 1) // FAN - 1
    return out


def _values(rows: pa.Table) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """What a block's rows are indexed by: for each field its values, and for each entry its value's number and its row."""
    every = np.arange(rows.num_rows)
    yield ALL, pa.array(["" for _ in every[:1]], pa.string()), every * 0, every
    column = lambda c: rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0)
    coded = lambda x: (x.dictionary, np.asarray(x.indices, dtype=np.int64))
    for field, c in LISTS.items():
        held = column(c)
        yield field, *coded(held.drop_null().dictionary_encode()), every[np.asarray(held.is_valid())]
    topics = column("topics")
    yield "topic", *coded(pc.list_flatten(topics).dictionary_encode("encode")), np.asarray(pc.list_parent_indices(topics), dtype=np.int64)
    for field, c in NUMBERS.items():
        held = column(c)
        numbers = np.asarray(held.drop_null(), dtype=np.int64)
        for w in range(WIDTHS):
            found, code = np.unique(numbers >> 4 * w, return_inverse=True)
            yield field, pa.array([f"{w}:{v}" for v in found.tolist()], pa.string()), code, every[np.asarray(held.is_valid())]


_HELD = "block long, held array<struct<field:string,value:string,n:int,places:array<bigint>,bits:binary>>"


def _block_entries(sparse: int):
    """A function of one block's rows: its values with their places or bits, in a row for each field (numbers: and width)."""

    def made(rows: pa.Table) -> pa.Table:
        place, held = np.asarray(rows["place"].combine_chunks(), dtype=np.int64), []
        for field, values, code, row in _values(rows):
            code, at = np.divmod(np.unique(code * BLOCK + place[row]), BLOCK)
            n = np.bincount(code, minlength=len(values))
            few = n <= sparse
            ends = np.cumsum(np.where(few, n, 0))
            # A value without an array of places has a null offset.
            offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(~few, False))
            bits = [None] * len(values)
            for v in np.flatnonzero(~few):
                own = np.zeros(BLOCK, bool)
                own[at[slice(*np.searchsorted(code, [v, v + 1]))]] = True
                bits[v] = np.packbits(own, bitorder="little").tobytes()
            places = pa.ListArray.from_arrays(offsets, pa.array(at[few[code]], pa.int64()))
            each = [pa.array([field] * len(values), pa.string()), values.cast(pa.string()), pa.array(n, pa.int32()), places, pa.array(bits, pa.binary())]
            held.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.StructArray.from_arrays(each, ["field", "value", "n", "places", "bits"])))
        block = pa.array([rows["block"][0].as_py()] * len(held), pa.int64())
        return pa.table({"block": block, "held": pa.concat_arrays(held)})

    return made


def bitmap_index(entities: DataFrame) -> DataFrame:
    """field, value, layer, block, n, places (if few) or bits."""
    # Rows meet by block before they become entries, so neither entries nor bits are shuffled.
    rows = entities.select("topics", *LISTS.values(), *NUMBERS.values(), F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id").alias("place"))
    held = rows.groupBy("block").applyInArrow(_block_entries(SPARSE), _HELD).select("block", F.inline("held"))
    return held.select("field", "value", F.lit(0).alias("layer"), "block", "n", "places", "bits")


def complement(bits: Column) -> Column:
    """All bits turned over, as digits of four bits."""
    return F.unhex(F.translate(F.hex(bits), "0123456789ABCDEF", "FEDCBA9876543210"))


def any_of(keys: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """by, layer, block, bits: the ids that hold one of the values asked for; keys: by, field, value."""
    met = keys.join(index, ["field", "value"]).select(*by, "layer", "block", "places", "bits")
    at = [*by, "layer", "block"]
    dense = met.where("bits is not null").select(*at, "bits")
    sparse = met.where("bits is null").select(*at, F.explode("places").alias("place")).groupBy(*at).agg(F.bitmap_construct_agg("place").alias("bits"))
    return dense.unionByName(sparse).groupBy(*at).agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(sets: DataFrame, by: list[str], needed: str) -> DataFrame:
    """by, layer, block, bits: the ids in all sets of each; needed: a column with how many sets there must be."""
    at = [*by, "layer", "block"]
    met = sets.groupBy(*at).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_c"), F.max(needed).alias("_m"))
    return met.where("_c = _m").select(*at, "bits").where(F.bitmap_count("bits") > 0)


def layered(layers: list[DataFrame], touched: list[DataFrame]) -> DataFrame:
    """The index of several layers of rows: a row counts if no later layer touched its id.

    touched: for each layer but the first, the ids it touched. Only the set of all ids
    of a layer changes, as every other is met with it.
    """
    rows, out = [d.withColumn("layer", F.lit(k)) for k, d in enumerate(layers)], None
    if not touched:
        return rows[0]
    for k, d in enumerate(rows):
        if k < len(touched):
            later = touched[k]
            for more in touched[k + 1 :]:
                later = later.unionByName(more)
            gone = later.groupBy(F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("_gone"))
            every = any_of(d.where(F.col("field") == ALL).select("field", "value").distinct(), d.where(F.col("field") == ALL), ["field", "value"])
            both = every.join(gone, "block", "left")
            kept = both.where("_gone is null").select("field", "value", "layer", "block", "bits")
            cut = both.where("_gone is not null").select("field", "value", "layer", "block", F.explode(F.array("bits", complement(F.col("_gone")))).alias("bits"))
            cut = cut.groupBy("field", "value", "layer", "block").agg(F.bitmap_and_agg("bits").alias("bits"))
            every = kept.unionByName(cut).select("field", "value", "layer", "block", F.bitmap_count("bits").cast("int").alias("n"), F.lit(None).cast("array<int>").alias("places"), "bits")
            d = d.where(F.col("field") != ALL).unionByName(every)
        out = d if out is None else out.unionByName(d)
    return out


# -- constraints ---------------------------------------------------------------


@dataclass(frozen=True)
class Asked:
    """What filters ask of the index. until: at how many relaxation steps, from the first, a field's constraint holds."""

    keys: list[tuple[str, str, int]]
    steps: int
    gives_up: tuple[str, ...]


def asked(filters: Filters) -> Asked:
    """Each active constraint as values of its field; one that nothing can match has a value that no row holds."""
    gives_up = tuple(n for n in RELAXABLE if n in filters.active())
    steps = len(gives_up) + 1
    held = {"location": filters.locations, "industry": filters.industries, "topic": filters.topics, "revenue": filters.revenue_buckets or ()}
    held |= {n: interval_keys(r) or ["none"] for n, r in (("founded", filters.founded), ("employees", filters.employees)) if r}
    until = {n: gives_up.index(n) + 1 if n in gives_up else steps for n in held}
    keys = [(ALL, "", steps), *((n, v, until[n]) for n, values in held.items() if n in filters.active() for v in dict.fromkeys(values))]
    return Asked(keys, steps, gives_up)


def step_sets(keys: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """by, step, layer, block, bits: the ids that match at each relaxation step; keys: by, field, value, until."""
    fields = keys.groupBy(by, "field").agg(F.max("until").alias("until"))
    every = F.explode(F.sequence(F.lit(0), F.col("until") - 1)).alias("step")
    needed = fields.select(by, every).groupBy(by, "step").agg(F.count("*").alias("_need"))
    sets = any_of(keys.drop("until"), index, [by, "field"])
    spread = sets.join(fields, [by, "field"]).select(by, "layer", "block", "bits", every).join(needed, [by, "step"])
    return all_of(spread, [by, "step"], "_need")


def step_counts(keys: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """by, step, n: exact matches at each step that has any."""
    return step_sets(keys, index, by).groupBy(by, "step").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def counts_of(index: DataFrame, filters: Filters) -> list[int]:
    """The matches of one question at each relaxation step, without the entity table."""
    a = asked(filters)
    keys = index.sparkSession.createDataFrame([(0, *k) for k in a.keys], "q int, field string, value string, until int")
    found = {r["step"]: r["n"] for r in step_counts(F.broadcast(keys), index, "q").collect()}  # a row for each step
    return [found.get(i, 0) for i in range(a.steps)]


def ids_of(block: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ids from blocks and places."""
    return np.where(block > 0, (block - 1) * BLOCK + place + 1, block * BLOCK - place)


def places_in(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def first_ids(sets: DataFrame, by: str, most: int) -> DataFrame:
    """by, id: at least the least ids of each set, most of them from each block."""
    kind = sets.schema[by].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [places_in(x) for x in b.column(2).to_pylist()]
            block = np.asarray(b.column(1))
            ids = [np.sort(ids_of(k, p))[:most] for k, p in zip(block, found, strict=True)]
            row = np.repeat(np.arange(b.num_rows), [len(i) for i in ids])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int64))], names=[by, "id"])

    return sets.select(by, "block", "bits").mapInArrow(run, f"{by} {kind}, id long")
