"""Sharding by jump consistent hashing.

``jump`` maps 64-bit keys to shards without a ring table: a key's shard is the
last stop of a pseudo-random walk below the shard count, so appending a shard
moves only the keys whose walk reaches it, a 1/n share, and all of them there.

``shard_rows`` adds the shard, a gapless slot in it by (key, tie columns), and
the shard after growth. The slot comes from two passes: a range partitioning by
key, a rank within each (range, shard), and prefix sums over the ranges' counts.
No shard is ever gathered in one task, and the text never moves.

Defined cases: a null key counts as key 0; a null or empty text has 0 bytes;
repeated keys share a shard and get different slots; empty input gives no rows;
other columns pass through unless named like one that is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from entitylens.llm.common import stored

#: Ranges for slot numbering at most; bounds the offset table to this many rows a shard.
MAX_RANGES = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key (any 64-bit integers), by jump consistent hashing."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = at[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[live] = ((shard[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[at[live] < shards]
    return shard.astype(np.int32)


def _with_columns(frame: DataFrame, add, fields: list[StructField]) -> DataFrame:
    schema = StructType([f for f in frame.schema.fields if f.name not in {x.name for x in fields}] + fields)
    names = [f.name for f in schema.fields[: -len(fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + add(b, state), names=names + [f.name for f in fields])

    return frame.mapInArrow(run, schema)


def shard_rows(df: DataFrame, key: str, shards: int, ties: tuple[str | Column, ...] = ()) -> DataFrame:
    """df with shard, slot and grown_shard (the shard among one more)."""
    spark = df.sparkSession

    def hashed(b: pa.RecordBatch, _: dict) -> list[pa.Array]:
        keys = b.column(key).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        return [pa.array(jump(keys, n)) for n in (shards, shards + 1)]

    def ranked(b: pa.RecordBatch, seen: dict) -> list[pa.Array]:
        from pyspark import TaskContext

        s = b.column("shard").to_numpy(zero_copy_only=False)
        order = np.argsort(s, kind="stable")
        starts = np.searchsorted(s[order], s[order])
        before = seen.setdefault("count", np.zeros(shards, np.int64))
        rank = np.empty(len(s), np.int64)
        rank[order] = np.arange(len(s)) - starts
        rank += before[s]
        before += np.bincount(s, minlength=shards)
        part = TaskContext.get().partitionId()
        return [pa.array(np.full(len(s), part, np.int32)), pa.array(rank)]

    both = [StructField("shard", IntegerType(), False), StructField("grown_shard", IntegerType(), False)]
    keyed = _with_columns(df, hashed, both)
    ranges = min(MAX_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    by = [F.col(key), *ties]
    ordered = keyed.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    place = [StructField("_range", IntegerType(), False), StructField("_rank", LongType(), False)]
    rows = stored(_with_columns(ordered, ranked, place), "shard-rows")
    totals = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # At most MAX_RANGES x shards rows of 16 bytes, whatever the input.
    joined = rows.join(F.broadcast(starts), ["shard", "_range"])
    return joined.withColumn("slot", F.col("_start") + F.col("_rank")).drop("_start", "_rank", "_range")


def op1(spark, sf_dir: str) -> DataFrame:
    """documents over 40 shards under the law ``key``."""
    from entitylens.llm.common import table

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard_rows(rows, "doc_id", 40, ("text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The walk of jump hashing as a recursive query; slots by (doc_id, crc) rest on doc_id alone where ids are unique.
#: DuckDB has no crc32, so text_crc32 is folded from a table of the 256 byte remainders.
OP1_SQL = """
WITH RECURSIVE rem(i, k, r) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END FROM rem WHERE k < 8
), lut AS (SELECT list(r ORDER BY i) AS l FROM rem WHERE k = 8),
hexed AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS nb, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, nb, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(nb), lambda i: (16 * (strpos('0123456789ABCDEF', h[2*i+1]) - 1) + strpos('0123456789ABCDEF', h[2*i+2]) - 1)::UBIGINT)),
    lambda c, b: xor(c // 256, lut.l[(xor(c % 256, b) + 1)::BIGINT]))) AS crc
  FROM hexed, lut
), walk(doc_id, n, key, b, j) AS (
  SELECT doc_id, n, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END::UHUGEINT, -1::BIGINT, 0::BIGINT
  FROM documents, (VALUES (40), (41)) v(n)
  UNION ALL
  SELECT doc_id, n, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS k2 FROM walk WHERE j < n)
), stop AS (SELECT doc_id, n, max(b) AS shard FROM walk WHERE j >= n GROUP BY ALL)
SELECT c.doc_id, (nb + 16)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, s.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY c.doc_id) - 1 AS slot, g.shard::INTEGER AS grown_shard
FROM crc c JOIN stop s ON s.doc_id = c.doc_id AND s.n = 40 JOIN stop g ON g.doc_id = c.doc_id AND g.n = 41
"""
