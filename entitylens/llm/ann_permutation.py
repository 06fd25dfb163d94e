"""Approximate nearest neighbours with a permutation index.

Every vector is represented by the order of its ``near`` nearest pivots, an eighth
of all; these codes are stored with the vectors. A block of rows holds one inverted
file for each pivot: the rows that have the pivot among their nearest, with its
place there. A query reads the files of its own nearest pivots, an eighth of the
postings, and adds up the footrule distance (how far each pivot's place differs; a
pivot that is missing counts as standing behind the last). The ``share`` of a
block's rows with the smallest footrule distance, and ``least`` rows at least, are
reranked by their distance to the query on the original vectors, in double
precision, and each block gives its best k.

The stated queries meet all rows in blocks: each block of rows meets each block of
queries once, so neither side is ever collected or broadcast. Rows that repeat id
and vector are merged first, and blocks are dealt by a hash of both, so neither a
common id nor a common vector gathers in one block. Pivots are a bounded sample
(``pivots`` distinct vectors, by hash); every row is indexed. A block has as many
rows as give each core of the cluster work, and at most ``block_rows``.

Defined cases: vectors that are null, of another than the most common length,
all zero, or hold null or non-finite components take no part, nor do null ids;
equal distances go to the smaller id; fewer candidates than k give all of them;
queries that repeat an id share one list; empty input gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylens.llm.common import stored, table


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fit = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    length = fit.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fit.where(F.size("v") == (length["n"] if length else 0))


def sample_pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    """Distinct vectors with the smallest hashes; collects ``pivots`` rows."""
    distinct = vectors.groupBy(F.xxhash64("v").alias("h")).agg(F.min("vec_id"), F.first("v").alias("v"))
    return np.array([r["v"] for r in distinct.orderBy("h").limit(pivots).collect()], float)


def codes(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The nearest pivots of each row in order."""
    far = (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :near].astype(np.int16)


class InvertedFiles:
    """For each pivot the rows of a block that have it in their code, and its place there."""

    def __init__(self, code: np.ndarray, pivots: int):
        self.rows, self.near = code.shape
        by_pivot = np.argsort(code, axis=None, kind="stable")
        self.row, self.place = (by_pivot // self.near).astype(np.int32), (by_pivot % self.near).astype(np.int32)
        self.ends = np.searchsorted(code.ravel()[by_pivot], np.arange(pivots + 1))

    def footrule(self, code: np.ndarray) -> np.ndarray:
        # With no pivot in common, each one of either side counts by how far it is from behind the last.
        score = np.full(self.rows, 2 * int((self.near - np.arange(self.near)).sum()), np.int64)
        for at, p in enumerate(code.tolist()):
            i, j = self.ends[p], self.ends[p + 1]
            score[self.row[i:j]] += np.abs(self.place[i:j] - at) - (self.near - at) - (self.near - self.place[i:j])
        return score


def search_block(ids: np.ndarray, x: np.ndarray, code: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_codes: np.ndarray, pivots: int, share: float, least: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The best k rows of one block for each query: (query, ids, distances)."""
    by_id = np.argsort(ids, kind="stable")
    ids, x, n = ids[by_id], x[by_id], len(ids)
    files = InvertedFiles(code[by_id], pivots)
    take = min(n, max(least, int(np.ceil(share * n))) + 1)
    for q, query, own in zip(query_ids, queries, query_codes, strict=True):
        # Equal footrules go to the smaller id.
        order = files.footrule(own) * n + np.arange(n)
        found = np.argpartition(order, take - 1)[:take]
        found = found[ids[found] != q]
        d = np.sqrt(((x[found] - query) ** 2).sum(1))
        best = np.lexsort((ids[found], d))
        best = best[: 2 * k] if len(np.unique(ids[found][best[: 2 * k]])) >= k else best
        hits = dict.fromkeys(zip(d[best].tolist(), ids[found][best].tolist(), strict=True))
        top = list(hits)[:k]
        yield int(q), np.array([i for _, i in top], np.int64), np.array([s for s, _ in top], float)


def permutation_index(df: DataFrame, pivots: int, near: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id, v and code (the places' pivots, 16 bits each) of every row that takes part, and how many pivots there are."""
    rows = stored(usable(df, id_col, vector_col).distinct(), "vectors")
    ref = sample_pivots(rows, pivots)
    near = min(near, max(1, len(ref) // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            code = codes(np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1), ref, near)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "v", "code"])

    return stored(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, code binary"), "permutations"), len(ref)


def search(df: DataFrame, every: int = 100, k: int = 10, pivots: int = 1024, near: int = 128, share: float = 0.1, least: int = 100, block_rows: int = 32_768, query_block: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    index, held = permutation_index(df, pivots, near, id_col, vector_col)
    n = index.count()
    least_blocks = min(4 * df.sparkSession.sparkContext.defaultParallelism, n // 8192)
    blocks, query_blocks = max(1, least_blocks, -(-n // block_rows)), max(1, -(-n // (every * query_block)))
    # Each block of rows meets each block of queries once: the stated queries against all rows.
    rows = index.withColumn("_block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("_query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = (
        index.where(F.col("vec_id") % every == 0)
        .withColumn("_query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.asarray(t["vec_id"].combine_chunks(), np.int64)
        vectors = np.asarray(pa.concat_arrays([c.flatten() for c in t["v"].chunks])).reshape(len(ids), -1)
        return ids, vectors, np.frombuffer(b"".join(t["code"].to_pylist()), np.int16).reshape(len(ids), -1)

    def near_in(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[tuple[int, int, float], None] = {}
        if left.num_rows and right.num_rows:
            for q, ids, d in search_block(*arrays(left), *arrays(right), held, share, least, k):
                out |= dict.fromkeys((q, i, s) for i, s in zip(ids.tolist(), d.tolist(), strict=True))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(list(v), t) for (c, t), v in zip(kinds.items(), columns, strict=True)})

    keys = ["_block", "_query_block"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(near_in, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"))


#: The exact neighbours; the index is compared with them in tests, as it may miss some.
EXACT_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score
FROM near QUALIFY rank <= 10
"""
