"""Hard-negative mining by integer products, screened in an orthogonal PCA rotation.

Vectors become integers, and a score is their exact inner product. An orthogonal
rotation (the eigenvectors of the second moments of all rows) moves most of every
vector's length into its leading components. A pair's product is accumulated over
them in stages; what is missing after a stage is at most the product of the two
residual norms, plus a slack for rounding. Pairs that can't reach the anchor's
threshold, or must lie above its window, are discarded at once; only survivors are
multiplied as integers. The rotation decides how early pairs go, never which.

Two searches over stored rows, each of anchors against rows in blocks. Positives:
anchors meet the blocks of their own label, and each block gives its best few.
Negatives: a positive's score p opens the window [p - p // 5, p] of ``SHARE``, and
anchors with their windows meet blocks that are cells around sampled centres; the
triangle inequality on a cell's centre and radius spares an anchor the cells that
hold nothing for it. Thresholds rise while a block is read. A label or cell of any
size is dealt over blocks of ``block_rows``, anchors over chunks of ``query_block``,
and rows are sent only to chunks with an anchor that asks for them. All that the
driver holds is d x d moments, at most ``MOST_CELLS`` centres, and the counts of cells.

Without clusters all pairs of anchors and rows are screened, which is what the
stated query set against all rows costs.

Defined cases: rows take no part if id, label or vector is null, a component is null
or not finite, the length isn't the most common one (of equally common ones the
longest), or the squared integer length reaches 2**62, as scores would outgrow a
long; zero vectors take part. Rows that repeat id, label and integer vector count
once; rows that only share an id are rows of their own, but none is a positive of an
anchor with its id. Equal scores go to the smaller id. Anchors without a positive,
or with negative scores only, give no rows; so does empty input. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylens.llm.common import stored, table

#: Parts of the sum of all squares that the leading components hold after each stage.
STAGES = (0.5, 0.75, 0.9)
#: Below this part of pairs left, the next stage goes on pair by pair and not by whole blocks.
SPARSE = 0.1
MOST_CELLS = 1024
#: A negative's score is at least 80 of 100 parts of the positive's: p - p // 5 for whole p from 0 on.
SHARE = 5
#: Anchors and rows that are multiplied at once.
TILE, STRIPE = 128, 4096


def integers(df: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and x, the integer vector, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fit = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null")
    fit = fit.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    length = fit.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    scaled = fit.where(F.size("v") == (length["n"] if length else 0)).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return scaled.where(square < 2.0**62).select("vec_id", "label", F.transform("v", lambda x: x.cast("int")).alias("x")).distinct()


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = [np.asarray(c.flatten()) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return np.concatenate([*flat, np.empty(0, np.int32)]).astype(np.int64).reshape(rows, -1 if rows and sum(map(len, flat)) else 0)


@dataclass(frozen=True)
class Rotation:
    """turn: orthogonal columns, the leading ones first; ends: how many of them each stage has seen."""

    turn: np.ndarray
    ends: tuple[int, ...]

    @staticmethod
    def of(moments: np.ndarray) -> Rotation:
        weight, vectors = np.linalg.eigh(moments)
        weight = np.maximum(weight[::-1], 0)
        seen = np.cumsum(weight) / max(weight.sum(), 1e-300)
        return Rotation(np.ascontiguousarray(vectors[:, ::-1]), tuple(sorted({int(np.searchsorted(seen, s)) + 1 for s in STAGES} & set(range(1, len(weight) + 1)) | {len(weight)})) if len(weight) else ())

    @property
    def slack(self) -> float:
        """Rounding of rotating and adding up, as a part of the product of two lengths; many times its bound."""
        d = len(self.turn)
        return 16 * (d + 16) * 2.0**-52 + 4 * float(np.abs(self.turn.T @ self.turn - np.eye(d)).sum(axis=0).max(initial=0))


class Turned:
    """Integer vectors, rotated, with their length and the length of what lies behind each stage."""

    def __init__(self, x: np.ndarray, by: Rotation):
        self.x, self.v = x, x.astype(float) @ by.turn
        self.norm = np.sqrt((x.astype(float) ** 2).sum(1))
        self.tail = {e: np.sqrt((self.v[:, e:] ** 2).sum(1)) for e in by.ends}

    def part(self, rows: slice) -> Turned:
        out = object.__new__(Turned)
        out.x, out.v, out.norm, out.tail = self.x[rows], self.v[rows], self.norm[rows], {e: t[rows] for e, t in self.tail.items()}
        return out


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of a's rows i and b's rows j, in pieces of bounded size."""
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)] + [np.empty(0, np.int64)])


def screened(q: Turned, x: Turned, by: Rotation, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are allowed and whose product may lie in low..high of their anchor.

    seed: where each anchor needs its best few only, low rises to the least of that many
    exact products after the first stage.
    """
    pairs, s, start = None, np.zeros(allowed.shape), 0
    low, high = low.astype(float), high.astype(float)
    for end in by.ends:
        if pairs is None:
            s += q.v[:, start:end] @ x.v[:, start:end].T
            rest = np.outer(q.tail[end], x.tail[end]) + np.outer(q.norm * by.slack, x.norm)
            if seed and start == 0 and allowed.shape[1] >= seed and np.isneginf(low).any():
                best = np.argpartition(np.where(allowed, -s, np.inf), seed - 1, axis=1)[:, :seed]
                whole = np.take_along_axis(allowed, best, 1).all(1)
                i, j = np.repeat(np.flatnonzero(whole), seed), best[whole].ravel()
                low[whole] = np.maximum(low[whole], products(q.x, x.x, i, j).reshape(-1, seed).min(1) if len(i) else 0)
            # Thresholds lose their last places as doubles.
            ok = allowed & (s + rest >= (low - np.abs(low) * 2.0**-50)[:, None]) & (s - rest <= (high + np.abs(high) * 2.0**-50)[:, None])
            if end == by.ends[-1] or ok.mean() < SPARSE:
                pairs = np.nonzero(ok)
                s = s[pairs]
        else:
            i, j = pairs
            s = s + np.einsum("ij,ij->i", q.v[i, start:end], x.v[j, start:end])
            rest = q.tail[end][i] * x.tail[end][j] + by.slack * q.norm[i] * x.norm[j]
            ok = (s + rest >= low[i] - np.abs(low[i]) * 2.0**-50) & (s - rest <= high[i] + np.abs(high[i]) * 2.0**-50)
            pairs, s = (i[ok], j[ok]), s[ok]
        start = end
    return pairs if pairs is not None else np.nonzero(allowed)


def best_of(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of each key, by higher score and smaller id."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    starts = np.flatnonzero(np.diff(sorted_key, prepend=-1)) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < k]


def _stripes(n: int, step: int) -> Iterator[slice]:
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def positives_in(q: Turned, q_ids: np.ndarray, x: Turned, x_ids: np.ndarray, by: Rotation, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of other ids for each anchor: (anchor, score, id)."""
    out = []
    for t in _stripes(len(q_ids), TILE):
        tile, n = q.part(t), t.stop - t.start
        low = np.full(n, -np.inf)
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for r in _stripes(len(x_ids), STRIPE):
            i, j = screened(tile, x.part(r), by, low, np.full(n, np.inf), q_ids[t, None] != x_ids[None, r], seed=k)
            now = i, products(tile.x, x.x[r], i, j), x_ids[r][j]
            held = tuple(np.concatenate(p) for p in zip(held, now, strict=True))
            keep = best_of(*held, k)
            held = tuple(p[keep] for p in held)
            full = np.flatnonzero(np.bincount(held[0], minlength=n) == k)
            low[full] = _least(held[0], held[1], n)[full]
        out.append((held[0] + t.start, held[1], held[2]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _least(key: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, key, score)
    return out


def negatives_in(q: Turned, q_labels: np.ndarray, windows: np.ndarray, x: Turned, x_ids: np.ndarray, x_labels: np.ndarray, by: Rotation, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor and upper end p of a window its best k rows of other labels: (anchor, p, score, id).

    windows: the upper ends of each anchor, as many columns as there are at most; -1 where there are fewer.
    """
    out = []
    for t in _stripes(len(q_labels), TILE):
        tile, p = q.part(t), windows[t]
        low = np.where(p >= 0, p - p // SHARE, np.iinfo(np.int64).max)
        held = tuple(np.empty(0, np.int64) for _ in range(3))
        for r in _stripes(len(x_ids), STRIPE):
            i, j = screened(tile, x.part(r), by, low.min(1), p.max(1), q_labels[t, None] != x_labels[None, r])
            score, ids = products(tile.x, x.x[r], i, j), x_ids[r][j]
            # A key for each anchor and window.
            for w in range(p.shape[1]):
                inside = (score >= low[i, w]) & (score <= p[i, w])
                now = i[inside] * p.shape[1] + w, score[inside], ids[inside]
                held = tuple(np.concatenate(c) for c in zip(held, now, strict=True))
            keep = best_of(*held, k)
            held = tuple(c[keep] for c in held)
            count = np.bincount(held[0], minlength=p.size).reshape(p.shape)
            least = _least(held[0], held[1], p.size).reshape(p.shape)
            low = np.where(count == k, np.maximum(low, least), low)
        a, w = held[0] // p.shape[1], held[0] % p.shape[1]
        out.append((a + t.start, p[a, w], held[1], held[2]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def moments(rows: DataFrame) -> np.ndarray:
    """The sums of products of components over all rows; a d x d matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in (b for b in batches if b.num_rows):
            x = matrix(b.column(0), b.num_rows).astype(float)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    d = int(sums["j"].max()) + 1 if len(sums) else 0
    out = np.zeros((d, d))
    out[sums["i"], sums["j"]] = out[sums["j"], sums["i"]] = sums["s"]
    return out


def columns_of(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(t[n].combine_chunks(), np.int64) if t.num_rows else np.empty(0, np.int64) for n in names]


def positives(rows: DataFrame, anchors: DataFrame, by: Rotation, k: int, block_rows: int, query_block: int) -> DataFrame:
    """anchor, anchor_id, label, x of each anchor with positive_id, positive_score and place of its first k positives."""
    # Labels that anchors have, with the number of blocks and chunks of each; joined, as labels may be many.
    dealt = rows.groupBy("label").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).join(anchors.groupBy("label").agg(F.ceil(F.count("*") / query_block).cast("int").alias("chunks")), "label")
    dealt = stored(dealt, "labels")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(dealt, "label").select("vec_id", "label", "x", F.pmod(F.xxhash64("vec_id", "x"), "blocks").cast("int").alias("block"), spread("chunks").alias("chunk"))
    right = anchors.join(dealt, "label").select("anchor", "vec_id", "label", "x", spread("blocks").alias("block"), F.pmod("anchor", "chunks").cast("int").alias("chunk"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64),) * 3
        key, q_ids = columns_of(b, "anchor", "vec_id")
        if a.num_rows and b.num_rows:
            found = positives_in(Turned(matrix(b["x"], b.num_rows), by), q_ids, Turned(matrix(a["x"], a.num_rows), by), *columns_of(a, "vec_id"), by, k)
        i, score, ids = found
        return pa.table({"anchor": key[i], "anchor_id": q_ids[i], "positive_id": ids, "positive_score": score})

    keys = ["label", "block", "chunk"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "anchor long, anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return stored(each.withColumn("place", place).where(F.col("place") <= k), "positives")


def mine(df: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, scale: int = 256, block_rows: int = 32_768, query_block: int = 65_536, cell_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor, a row whose id is divisible by every."""
    rows = stored(integers(df, scale, id_col, vector_col, label_col), "integer-vectors")
    by = Rotation.of(moments(rows))
    # Rows that share an id have anchors of their own.
    anchors = stored(rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.xxhash64("vec_id", "label", "x")), "anchors")
    found = positives(rows, anchors, by, n_positives, block_rows, query_block)

    ends = found.where("positive_score >= 0").groupBy("anchor", "anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("ends"))
    asking = stored(anchors.join(ends.withColumnRenamed("anchor_id", "vec_id"), ["anchor", "vec_id"]), "windows")
    n = rows.count()
    centres = np.array([r["x"] for r in rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(min(MOST_CELLS, -(-n // cell_rows))).collect()], float)
    centres = centres.reshape(len(centres), len(by.turn))

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = (centres**2).sum(1)[None] - 2 * x @ centres.T
        cell = far.argmin(1)
        return cell.astype(np.int32), np.sqrt(((x - centres[cell]) ** 2).sum(1))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            cell, far = nearest(matrix(b.column(2), b.num_rows).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["vec_id", "label", "x", "cell", "far"])

    placed = stored(rows.select("vec_id", "label", "x").mapInArrow(in_cells, "vec_id long, label long, x array<int>, cell int, far double"), "cells")
    # At most MOST_CELLS rows, which are also broadcast.
    sizes = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.max("far").alias("far")), "cell-sizes")
    held = sorted(tuple(r) for r in sizes.collect())
    cells = np.array([c for c, _, _ in held], np.int32)
    blocks = np.array([b for _, b, _ in held], np.int64)
    radius = np.array([r for _, _, r in held], float) * (1 + 2.0**-40)
    middle = centres[cells]
    chunks = max(1, -(-n // (every * query_block)))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            x = matrix(b.column(2), b.num_rows).astype(float)
            top = np.array([e[-1] for e in b.column(4).to_pylist()], float)
            least = np.array([e[0] - e[0] // SHARE for e in b.column(4).to_pylist()], float)
            norm = np.sqrt((x**2).sum(1))
            to = x @ middle.T
            reach = np.outer(norm, radius) + by.slack * np.outer(norm, np.sqrt((middle**2).sum(1)) + radius) + 1
            i, c = np.nonzero((to + reach >= least[:, None]) & (to - reach <= top[:, None]))
            i, c, block = np.repeat(i, blocks[c]), np.repeat(c, blocks[c]), np.concatenate([np.arange(m) for m in blocks[c]] + [np.empty(0, np.int64)])
            # Anchors near one centre share a chunk, so that a chunk asks for few cells.
            home = nearest(x)[0][i] * chunks // max(1, len(centres)) if chunks > 1 else np.zeros(len(i), np.int64)
            yield pa.RecordBatch.from_arrays([col.take(pa.array(i)) for col in b.columns] + [pa.array(cells[c]), pa.array(block.astype(np.int32)), pa.array(np.asarray(home, np.int32))], names=["anchor", "vec_id", "x", "label", "ends", "cell", "block", "chunk"])

    right = stored(asking.select("anchor", "vec_id", "x", "label", "ends").mapInArrow(to_cells, "anchor long, vec_id long, x array<int>, label long, ends array<long>, cell int, block int, chunk int"), "asked")
    # A chunk that is much asked for is split by hash; rows go to the parts that exist.
    crowd = stored(right.groupBy("cell", "block", "chunk").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts")), "crowds")
    dealt = right.join(crowd, ["cell", "block", "chunk"]).withColumn("part", F.pmod("anchor", "parts").cast("int")).drop("parts")
    wanted = crowd.select(*[F.col(c).alias(c) for c in ("cell", "block", "chunk")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocked = placed.join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), "blocks").cast("int"))
    left = blocked.select("cell", "block", "vec_id", "label", "x").join(wanted, ["cell", "block"])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out = (np.empty(0, np.int64),) * 4
        key, q_ids, q_labels = columns_of(b, "anchor", "vec_id", "label")
        if a.num_rows and b.num_rows:
            ends = b["ends"].to_pylist()
            windows = np.full((len(ends), max(map(len, ends))), -1, np.int64)
            for r, e in enumerate(ends):
                windows[r, : len(e)] = e
            x_ids, x_labels = columns_of(a, "vec_id", "label")
            out = negatives_in(Turned(matrix(b["x"], b.num_rows), by), q_labels, windows, Turned(matrix(a["x"], a.num_rows), by), x_ids, x_labels, by, n_negatives)
        i, p, score, ids = out
        return pa.table({"anchor": key[i], "anchor_id": q_ids[i], "positive_score": p, "negative_id": ids, "negative_score": score})

    keys = ["cell", "block", "chunk", "part"]
    each = left.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "anchor long, anchor_id long, positive_score long, negative_id long, negative_score long")
    window = Window.partitionBy("anchor", "anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = each.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n_negatives)
    return ranked.join(found, ["anchor", "anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of each anchor and positive of embeddings, some labels of which are wrong."""
    vectors = table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", wrong))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN met USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
