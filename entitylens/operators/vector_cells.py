"""Exact nearest vectors without reading most of them: cells with a centre and a radius.

Every vector lies in the cell of its nearest centre (a bounded sample of vectors, by
hash), and a cell knows the greatest distance of its vectors from the centre. No product
with a query exceeds the centre's by more than the query's length times that radius. The
cells with the greatest bounds give a threshold; of the others only those are read that
can hold a better vector or a tie. Cells are a column that rows are clustered by, so
what isn't read is skipped by its files' statistics. Vectors that are spread evenly in
many dimensions have wide cells, and then most are read.

Vectors of another length than the centres', with null or non-finite components, or null
themselves, lie in a cell of their own that every search reads, and that scores as a scan does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylens.operators.vectors import cosine

#: Cells at most, and rows of a cell on average below that.
MOST_CELLS, CELL_ROWS = 1024, 4096
#: The threshold comes from cells that hold this many times k rows.
AHEAD = 2
#: Scores are rounded to nine decimals; rounding of sums is far below.
SLACK = 2e-9
ODD = -1


@dataclass(frozen=True)
class VectorCells:
    """rows: cell, id, embedding; the cells' numbers, centres, radii and sizes, MOST_CELLS at most."""

    rows: DataFrame
    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(vectors: DataFrame, cell_rows: int = CELL_ROWS) -> VectorCells:
        """Builds the cells; rows are a plan over vectors, to be kept or written by cell."""
        fit = F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        v = vectors.select("id", "embedding", fit.alias("fit"))
        sizes = v.where("fit").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        d, n = (sizes["d"], sizes["count"]) if sizes else (0, 0)
        sample = v.where(F.col("fit") & (F.size("embedding") == d)).orderBy(F.xxhash64("id"), "id").limit(min(MOST_CELLS, -(-n // cell_rows)))
        centres = np.array([r["embedding"] for r in sample.collect()], float)
        centres = centres.reshape(len(centres), d)
        kind = vectors.schema["embedding"].dataType.simpleString()

        def run(batches):
            for b in (b.slice(i, CELL_ROWS) for b in batches for i in range(0, b.num_rows, CELL_ROWS)):
                cell, far = np.full(b.num_rows, ODD, np.int32), np.zeros(b.num_rows)
                mine = np.flatnonzero(np.asarray(b.column(2)) & (np.asarray(pa.compute.fill_null(pa.compute.list_value_length(b.column(1)), -1)) == d))
                if len(mine) and len(centres):
                    x = np.asarray(b.column(1).take(pa.array(mine)).flatten(), float).reshape(len(mine), d)
                    cell[mine] = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
                    far[mine] = np.sqrt(((x - centres[cell[mine]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1), pa.array(far)], names=["cell", "id", "embedding", "far"])

        rows = v.mapInArrow(run, f"cell int, id long, embedding {kind}, far double")
        held = sorted(map(tuple, rows.groupBy("cell").agg(F.max("far"), F.count("*")).collect()))
        cells = np.array([c for c, _, _ in held], int)
        middle = np.array([centres[c] if c != ODD else np.zeros(d) for c in cells]).reshape(len(cells), d)
        radii = np.array([np.inf if c == ODD else r for c, r, _ in held])
        return VectorCells(rows.drop("far"), cells, middle, radii, np.array([m for _, _, m in held], int))

    def bounds(self, query: list[float]) -> np.ndarray:
        """The greatest product that a vector of each cell can have."""
        q = np.asarray(query, float)
        if len(q) != self.centres.shape[1]:
            return np.where(self.cells == ODD, np.inf, -np.inf)
        length = float(np.sqrt(q @ q))
        reach = np.where(self.cells == ODD, np.inf, length * np.where(np.isinf(self.radii), 0.0, self.radii))
        return self.centres @ q + reach + SLACK * (1 + length * (np.sqrt((self.centres**2).sum(1)) + np.where(np.isinf(self.radii), 0.0, self.radii)))

    def _scored(self, cells: np.ndarray, query: list[float], k: int, mask: DataFrame | None) -> DataFrame:
        some = self.rows.where(F.col("cell").isin([int(c) for c in cells]))
        some = some if mask is None else some.join(mask.select("id"), "id", "left_semi")
        return cosine(some, query).orderBy(F.desc("cosine"), "id").limit(k)

    def chosen(self, query: list[float], k: int, mask: DataFrame | None = None) -> np.ndarray:
        """The cells that the k best can lie in."""
        bound = self.bounds(query)
        order = np.argsort(-bound, kind="stable")
        sized = np.where(self.cells == ODD, 0, self.sizes)[order]
        before = np.cumsum(sized) - sized
        best = self._scored(self.cells[order[before < AHEAD * k]], query, k, mask).collect()
        # Spark ranks a score that is no number first; no cell is below one.
        return self.cells[~(bound < best[-1]["cosine"])] if len(best) == k else self.cells

    def top(self, query: list[float], k: int, mask: DataFrame | None = None) -> DataFrame:
        """id and cosine of the k best, of those whose id is in mask; equal ones by id."""
        return self._scored(self.chosen(query, k, mask), query, k, mask)
