"""Vector search by cells against the scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylens.operators.vector_cells import VectorCells
from entitylens.operators.vectors import cosine


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(0, 30, 1500)] + 0.1 * rng.normal(size=(1500, 16))
    v[700:900] = v[3]  # ties
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(1500), v, strict=True)]
    rows += [(5000, None), (5001, [1.0] * 3), (5002, [float("nan")] * 16), (5003, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3).cache()
    return df, v


def listed(df):
    return [(r["id"], None if np.isnan(r["cosine"]) else r["cosine"]) for r in df.collect()]


def test_top_equals_the_scan_and_reads_few_cells(made):
    df, v = made
    found = VectorCells.of(df, cell_rows=30)
    found = VectorCells(found.rows.cache(), found.cells, found.centres, found.radii, found.sizes)
    for at, k in ((3, 10), (3, 250), (1000, 1), (50, 2000)):
        query = v[at].tolist()
        assert listed(found.top(query, k)) == listed(cosine(df, query).orderBy(F.desc("cosine"), "id").limit(k))
    # A score that is no number comes first and keeps all cells; without it few are read.
    found = VectorCells.of(df.where("id <> 5002"), cell_rows=30)
    read = [found.sizes[np.isin(found.cells, found.chosen(v[1000].tolist(), k))].sum() / found.sizes.sum() for k in (1, 2000)]
    assert read[0] < 0.5 and read[1] == 1
    some = df.where("id % 7 = 0")
    query = v[100].tolist()
    assert listed(found.top(query, 20, some)) == listed(cosine(some, query).orderBy(F.desc("cosine"), "id").limit(20))
    assert listed(found.top([1.0, 0.0, 0.0], 5)) == listed(cosine(df, [1.0, 0.0, 0.0]).orderBy(F.desc("cosine"), "id").limit(5))


def test_no_vectors(made):
    df, _ = made
    for empty in (df.where("false"), df.where("id in (5000, 5003)")):
        assert VectorCells.of(empty).top([1.0] * 16, 5).count() == 0
