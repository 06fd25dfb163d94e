"""Block-max postings against the scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from entitylens.operators import blocks
from entitylens.operators.ingest import indexed
from entitylens.operators.lexical import KeywordIndex, bm25, top_ranked

TERMS = [["alpha"], ["alpha beta"], ["alpha beta", "gamma", "alpha-beta"], ["beta gamma delta"], ["omega", "x", "?"], ["nowhere"], [], ["alpha alpha"], ["delta", "beta gamma alpha", "alpha beta"]]


def corpus(spark, n, seed=1, first=1):
    rng = random.Random(seed)
    words = ["alpha"] * 3 + ["beta"] * 3 + ["gamma"] * 2 + ["delta", "omega"] + [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(rng.randrange(k)))
    rows = [(i, text(4), text(40), [text(3)] if i % 3 else []) for i in rng.sample(range(first, 20 * n), n)]
    return indexed(spark.createDataFrame(rows, "id long, name string, description string, topics array<string>").repartition(3))


def listed(df):
    return [tuple(r) for r in df.orderBy(F.desc("bm25"), "id").select("id", "bm25").collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return corpus(spark, 1500).cache()


def test_top_equals_the_scan(rows, monkeypatch):
    monkeypatch.setattr(blocks, "IDS", 256)
    index = blocks.BlockIndex.of(rows)
    index = blocks.BlockIndex(index.blocks.cache(), KeywordIndex(index.words.postings.cache(), index.words.n_rows, index.words.mean_words))
    for terms in TERMS:
        for k in (1, 10):
            assert listed(index.top(terms, k)) == listed(top_ranked(bm25(rows, terms, F.lit(True)), "bm25", "r", k)), terms
    some = F.col("id") % 5 == 0
    for k in (10, 5000):
        assert listed(index.top(TERMS[2], k, rows.where(some))) == listed(top_ranked(bm25(rows, TERMS[2], some), "bm25", "r", k))


def test_few_blocks_are_read(rows, monkeypatch):
    monkeypatch.setattr(blocks, "IDS", 256)
    index = blocks.BlockIndex.of(rows)
    index.top(["omega omega"], 3).collect()
    assert index.share_read() < 0.5
    index.top(["alpha"], 1).collect()
    assert 0 < index.share_read() < 0.2


def test_layers_count_what_is_up_to_date(spark, rows, monkeypatch):
    monkeypatch.setattr(blocks, "IDS", 256)
    new = corpus(spark, 200, seed=2).cache()
    gone = rows.where("id % 11 = 0").select("id")
    now = rows.join(new.select("id"), "id", "left_anti").unionByName(new).join(gone, "id", "left_anti").cache()
    layers = [blocks.block_postings(d).withColumn("layer", F.lit(k)) for k, d in enumerate((rows, new))]
    dead = new.select("id", F.lit(1).alias("last")).unionByName(gone.select("id", F.lit(2).alias("last"))).groupBy("id").agg(F.max("last").alias("last"))
    words = KeywordIndex.of(now)
    index = blocks.BlockIndex(layers[0].unionByName(layers[1]).cache(), KeywordIndex(words.postings.cache(), words.n_rows, words.mean_words), dead.cache())
    for terms in TERMS[:5]:
        assert listed(index.top(terms, 20)) == listed(top_ranked(bm25(now, terms, F.lit(True)), "bm25", "r", 20)), terms
