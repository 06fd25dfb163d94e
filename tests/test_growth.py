"""Plans that grow with the entities: what they derive once, and where their rows meet."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from entitylens.llm import ngram_join, suffix_dedup
from entitylens.llm.common import maybe_in
from entitylens.operators import bitmaps, blocks, lexical, vectors
from entitylens.operators.filters import Filters
from entitylens.plans import batch, queries
from entitylens.plans.queries import QUERIES

#: Part of the pattern that finds topics, which only the derivation of entities has.
TOPICS = "fraud  prevention"
SEARCHES = "explain_breakdown mode_keyword explain_matched_on mode_semantic relax_exact_first pagination hybrid_search keyword_rank hydrate_page keyword_topk join_keyword_hydrate keyword_phrase_or keyword_filtered filter_topics_any topic_industry_join bitmap_total bitmap_values bitmap_not".split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_read_the_snapshot(spark, sf_dir, name):
    """No branch of a search derives topics again; each used to for every mention of topics, industry or words."""
    assert TOPICS in optimized(queries.entities(spark, sf_dir))
    assert TOPICS not in optimized(QUERIES[name](spark, sf_dir))


def test_entities_are_dealt_out(spark, sf_dir):
    """One row group is one task, so rows are dealt out before anything is derived."""
    text = plan(queries.entities(spark, sf_dir))
    assert text.index("fraud  prevention") < text.index("Exchange hashpartitioning(id") < text.index("FileScan")


@pytest.mark.parametrize("index", [bitmaps.bitmap_index, blocks.block_postings])
def test_indexes_shuffle_rows_not_entries(spark, sf_dir, index):
    """Rows meet by block before they become entries or terms, in one exchange."""
    text = plan(index(queries.snapshot(spark, sf_dir)))
    assert re.findall(r"Exchange hashpartitioning\((\w+?)#", text) == ["block"]
    assert text.rindex("Generate") < text.index("Exchange")


def test_later_runs_leave_out_buckets_within_one_class(spark):
    """Five sets meet in a bucket of each run; once they are one class, no bucket of them is read, joined or split again."""
    runs = range(ngram_join.FIRST_RUNS, ngram_join.RUNS)
    tokens = [[7]] * ngram_join.RUNS
    sets = spark.createDataFrame([(i, tokens, tokens, tokens) for i in range(5)], "sid long, level0 array<array<long>>, level1 array<array<long>>, level2 array<array<long>>")
    for root, small in ((F.col("sid"), 5 * len(runs)), (F.lit(0).cast("long"), 0)):
        found = ngram_join.buckets(sets, sets.select("sid", root.alias("root"), "level0"), runs, "test")
        assert [f.count() for f in found] == [small, 0]


def test_more_rows_are_more_tasks(spark, sf_dir, monkeypatch):
    """Spark merges parts that are small in bytes, which left as many tasks as cores at every size."""
    monkeypatch.setattr(queries, "ROWS_A_TASK", 10)
    rows = queries.customer_entities(spark, sf_dir).count()
    assert queries.entities(spark, sf_dir).rdd.getNumPartitions() == -(-rows // 10) > spark.sparkContext.defaultParallelism


def test_texts_without_partner_are_not_shuffled(spark, monkeypatch):
    """Of 300 texts two are near copies; all texts, tokens and sets used to be shuffled to meet what these two have in common."""
    left = {}

    def spied(df, key, wanted, name):
        out = maybe_in(df, key, wanted, name)
        left[name] = (df.count(), out.count(), out.join(wanted.distinct().withColumnRenamed(wanted.columns[0], "_w"), key == F.col("_w"), "left_semi").count())
        return out

    monkeypatch.setattr(ngram_join, "maybe_in", spied)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(299)]
    docs = spark.createDataFrame([*enumerate(texts), (299, texts[0] + " more")], "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.linked(docs).collect()}
    assert found == {i: (i, 0) for i in range(1, 299)} | {0: (0, 1), 299: (0, 1)}
    for name in ("first-shared-tokens", "grouped", "grouped-texts"):
        rows, kept, wanted = left[name]
        assert wanted <= kept < rows / 10 and wanted > 0


def test_vectors_without_match_are_not_shuffled(spark, sf_dir, monkeypatch):
    """Searches joined all vectors with all entities by id, which shuffled every vector whatever the filter was."""
    left = []

    def spied(df, key, wanted, name):
        out = maybe_in(df, key, wanted, name)
        left.append((df.count(), out.count()))
        return out

    monkeypatch.setattr(vectors, "maybe_in", spied)
    e, v, mask = queries.snapshot(spark, sf_dir), queries.entity_vectors(spark, sf_dir), Filters(locations=("Finland",)).predicate()
    ids = {r["id"] for r in e.where(mask).select("id").collect()}
    known = vectors.matching(v, e, mask, len(ids))
    assert left == [] and not re.search(r"Exchange hashpartitioning\(id#", plan(known))
    found = vectors.matching(v, e, mask)
    assert left[0][1] < left[0][0] / 2
    assert sorted(r["id"] for r in known.collect()) == sorted(r["id"] for r in found.collect()) == sorted(ids)
    assert {r["id"]: r["embedding"] for r in found.collect()} == {r["id"]: r["embedding"] for r in v.collect() if r["id"] in ids}


def test_short_texts_are_looked_at_together(monkeypatch):
    """Anchors of 200 short texts took 200 rounds of calls; they come out as if each text were alone."""
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"ab" if i % 3 else b"abcdefgh ", k=rng.choice([0, 399, 400, 401, 799, 1500]))) for i in range(200)]
    calls, gram_ids = [], suffix_dedup.gram_ids
    monkeypatch.setattr(suffix_dedup, "gram_ids", lambda raw: calls.append(len(raw)) or gram_ids(raw))
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([t for _, t in some], pa.binary())], names=["kid", "raw"])
    rows = lambda batches: pa.Table.from_batches(list(suffix_dedup._anchor_rows(400)(iter(batches)))).sort_by([("kid", "ascending"), ("at", "ascending")]).to_pylist()
    every = list(enumerate(texts))
    found = rows([batch(every)])
    assert len(calls) <= 1 + sum(map(len, texts)) // (suffix_dedup.AT_ONCE // 2)
    assert found and found == rows([batch([x]) for x in every])


def test_indexes_expand_rows_in_tasks(spark, sf_dir):
    """Words and values were one row for each occurrence in every plan, which were sorted and, for words, shuffled."""
    e = queries.snapshot(spark, sf_dir)
    assert "Exchange" not in plan(lexical.postings(e))
    assert not re.search("Aggregate|collect_", plan(bitmaps.bitmap_index(e)))


def test_postings_of_odd_rows(spark):
    """Repeated words, fields that are null or blank, and more rows than are looked at at once."""
    rows = [(i, " a  b  a ", None if i % 2 else "  ", " a " if i % 3 else "", 4) for i in range(lexical.ROWS_AT_ONCE + 3)]
    df = spark.createDataFrame(rows, "id long, w_name string, w_description string, w_topics string, n_words int").coalesce(1)
    topics = 2 << lexical.APART
    found = {(r["id"], r["term"]): (r["n_words"], r["places"]) for r in lexical.postings(df).collect()}
    assert found == {(i, t): (4, [0, 2] + [topics] * bool(i % 3) if t == "a" else [1]) for i, *_ in rows for t in "ab"}
    assert lexical.postings(df.where("false")).collect() == []


def test_questions_are_parsed_once(spark, sf_dir, monkeypatch):
    """Every branch of the plan parsed all questions again, as none waited for another's rows."""
    plans = []
    search = batch.search
    monkeypatch.setattr(batch, "search", lambda *a, **k: plans.append(search(*a, **k)) or plans[-1])
    QUERIES["batch_search"](spark, sf_dir)
    assert "text" in optimized(queries.asked_of_benchmark(spark, sf_dir))
    # Only listing without words reads an Arrow step of its own, first_ids.
    assert optimized(plans[0].results).count("MapInArrow") <= 1 and "MapInArrow" not in optimized(plans[0].questions)
