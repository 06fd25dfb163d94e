"""The bitmap index against scans, and batch search against the engine one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from entitylens.operators import bitmaps, rank
from entitylens.operators.filters import Filters, Range
from entitylens.operators.ingest import enriched, indexed
from entitylens.operators.lexical import KeywordIndex
from entitylens.operators.vectors import HashEmbedder
from entitylens.plans import batch
from entitylens.plans.engine import Engine, Request
from entitylens.plans.nlq import parse

TOPICS = ["fraud detection", "diagnostics", "drug discovery", "5g analytics", "smart grid", "lending and payments"]
ASKED = [
    "fraud detection in Finland or Germany",
    "telecom companies in UK working on 5G analytics with fewer than 20 employees",
    "UK 5G analytics with at most 190 employees founded after 2010",
    "companies in Norway",
    "German companies with more than 500 employees and revenue above 500M",
    "biotech drug discovery founded before 1990 with 1000-1100 employees",
    "platform for lending", "smart-grid smart grid x ?", "Firm7 firm9 zebra", "", "between 100 and 300 staff",
    "fintech in Germany founded since 2005 with revenue under 20M and at least 10000 employees",
]


@pytest.fixture(scope="module")
def entities(spark):
    rng = random.Random(3)
    rows = [(rng.choice([i, i + 32_768, i + 131_072]), f"Firm{i % 11}", f"AI-powered platform for {TOPICS[i % 6]}.", "", ["Finland", "Germany", "UK", "Norway", None][i % 5], rng.choice([None, *range(1990, 2022)]), rng.choice([None, 0, 15, 16, 17, 255, 256, 4095, 70_000, *range(10, 2000, 37)]), rng.choice([None, "1M-10M", "500M+", "10M-50M"])) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "id long, name string, description string, industry string, location string, founded_year int, employee_count long, revenue_range string")
    return indexed(enriched(df)).repartition(3).cache()


@pytest.fixture(scope="module")
def index(entities):
    return bitmaps.bitmap_index(entities).cache()


def test_interval_keys_cover_exactly_their_range():
    rng = random.Random(1)
    for _ in range(200):
        low, high = sorted(rng.choice([0, 1, 15, 16, 255, 256, 4095, 2**20, 16**6 - 1, rng.randrange(16**6)]) for _ in range(2))
        keys = bitmaps.interval_keys(Range(low, high))
        covered = sorted((int(k) << 4 * int(w), (int(k) + 1) << 4 * int(w)) for w, k in (x.split(":") for x in keys))
        assert covered[0][0] == low and covered[-1][1] == high + 1 and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
        assert len(keys) <= 2 * 15 * bitmaps.WIDTHS
    assert bitmaps.interval_keys(Range(5, 4)) == []
    same = lambda a, b: set(bitmaps.interval_keys(a)) == set(bitmaps.interval_keys(b))
    assert same(Range(5, 9, False, False), Range(6, 8)) and same(Range(4.5, 8.5, False, False), Range(5, 8)) and same(Range(None, 8.5), Range(0, 8)) and same(Range(4.5), Range(5))


@pytest.mark.parametrize("sparse", [1024, 3])
def test_counts_equal_a_scan(spark, entities, index, monkeypatch, sparse):
    monkeypatch.setattr(bitmaps, "SPARSE", sparse)
    built = index if sparse == 1024 else bitmaps.bitmap_index(entities)
    cases = [parse(q).filters for q in ASKED] + [Filters(), Filters(("Nowhere",)), Filters(topics=("nothing",)), Filters(revenue_buckets=("?",)), Filters(("UK", "UK", "Norway"), (), ("diagnostics", "lending"), Range(1990, 2021), Range(16, 255, False, True), ("1M-10M", "500M+"))]
    for f in cases:
        scan = rank.relaxation_counts(entities, f).first()
        assert bitmaps.counts_of(built, f) == list(scan)


def test_no_entity_column_is_read(spark, entities, tmp_path):
    bitmaps.bitmap_index(entities).write.parquet(str(tmp_path / "bits"))
    stored = spark.read.parquet(str(tmp_path / "bits"))
    keys = spark.createDataFrame([(0, *k) for k in bitmaps.asked(Filters(("UK",), employees=Range(10, 300))).keys], "q int, field string, value string, until int")
    files = bitmaps.step_counts(keys, stored, "q").inputFiles()
    assert files and all("/bits/" in f for f in files)


def test_layers_count_the_last_row_of_each_id(spark, entities):
    old, new = entities.where("id % 3 <> 0"), entities.where("id % 2 = 0").withColumn("location", F.lit("Finland"))
    gone = entities.where("id % 7 = 0").select("id")
    built = bitmaps.layered([bitmaps.bitmap_index(d) for d in (old, new, new.where("false"))], [new.select("id"), gone])
    now = old.join(new.select("id"), "id", "left_anti").unionByName(new).join(gone, "id", "left_anti").cache()
    for f in (Filters(), Filters(("Finland",)), Filters(("UK", "Germany"), topics=("diagnostics",)), Filters(employees=Range(10, 500), founded=Range(2000))):
        assert bitmaps.counts_of(built, f) == list(rank.relaxation_counts(now, f).first())


def test_ids_come_back_from_blocks(spark):
    ids = [1, 2, 32_768, 32_769, 100_000, 0, -5, -32_768, -70_000, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.bitmap_bucket_number("id").alias("b"), F.bitmap_bit_position("id").alias("p")).toPandas()
    assert bitmaps.ids_of(df["b"].to_numpy(), df["p"].to_numpy()).tolist() == ids


def one_by_one(engine, question, mode, **more):
    parsed = parse(question)
    relaxation = rank.relaxed(engine.entities, parsed.filters)
    request = Request(question, mode=mode, **more)
    page, _, fallback = engine.plan(parsed, parsed.filters, relaxation, request)
    return [(r["id"], r["score"]) for r in page.collect()], relaxation.strict_count, relaxation.count, list(relaxation.dropped), fallback


@pytest.mark.parametrize(("mode", "more"), [("keyword", {}), ("hybrid", {}), ("semantic", {"limit": 5, "offset": 3})])
def test_batch_equals_the_engine(spark, entities, index, mode, more):
    model = HashEmbedder(16)
    made = [(r["id"], model._one(r["name"] + r["description"]).tolist()) for r in entities.select("id", "name", "description").collect()]
    vectors = spark.createDataFrame(made, "id long, embedding array<double>").cache()
    engine = Engine(entities, vectors if mode != "keyword" else None, model.query)
    asked = [(f"q{i}", t) for i, t in enumerate(ASKED)]
    questions = spark.createDataFrame(asked + [("none", None)], "q string, text string").repartition(2)
    q_vectors = spark.createDataFrame([(k, model.query(t).tolist()) for k, t in asked], "q string, embedding array<double>")
    words = KeywordIndex.of(entities)
    words = KeywordIndex(words.postings.cache(), words.n_rows, words.mean_words)
    found = batch.search(questions, entities, words, index, vectors if mode != "keyword" else None, q_vectors, mode=mode, **more)
    info = {r["q"]: r for r in found.questions.collect()}
    pages = {}
    for r in found.results.orderBy("q", "place").collect():
        pages.setdefault(r["q"], []).append((r["id"], r["score"]))
    assert len(info) == len(asked) + 1
    for k, text in asked:
        page, strict, count, dropped, fallback = one_by_one(engine, text, mode, **more)
        r = info[k]
        assert (r["strict_count"], r["count"], r["dropped"], r["fallback"]) == (strict, count, dropped, fallback), text
        assert pages.get(k, []) == page, text


def test_questions_that_rank_alike_are_ranked_once(spark, entities, index, monkeypatch):
    """Words that no entity holds made each question a search of its own: every hit stood once for each of them."""
    rows = []
    scores = batch.keyword_scores
    monkeypatch.setattr(batch, "keyword_scores", lambda *a: rows.append(scores(*a)) or rows[-1])
    asked = [(f"q{i}", f"{'fraud detection' if i % 2 else 'smart grid'} in {'Finland' if i % 3 else 'Norway'} zebra{'x' * i}") for i in range(24)]
    words = KeywordIndex.of(entities)
    found = batch.search(spark.createDataFrame(asked, "q string, text string"), entities, words, index, mode="keyword")
    pages = {}
    for r in found.results.orderBy("q", "place").collect():
        pages.setdefault(r["q"], []).append((r["id"], r["score"], r["bm25"]))
    hits = rows[0].groupBy("w").count().collect()
    assert len(hits) == 2 and sum(r["count"] for r in hits) == entities.where("w_topics like '%fraud  detection%' or w_topics like '%smart  grid%'").count()
    for k, _ in asked:
        assert pages[k] == pages[f"q{int(k[1:]) % 6}"] and pages[k]
    assert len({str(p) for p in pages.values()}) == 4
    engine = Engine(entities)
    for k, text in asked[:4]:
        assert [p[:2] for p in pages[k]] == one_by_one(engine, text, "keyword")[0]
