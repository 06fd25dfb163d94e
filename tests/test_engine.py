from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from entitylens.functions.text import normalize, normalize_col, tokens, tokens_col
from entitylens.operators import rank
from entitylens.operators.bitmaps import counts_of
from entitylens.operators.filters import Filters, Range
from entitylens.operators.ingest import enriched, indexed
from entitylens.operators.lexical import KeywordIndex, bm25
from entitylens.operators.metrics import Metrics, nearest_rank
from entitylens.operators.vectors import HashEmbedder, try_embedder
from entitylens.plans.engine import Engine, InvalidRequest, NotFound, Request
from entitylens.sources.companies import RAW_SCHEMA
from entitylens.store import Conflict, Store
from entitylens.streaming.ingest import ingest_folder

TOPICS = ["fraud detection", "diagnostics", "drug discovery", "5g analytics", "smart grid"]


@pytest.fixture(scope="module")
def entities(spark):
    rows = []
    for i in range(1, 46):
        rows.append((i, f"Firm{i}", f"AI-powered platform for {TOPICS[i % 5]}.", "", ["Finland", "Germany", "UK"][i % 3], 2000 + i % 20, 10 + 37 * i, "1M-10M" if i % 2 else "500M+"))
    rows.append((46, "Nulls", "Platform for fraud detection and lending.", "", "Finland", None, None, None))
    df = spark.createDataFrame(rows, "id long, name string, description string, industry string, location string, founded_year int, employee_count long, revenue_range string")
    return indexed(enriched(df)).cache()


@pytest.fixture(scope="module")
def engine(spark, entities):
    model = HashEmbedder(32)
    made = [(r["id"], model._one(r["description"]).tolist()) for r in entities.select("id", "description").collect()]
    return Engine(entities, spark.createDataFrame(made, "id long, embedding array<double>"), model.query)


def test_text_columns_agree_with_python(spark):
    texts = ["Größe Café", "Smart Grids!", "  a_b 500M+ ", "", "classes ANALYTICS companies", "Ünïcödé ÅNGSTRÖM"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", normalize_col(F.col("t")).alias("n"), tokens_col(F.col("t")).alias("w")).collect()
    assert [(r["n"], r["w"]) for r in got] == [(normalize(t), tokens(t)) for t in texts]


def test_filters_hold_and_totals_are_exact(engine, entities):
    r = engine.search(Request("companies in Germany with more than 500 employees", limit=100))
    rows = r.results.collect()
    assert r.total == len(rows) == entities.where("location = 'Germany' and employee_count > 500").count() > 0


def test_relaxation_gives_up_in_order_and_says_so(engine):
    r = engine.search(Request("telecom companies in UK working on 5G analytics with fewer than 20 employees"))
    assert r.relaxation.applied and r.relaxation.dropped == ("employees",)
    assert r.relaxation.message.startswith("No companies matched every constraint, so the employees constraint was relaxed. Showing")
    near = [x["employee_count"] for x in r.results.collect()]
    assert near and all(x["location"] == "UK" for x in r.results.collect())
    assert not engine.search(Request("UK 5G analytics with fewer than 20 employees", allow_relaxation=False)).results.collect()


def test_exact_matches_lead_relaxed_ones(engine, entities):
    two = entities.where("location = 'UK' and array_contains(topics, '5g analytics')").orderBy("employee_count").limit(2).collect()
    r = engine.search(Request(f"UK 5G analytics with at most {two[-1]['employee_count']} employees"))
    rows = r.results.collect()
    assert r.relaxation.applied and {x["id"] for x in rows[:2]} == {x["id"] for x in two}
    assert rows[0]["matched_on"][0] == "matches every requested constraint"


def test_modes_and_determinism(engine):
    for mode in ("hybrid", "keyword", "semantic"):
        one, two = (engine.search(Request("fraud detection", mode=mode)).results.collect() for _ in range(2))
        assert one == two and one


def test_fallback_lists_by_id(entities):
    r = Engine(entities).search(Request("companies in Finland"))
    ids = [x["id"] for x in r.results.collect()]
    assert r.fallback and ids == sorted(ids)


def test_similar(engine, entities):
    page, n = engine.similar(5, same_location=True)
    rows = page.collect()
    assert all(r["id"] != 5 and r["location"] == "UK" for r in rows) and n == entities.where("location = 'UK' and id <> 5").count()
    with pytest.raises(NotFound):
        engine.similar(999)


def test_low_coverage_leaves_vectors_out(spark, entities):
    few = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert not Engine(entities, few, lambda t: [1.0, 0.0]).semantic


def test_overlapping_phrases_count(spark):
    df = spark.createDataFrame([(1, "a", "xx xx xx", "", "", None, None, None), (2, "b", "yy zz", "", "", None, None, None), (3, "c", "zz", "", "", None, None, None)], "id long, name string, description string, industry string, location string, founded_year int, employee_count long, revenue_range string")
    found = bm25(indexed(enriched(df)), ["xx xx"], F.lit(True)).collect()
    assert [r["id"] for r in found] == [1] and found[0]["bm25"] > 0


@pytest.mark.parametrize("term", ['"', "'", "a AND b", "*", "(", "NEAR(", "col:x", "-", "^", "\\"])
def test_hostile_terms_are_harmless(entities, term):
    bm25(entities, [term], F.lit(True)).count()


@pytest.mark.parametrize("bad", [Request(""), Request("x", limit=0), Request("x", limit=101), Request("x", offset=-1), Request("x", mode="other"), Request("x" * 1001)])
def test_requests_are_checked(engine, bad):
    with pytest.raises(InvalidRequest):
        engine.search(bad)


def test_relaxation_steps_are_cumulative():
    f = Filters(("UK",), ("Retail",), (), Range(2000), Range(None, 5), ("0-1M",))
    assert [d for d, _ in rank.relaxation_steps(f)] == [(), ("employees",), ("employees", "revenue"), ("employees", "revenue", "founded"), ("employees", "revenue", "founded", "industry")]


def test_store_lifecycle(spark, tmp_path):
    src = tmp_path / "in.json"
    src.write_text(json.dumps([
        {"id": 7, "name": "Seven", "description": "Platform for payments", "country": "germany"},
        {"company_name": "Next", "summary": "Solution for smart grids", "revenue": 2500000, "employees": 12},
        {"name": "  ", "id": 9},
        {"id": 7, "name": "Seven again", "description": "Platform for lending", "hq": "Atlantis", "founded": 1999},
    ]))
    from entitylens.sources.companies import read_records

    store = Store(spark, str(tmp_path / "store"), dim=32)
    assert store.try_engine()[0] is None
    stats = store.ingest(read_records(spark, str(src)))
    assert (stats["read"], stats["written"], stats["invalid"], stats["corpus_size"]) == (4, 3, 1, 2)
    rows = {r["id"]: r for r in store.entities().collect()}
    assert rows[7]["name"] == "Seven again" and rows[7]["location"] == "Atlantis" and rows[7]["topics"] == ["lending"]
    assert rows[8]["topics"] == ["smart grid"] and rows[8]["industry"] == "Energy" and rows[8]["revenue_range"] == "1M-10M"
    old = store.engine()
    store.embed()
    assert store.engine().semantic and not old.semantic
    store.delete(8)
    assert old.get(8).count() == 1 and store.engine().get(8).count() == 0
    with pytest.raises(NotFound):
        store.delete(8)
    assert store.engine().search(Request("lending")).results.count() == 1


def test_stream_ingests_what_arrives(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": 1, "name": "A"}\n{"id": 2, "name": "B"}\nbroken\n')
    store = Store(spark, str(tmp_path / "store"))
    ingest_folder(store, str(folder), str(tmp_path / "cp")).awaitTermination()
    (folder / "b.jsonl").write_text('{"id": 2, "name": "B2"}\n')
    ingest_folder(store, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: r["name"] for r in store.entities().collect()} == {1: "A", 2: "B2"}


def test_index_gives_the_scores_of_a_scan(entities):
    index = KeywordIndex.of(entities)
    for terms in (["fraud detection"], ["smart-grid", "x", "renewable energy"], ["platform for", "a"], ["nowhere at all"], []):
        for mask in (F.lit(True), F.col("location") == "Finland"):
            scan, found = ({r["id"]: r["bm25"] for r in df.collect()} for df in (bm25(entities, terms, mask), index.bm25(entities, terms, mask)))
            assert scan == found


def test_phrases_stay_within_a_column_and_may_overlap(spark):
    rows = spark.createDataFrame([(1, " go  go  go ", " fish ", " ", 4), (2, " a ", " go  go ", " go ", 4)], "id long, w_name string, w_description string, w_topics string, n_words long")
    index = KeywordIndex.of(rows)
    for terms in (["go go"], ["go fish"], ["fish", "go go go"]):
        assert {tuple(r) for r in index.bm25(rows, terms, F.lit(True)).collect()} == {tuple(r) for r in bm25(rows, terms, F.lit(True)).collect()}


def test_index_follows_updates_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), dim=32)
    raw = lambda *rows: spark.createDataFrame(rows, "id string, name string, description string").transform(lambda df: df.withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in df.columns}))
    found = lambda q: {r["id"] for r in store.engine().search(Request(q, mode="keyword")).results.collect()}
    store.ingest(raw(("1", "Zebra", "zebra crossing"), ("2", "Lion", "lion den")))
    assert store.engine().index is not None and found("zebra") == {1}
    store.ingest(raw(("1", "Tiger", "tiger lair")))
    assert found("tiger") == {1} and 1 not in found("zebra crossing lion")
    store.delete(1)
    assert found("tiger lion") == {2}


def test_small_writes_lie_over_the_snapshot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("entitylens.store.TOUCHED_SHARE", 10.0)
    monkeypatch.setattr("entitylens.store.MOST_DELTAS", 5)
    store = Store(spark, str(tmp_path / "store"), dim=32)
    raw = lambda *rows: spark.createDataFrame(rows, "id string, name string, description string").transform(lambda df: df.withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in df.columns}))
    have = lambda: {r["id"]: r["name"] for r in store.entities().collect()}
    first = store.ingest(raw(("1", "Zebra", "zebra crossing"), ("2", "Lion", "lion den"), ("3", "Owl", "owl nest")))
    old = store.engine()
    steps = [
        (lambda: store.ingest(raw(("2", "Tiger", "tiger lair"), (None, "Fox", "fox hole"))), {1: "Zebra", 2: "Tiger", 3: "Owl", 4: "Fox"}),
        (lambda: store.delete(2), {1: "Zebra", 3: "Owl", 4: "Fox"}),
        (lambda: store.ingest(raw(("2", "Lynx", "lynx tiger"), ("3", "Owl", "owl tower"))), {1: "Zebra", 2: "Lynx", 3: "Owl", 4: "Fox"}),
        (lambda: store.ingest(raw(("9", " ", None))), {1: "Zebra", 2: "Lynx", 3: "Owl", 4: "Fox"}),
        (lambda: store.delete(4), {1: "Zebra", 2: "Lynx", 3: "Owl"}),
    ]
    for n, (write, want) in enumerate(steps, 1):
        write()
        now, rows = store.meta(), store.entities()
        assert have() == want and now["rows"] == len(want) and now["snapshot"] == first["snapshot"] and len(now["deltas"]) == n
        for terms in (["tiger"], ["owl tower", "lion"]):
            scan = {r["id"]: r["bm25"] for r in bm25(rows, terms, F.lit(True)).collect()}
            assert scan == {r["id"]: r["bm25"] for r in store.index().words.bm25(rows, terms, F.lit(True)).collect()}
            assert scan == {r["id"]: r["bm25"] for r in store.index().top(terms, 100).collect()}
        for f in (Filters(), Filters(topics=("lending",))):
            assert counts_of(store.bitmaps(), f) == list(rank.relaxation_counts(rows, f).first())
    with pytest.raises(NotFound):
        store.delete(4)
    # The sixth write makes a whole snapshot; ids go on from the highest.
    store.ingest(raw((None, "Elk", "elk")))
    assert have() == {1: "Zebra", 2: "Lynx", 3: "Owl", 4: "Elk"} and store.meta()["deltas"] == [] and store.meta()["snapshot"] != first["snapshot"]
    assert {r["id"] for r in old.search(Request("lion", mode="keyword")).results.collect()} == {2}


def test_ids_are_looked_up_in_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("entitylens.store.TOUCHED_SHARE", 1.0)
    rng = random.Random(5)
    store, parts = Store(spark, str(tmp_path / "store"), dim=32), spark.conf.get("spark.sql.shuffle.partitions")
    make = lambda rows: spark.createDataFrame(rows, "id string, name string, description string").withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in ("id", "name", "description")})
    have = {}

    def write(rows):
        store.ingest(make([(str(i), n, f"smart grid {'x ' * (i % 5)}") for i, n in rows]))
        have.update(rows)

    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        write([(i, f"first {i}") for i in rng.sample(range(1, 4000), 800)])
        files = lambda df: [f for f in df.inputFiles() if "/entities/" in f]
        assert len(files(store.entities())) >= 12
        some = sorted(have)[100]
        assert store.rows_of([some]).first()["name"] == have[some] and len(files(store.rows_of([some]))) == 1
        assert {r["id"] for r in store.rows_of([some, -1, 10**9]).collect()} == {some}
        page = store.page_after(some, 20)
        assert [r["id"] for r in page.collect()] == sorted(have)[101:121] and len(files(page)) <= 2
        for step in range(4):
            near = sorted(have)[100:110]
            write([(i, f"step {step} {i}") for i in (*near[:2], rng.randrange(5000, 9000))])
            store.delete(near[5])
            del have[near[5]]
            assert {r["id"]: r["name"] for r in store.rows_of([*near, 10**9]).collect()} == {i: have[i] for i in near if i in have}
            assert len(files(store.rows_of([near[3]]))) == 1 and len(files(store.rows_of([near[0]]))) == 1 and store.rows_of([near[5]]).count() == 0
            for key in (0, near[0], near[4], sorted(have)[-3]):
                assert [(r["id"], r["name"]) for r in store.page_after(key, 15).collect()] == [(i, have[i]) for i in sorted(have) if i > key][:15]
            now, rows = store.meta(), store.entities()
            assert now["figures"] == store._figures(rows) and now["rows"] == len(have)
        store.delete(max(have))
        del have[max(have)]
        assert store.meta()["figures"]["max_id"] == max(have) and store.engine().get(max(have)).count() == 1
        with pytest.raises(ValueError, match="at most"):
            store.rows_of(list(range(2000)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_write_that_stops_leaves_the_snapshot_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), dim=32)
    rows = spark.createDataFrame([("1", "A")], "id string, name string").withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in ("id", "name")})
    first = store.ingest(rows)
    # A record that was begun and not finished.
    (tmp_path / "store" / "begun-0.json").write_text('{"snapshot": "sna')
    assert store.meta()["snapshot"] == first["snapshot"]
    store.set_meta("note", [1, 2])
    assert store.get_meta("note") == [1, 2] and store.meta()["snapshot"] == first["snapshot"]
    again = store.ingest(rows)
    assert again["corpus_size"] == 1 and store.get_meta("note") == [1, 2]


def test_two_writers_do_not_hide_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), dim=32)
    store.set_meta("a", 1)
    began = store.meta()
    store.set_meta("b", 2)
    with pytest.raises(Conflict):
        store._point(began | {"snapshot": "late"}, began)


def test_a_writer_that_is_overtaken_fails(spark, tmp_path):
    """A has written its record and not yet published it; B publishes; A must not."""
    a, b = (Store(spark, str(tmp_path / "store"), dim=32) for _ in range(2))
    before = a.set_meta("x", 1)
    begun = a._begun(before | {"version": 2, "own": {"x": "a"}})
    assert b.meta() == before
    b.set_meta("x", "b")
    target = a._path(f"{a.path}/pointer-000000000002.json")
    with pytest.raises(Exception, match="exist"):
        a._renamed(begun, target)
    with pytest.raises(Conflict):
        a._point(before | {"own": {"x": "a"}}, before)
    assert a.get_meta("x") == "b" and a.meta()["version"] == 2


def test_racing_writers_publish_one_version_each(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, str(tmp_path / "store"), dim=32)
    before = store.set_meta("n", 0)

    def write(i):
        try:
            return store._point(before | {"own": {"n": i}}, before)["own"]["n"]
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [w for w in pool.map(write, range(24)) if w is not None]
    assert won == [store.get_meta("n")] and store.meta()["version"] == 2
    assert not list((tmp_path / "store").glob("begun-*"))


def test_a_damaged_pointer_is_an_error(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), dim=32)
    store.set_meta("a", 1)
    (tmp_path / "store" / "pointer-000000000002.json").write_text('{"snapshot": "sna')
    with pytest.raises(RuntimeError, match="damaged"):
        store.meta()


def test_folders_that_no_pointer_names_expire(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("entitylens.store.KEPT_POINTERS", 2)
    store = Store(spark, str(tmp_path / "store"), dim=32)
    rows = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, name string").withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in ("id", "name")})
    for _ in range(4):
        store.ingest(rows)
    folders = lambda: {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()}
    assert len(folders()) == 4  # all are younger than the grace time
    monkeypatch.setattr("entitylens.store.GRACE_S", -60)
    kept = {store.meta()["snapshot"]}
    store.set_meta("a", 1), store.embed(), store.set_meta("b", 1)
    assert folders() == kept | {store.meta()["vectors"]}
    assert len(list((tmp_path / "store").glob("pointer-*"))) == 2 and store.engine().semantic and store.entities().count() == 2


def test_a_fresh_checkpoint_hides_no_new_data(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    store, checkpoint = Store(spark, str(tmp_path / "store")), tmp_path / "cp"
    (folder / "a.jsonl").write_text('{"id": 1, "name": "A"}\n')
    ingest_folder(store, str(folder), str(checkpoint)).awaitTermination()
    (folder / "a.jsonl").unlink()
    checkpoint.rename(tmp_path / "old-cp")
    (folder / "b.jsonl").write_text('{"id": 2, "name": "B"}\n')
    ingest_folder(store, str(folder), str(checkpoint)).awaitTermination()
    assert {r["id"] for r in store.entities().collect()} == {1, 2}
    # The same stream goes on where it was: nothing is stored twice.
    (folder / "c.jsonl").write_text('{"name": "C"}\n')
    for _ in range(2):
        ingest_folder(store, str(folder), str(checkpoint)).awaitTermination()
    assert sorted(r["name"] for r in store.entities().collect()) == ["A", "B", "C"]


def test_a_batch_that_comes_again_stores_nothing_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), dim=32)
    rows = spark.createDataFrame([(None, "A"), (None, "B")], "id string, name string").withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in ("id", "name")})
    for number, size in ((0, 2), (0, 2), (1, 4), (1, 4)):
        assert store.ingest(rows, batch=("s", number))["corpus_size"] == size
    assert store.entities().count() == 4


def test_an_embedder_that_fails_leaves_search_by_words(spark, tmp_path):
    def broken(dim):
        raise OSError("no model here")

    store = Store(spark, str(tmp_path / "store"), embedder=broken)
    rows = spark.createDataFrame([("1", "A")], "id string, name string").withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in ("id", "name")})
    store.ingest(rows)
    assert store.model is None and not store.engine().semantic
    with pytest.raises(RuntimeError):
        store.embed()


def test_embedders_give_their_dimension_and_instruct_queries_only():
    class Asked(HashEmbedder):
        instruction = "query: "

        def __init__(self, dim):
            super().__init__(dim + 8)
            self.dim_asked, self.seen = dim, []

        def documents(self, texts):
            self.seen += texts
            return super().documents(texts)[:, : self.dim_asked // 2]

    model = try_embedder(Asked, 32)
    assert model.dim == 16
    model.documents(["a"]), model.query("b"), model.query(" B ")
    assert model.seen == ["warm-up", "a", "query: b"]


def test_vectors_that_are_not_whole_are_left_out(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), dim=32)
    rows = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, name string").withColumns({f.name: F.lit(None).cast("string") for f in RAW_SCHEMA.fields if f.name not in ("id", "name")})
    store.ingest(rows)
    now = store.embed()
    assert store.engine().semantic
    now = store._point(now | {"vector_rows": 3}, now)
    assert not store.engine().semantic
    now = store._point(now | {"vector_rows": 2}, now)
    assert store.engine().semantic
    # A file that is cut short, and one that is gone.
    part = next((tmp_path / "store" / now["vectors"]).glob("part-*"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-3])
    assert store.vectors() is None
    part.write_bytes(whole)
    assert store.vectors().count() == 2
    part.unlink()
    assert store.vectors() is None and not store.engine().semantic


def test_texts_are_hashed_by_batch():
    import hashlib

    def plain(text, dim):
        v = [0.0] * dim
        for t in tokens(text):
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = max(sum(x * x for x in v) ** 0.5, 1e-12)
        return [x / n for x in v]

    texts = ["smart grids smart", "", "fraud detection and lending", "é Ünï", "smart"]
    assert HashEmbedder(32).documents(texts).tolist() == [plain(t, 32) for t in texts]
    assert HashEmbedder(32).documents([]).shape == (0, 32) and HashEmbedder(8).documents(["", ""]).tolist() == [[0.0] * 8] * 2


def test_metrics():
    m = Metrics()
    m.incr("hits", mode="x", a=1)
    with m.timer("t"):
        pass
    s = m.snapshot()
    assert s["counters"] == {"hits{a=1,mode=x}": 1} and s["timings"]["t"]["count"] == 1
    assert nearest_rank([1, 2, 3, 4], 50) == 3 and nearest_rank([], 50) == 0.0
