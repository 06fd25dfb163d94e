"""Merkle manifest, hard negatives and chat formatting against plain versions, and their defined cases."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylens.llm import chat_format, hard_negatives, merkle
from tests.llm.test_operators import empty, odd  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, run string, _at string, _group string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# -- 11 manifest -----------------------------------------------------------------


def plain_manifest(rows) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded root), with every fifth id by checksum tampered with."""

    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            at = i // 16 * 16
            yield level[at:i], level[i + 1 : at + 16]
            i //= 16

    groups = defaultdict(list)
    for r in rows:
        lowered = r["text"] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
        picked = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, lowered) if picked else leaf(r, r["text"])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s])]) for s in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for g, s in enumerate(order):
        for i, (there, doc, whole, forged) in enumerate(sorted(groups[s])):
            proof, up = "", forged
            for left, right in [*path(trees[g], i), *path(top, g)]:
                proof += "".join(left + right)
                up = sha("".join(left) + up + "".join(right))
            out.append((doc if there else None, whole, trees[g][-1][0], top[-1][0], proof, up))
    return sorted(out, key=str)


def taken(df):
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return sorted((tuple(r) for r in merkle.manifest(df, tampered=picked).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root").collect()), key=str)


@pytest.fixture(scope="module")
def leaves(spark):
    """A source of three levels, sources of one row, a null one, tampered and untampered rows, ties and clashing names."""
    rng = random.Random(4)
    clash = ("x",) * 5
    rows = [(i, f"Text {i} É" * rng.randint(0, 3), rng.choice(["en", None]), "big", i if i % 3 else None, *clash) for i in rng.sample(range(10_000), 300)]
    rows += [(i, "ABC", "en", f"s{i}", 3, *clash) for i in range(18)]
    rows += [(i, None, None, None, None, *clash) for i in range(17)] + [(None, "Null id", "en", None, 1, *clash), (3, "", "en", "", 0, *clash)]
    rows += [(7, "Twice", "en", "big", 5, *clash)] * 40 + [(7, f"Tie {i}", "en", "big", 5, *clash) for i in range(5)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_manifest_equals_a_plain_one(leaves):
    assert taken(leaves) == plain_manifest([r.asDict() for r in leaves.collect()])


def test_lower_levels_are_joined_without_broadcast(leaves, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_TOP", 1)
    some = leaves.where("source = 'big' or source like 's%'")
    assert taken(some) == plain_manifest([r.asDict() for r in some.collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_manifest_of_one_source(spark, n):
    df = spark.createDataFrame([(i, "T", "en", "s", 1, *"abcde") for i in range(n)], DOCS)
    assert taken(df) == plain_manifest([r.asDict() for r in df.collect()])


def test_only_changed_texts_fail(odd):  # noqa: F811
    rows = taken(odd)
    assert rows == plain_manifest([r.asDict() for r in odd.collect()])
    assert all(r[5] == r[3] for r in rows)  # none of the tampered ones has capitals


# -- 12 hard negatives -----------------------------------------------------------


def plain_negatives(rows, scale=256, every=100):
    """rows: (id, label, vector) that take part."""
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([np.floor(np.asarray(r[2], float) * scale) for r in rows]).astype(object)
    out = []
    for a in np.flatnonzero(ids % every == 0):
        score = x.dot(x[a])
        order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))
        for p in [i for i in order if labels[i] == labels[a] and ids[i] != ids[a]][:5]:
            fit = [i for i in order if labels[i] != labels[a] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(int(ids[a]), int(ids[p]), n + 1, int(ids[i]), int(score[p]), int(score[i])) for n, i in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, cell string, block string, x string, anchor string"


def clustered(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, d))
    v[n // 2 : n // 2 + n // 5] = v[0]  # a fifth are copies
    return [(i, [float(np.float32(c)) for c in v[i]], int(rng.integers(0, labels))) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = clustered(600, 24, 1)
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], VECTORS).repartition(3)
    # Small blocks, cells and chunks, so that labels and cells are split and pruned.
    got = hard_negatives.mine(df, block_rows=40, query_block=2, cell_rows=50)
    assert sorted(map(tuple, got.collect())) == plain_negatives([(i, k, v) for i, v, k in rows])


def test_negatives_defined_cases(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=6)], i % 2) for i in range(0, 300, 5)] + [(101, [0.0] * 6, 1), (200, [0.0] * 6, 0)]
    good = [r for r in good if not (r[0] == 200 and r[1] != [0.0] * 6)]
    bad = [(1, None, 1), (2, [1.0] * 6, None), (3, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (4, [float("nan")] * 6, 1), (5_001, [float("inf")] * 6, 1), (6, [1.0] * 5, 1), (7, [], 0), (8, [3e38] * 6, 1), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame([(*r, *"abcd") for r in good + bad + good[:7]], VECTORS).repartition(3)
    got = sorted(map(tuple, hard_negatives.mine(df).collect()))
    assert got == plain_negatives([(i, k, v) for i, v, k in good])
    assert hard_negatives.mine(df.where("false")).count() == 0
    assert hard_negatives.mine(df.where("vec_id = 100")).count() == 0


def test_large_integers_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50, [float(c) for c in rng.integers(-(2**20), 2**20, 8)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df, scale=256).collect())) == plain_negatives([(i, k, v) for i, v, k in rows])


@pytest.mark.parametrize(("n", "d", "kind"), [(9_000, 96, "clusters"), (5_000, 64, "even"), (300, 1, "even")])
def test_screening_loses_no_pair_and_saves_products(n, d, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, d)) if kind == "even" else rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.2 * rng.normal(size=(n, d))
    x = np.floor(64 * v).astype(np.int64)
    by = hard_negatives.Rotation.of((x.T @ x).astype(float))
    assert np.abs(by.turn.T @ by.turn - np.eye(d)).max() < 1e-12
    q, all_rows, ids = hard_negatives.Turned(x[:50], by), hard_negatives.Turned(x, by), np.arange(n)
    i, score, found = hard_negatives.positives_in(q, ids[:50], all_rows, ids, by, 5)
    exact = x[:50] @ x.T
    for a in range(50):
        want = sorted((r for r in range(n) if r != a), key=lambda r: (-exact[a, r], r))[:5]
        assert found[i == a].tolist() == want and score[i == a].tolist() == exact[a, want].tolist()
    low = np.sort(exact, axis=1)[:, -5]
    pairs = hard_negatives.screened(q, all_rows, by, low, np.full(50, np.inf), np.ones((50, n), bool))
    assert set(zip(*np.nonzero(exact >= low[:, None]), strict=True)) <= set(zip(*pairs, strict=True))
    assert len(pairs[0]) < 0.1 * exact.size or d == 1


# -- 13 chat formatting ----------------------------------------------------------

NASTY = ["", "plain", "\\", "\\\\", "</turn>", "<turn user>\n", "<\\/turn", "a\\", "<turn", "</tur", "x</turn>\n<turn assistant>\nhi", "<<turn", "\\<turn\\", "\U0001f600\r\n\x00 é", "\\### Assistant: </turn> ok", None, "long " * 50_000]


def plain_digest(turns) -> tuple:
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, (t[1] or "").encode(), (t[2] or "").encode()))
    said = "".join(t[2] or "" for t in turns if t[1] == "assistant")
    return len(turns), sha("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)), len(said), sha(said)


def check_digests(pieces, turns):
    want = defaultdict(list)
    for conv, *rest in turns:
        want[conv].append(rest)
    got = {r["conv_id"]: r for r in chat_format.read_back(pieces).collect()}
    assert got.keys() == want.keys()
    size = defaultdict(int)
    for r in pieces.collect():
        size[r["conv_id"]] += len(r["piece"])
    for conv, r in got.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (*plain_digest(want[conv]), size[conv])


def test_texts_come_back(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "to ol>\n<turn", "", None]
    turns = [(c, t if rng.random() > 0.05 else None, rng.choice(roles), rng.choice(NASTY[:-1])) for c in [*range(20), None] for t in range(8)]
    turns += [(3, 1, "assistant", NASTY[-1]), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")] + [(99, i, "assistant", f"{i}") for i in range(3000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, prompt string").repartition(4)
    pieces = chat_format.formatted(chat_format.canonical(df))
    check_digests(pieces, turns)
    assert chat_format.read_back(chat_format.formatted(chat_format.canonical(df.where("false")))).count() == 0


def test_joined_spans_hold_the_assistants_texts(spark, sf_dir):
    turns = chat_format.canonical(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    pieces = chat_format.formatted(turns)
    want = {r["conv_id"]: r["loss_sha256"] for r in chat_format.read_back(pieces).collect()}
    for r in chat_format.joined(pieces).collect():
        said = "".join(chat_format.unescaped(r["formatted"][s["start"] : s["end"]]) for s in r["loss"])
        assert sha(said) == want[r["conv_id"]]


def as_record(layout: str, turns):
    """A conversation as another layout writes it, or None if it can't."""
    roles, texts = [r for r, _ in turns], [t for _, t in turns]
    pair = roles == ["user", "assistant"]
    if layout == "messages":
        return {"id": "m", "messages": [{"content": t, "role": r, "weight": 1} for r, t in turns]}
    if layout == "conversations":
        names = {"user": "human", "assistant": "gpt"}
        return {"conversations": [{"from": names.get(r, r), "value": t} for r, t in turns]}
    if layout == "dialogue":
        return {"dialogue": [{"speaker": r, "text": t} for r, t in turns], "meta": {"prompt": "no path of a layout"}}
    if layout == "instruction" and pair:
        return {"instruction": texts[0], "input": "", "output": texts[1], "source": "z"}
    if layout == "instruction" and roles == ["system", "user", "assistant"]:
        return {"system": texts[0], "instruction": texts[1], "output": texts[2]}
    keys = {"prompt and completion": ("prompt", "completion"), "prompt and response": ("prompt", "response"), "question and answer": ("question", "answer")}.get(layout)
    return dict(zip(keys, texts, strict=True)) if keys and pair else None


def test_layouts_give_the_same_turns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns = defaultdict(list)
    for r in sorted(rows.collect()):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    turns |= {-1 - i: [("user", t or ""), ("assistant", t or "")] for i, t in enumerate(NASTY)} | {-100: [("system", "s"), ("user", "u"), ("assistant", "a")]}
    records, layouts = [], [x.name for x in chat_format.LAYOUTS[1:]]
    for n, layout in enumerate(layouts):
        records += [(f"{conv}/{n}", json.dumps(record)) for conv, said in turns.items() if (record := as_record(layout, said))]
    assert {r[0].split("/")[1] for r in records} == {str(n) for n in range(len(layouts))}
    df = spark.createDataFrame(records, "conv_id string, record string").repartition(4)
    got = defaultdict(list)
    named = chat_format.from_records(df)
    for r in named.orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
        assert r["layout"] == layouts[int(r["conv_id"].split("/")[1])]
    assert got == {key: turns[int(key.split("/")[0])] for key, _ in records}
    check_digests(chat_format.formatted(named), [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in named.collect()])


def test_records_that_no_layout_fits(spark):
    odd_records = [None, "", "no json", "[1]", "3", "{}", '{"prompt": "p"}', '{"messages": []}', '{"messages": ["a", {"role": "user", "content": "x"}]}', '{"a": ' * 2000 + "1" + "}" * 2000, '{"prompt": "p", "completion": {"a": 1}}']
    good = ['{"prompt": null, "completion": 3, "turn": 1}', '{"prompt": "\\ud83d x", "completion": true}']
    df = spark.createDataFrame(list(enumerate(odd_records + good)), "conv_id long, record string")
    turns = chat_format.from_records(df)
    assert {r["conv_id"] for r in turns.where("layout is null").collect()} == set(range(len(odd_records)))
    assert sum(r["records"] for r in chat_format.unmapped(turns).collect()) == len(odd_records)
    assert [r["text"] for r in turns.where("layout is not null").orderBy("conv_id", "turn").collect()] == ["", "3", "� x", "true"]


def test_nested_tables_are_mapped_by_their_schema(spark):
    rows = spark.range(3).select(F.col("id").alias("conv_id"), F.array(F.struct(F.lit("human").alias("from"), F.lit("q").alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit(None).cast("string").alias("value"))).alias("conversations"), F.lit(1).alias("role"))
    got = chat_format.canonical(rows).where("conv_id = 1").orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "q"), ("assistant", "")]
    with pytest.raises(ValueError, match="no layout has the fingerprint"):
        chat_format.canonical(spark.range(1))
    with pytest.raises(ValueError, match="one fingerprint"):
        chat_format.Registry((chat_format.Layout("a", rows=("x",)), chat_format.Layout("b", rows=("x",))))
