"""Many questions in one plan: a table of questions against the corpus.

Every question is parsed where it lies and becomes rows: (constraint set, field, value)
for the bitmap index, (question, phrase) and (phrase, word) for the inverted table.
Questions with equal constraints share their counts, equal phrases their places. The
relaxation step of each constraint set follows from its counts; rankings are windows
over (question, entity) rows that are cut to the pool before they meet. Words are ranked
once for all questions with the same constraints and the same phrases that any entity
holds. What runs is the same for one question and a million, and it gives what the engine
gives one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylens.functions.scalars import total
from entitylens.operators import rank
from entitylens.operators.bitmaps import BLOCK, asked, first_ids, places_in, step_counts, step_sets
from entitylens.operators.lexical import DECIMALS, KeywordIndex, phrase_hits, phrase_parts, phrases
from entitylens.plans.engine import POOL
from entitylens.plans.nlq import parse
from entitylens.shared import stored

_RANGE = T.StructType([T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("min_inclusive", T.BooleanType()), T.StructField("max_inclusive", T.BooleanType())])
_LIST = T.ArrayType(T.StringType())
_KEYS = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType()), T.StructField("until", T.IntegerType())]))
_PARSED = [("phrases", T.ArrayType(_LIST)), ("locations", _LIST), ("industries", _LIST), ("topics", _LIST), ("founded", _RANGE), ("employees", _RANGE), ("buckets", _LIST), ("f", T.StringType()), ("keys", _KEYS), ("gives_up", _LIST)]
#: Questions whose scores over one block of vectors are held at once, and questions of one chunk.
AT_ONCE, CHUNK = 64, 2048
CONSTRAINTS = ["locations", "industries", "q_topics", "founded", "employees", "buckets"]
NARROW = ["id", "topics", "location", "industry", "founded_year", "employee_count", "revenue_range"]


def parsed(questions: DataFrame) -> DataFrame:
    """q and what the parser reads in text; f names equal constraint sets."""
    kind = questions.schema["q"]
    schema = T.StructType([T.StructField("q", kind.dataType)] + [T.StructField(n, t) for n, t in _PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            out: dict[str, list] = {n: [] for n, _ in _PARSED}
            for text in b.column(1).to_pylist():
                p = parse(text or "")
                f, a = p.filters, asked(p.filters)
                spans = [{"min": r.min and float(r.min), "max": r.max and float(r.max), "min_inclusive": r.min_inclusive, "max_inclusive": r.max_inclusive} for r in (f.founded, f.employees)]
                keys = [{"field": x, "value": v, "until": u} for x, v, u in a.keys]
                row = (phrases(p.lexical_terms()), f.locations, f.industries, f.topics, *spans, f.revenue_buckets or (), hashlib.md5(repr(a).encode()).hexdigest(), keys, a.gives_up)
                for (n, _), v in zip(_PARSED, row, strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([list(v) if isinstance(v, tuple) else v for v in out[n]], to_arrow_type(t)) for n, t in _PARSED]], names=["q", *out])

    return questions.select("q", F.col("text").cast("string")).mapInArrow(run, schema)


def steps(questions: DataFrame, bitmaps: DataFrame, allowed: bool) -> DataFrame:
    """f, strict_count, count and dropped: how far each constraint set is relaxed."""
    sets = questions.groupBy("f").agg(F.first("keys").alias("keys"), F.first("gives_up").alias("gives_up"))
    keys = sets.select("f", F.explode("keys").alias("k")).select("f", "k.*")
    found = step_counts(keys, bitmaps, "f").groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.size("gives_up")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("long"))
    counts = sets.join(found, "f", "left").withColumn("c", F.coalesce(every, F.transform(F.sequence(F.lit(0), F.size("gives_up")), lambda i: F.lit(0).cast("long"))))
    last = F.size("gives_up")
    enough = F.filter(F.sequence(F.lit(0), last), lambda i: F.element_at("c", i + 1) >= rank.ENOUGH)
    at = F.coalesce(F.get(enough, F.lit(0)), last)
    at = F.when(F.element_at("c", at + 1) > F.element_at("c", 1), at).otherwise(0) if allowed else F.lit(0)
    placed = counts.withColumn("at", at)
    return placed.select("f", "at", F.element_at("c", 1).alias("strict_count"), F.element_at("c", F.col("at") + 1).alias("count"), F.slice("gives_up", F.lit(1), F.col("at")).alias("dropped"))


def _in_range(column: str, r: str) -> Column:
    v, low, high = F.col(column), F.col(f"{r}.min"), F.col(f"{r}.max")
    above = low.isNull() | (v > low) | (F.col(f"{r}.min_inclusive") & (v == low))
    below = high.isNull() | (v < high) | (F.col(f"{r}.max_inclusive") & (v == high))
    return (low.isNull() & high.isNull()) | (v.isNotNull() & above & below)


def matches(dropped: Column | None = None) -> Column:
    """Whether an entity's row matches the question's beside it, without the constraints in dropped."""
    listed = lambda values, column: (F.size(values) == 0) | F.coalesce(F.array_contains(F.col(values), F.col(column)), F.lit(False))
    parts = {
        "location": listed("locations", "location"),
        "topic": (F.size("q_topics") == 0) | F.coalesce(F.arrays_overlap("topics", "q_topics"), F.lit(False)),
        "industry": listed("industries", "industry"),
        "revenue": listed("buckets", "revenue_range"),
        "founded": _in_range("founded_year", "founded"),
        "employees": _in_range("employee_count", "employees"),
    }
    out = F.lit(True)
    for name, part in parts.items():
        out = out & (part if dropped is None or name not in rank.RELAXABLE else F.array_contains(dropped, name) | part)
    return out


def alike(questions: DataFrame, found: DataFrame) -> DataFrame:
    """questions, those that hold a found phrase, with their found phrases in order, and names of equal ones.

    w names equal phrases, k equal phrases and constraints. found: p. A phrase that no entity
    holds adds nothing to any score, so most questions that are worded differently rank alike.
    """
    wanted = questions.select("q", F.posexplode("phrases").alias("i", "words")).select("q", "i", F.array_join("words", " ").alias("p"))
    held = wanted.join(found.select("p"), "p").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("x"))
    named = questions.join(held.select("q", F.col("x.p").alias("found")), "q")
    name = lambda *columns: F.md5(F.to_json(F.struct(*columns)))
    return named.withColumns({"w": name("found"), "k": name("found", "f", *CONSTRAINTS)})


def keyword_scores(worded: DataFrame, parts: DataFrame) -> DataFrame:
    """w, id, bm25 of all entities that hold one of the phrases named w, whatever filters are; worded: w, found; parts: p, id, part."""
    wanted = worded.dropDuplicates(["w"]).select("w", F.posexplode("found").alias("i", "p"))
    met = wanted.join(parts, "p").groupBy("w", "id").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("x"))
    # In the order of the phrases, as rounding depends on it.
    return met.select("w", "id", F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x["part"]), DECIMALS).alias("bm25"))


def top(scored: DataFrame, score: str, place: str, pool: int, by: str = "q") -> DataFrame:
    """The pool best rows of each question with their rank from 0; Spark cuts each task's rows before the shuffle."""
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id"))
    return scored.withColumn(place, order).where(F.col(place) <= pool).withColumn(place, (F.col(place) - 1).cast("long"))


def vector_scores(masks: DataFrame, vectors: DataFrame, asked_vectors: DataFrame, n_questions: int, pool: int) -> DataFrame:
    """q, id, cosine of each question's best rows in each block; masks: q, block, bits; vectors: id, embedding."""
    kind = masks.schema["q"].dataType.simpleString()
    chunks = max(1, -(-n_questions // CHUNK))
    chunk = F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")
    right = masks.join(asked_vectors.select("q", F.col("embedding").cast("array<double>").alias("e")), "q").withColumn("chunk", chunk)
    left = vectors.select("id", F.col("embedding").cast("array<double>").alias("v"), F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id").alias("place")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        row, ids, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        # A question's vector of another length meets no row.
        size = [len(e) for e in b["e"].to_pylist()] if b.num_rows else []
        x = a.filter(pa.compute.equal(pa.compute.list_value_length(a["v"]), size[0])) if size and a.num_rows else a.slice(0, 0)
        if x.num_rows:
            v = np.concatenate([np.asarray(c.flatten()) for c in x["v"].chunks]).reshape(x.num_rows, -1)
            place, known = np.asarray(x["place"].combine_chunks()), np.asarray(x["id"].combine_chunks())
            by_id = np.argsort(known)
            v, place, known = v[by_id], place[by_id], known[by_id]
            bits = b["bits"].to_pylist()
            fit = [i for i, n in enumerate(size) if n == v.shape[1]]
            for at in range(0, len(fit), AT_ONCE):
                some = fit[at : at + AT_ONCE]
                s = np.round(np.array([b["e"][i].as_py() for i in some]) @ v.T, DECIMALS)
                for i, own in zip(some, s, strict=True):
                    held = np.zeros(BLOCK, bool)
                    held[places_in(bits[i])] = True
                    inside = np.flatnonzero(held[place])
                    best = inside[np.argsort(-own[inside], kind="stable")[:pool]]
                    row.append(np.full(len(best), i))
                    ids.append(known[best])
                    scores.append(own[best] + 0.0)
        q = b["q"].combine_chunks() if b.num_rows else pa.array([], b.schema.field("q").type)
        return pa.table({"q": q.take(pa.array(np.concatenate(row))), "id": np.concatenate(ids), "cosine": np.concatenate(scores)})

    keys = ["block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"q {kind}, id long, cosine double")


@dataclass(frozen=True)
class Batch:
    """questions: q, strict_count, count, dropped, fallback; results: q, place, id, score and its parts."""

    questions: DataFrame
    results: DataFrame


def _proximity(name: str, column: str, scale: float | None) -> Column:
    v, low, high, far = F.col(column).cast("double"), F.col(f"{name}.min"), F.col(f"{name}.max"), F.lit(0.0)
    unit = lambda bound: F.lit(scale) if scale else F.greatest(F.abs(bound), F.lit(1.0))
    far = F.when(low.isNotNull() & (v < low), (low - v) / unit(low)).otherwise(far)
    far = F.when(high.isNotNull() & (v > high), (v - high) / unit(high)).otherwise(far)
    return F.when(F.array_contains("dropped", name) & v.isNotNull(), F.lit(rank.PROXIMITY_WEIGHT) / (1.0 + far)).otherwise(0.0)


def search(questions: DataFrame, entities: DataFrame, index: KeywordIndex, bitmaps: DataFrame, vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None, mode: str = "hybrid", limit: int = 10, offset: int = 0, allow_relaxation: bool = True) -> Batch:
    """Answers to a table of questions (q, text). vectors: id, embedding; asked_vectors: q, embedding.

    q is unique; a null text asks for nothing. Entities' ids are unique.
    """
    pool = max(POOL, offset + limit)
    mode = mode if vectors is not None and asked_vectors is not None else "keyword"
    # Both are read in many places of the plan, which would parse and count once for each.
    read = stored(parsed(questions), "questions")
    chosen = read.join(steps(read, bitmaps, allow_relaxation), "f")
    narrow = entities.select(*NARROW)
    filters = [F.col("topics").alias(c) if c == "q_topics" else F.col(c) for c in CONSTRAINTS]
    terms = stored(chosen.select("q", "f", "at", "strict_count", "count", "dropped", *filters, "phrases", (F.size("phrases") > 0).alias("worded")), "terms")

    keys = read.dropDuplicates(["f"]).select("f", F.explode("keys").alias("k")).select("f", "k.*")

    def sets(some: DataFrame) -> DataFrame:
        """f, block, bits of what matches at the step that some's questions are relaxed to, from the constraints that hold there."""
        kept = keys.join(some.select("f", "at").distinct(), "f").where("until > at")
        return step_sets(kept.select("f", "field", "value", F.lit(1).alias("until")), bitmaps, "f")

    sides = []
    none = {"bm25": "double", "keyword_rank": "long", "cosine": "double", "vector_rank": "long"}
    if mode != "semantic":
        wanted = read.select(F.explode("phrases").alias("words")).select(F.array_join("words", " ").alias("p"), "words").dropDuplicates(["p"])
        held = stored(phrase_hits(wanted, index.postings), "phrases")
        worded = alike(terms, held.select("p").distinct())
        hits = keyword_scores(worded, phrase_parts(held, index)).join(narrow, "id").join(worded.drop("q", "phrases", "found").dropDuplicates(["k"]), "w").where(matches(F.col("dropped")))
        ranked = top(hits.select("k", "id", "bm25"), "bm25", "keyword_rank", pool, "k")
        sides.append(worded.select("q", "k").join(ranked, "k"))
    if mode != "keyword":
        masks = sets(terms).join(terms.select("q", "f"), "f").select("q", "block", "bits")
        sides.append(top(vector_scores(masks, vectors, asked_vectors, read.count(), pool), "cosine", "vector_rank", pool))
    else:
        # Without words or vectors the first ids that match are listed.
        bare = terms.where(~F.col("worded"))
        listed = bare.select("q", "f").join(first_ids(sets(bare), "f", pool), "f")
        first = top(listed.select("q", "id", F.lit(0.0).alias("none")), "none", "at", pool).select("q", "id")
        sides.append(first)
    both = None
    for s in sides:
        s = s.select("q", "id", *[F.col(c) if c in s.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])
        both = s if both is None else both.unionByName(s)
    found = rank.with_ranks(both.groupBy("q", "id").agg(*[F.max(c).alias(c) for c in none]))
    met = found.join(narrow, "id").join(terms.drop("phrases"), "q")
    shared = F.size(F.array_intersect("q_topics", "topics")).cast("double") / F.size("q_topics")
    parts = met.withColumns({
        "topic_score": F.when(F.size("q_topics") > 0, F.lit(rank.TOPIC_WEIGHT) * shared / rank.RRF_K).otherwise(0.0),
        "exact_bonus": F.when((F.size("dropped") > 0) & matches(), rank.EXACT_BONUS).otherwise(0.0),
        "proximity": total([F.lit(0.0), _proximity("employees", "employee_count", None), _proximity("founded", "founded_year", rank.YEAR_SCALE)]),
    })
    scored = parts.withColumn("score", F.round(total([F.col(c) for c in ("keyword_score", "vector_score", "topic_score", "exact_bonus", "proximity")]), DECIMALS))
    order = Window.partitionBy("q").orderBy(*[F.desc(c) if down else F.asc(c) for c, down in rank.ORDER])
    page = scored.withColumn("place", F.row_number().over(order)).where(F.col("place").between(offset + 1, offset + limit))
    kept = page.select("q", "place", "id", "score", "bm25", "cosine", "keyword_rank", "vector_rank", "topic_score", "exact_bonus", "proximity")
    return Batch(terms.select("q", "strict_count", "count", "dropped", (~F.col("worded") & F.lit(mode == "keyword")).alias("fallback")), kept)
