"""Fusion of the two rankings, boosts, relaxation and the final order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylens.functions.scalars import total
from entitylens.operators.filters import RELAXABLE, Filters
from entitylens.operators.lexical import DECIMALS

# Fixed values of the ranking.
RRF_K, KEYWORD_WEIGHT, VECTOR_WEIGHT, TOPIC_WEIGHT = 60, 1.0, 1.0, 2.0
EXACT_BONUS, PROXIMITY_WEIGHT, YEAR_SCALE = 1.0, 0.05, 10.0
ENOUGH = 3
#: The final order.
ORDER = [("score", True), ("bm25", True), ("cosine", True), ("id", False)]


def fused(keyword: DataFrame | None, vector: DataFrame | None) -> DataFrame:
    """Reciprocal ranks of both retrievers by id: union and group, so no outer join."""
    none = {"bm25": "double", "keyword_rank": "long", "cosine": "double", "vector_rank": "long"}
    sides = [s.select("id", *[F.col(c) if c in s.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]) for s in (keyword, vector) if s is not None]
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return with_ranks(both.groupBy("id").agg(*[F.max(c).alias(c) for c in none]))


def with_ranks(by_id: DataFrame) -> DataFrame:
    """Adds what the ranks are worth; a score that a row lacks is 0."""
    part = lambda rank, w: F.coalesce(F.lit(w) / (RRF_K + F.col(rank)), F.lit(0.0))
    return by_id.withColumns({
        "keyword_score": part("keyword_rank", KEYWORD_WEIGHT),
        "vector_score": part("vector_rank", VECTOR_WEIGHT),
        "bm25": F.coalesce("bm25", F.lit(0.0)),
        "cosine": F.coalesce("cosine", F.lit(0.0)),
    })


def topic_boost(requested: tuple[str, ...]) -> Column:
    if not requested:
        return F.lit(0.0)
    shared = F.size(F.array_intersect(F.array(*map(F.lit, requested)), F.col("topics")))
    return F.lit(TOPIC_WEIGHT) * (shared.cast("double") / len(requested)) / RRF_K


def proximity(strict: Filters, dropped: tuple[str, ...]) -> Column:
    """Rows near a bound that was given up come first; head counts are relative to the bound, years to a decade."""
    out = []
    for name, column, r, scale in (("employees", "employee_count", strict.employees, None), ("founded", "founded_year", strict.founded, YEAR_SCALE)):
        if name not in dropped or not r:
            continue
        v, far = F.col(column).cast("double"), F.lit(0.0)
        if r.min is not None:
            far = F.when(v < r.min, (F.lit(float(r.min)) - v) / (scale or max(abs(r.min), 1.0))).otherwise(far)
        if r.max is not None:
            far = F.when(v > r.max, (v - float(r.max)) / (scale or max(abs(r.max), 1.0))).otherwise(far)
        out.append(F.when(v.isNotNull(), F.lit(PROXIMITY_WEIGHT) / (1.0 + far)).otherwise(0.0))
    return total(out) if out else F.lit(0.0)


def exact_bonus(strict: Filters, relaxed: bool) -> Column:
    return F.when(F.coalesce(strict.predicate(), F.lit(False)), EXACT_BONUS).otherwise(0.0) if relaxed else F.lit(0.0)


def in_order(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return scored.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in ORDER]).offset(offset).limit(limit)


@dataclass(frozen=True)
class Relaxation:
    applied: bool
    strict_count: int
    count: int
    dropped: tuple[str, ...] = ()
    filters: Filters = Filters()

    @property
    def message(self) -> str | None:
        if not self.applied:
            return None
        # The wording of the message.
        some = "No companies" if not self.strict_count else f"Only {self.strict_count} compan{'y' if self.strict_count == 1 else 'ies'}"
        were = "constraint was" if len(self.dropped) == 1 else "constraints were"
        tail = f", with the {self.strict_count} exact match{'' if self.strict_count == 1 else 'es'} listed first." if self.strict_count else "."
        return f"{some} matched every constraint, so the {', '.join(self.dropped)} {were} relaxed. Showing {self.count} wider matches{tail}"


def relaxation_steps(strict: Filters) -> list[tuple[tuple[str, ...], Filters]]:
    """strict, then strict without one more constraint each, in order."""
    steps, now = [((), strict)], strict
    for name in RELAXABLE:
        if name in strict.active():
            now = now.without(name)
            steps.append(((*steps[-1][0], name), now))
    return steps


def relaxation_counts(entities: DataFrame, strict: Filters) -> DataFrame:
    """One row: the matches of each step, from one pass."""
    return entities.agg(*[F.count_if(F.coalesce(f.predicate(), F.lit(False))).alias(f"step{i}") for i, (_, f) in enumerate(relaxation_steps(strict))])


def relaxed(entities: DataFrame, strict: Filters, allowed: bool = True, enough: int = ENOUGH, counts: list[int] | None = None) -> Relaxation:
    """Gives up constraints until enough rows match; reports what it gave up. counts: the matches of each step, if known."""
    steps = relaxation_steps(strict)
    counts = counts or relaxation_counts(entities, strict).first()
    if not allowed or counts[0] >= enough or len(steps) == 1:
        return Relaxation(False, counts[0], counts[0], (), strict)
    at = next((i for i in range(1, len(steps)) if counts[i] >= enough), len(steps) - 1)
    if counts[at] == counts[0]:
        return Relaxation(False, counts[0], counts[0], (), strict)
    return Relaxation(True, counts[0], counts[at], steps[at][0], steps[at][1])


def scored(candidates: DataFrame, entities: DataFrame, requested: tuple[str, ...], strict: Filters, relaxation: Relaxation) -> DataFrame:
    """candidates with all boosts and their sum. Only narrow columns meet the candidates; texts come with the page."""
    narrow = entities.select("id", "topics", "location", "industry", "founded_year", "employee_count", "revenue_range")
    met = narrow.join(F.broadcast(candidates), "id")  # two pools of candidates at most
    parts = met.withColumns({
        "topic_score": topic_boost(requested),
        "exact_bonus": exact_bonus(strict, relaxation.applied),
        "proximity": proximity(strict, relaxation.dropped),
    })
    return parts.withColumn("score", F.round(total([F.col(c) for c in ("keyword_score", "vector_score", "topic_score", "exact_bonus", "proximity")]), DECIMALS))


def matched_on(filters: Filters) -> Column:
    """Why a row was found, in a fixed order."""
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    topics = F.transform(F.array_intersect(F.array(*map(F.lit, filters.topics)), F.col("topics")), lambda t: F.concat(F.lit("topic: "), t)) if filters.topics else F.array().cast("array<string>")
    member = lambda c, values: F.col(c).isin(list(values)) if values else F.lit(False)
    return F.concat(
        one(F.col("exact_bonus") > 0, F.lit("matches every requested constraint")),
        topics,
        one(member("location", filters.locations), F.concat(F.lit("location: "), F.col("location"))),
        one(member("industry", filters.industries), F.concat(F.lit("industry: "), F.col("industry"))),
        one(F.col("keyword_rank").isNotNull(), F.concat(F.lit("keyword rank "), (F.col("keyword_rank") + 1).cast("string"))),
        one(F.col("vector_rank").isNotNull(), F.concat(F.lit("semantic rank "), (F.col("vector_rank") + 1).cast("string"))),
    )


def breakdown() -> Column:
    return F.struct(
        F.round("keyword_score", 6).alias("keyword"),
        F.round("vector_score", 6).alias("vector"),
        F.round("topic_score", 6).alias("topic"),
        "keyword_rank",
        "vector_rank",
    )
