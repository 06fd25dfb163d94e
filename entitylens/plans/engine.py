"""The search engine: parse, filter, relax, retrieve, fuse, order, explain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylens.operators import rank
from entitylens.operators.bitmaps import counts_of
from entitylens.operators.blocks import BlockIndex
from entitylens.operators.filters import Explicit, Filters
from entitylens.operators.lexical import KeywordIndex, bm25, phrases, top_ranked
from entitylens.operators.metrics import Metrics
from entitylens.operators.vectors import LEAST_COVERAGE, cosine, coverage, matching
from entitylens.plans.nlq import Parsed, parse

POOL = 400
PAGE_COLUMNS = ["id", "name", "description", "industry", "location", "founded_year", "employee_count", "revenue_range", "topics"]


class InvalidRequest(ValueError):
    """A request outside the accepted bounds."""


class NotFound(LookupError):
    """No entity has the id."""


@dataclass(frozen=True)
class Request:
    query: str
    limit: int = 10
    offset: int = 0
    mode: str = "hybrid"
    filters: Explicit | None = None
    allow_relaxation: bool = True
    explain: bool = True

    def checked(self) -> Request:
        for ok, what in (
            (1 <= len(self.query.strip()) and len(self.query) <= 1000, "query must have 1 to 1000 characters"),
            (1 <= self.limit <= 100, "limit must be 1 to 100"),
            (0 <= self.offset <= 10_000, "offset must be 0 to 10000"),
            (self.mode in ("hybrid", "keyword", "semantic"), "mode must be hybrid, keyword or semantic"),
        ):
            if not ok:
                raise InvalidRequest(what)
        return self


@dataclass
class Response:
    """results is a plan: nothing ran for it yet but the count."""

    parsed: Parsed
    filters: Filters
    relaxation: rank.Relaxation
    results: DataFrame
    total: int
    mode: str
    fallback: bool = False
    timings_ms: dict[str, float] = field(default_factory=dict)


class Engine:
    """Searches over one snapshot: entities (indexed, enriched) and optionally vectors (id, embedding).

    vectors are left out if they cover too few entities. embed turns a question
    into a vector; without it, or without vectors, only words are searched. Words
    are looked up in the index, and matches counted in the bitmaps; without these, all
    entities are scanned, with the same results.
    """

    def __init__(self, entities: DataFrame, vectors: DataFrame | None = None, embed=None, check_coverage: bool = True, index: KeywordIndex | BlockIndex | None = None, bitmaps: DataFrame | None = None, lookup: Callable[[list[int]], DataFrame] | None = None):
        self.entities, self.embed, self.metrics, self.index, self.bitmaps = entities, embed, Metrics(), index, bitmaps
        #: The rows of some ids, from few files where the store knows them.
        self.lookup = lookup or (lambda ids: entities.where(F.col("id").isin(ids)))
        if vectors is not None and check_coverage:
            share = coverage(entities, vectors).first()
            vectors = vectors if share["n"] and share["coverage"] >= LEAST_COVERAGE else None
        self.vectors = vectors

    @property
    def semantic(self) -> bool:
        return self.vectors is not None and self.embed is not None

    def search(self, request: Request) -> Response:
        began = perf_counter()
        parsed = parse(request.checked().query)
        strict = request.filters.over(parsed.filters) if request.filters else parsed.filters
        parse_ms = (perf_counter() - began) * 1000
        began = perf_counter()
        # Excluded ids are no constraint that bitmaps hold.
        counts = counts_of(self.bitmaps, strict) if self.bitmaps is not None and not strict.exclude_ids else None
        relaxation = rank.relaxed(self.entities, strict, request.allow_relaxation, counts=counts)
        plan, mode, fallback = self.plan(parsed, strict, relaxation, request)
        self.metrics.incr("searches", mode=mode)
        return Response(parsed, strict, relaxation, plan, relaxation.count, mode, fallback, {"parse": parse_ms, "filter": (perf_counter() - began) * 1000})

    def plan(self, parsed: Parsed, strict: Filters, relaxation: rank.Relaxation, request: Request) -> tuple[DataFrame, str, bool]:
        """The page's plan: filters stand below both rankings, texts are joined to the page only."""
        mask, pool = relaxation.filters.predicate(), max(POOL, request.offset + request.limit)
        mode = request.mode if self.semantic else "keyword"
        terms = parsed.lexical_terms()
        keyword = vector = None
        if mode != "semantic" and phrases(terms):
            keyword = top_ranked(self._by_words(terms, mask, relaxation, pool), "bm25", "keyword_rank", pool)
        if mode != "keyword":
            vector = top_ranked(cosine(matching(self.vectors, self.entities, mask, relaxation.count), list(self.embed(parsed.semantic_text))), "cosine", "vector_rank", pool)
        fallback = keyword is None and vector is None
        if fallback:
            first = self.entities.where(mask).orderBy("id").limit(pool)
            keyword = first.select("id", F.lit(None).cast("double").alias("bm25"), F.lit(None).cast("long").alias("keyword_rank"))
        # What the question asks for decides boosts and reasons; explicit filters only decide what matches.
        found = rank.scored(rank.fused(keyword, vector), self.entities, parsed.filters.topics, strict, relaxation)
        page = rank.in_order(found, request.limit, request.offset)
        return self.hydrated(page, parsed.filters, request.explain), mode, fallback

    def _by_words(self, terms: list[str], mask: Column, relaxation: rank.Relaxation, pool: int) -> DataFrame:
        if isinstance(self.index, BlockIndex):
            return self.index.top(terms, pool, self.entities.where(mask) if relaxation.filters.parts() else None)
        return self.index.bm25(self.entities, terms, mask) if self.index else bm25(self.entities, terms, mask)

    def hydrated(self, page: DataFrame, parsed: Filters, explain: bool) -> DataFrame:
        """The page with its entities' fields; one whose entity is gone is left out."""
        why = page.withColumn("matched_on", rank.matched_on(parsed)).withColumn("score_breakdown", rank.breakdown() if explain else F.lit(None).cast("string"))
        kept = why.select("id", "score", "bm25", "cosine", "matched_on", *(["score_breakdown"] if explain else []))
        # A page has at most 100 rows.
        full = self.entities.select(*PAGE_COLUMNS).join(F.broadcast(kept), "id")
        return full.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in rank.ORDER]).drop("bm25", "cosine")

    def get(self, key: int) -> DataFrame:
        return self.lookup([key]).select(*PAGE_COLUMNS)

    def similar(self, key: int, limit: int = 10, same_industry: bool = False, same_location: bool = False) -> tuple[DataFrame, int]:
        """Entities like one: by vector, or by shared topics where it has none. Results and how many could match."""
        seed = self.lookup([key]).first()
        if seed is None:
            raise NotFound(f"no entity has id {key}")
        own = self.vectors.where(F.col("id") == key).first() if self.vectors is not None else None
        near = Filters(
            locations=(seed["location"],) if same_location and seed["location"] else (),
            industries=(seed["industry"],) if same_industry and seed["industry"] else (),
            topics=() if own else tuple(seed["topics"]),
            exclude_ids=(key,),
        )
        matches = self.entities.where(near.predicate()).count()
        requested = F.array(*map(F.lit, seed["topics"])) if seed["topics"] else F.array().cast("array<string>")
        shared = F.array_intersect(F.col("topics"), requested)
        reasons = F.transform(shared, lambda t: F.concat(F.lit("shared topic: "), t))
        if own:
            best = cosine(matching(self.vectors, self.entities, near.predicate(), matches), list(own["embedding"])).orderBy(F.desc("cosine"), "id").limit(limit)
            page = self.entities.select(*PAGE_COLUMNS).join(F.broadcast(best), "id")
            return page.select(*PAGE_COLUMNS, F.round("cosine", 6).alias("score"), reasons.alias("matched_on")).orderBy(F.desc("score"), "id"), matches
        first = self.entities.where(near.predicate()).orderBy("id").limit(limit)
        return first.select(*PAGE_COLUMNS, F.lit(1.0).alias("score"), reasons.alias("matched_on")), matches
