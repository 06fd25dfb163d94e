"""The filter algebra: a small description of constraints and the predicate it stands for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from entitylens.functions.vocab import REVENUE_BUCKETS, buckets_overlapping

#: Constraints that may be given up, in this order; the others never are.
RELAXABLE = ("employees", "revenue", "founded", "industry")


@dataclass(frozen=True)
class Range:
    """Bounds of a number; None is open."""

    min: float | None = None
    max: float | None = None
    min_inclusive: bool = True
    max_inclusive: bool = True

    def __bool__(self) -> bool:
        return self.min is not None or self.max is not None

    def holds(self, c: Column) -> Column:
        """A missing number is in no range; it gives null, which no filter keeps."""
        parts = []
        if self.min is not None:
            parts.append(c >= self.min if self.min_inclusive else c > self.min)
        if self.max is not None:
            parts.append(c <= self.max if self.max_inclusive else c < self.max)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def describe(self) -> str:
        low = None if self.min is None else (">= " if self.min_inclusive else "> ") + amount_text(self.min)
        high = None if self.max is None else ("<= " if self.max_inclusive else "< ") + amount_text(self.max)
        return " and ".join(x for x in (low, high) if x) or "any"


def amount_text(v: float) -> str:
    for size, mark in ((1e9, "B"), (1e6, "M")):
        if v >= size:
            return f"{v / size:g}{mark}"
    return f"{v / 1e3:g}K" if v >= 1e4 and v == int(v) else f"{v:g}"


@dataclass(frozen=True)
class Filters:
    """All constraints together; an empty field is no constraint."""

    locations: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    founded: Range = Range()
    employees: Range = Range()
    revenue_buckets: tuple[str, ...] | None = None
    exclude_ids: tuple[int, ...] = ()

    def parts(self) -> dict[str, Column]:
        """Each active constraint as a predicate. Values outside the vocabulary match nothing."""
        out: dict[str, Column] = {}
        if self.locations:
            out["location"] = F.col("location").isin(list(self.locations))
        if self.industries:
            out["industry"] = F.col("industry").isin(list(self.industries))
        if self.topics:
            out["topic"] = F.arrays_overlap("topics", F.array(*map(F.lit, self.topics)))
        if self.founded:
            out["founded"] = self.founded.holds(F.col("founded_year"))
        if self.employees:
            out["employees"] = self.employees.holds(F.col("employee_count"))
        if self.revenue_buckets:
            known = [b for b in self.revenue_buckets if b in REVENUE_BUCKETS]
            out["revenue"] = F.col("revenue_range").isin(known) if known else F.lit(False)
        if self.exclude_ids:
            out["exclude"] = ~F.col("id").isin(list(self.exclude_ids))
        return out

    def predicate(self) -> Column:
        return reduce(lambda a, b: a & b, self.parts().values(), F.lit(True))

    def active(self) -> list[str]:
        held = {"location": self.locations, "industry": self.industries, "topic": self.topics, "founded": self.founded, "employees": self.employees, "revenue": self.revenue_buckets}
        return [name for name, values in held.items() if values]

    def without(self, name: str) -> Filters:
        cleared = {"location": {"locations": ()}, "industry": {"industries": ()}, "topic": {"topics": ()}, "founded": {"founded": Range()}, "employees": {"employees": Range()}, "revenue": {"revenue_buckets": None}}
        return replace(self, **cleared[name])


@dataclass(frozen=True)
class Explicit:
    """Filters a caller sets next to a query: None keeps what was parsed, an empty list clears it."""

    locations: Sequence[str] | None = None
    industries: Sequence[str] | None = None
    topics: Sequence[str] | None = None
    founded_after: int | None = None
    founded_before: int | None = None
    min_employees: int | None = None
    max_employees: int | None = None
    min_revenue: float | None = None
    max_revenue: float | None = None
    exclude_ids: Sequence[int] = ()

    def over(self, parsed: Filters) -> Filters:
        """parsed with these on top; bounds set here are inclusive."""
        lists = {k: tuple(v) for k in ("locations", "industries", "topics") if (v := getattr(self, k)) is not None}
        out = replace(parsed, **lists)
        for field, low, high in (("founded", self.founded_after, self.founded_before), ("employees", self.min_employees, self.max_employees)):
            r = getattr(out, field)
            if low is not None:
                r = replace(r, min=low, min_inclusive=True)
            if high is not None:
                r = replace(r, max=high, max_inclusive=True)
            out = replace(out, **{field: r})
        if self.min_revenue is not None or self.max_revenue is not None:
            out = replace(out, revenue_buckets=tuple(buckets_overlapping(self.min_revenue, self.max_revenue)))
        return replace(out, exclude_ids=(*out.exclude_ids, *self.exclude_ids))
