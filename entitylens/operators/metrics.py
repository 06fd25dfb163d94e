"""Figures about runs: nearest-rank percentiles, recent windows, counters, checks."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager
from time import perf_counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylens.operators.filters import Filters

RECENT = 4096
POINTS = (50, 90, 95, 99)


def nearest_rank(values: list[float], p: float) -> float:
    return sorted(values)[round(p / 100 * (len(values) - 1))] if values else 0.0


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank percentiles, maximum and mean of each group, without gathering a group.

    A value's rank comes from counts: equal values are summed first, then ranked by
    their running count, so what is sorted is the distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(by).orderBy("_v")))
    totals = df.groupBy(by).agg(F.count(value).alias("n"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))
    place = {p: F.bround(F.lit(p / 100) * (F.col("n") - 1)) + 1 for p in POINTS}
    picked = upto.join(totals.select(by, "n"), by).groupBy(by).agg(*[F.min(F.when(F.col("_upto") >= place[p], F.col("_v"))).alias(f"p{p}") for p in POINTS])
    return totals.join(picked, by)


def median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The mean of the two middle values of each group, from counts of distinct values, without gathering a group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(by).orderBy("_v")))
    totals = df.groupBy(by).agg(F.count(value).alias("_all"))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col("_v")))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    picked = upto.join(totals, by).groupBy(by).agg(((at(low) + at(high)) / 2).alias("median"))
    return totals.select(by).join(picked, by, "left")


def recent(df: DataFrame, by: str, time: str, tie: str, most: int = RECENT) -> DataFrame:
    """The last rows of each group, as a ring buffer would hold them."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time), F.desc(tie)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def violations(results: DataFrame, filters: Filters) -> DataFrame:
    """One row: how many results contradict each constraint; a missing number contradicts none."""
    parts = filters.parts()
    return results.agg(*[F.count_if(~p).alias(name) for name, p in parts.items()], F.count("*").alias("n"))


class Metrics:
    """Counters, gauges and recent timings of a process."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.counters: Counter[str] = Counter()
        self.gauges: dict[str, float] = {}
        self.timings: dict[str, deque[float]] = {}

    @staticmethod
    def key(name: str, labels: dict[str, object]) -> str:
        return name + ("{" + ",".join(f"{k}={labels[k]}" for k in sorted(labels)) + "}" if labels else "")

    def incr(self, name: str, value: float = 1, **labels: object) -> None:
        self.counters[self.key(name, labels)] += value

    def gauge(self, name: str, value: float, **labels: object) -> None:
        self.gauges[self.key(name, labels)] = value

    def observe_ms(self, name: str, ms: float, **labels: object) -> None:
        self.timings.setdefault(self.key(name, labels), deque(maxlen=RECENT)).append(ms)

    @contextmanager
    def timer(self, name: str, **labels: object) -> Iterator[None]:
        began = perf_counter()
        try:
            yield
        finally:
            self.observe_ms(name, (perf_counter() - began) * 1000, **labels)

    def snapshot(self) -> dict[str, object]:
        figures = {k: {"count": len(v), "max": max(v), "mean": sum(v) / len(v)} | {f"p{p}": nearest_rank(list(v), p) for p in POINTS} for k, v in self.timings.items()}
        return {"counters": dict(self.counters), "gauges": dict(self.gauges), "timings": figures}


def counter_key(name: str, labels: list[str]) -> Column:
    """The same key for rows: name{label=value,...} with labels sorted."""
    pairs = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(labels)]
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("}"))
