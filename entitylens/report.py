"""A report on an engine: latency by question and mode, throughput, and whether results keep what was asked."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from statistics import median
from time import perf_counter

from entitylens.operators.metrics import nearest_rank, violations
from entitylens.plans.engine import Engine, Request


def _ms(run) -> float:
    began = perf_counter()
    run()
    return (perf_counter() - began) * 1000


def _points(ms: Sequence[float]) -> dict[str, float]:
    return {f"p{p}_ms": round(nearest_rank(list(ms), p), 2) for p in (50, 95, 99)}


def measure(engine: Engine, questions: Sequence[str], repeats: int = 3, clients: Sequence[int] = (1, 4), calls: int = 16) -> dict:
    """Relaxed results are checked too, against the filters they were relaxed to."""
    ask = lambda q, mode="hybrid": engine.search(Request(q, mode=mode)).results.collect()
    cold = [_ms(lambda q=q: ask(q)) for q in questions]
    each = {q: [_ms(lambda q=q: ask(q)) for _ in range(repeats)] for q in questions}
    modes = {m: _points([_ms(lambda q=q, m=m: ask(q, m)) for q in questions]) for m in ("keyword", "semantic", "hybrid")}
    load = {}
    for n in clients:
        with ThreadPoolExecutor(n) as pool:
            wall = _ms(lambda pool=pool: list(pool.map(ask, [questions[i % len(questions)] for i in range(calls)])))
        load[str(n)] = round(calls / wall * 1000, 2)
    checks = {"questions": len(questions), "non_empty": 0, "relaxed": 0, "violations": 0}
    stages: dict[str, list[float]] = {}
    for q in questions:
        r = engine.search(Request(q, limit=10))
        found = violations(r.results, r.relaxation.filters).first().asDict()
        checks["non_empty"] += found.pop("n") > 0
        checks["relaxed"] += r.relaxation.applied
        checks["violations"] += sum(v or 0 for v in found.values())
        for k, v in r.timings_ms.items():
            stages.setdefault(k, []).append(v)
    warm = [x for v in each.values() for x in v]
    return {"warm": _points(warm), "cold": _points(cold), "by_question": {q: _points(v) for q, v in each.items()}, "modes": modes, "requests_per_second": load, "stage_median_ms": {k: round(median(v), 3) for k, v in stages.items()}, "checks": checks}


def render(report: dict) -> str:
    row = lambda name, p: f"| {name} | {p['p50_ms']} | {p['p95_ms']} | {p['p99_ms']} |"
    lines = ["# Search report", "", "| what | p50 ms | p95 ms | p99 ms |", "|-|-|-|-|", row("warm", report["warm"]), row("cold", report["cold"])]
    lines += [row(f"mode {m}", p) for m, p in report["modes"].items()]
    lines += [row(q, p) for q, p in report["by_question"].items()]
    lines += ["", "| clients | requests a second |", "|-|-|", *[f"| {n} | {v} |" for n, v in report["requests_per_second"].items()]]
    lines += ["", "| stage | median ms |", "|-|-|", *[f"| {k} | {v} |" for k, v in report["stage_median_ms"].items()]]
    lines += ["", "Checks: " + ", ".join(f"{k} {v}" for k, v in report["checks"].items()) + "."]
    return "\n".join(lines) + "\n"


def write(report: dict, folder: str) -> None:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "report.md").write_text(render(report))
    (out / "report.json").write_text(json.dumps(report, indent=2))
