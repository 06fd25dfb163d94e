"""Builds a store from a file of records: python -m entitylens.build --dataset FILE --store DIR [--skip-vectors] [--rebuild]."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from entitylens.sources.companies import read_records
from entitylens.store import Store


def build(spark: SparkSession, dataset: str, path: str, skip_vectors: bool = False, rebuild: bool = False) -> dict:
    """Ingests, then embeds. If embedding fails, the index of words stays usable and the report says why."""
    store, began = Store(spark, path), time.perf_counter()
    if rebuild or not store.meta():
        report = store.ingest(read_records(spark, dataset))
    else:
        report = {"corpus_size": store.meta()["rows"], "kept": True}
    if not skip_vectors:
        try:
            store.embed()
        except Exception as e:  # noqa: BLE001
            report["vectors_failed"] = str(e)[:500]
    seconds = time.perf_counter() - began
    return report | store.summary() | {"seconds": round(seconds, 2), "rows_per_second": round(report.get("read", 0) / seconds, 1)}


def main() -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dataset", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--skip-vectors", action="store_true")
    p.add_argument("--rebuild", action="store_true")
    a = p.parse_args()
    report = build(SparkSession.builder.appName("entitylens-build").getOrCreate(), a.dataset, a.store, a.skip_vectors, a.rebuild)
    print(json.dumps(report, indent=2))
    return 0 if report["ready"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
