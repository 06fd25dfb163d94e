"""What several operators share: shared storage, document input, text units."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from entitylens.shared import CLEANUP, discard, maybe_flagged, maybe_in, shared_dir, stored  # noqa: F401  operators take them from here
from entitylens.shipping import ship

#: A word, as every operator here sees it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

MUL_A = np.uint64(0x9E3779B97F4A7C15)
MUL_B = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of ordered pairs of 64-bit identifiers."""
    h = (a ^ (a >> np.uint64(29))) * MUL_A + b * MUL_B
    h ^= h >> np.uint64(32)
    return h * MUL_A


def scrambled(a: np.ndarray, seed: int) -> np.ndarray:
    """Another uniform 64-bit hash of a for each seed."""
    h = (a + np.uint64((seed * 0x632BE59BD9B4E019 + 0x51) % 2**64)) * MUL_A
    h ^= h >> np.uint64(31)
    h *= MUL_B
    return h ^ (h >> np.uint64(33))
