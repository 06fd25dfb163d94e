"""Exact cosine search over unit vectors, coverage, and a plain text embedder."""

from __future__ import annotations

import hashlib
import logging
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylens.functions.scalars import dot
from entitylens.functions.text import tokens
from entitylens.operators.lexical import DECIMALS
from entitylens.shared import maybe_in

log = logging.getLogger("entitylens")

#: Vectors are left out of a search if fewer of the rows than this have one.
LEAST_COVERAGE = 0.5
#: Ids of matches that are broadcast at most.
MOST_IDS = 200_000


def cosine(vectors: DataFrame, query: list[float], mask: Column | None = None) -> DataFrame:
    """id and cosine of the rows in mask (unit vectors are assumed). The query is a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if mask is None else vectors.where(mask)
    return rows.where(F.size("embedding") == len(query)).select("id", F.round(dot(F.col("embedding"), q), DECIMALS).alias("cosine"))


def matching(vectors: DataFrame, entities: DataFrame, mask: Column, count: int | None = None) -> DataFrame:
    """The vectors of the entities in mask (count of them, if known).

    The others' are left out before a join shuffles them: by the ids themselves where they
    are few, else by a filter of bits.
    """
    wanted = entities.where(mask).select("id")
    if count is not None and count <= MOST_IDS:
        return vectors.join(F.broadcast(wanted), "id")
    return maybe_in(vectors, F.col("id"), wanted, "matching-ids").join(wanted, "id")


def coverage(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: the share of entities that have a vector."""
    have = vectors.select(F.col("id"), F.lit(True).alias("_has")).distinct()
    return entities.select("id").join(have, "id", "left").agg(F.avg(F.col("_has").isNotNull().cast("double")).alias("coverage"), F.count("*").alias("n"))


class Embedder:
    """What a store needs of a text model: a name, documents() in batches, and query() through a cache of the last ones.

    A model trained with an instruction before queries names it in ``instruction``; documents never get it.
    """

    name = ""
    instruction = ""

    def __init__(self, dim: int = 384, kept: int = 2048):
        self.dim, self.kept = dim, kept
        self._cache: OrderedDict[str, np.ndarray] = OrderedDict()

    def documents(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def query(self, text: str) -> np.ndarray:
        key = text.strip().casefold()
        if key in self._cache:
            self._cache.move_to_end(key)
        else:
            self._cache[key] = self.documents([self.instruction + text])[0]
            if len(self._cache) > self.kept:
                self._cache.popitem(last=False)
        return self._cache[key]


def try_embedder(make: Callable[[int], Embedder], dim: int) -> Embedder | None:
    """The model, with the dimension that it really gives; None if it can't be made, and searches go on by words."""
    try:
        model = make(dim)
        real = model.documents(["warm-up"]).shape[-1]
    except Exception:  # noqa: BLE001  whatever a model's library raises
        log.exception("no embedder; searching by words only")
        return None
    if real != model.dim:
        log.warning("the embedder gives %d dimensions, not %d", real, model.dim)
        model.dim = real
    return model


class HashEmbedder(Embedder):
    """Unit vectors from hashed tokens: deterministic, without a model."""

    name = "hashed-tokens"

    def documents(self, texts: list[str]) -> np.ndarray:
        """All texts at once: each distinct token is hashed once, and adds one or takes one off in its place."""
        found = [tokens(t) for t in texts]
        names, at = np.unique(np.array([w for words in found for w in words] or [""], dtype=object).astype(str), return_inverse=True)
        hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in names.tolist()], np.uint64)
        out = np.zeros((len(texts), self.dim))
        row = np.repeat(np.arange(len(texts)), [len(words) for words in found])
        at = at[: len(row)]
        sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
        np.add.at(out, (row, (hashes % np.uint64(self.dim)).astype(np.int64)[at]), sign[at])
        return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)

    def _one(self, text: str) -> np.ndarray:
        return self.documents([text])[0]


def embedded(rows: DataFrame, text: Column, make: Callable[[], Embedder]) -> DataFrame:
    """id and embedding of each row, made in batches on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "embedding": list(model.documents(f["text"].tolist()).astype(np.float32))})

    return rows.select("id", text.alias("text")).mapInPandas(run, "id long, embedding array<float>")
