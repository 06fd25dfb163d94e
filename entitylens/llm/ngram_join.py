"""Similarity join on word n-gram sets by chosen paths.

A text is the set of its runs of five words; two texts are linked if the Jaccard
similarity of their sets is 0.8 or more. Texts with equal sets are merged first.

Candidates: each run samples from every set the tokens whose hash, seeded by run
and level, lies below branching / size. Sets that share a sampled token meet in
its bucket; a pair at the threshold does with probability 1 - exp(-0.8
branching) in each run and level. Small buckets are compared by brute force.
Larger ones are split by the next level's sampled tokens, so that sets which
share only a common passage drift apart while similar ones stay together. A
bucket that splitting doesn't shrink, as its sets are alike, is compared at once.
Runs are repeated until the target recall: ``runs_for`` gives their number from
the chance that one run misses a pair although all its buckets reach the last
level.

Brute force looks at 256-bit sketches (one bit for each of 256 minimum hashes)
and set sizes, and keeps pairs whose sketches agree as pairs at the threshold do
but for a chance below 1e-7. What passes is only ever reduced to a forest
(``forest``): a bucket is compared block by block; each block sends its most
central sets on, as leaders, to join the blocks; then only sets outside the
bucket's main class are held against all its blocks, where these sets fit one
block. So a bucket of g alike sets makes g edges and one pass over its rows.
After the first runs, buckets that lie in one class are left out, and others give
edges between classes only.

Where more sets than a block lie outside the main class, as pages of one template
do whose similarity stays below the threshold, blocks aren't paired. A bucket of
sketches is then one component; sets of one component meet by their rare n-grams
(``rare_links``): of two linked sets, with n-grams ordered from rare to frequent
in the component, the first one that they share stands early in both, how early
follows from both sizes. Sets that share only what the template has don't meet.

The forest's components hold all links; inside each component, exact set
intersections decide, by the same kind of forest (classes). Where the number of
links of each row is asked for, sets of one class are counted in pairs of large
blocks: the one step whose work grows with the square of different sets, those of
one class; ``keep_first``, which needs classes only, doesn't do it.

Texts and sets are named by 256- and 128-bit digests.

Defined cases: a text with fewer than five words is one run of all its words;
null texts and texts without words have no set, are alone in their class and
have no links; very long texts are taken whole, one at a time; a null id counts
as any other value; repeated rows and equal sets link each other; empty input
gives no rows; other columns, whatever their names, are ignored (``keep_first``
passes them through).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylens.llm.common import maybe_flagged, maybe_in, mix, scrambled, stored, table
from entitylens.llm.components import components

WORDS = 5
SIMILARITY = 0.8
LEVELS = 3
BRANCHING = 2.5
#: The least chance to find a pair at the threshold whose buckets all reach the last level.
RECALL = 1 - 1e-6
#: Runs before buckets within one class are left out.
FIRST_RUNS = 2
#: Sets in a bucket that is compared at once.
SMALL = 48
#: A bucket whose large children would hold this share of its rows is not split; judged by so many of its sets.
DENSE, JUDGED = 0.8, 64
#: Sets in a block of sketches; sets and n-grams in a block of exact sets.
BLOCK = 4096
BLOCK_SETS, BLOCK_GRAMS = 2048, 1_000_000
#: Blocks that are packed at once, as a batch of rows may hold many small ones.
PACKED_AT_ONCE = 64
#: Words whose identifiers a worker holds.
WORDS_HELD = 100_000
#: Bytes of the rows that reach a worker at once; one row more where a single one is larger, as packed blocks are.
BATCH_BYTES = 8 << 20
#: N-grams by which two blocks of sets are multiplied at once.
WIDTH = 1024
#: Classes of a block that send a leader on have this share of its sets at least.
LED = 1 / 8
SKETCH_BITS = 256
#: Of 256 bits, a pair at 0.8 agrees in 230.4 on average, with a deviation of 4.8.
AGREE = 204


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    """Runs until a pair at the threshold is found with this chance."""
    missed = 1 - (1 - math.exp(-similarity * BRANCHING)) ** LEVELS
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


RUNS = runs_for(RECALL)


class WordIds(dict):
    """64-bit identifiers of words; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS_HELD:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def gram_set(raw: bytes, ids: WordIds, words: int = WORDS) -> np.ndarray:
    """Sorted distinct identifiers of the runs of ``words`` words."""
    found = raw.split()
    if not found:
        return np.array([], np.uint64)
    w = np.fromiter(map(ids.__getitem__, found), np.uint64, len(found))
    width = min(words, len(w))
    out = scrambled(w[: len(w) - width + 1], width)
    for k in range(1, width):
        out = mix(out, w[k : len(w) - width + 1 + k])
    return np.unique(out)


def bits_of(grams: np.ndarray) -> np.ndarray:
    """One bit of each of 256 minimum hashes of a set, packed into four integers.

    Large sets fill four one-permutation tables of 64 cells; cells that stay empty,
    and all of a small set, take the minimum of a hash of their own.
    """
    worst = np.iinfo(np.uint64).max
    least = np.full(SKETCH_BITS, worst, np.uint64)
    if len(grams) >= SKETCH_BITS:
        for k in range(4):
            h = np.sort(scrambled(grams, 77 + k))
            cell = (h >> np.uint64(58)).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
            least[64 * k + cell[first]] = h[first] & np.uint64(2**58 - 1)
    empty = np.flatnonzero(least == worst)
    for part in np.array_split(empty, max(1, len(empty) * len(grams) // 500_000)):
        seeds = scrambled(part.astype(np.uint64), 1000)
        least[part] = scrambled(grams[None] ^ seeds[:, None], 1001).min(1)
    return np.packbits((scrambled(least, 5) & np.uint64(1)).astype(np.uint8)).view("<u8")


#: N-grams hashed for all runs at once, so that a very long text needs no more memory than others.
SAMPLED_AT_ONCE = 8192
SEEDS = scrambled(np.arange(RUNS * LEVELS, dtype=np.uint64), 10_000)


def sampled(grams: np.ndarray) -> list[list[list[int]]]:
    """The tokens that a set samples, hashed: by level, then by run."""
    most = BRANCHING / len(grams)
    rows, tokens = [], []
    for at in range(0, len(grams), SAMPLED_AT_ONCE):
        h = scrambled(grams[None, at : at + SAMPLED_AT_ONCE] ^ SEEDS[:, None], 10_001)
        row, column = np.nonzero(h < np.uint64(int(most * 2**64))) if most < 1 else np.nonzero(np.ones(h.shape, bool))
        rows.append(row)
        tokens.append(h[row, column].view(np.int64))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    found = np.split(np.concatenate(tokens)[order], np.searchsorted(row[order], np.arange(1, len(SEEDS))))
    each = [x.tolist() for x in found]
    return [each[i * RUNS : (i + 1) * RUNS] for i in range(LEVELS)]


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, text -> doc_id, text_key, set_key, n, and what a set needs where this task meets it first."""
    ids, seen = WordIds(), set()
    kind = pa.list_(pa.list_(pa.int64()))
    for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        keys, n, bits = [], [], []
        levels: list[list] = [[] for _ in range(LEVELS)]
        for text in b.column(2):
            grams = gram_set((text.as_py() or "").encode(), ids)
            n.append(len(grams))
            key = hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None
            keys.append(key)
            if key is None or key in seen:
                bits.append(None)
                for x in levels:
                    x.append(None)
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(key)
            bits.append(bits_of(grams).tobytes())
            for x, tokens in zip(levels, sampled(grams), strict=True):
                x.append(tokens)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), *[pa.array(x, kind) for x in levels]],
            names=["doc_id", "text_key", "set_key", "n", "bits", *[f"level{i}" for i in range(LEVELS)]],
        )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys, from batches sorted by the keys."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            v = np.asarray(b.column(k))
            new[1:] |= v[1:] != v[:-1]
        if kept and any(kept[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(kept)
            kept = []
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield pa.Table.from_batches([*kept, b.slice(0, last)])
            kept = []
        kept.append(b.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def _alike(n1: np.ndarray, s1: np.ndarray, n2: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow a similarity of SIMILARITY; arrays broadcast against each other."""
    sizes = np.minimum(n1, n2) >= SIMILARITY * np.maximum(n1, n2) - 1e-9
    differ = np.bitwise_count(s1 ^ s2).sum(-1, dtype=np.int64)
    return sizes & (differ <= SKETCH_BITS - AGREE)


def _bits(column: pa.ChunkedArray | pa.Buffer) -> np.ndarray:
    raw = b"".join(column.to_pylist()) if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(raw, "<u8").reshape(-1, SKETCH_BITS // 64)


def united(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names in pairs (rows of two), sorted, and the least name of each one's component."""
    names, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    least = np.arange(len(names))
    while len(a):
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least[a] == least[b]).all():
            break
    return names, names[least]


def edge_rows(names: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    out = names != roots
    return pa.RecordBatch.from_arrays([pa.array(roots[out].astype(np.int64)), pa.array(names[out].astype(np.int64))], names=["a", "b"])


def _small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the pairs of sets that pass, from small buckets; a bucket's rows stand together."""
    for t in _runs(batches, ["k"]):
        k, sid, n, bits = np.asarray(t["k"]), np.asarray(t["sid"]), np.asarray(t["n"]), _bits(t["bits"])
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, SMALL):
            at = np.flatnonzero(k[d:] == k[:-d])
            if not len(at):
                break
            at = at[_alike(n[at], bits[at], n[at + d], bits[at + d])]
            found.append(np.stack([sid[at], sid[at + d]], 1))
        yield edge_rows(*united(np.concatenate(found)))


#: Whether each of the given rows of one block is linked to each row of another.
Against = Callable[[np.ndarray], np.ndarray]
Kernel = Callable[[dict, dict], Against]


def sketched(a: dict, b: dict) -> Against:
    """Links by sizes and sketches."""
    return lambda rows: _alike(a["n"][rows, None], a["bits"][rows, None], b["n"][None], b["bits"][None])


def exact(a: dict, b: dict) -> Against:
    """Links of sets: intersection / union >= 0.8, in whole numbers. A row's link to itself is left open."""
    every, owner = np.concatenate(b["grams"]), np.repeat(np.arange(len(b["sid"])), b["n"])
    width = WIDTH

    def against(rows: np.ndarray) -> np.ndarray:
        asked = [a["grams"][i] for i in rows]
        names, own = np.unique(np.concatenate(asked), return_inverse=True)
        at = np.minimum(np.searchsorted(names, every), len(names) - 1)
        hit = names[at] == every
        column, holder = at[hit], owner[hit]
        # Of a block against itself, n-grams of one set only say nothing.
        useful = np.bincount(column, minlength=len(names)) > (a is b)
        place = np.cumsum(useful) - 1
        left = (np.repeat(np.arange(len(rows)), [len(x) for x in asked]), own)
        sides = []
        for row, col in (left, (holder, column)):
            keep = useful[col]
            row, col = row[keep], place[col[keep]]
            order = np.argsort(col, kind="stable")
            sides.append((row[order], col[order]))
        both = np.zeros((len(rows), len(b["sid"])), np.float32)
        for c in range(0, int(useful.sum()), width):
            m = [np.zeros((n, width), np.float32) for n in both.shape]
            for (row, col), x in zip(sides, m, strict=True):
                i, j = np.searchsorted(col, [c, c + width])
                x[row[i:j], col[i:j] - c] = 1
            both += m[0] @ m[1].T
        return 9 * both.astype(np.int64) >= 4 * (a["n"][rows, None] + b["n"][None])

    return against


def most_central(bits: np.ndarray) -> int:
    """The set whose sketch is nearest to the majority's bits."""
    bits = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)
    return int((bits != (2 * bits.sum(0, dtype=np.int64) > len(bits))).sum(1).argmin())


def joined(a: dict, b: dict, kernel: Kernel, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Classes (``root``) of two blocks that the kernel's links unite: their names, and the least name of what they are now in.

    A block against itself (a is b) begins with its most central set. Rows that are in that
    one's class need no look of their own: whatever is outside is held against all rows.
    """
    roots = np.unique(np.concatenate([a["root"], b["root"]]))
    now = roots.copy()
    left, right = np.searchsorted(roots, a["root"]), np.searchsorted(roots, b["root"])
    against, todo = kernel(a, b), np.arange(len(left))
    centre = most_central(a["bits"]) if a is b else None
    while len(todo):
        rows, todo = (todo[:step], todo[step:]) if centre is None or len(todo) < len(left) else (np.array([centre]), np.delete(todo, centre))
        i, j = np.nonzero(against(rows) & (now[left[rows]][:, None] != now[right][None]))
        if len(i):
            names, least = united(np.unique(np.stack([now[left[rows]][i], now[right][j]], 1), axis=0))
            place = np.minimum(np.searchsorted(names, now), len(names) - 1)
            now = np.where(names[place] == now, least[place], now)
        if centre is not None:
            todo = todo[now[left[todo]] != now[left[centre]]]
    return roots, now


def leaders(block: dict, roots: np.ndarray, now: np.ndarray) -> list[int]:
    """The most central set of each class that holds much of a block."""
    cls = now[np.searchsorted(roots, block["root"])]
    names, size = np.unique(cls, return_counts=True)
    members = [np.flatnonzero(cls == name) for name in names[size >= max(2, LED * len(cls))]]
    return [int(at[most_central(block["bits"][at])]) for at in members]


def _packed(names: list[str], keys: list[str]):
    """One row for each block: its columns' values, packed. Rows come sorted by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            cols = {c: np.asarray(t[c]) for c in keys}
            change = np.zeros(t.num_rows, bool)
            for v in cols.values():
                change[1:] |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change)])
            ends = np.concatenate([starts[1:], [t.num_rows]])
            for at in range(0, len(starts), PACKED_AT_ONCE):
                some = slice(at, at + PACKED_AT_ONCE)
                out = {c: pa.array(v[starts[some]]) for c, v in cols.items()}
                base = starts[at]
                part = t.slice(base, ends[some][-1] - base)
                edges = list(zip(starts[some] - base, ends[some] - base, strict=True))
                for c in names:
                    if pa.types.is_binary(t[c].type):
                        v = part[c].to_pylist()
                        out[c] = pa.array([b"".join(v[i:j]) for i, j in edges], pa.binary())
                    else:
                        v = np.asarray(part[c]).astype(np.int64)
                        out[c] = pa.array([v[i:j].tobytes() for i, j in edges], pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as packed rows are large; what is packed is read where it lies."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: v[i].as_buffer() if pa.types.is_binary(v.type) else v[i].as_py() for c, v in zip(b.schema.names, b.columns, strict=True)}


def _unpacked(row: dict) -> dict:
    block = {c: np.frombuffer(row[c], "<i8") for c in ("sid", "n", "root", "rows") if c in row} | {"bits": _bits(row["bits"])}
    if "grams" in row:
        block["grams"] = np.split(np.frombuffer(row["grams"], "<u8"), np.cumsum(block["n"])[:-1])
    return block


def _packed_blocks(rows: DataFrame, keys: list[str], names: list[str], run=None, schema: str = "") -> DataFrame:
    """rows by their blocks (keys), one row each, with the columns in names packed.

    With run, what it makes of these rows: in the same worker, so that packed rows don't pass through the JVM.
    """
    packed, pack = rows.repartition(*keys).sortWithinPartitions(*keys), _packed(names, keys)
    if run:
        return packed.mapInArrow(lambda batches: run(pack(batches)), schema)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return packed.mapInArrow(pack, ", ".join([*[f"{k} {kind[k]}" for k in keys], *[f"{n} binary" for n in names]]))


def _paired(left: DataFrame, right: DataFrame, at: list[str], run, schema: str) -> DataFrame:
    """run(left row, right row) over rows of two frames with the same columns that agree in ``at``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for row in _rows(batches):
            now = tuple(row[c] for c in at)
            if held and held[0] == now:
                yield from run(held[1], row)
                held = None
            else:
                held = (now, row)

    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return both.repartition(*at).sortWithinPartitions(*at, "_side").mapInArrow(over, schema)


def one_class(wide: DataFrame) -> DataFrame:
    """Edges that make each bucket one component; wide: root, _main."""
    return wide.where("root <> _main").select(F.col("_main").alias("a"), F.col("root").alias("b")).distinct()


def _gram_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, sid, packed n-grams -> k, sid, one n-gram."""
    for row in _rows(batches):
        grams = np.frombuffer(row["grams"], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row[c])) for c in ("k", "sid")] + [pa.array(grams)], names=["k", "sid", "g"])


def _linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ra, rb, and two sets' packed n-grams -> ra, rb of those that are linked."""
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            x, y = (np.frombuffer(b.column(c)[i].as_buffer(), "<u8") for c in ("ga", "gb"))
            keep[i] = 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("ra", "rb")], names=["a", "b"])


def rare_pairs(traits: DataFrame) -> DataFrame:
    """ra, rb, a, b: pairs of sets of one bucket and of different classes that may be linked.

    traits: k, sid, root, n, main (whether root is the bucket's main class), grams.
    A set's n-grams are ordered by their number of sets in the bucket; ``r`` is how many
    stand from one on. If it is the first that two linked sets of n and m have in common,
    both have 9 r >= 4 (n + m), and 5 m >= 4 n. So the smaller set stands for its
    n-grams with 9 r >= 8 m, and the larger one asks for a range of sizes, by bands of
    about 3 %.
    """
    each = traits.select("k", "sid", "grams").mapInArrow(_gram_list, "k long, sid long, g long")
    often = each.groupBy("k", "g").agg(F.count("*").alias("c")).where("c > 1")
    own = each.join(often, ["k", "g"]).groupBy("k", "sid").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("o"))
    placed = own.join(traits.drop("grams"), ["k", "sid"]).select("k", "sid", "root", "n", "main", F.size("o").alias("m"), F.posexplode("o").alias("i", "x"))
    early = stored(placed.select("k", F.col("x.g").alias("g"), "sid", "root", "n", "main", (F.col("m") - F.col("i")).cast("long").alias("r")).where("5 * r >= 4 * n"), "rare-grams")
    band = lambda n: F.floor(F.log(n) * 32).cast("int")
    held = early.where("9 * r >= 8 * n").select("k", "g", F.col("sid").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("r").alias("hb"), F.col("main").alias("mb"), band(F.col("n")).alias("band"))
    low, high = F.expr("(4 * n + 4) div 5"), F.expr("least(n, 9 * r div 4 - n)")
    asks = early.select("k", "g", F.col("sid").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("r").alias("ha"), F.col("main").alias("ma"), low.alias("low"), high.alias("high")).where("low <= high")
    asks = asks.withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("high"))))).drop("low", "high")
    # Two sets of the main class never meet.
    met = asks.where("not ma").join(held, ["k", "g", "band"]).unionByName(asks.where("ma").join(held.where("not mb"), ["k", "g", "band"]))
    passed = met.where("ra <> rb and nb <= na and 5 * nb >= 4 * na and 9 * least(ha, hb) >= 4 * (na + nb)")
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return passed.select(pick("ra", "rb").alias("ra"), pick("rb", "ra").alias("rb"), pick("a", "b").alias("a"), pick("b", "a").alias("b")).distinct()


def rare_links(wide: DataFrame) -> DataFrame:
    """Edges between the classes of linked sets, found by rare n-grams; wide: k, sid, root, _main, n, grams."""
    traits = stored(wide.select("k", "sid", "root", "n", (F.col("root") == F.col("_main")).alias("main"), "grams"), "apart")
    grams = traits.select("sid", "grams")
    pairs = stored(rare_pairs(traits), "rare-pairs")
    both = pairs.join(grams.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("sid").alias("b"), F.col("grams").alias("gb")), "b")
    return stored(both.select("ra", "rb", "ga", "gb").mapInArrow(_linked_pairs, "a long, b long").distinct(), "rare-links")


def forest(rows: DataFrame, kernel: Kernel, block: int, name: str, beyond: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) between classes that join whatever the kernel's links join within each bucket.

    rows: k, nb (blocks of the bucket), sid, root (the class so far), n, bits and what else the kernel reads.
    beyond makes the edges of buckets with more than a block of sets outside their main class.
    """
    names = [c for c in rows.columns if c not in ("k", "nb")]
    placed = rows.withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = _unpacked(row)
            roots, now = joined(x, x, kernel)
            edges = edge_rows(roots, now)
            led = x["sid"][leaders(x, roots, now)] if row["nb"] > 1 else np.zeros(0, np.int64)
            k = [None] * edges.num_rows + [row["k"]] * len(led)
            columns = [pa.array(k, pa.int64()), *[pa.array(np.concatenate([np.asarray(c), led])) for c in edges.columns]]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "a", "b"])

    first = stored(_packed_blocks(placed, ["k", "blk", "nb"], names, within, "k long, a long, b long"), f"{name}-blocks")
    edges = first.where("k is null").select("a", "b")
    wide = rows.where("nb > 1")
    if wide.limit(1).count() == 0:
        return edges
    # Leaders of the blocks of a bucket are a bucket of their own, far smaller.
    led = first.where("k is not null").select("k", F.col("a").alias("sid"))
    many = led.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    edges = edges.unionByName(forest(stored(wide.drop("nb").join(led, ["k", "sid"]).join(many, "k"), f"{name}-leaders"), kernel, block, name, beyond))
    # Sets outside the bucket's main class, up to a block of them, meet all its blocks.
    classes = components(edges).select(F.col("node").alias("root"), F.col("root").alias("_now"))
    wide = wide.join(classes, "root", "left").withColumn("root", F.coalesce("_now", "root")).drop("_now")
    main = wide.groupBy("k", "root").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "root"))["root"].alias("_main"))
    wide = stored(wide.join(stored(main, f"{name}-main"), "k"), f"{name}-wide")
    rest = wide.where("root <> _main")
    extent = stored(rest.groupBy("k").agg((F.count("*") > block).alias("many")), f"{name}-rest")
    few, many = extent.where("not many").select("k"), extent.where("many").select("k")
    held = wide.join(few, "k").withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
    left = _packed_blocks(rest.join(few, "k"), ["k", "nb"], names).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")
    right = _packed_blocks(held, ["k", "blk"], names)

    def across(x: dict, y: dict) -> Iterator[pa.RecordBatch]:
        yield edge_rows(*joined(_unpacked(x), _unpacked(y), kernel))

    edges = edges.unionByName(stored(_paired(left, right, ["k", "blk"], across, "a long, b long"), f"{name}-across"))
    if many.limit(1).count() == 0:
        return edges
    return edges.unionByName(beyond(wide.join(many, "k")))


def dense_buckets(large: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """k of the large buckets (k, r, sid, c) that sampling tokens of a level would not shrink.

    About JUDGED sets of each bucket, by hash, sample tokens. If those in children
    that would be large again add up to DENSE of them, most of the bucket's sets are
    alike. This only chooses how a bucket is compared; no set is left out.
    """
    judged = large.where(F.pmod(F.xxhash64("k", "sid"), F.col("c")) < JUDGED)
    asked = judged.select("k", "c", "r", "sid").join(sets.select("sid", f"level{level}"), "sid")
    children = asked.select("k", "c", F.explode(F.get(F.col(f"level{level}"), F.col("r"))).alias("t")).groupBy("k", "c", "t").agg(F.count("*").alias("n"))
    held = children.where((F.col("n") > 1) & (F.col("n") * F.col("c") > SMALL * JUDGED)).groupBy("k").agg(F.sum("n").alias("held"))
    total = judged.groupBy("k").agg(F.count("*").alias("n"))
    return held.join(total, "k").where(F.col("held") >= DENSE * F.col("n")).select("k")


def buckets(sets: DataFrame, rooted: DataFrame, runs: range, name: str) -> tuple[DataFrame, DataFrame]:
    """Small and large buckets of some runs; sets: sid, levels; rooted: sid, root (the class so far), level0.

    A large bucket is split only if that shrinks it; one of similar sets is compared as it is.
    A bucket within one class can join nothing, nor can its children, so it ends here.
    Most tokens are of one set only and few sets are in large buckets, so the others' rows
    are left out before tokens meet their sizes and sets their next tokens.
    """
    now = rooted.select("sid", "root", F.posexplode("level0").alias("r", "tokens")).where(F.col("r").between(runs.start, runs.stop - 1))
    now = now.select("sid", "root", "r", F.explode("tokens").alias("t")).select(F.xxhash64("r", "t").alias("k"), "r", "sid", "root")
    small = wide = None
    for level in range(LEVELS):
        # Stored, so that the join reads plain exchanges and Spark can split a hot bucket's partition.
        mixed = now.groupBy("k").agg(F.count("*").cast("int").alias("c"), F.min("root").alias("_a"), F.max("root").alias("_z")).where("_a <> _z")
        sizes = stored(mixed.select("k", "c"), f"{name}-sizes{level}")
        if level == 0:
            now = maybe_in(now, F.col("k"), sizes.select("k"), f"{name}-shared-tokens")
        met = stored(now.join(sizes, "k"), f"{name}-buckets{level}")
        part, large = met.where(F.col("c") <= SMALL).select("k", "sid"), met.where(F.col("c") > SMALL)
        small = part if small is None else small.unionByName(part)
        if level == 0:
            sets = stored(maybe_in(sets.select("sid", *[f"level{i}" for i in range(1, LEVELS)]), F.col("sid"), large.select("sid"), f"{name}-split"), f"{name}-next-tokens")
        if level + 1 < LEVELS:
            dense = stored(dense_buckets(large, sets, level + 1), f"{name}-dense{level}")
            kept, large = large.join(dense, "k", "left_semi"), large.join(dense, "k", "left_anti")
            deeper = large.select("k", "r", "sid", "root").join(sets.select("sid", f"level{level + 1}"), "sid")
            now = deeper.withColumn("t", F.explode(F.get(F.col(f"level{level + 1}"), F.col("r")))).select(F.xxhash64("k", "t").alias("k"), "r", "sid", "root")
        else:
            kept = large
        wide = kept if wide is None else wide.unionByName(kept)
    return small, wide


def candidates(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between set ids whose components hold every link; sets: sid, n, bits, levels.

    The classes of the first runs spare the later ones most of their buckets.
    """
    traits, edges = sets.select("sid", "n", "bits"), None
    for runs, name in ((range(FIRST_RUNS), "first"), (range(FIRST_RUNS, RUNS), "later")):
        rooted = sets.withColumn("root", F.col("sid"))
        if edges is not None:
            classes = components(edges).select(F.col("node").alias("sid"), F.col("root").alias("_now"))
            all_sets = maybe_flagged(sets.select("sid", "level0"), F.col("sid"), classes.select("sid"), "classed")
            classed = all_sets.where("_maybe").join(classes, "sid", "left").select("sid", F.coalesce("_now", "sid").alias("root"), "level0")
            rooted = stored(classed.unionByName(all_sets.where("not _maybe").select("sid", F.col("sid").alias("root"), "level0")), "classes-so-far")
        small, wide = buckets(sets, rooted, runs, name)
        pairs = stored(small.join(traits, "sid").repartition("k").sortWithinPartitions("k").mapInArrow(_small_pairs, "a long, b long"), f"{name}-small")
        placed = stored(wide.join(traits, "sid").withColumn("nb", F.ceil(F.col("c") / block).cast("int")).select("k", "nb", "sid", "root", "n", "bits"), f"{name}-wide")
        found = pairs.unionByName(forest(placed, sketched, block, f"{name}-sketches", one_class))
        edges = found if edges is None else edges.unionByName(found)
    return edges


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = WordIds()
    for b in batches:
        grams = [gram_set(t.as_py().encode(), ids).tobytes() for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(grams, pa.binary())], names=[*b.schema.names[1:], "grams"])


def _counts(x: dict, y: dict) -> Iterator[pa.RecordBatch]:
    """For each set of two blocks (or of one): how many rows it links to in the other."""
    a, b = _unpacked(x), None if x is y else _unpacked(y)
    links = exact(a, b or a)(np.arange(len(a["sid"])))
    if b is None:
        np.fill_diagonal(links, False)
    sid, n = [a["sid"]], [links.astype(np.float64) @ (b or a)["rows"].astype(np.float64)]
    if b is not None:
        sid, n = [*sid, b["sid"]], [*n, links.T.astype(np.float64) @ a["rows"].astype(np.float64)]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sid)), pa.array(np.concatenate(n).astype(np.int64))], names=["sid", "links"])


def link_counts(placed: DataFrame) -> DataFrame:
    """sid, links: the rows that each set links to; placed: k, nb, sid, n, rows, bits, grams."""
    names = ["sid", "n", "rows", "bits", "grams"]
    blocks = stored(_packed_blocks(placed.withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")), ["k", "blk", "nb"], names), "blocks-of-sets")
    one = blocks.mapInArrow(lambda batches: (t for row in _rows(batches) for t in _counts(row, row)), "sid long, links long")
    at = ["k", "_lo", "_hi"]
    wide = blocks.where("nb > 1")
    low = wide.withColumns({"_lo": F.col("blk"), "_hi": F.explode(F.sequence(F.col("blk") + 1, F.col("nb")))}).where("_hi < nb")
    high = wide.where("blk > 0").withColumns({"_hi": F.col("blk"), "_lo": F.explode(F.sequence(F.lit(0), F.greatest(F.col("blk") - 1, F.lit(0))))})
    pairs = _paired(low.select(*at, *names), high.select(*at, *names), at, _counts, "sid long, links long")
    return one.unionByName(pairs).groupBy("sid").agg(F.sum("links").alias("links"))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: bool = True, block: int = BLOCK, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, text_key, class_id (the least id of its component), n_links (if count) and whether it is the first of its class, of each row.

    block and block_sets: how many sketches, and exact sets, a block holds.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, min(BATCH_BYTES, int(before.removesuffix("b")) if before and before.removesuffix("b").isdigit() else BATCH_BYTES))
    try:
        return _linked(df, id_col, text_col, count, block, block_sets)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def blocked(sets: DataFrame, block_sets: int) -> DataFrame:
    """sets (k, n, ...) with nb, the blocks of exact sets that a bucket takes."""
    size = F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / block_sets)).cast("int")
    return sets.join(stored(sets.groupBy("k").agg(size.alias("nb")), "blocks"), "k")


def _linked(df: DataFrame, id_col: str, text_col: str, count: bool, block: int, block_sets: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("_text"))
    levels = [f"level{i}" for i in range(LEVELS)]
    kinds = ", ".join(f"{x} array<array<long>>" for x in levels)
    rows = stored(docs.mapInArrow(_set_rows, f"doc_id long, text_key binary, set_key binary, n int, bits binary, {kinds}"), "gram-sets")
    # One row for each set, with a number of its own; one text stands for it.
    once = lambda c: F.first(c, ignorenulls=True).alias(c)
    merged = rows.where("set_key is not null").groupBy("set_key").agg(F.count("*").alias("rows"), F.min("text_key").alias("text_key"), F.max("n").alias("n"), once("bits"), *map(once, levels))
    sets = stored(merged.withColumn("sid", F.monotonically_increasing_id()), "sets")
    groups = components(candidates(sets.select("sid", "n", "bits", *levels), block)).select(F.col("node").alias("sid"), F.col("root").alias("k"))
    traits = sets.select("sid", "text_key", "rows", F.col("n").cast("long").alias("n"), "bits")
    chosen = stored(maybe_in(traits, F.col("sid"), groups.select("sid"), "grouped").join(groups, "sid"), "grouped-sets")
    # Only texts of sets in groups are shuffled; equal ones are merged before they meet their group.
    texts = maybe_in(docs, F.col("text_key"), chosen.select("text_key"), "grouped-texts")
    members = texts.dropDuplicates(["text_key"]).join(chosen, "text_key").select("_text", "k", "sid", "rows", "n", "bits")
    grams = stored(members.mapInArrow(_gram_rows, "k long, sid long, rows long, n long, bits binary, grams binary"), "group-sets")
    placed = blocked(grams, block_sets).select("k", "nb", "sid", F.col("sid").alias("root"), "n", "bits", "grams")
    classes = components(forest(placed, exact, block_sets, "links", rare_links)).select(F.col("node").alias("sid"), F.col("root").alias("cls"))
    info = sets.select("set_key", "sid", "rows").join(classes, "sid", "left").withColumn("cls", F.coalesce("cls", "sid"))
    n_links = F.lit(None).cast("long")
    if count:
        classed = grams.drop("k").join(classes.withColumnRenamed("cls", "k"), "sid")
        info = info.join(link_counts(blocked(classed, block_sets)), "sid", "left")
        n_links = F.coalesce(F.coalesce("links", F.lit(0)) + F.col("rows") - 1, F.lit(0))
    every = rows.select("doc_id", "text_key", "set_key").join(stored(info, "set-classes"), "set_key", "left")
    named = stored(every.select("doc_id", "text_key", "cls", n_links.alias("n_links")), "linked-rows")
    least = stored(named.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_key")).alias("first")), "classes")
    out = named.join(least, "cls", "left")
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links", (F.col("cls").isNull() | (F.col("first") == F.struct("doc_id", "text_key"))).alias("first"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates and number of links."""
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: All pairs of sets that share a run of words, counted; classes by label propagation.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM w WHERE len(w) > 0),
sets AS (SELECT g, min(doc_id) AS rep, count(*) AS n FROM grams GROUP BY g),
flat AS MATERIALIZED (SELECT rep, unnest(g) AS t FROM sets),
often AS (SELECT t FROM flat GROUP BY t HAVING count(*) > 1),
inter AS MATERIALIZED (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM (FROM flat SEMI JOIN often USING (t)) a JOIN flat b ON a.t = b.t AND a.rep <> b.rep GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y, q.n AS m FROM inter JOIN sets p ON p.rep = x JOIN sets q ON q.rep = y WHERE 9 * c >= 4 * (len(p.g) + len(q.g))),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
cls AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x),
links AS (SELECT x, sum(m) AS m FROM link GROUP BY x)
SELECT d.doc_id, coalesce(cls.class_id, s.rep, d.doc_id)::BIGINT AS class_id, (coalesce(links.m, 0) + coalesce(s.n, 1) - 1)::BIGINT AS n_links
FROM documents d LEFT JOIN grams USING (doc_id) LEFT JOIN sets s ON s.g = grams.g LEFT JOIN links ON links.x = s.rep LEFT JOIN cls ON cls.x = s.rep
"""


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the least id. Rows that repeat id and text are one.

    Columns named ``_near_key``, ``_near_id`` or ``_near_text`` can't be passed through.
    """
    found = linked(df, id_col, text_col, count=False)
    drop = found.where(~F.col("first")).select(F.col("doc_id").alias("_near_id"), F.col("text_key").alias("_near_text")).distinct()
    left = df.withColumn("_near_key", text_key(F.coalesce(F.col(text_col), F.lit(""))))
    stay = left.join(drop, (F.col(id_col).cast("long").eqNullSafe(F.col("_near_id"))) & (F.col("_near_key") == F.col("_near_text")), "left_anti")
    again = found.where("first").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    out = stay.dropDuplicates([id_col, "_near_key"]) if again else stay
    return out.select(*df.columns)
