"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if some string of ``length`` bytes that covers it starts at two or
more places of the corpus. Suffixes with the same next ``length`` bytes have to
be found, and that by refining buckets:

1. Identifiers of 8-byte strings are doubled twice, each time by the identifier
   at the later offset, to identifiers of 32-byte grams. Only *anchors* become
   suffixes to sort: the least gram of each window of ``length`` bytes. Equal
   windows have equal anchors at equal distances, so no repeat is lost, and one
   byte in about 185 is an anchor. Anchors are sorted into buckets by gram.
2. A bucket is refined by the identifiers of later offsets: every 32 bytes over
   the stretch [first window's start, last window's end) that shares the anchor.
   Where a refined bucket still has two places, all its windows repeat.
3. Other anchors with a common gram stay only if the half window before or after
   them is common too: each window holds one of the two. They are refined again,
   by cells of CELL window starts. A cell has an identifier for what all its
   windows share (if alone in its bucket, none of them repeats) and one for all
   they cover (if not alone, all repeat).
4. In cells that are neither, each window gets its own identifier. Only cells
   outside the known ones matter, as all windows of an anchor overlap.

This departs from the textbook's refinement in one point: the identifier of a
bucket is not its rank after a sort of the whole corpus but a hash of the pointers
below it, so that every task can look later offsets up in the text at hand instead
of joining a table of all suffixes; rounds 2 to 4 are the refinement's rounds, and
only suffixes whose buckets still hold several go on to the next.

An identifier is a 64-bit hash of the pointers below it, and a refined bucket is
keyed together with its gram's, so 128 bits decide. Buckets are only ever
counted, by their least and greatest place, before they are shuffled; no bucket
is gathered, whatever its size. Equal texts count as one text while suffixes are
sorted; they repeat whole if they have ``length`` bytes.

Texts cross the network once, those with a common gram only after equal ones
have been merged. A text is named by 60 bits of its digest; names that two
digests share are found beforehand and replaced, so no two texts are mixed up.

Defined cases: a null text is an empty one; texts shorter than ``length`` keep
all bytes; very long texts are taken whole, in overlapping stretches; a null id
stays null; overlapping and periodic repeats count; repeated rows repeat each
other; empty input gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylens.llm.common import discard, mix, scrambled, stored, table

#: Hexadecimal digits of a text's digest that name it.
NAME_DIGITS = 15
#: Replaced names that are broadcast at most.
MOST_RENAMED = 100_000
GRAM = 32
CELL = 16
#: Bytes looked at together; longer texts are cut into overlapping stretches of this size.
STRETCH = 1 << 20
#: Bytes of short texts that are looked at together.
AT_ONCE = 1 << 16
PLACE_MASK = np.uint64(STRETCH - 1)


def gram_ids(raw: bytes) -> np.ndarray:
    """Identifier of the GRAM bytes at each offset."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    ids, width = scrambled(words, 1), 8
    while width < GRAM:
        ids = mix(ids[:-width], ids[width:])
        width *= 2
    return ids


def stretch_ids(grams: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Identifiers of the strings [start, start + size), size <= most, from the grams at every GRAM-th offset."""
    out = scrambled(size.astype(np.uint64), 2)
    last = size - GRAM
    for k in range(-(-most // GRAM)):
        more = k * GRAM < last + GRAM
        at = start + np.minimum(k * GRAM, last)
        out = np.where(more, mix(out, grams[np.where(more, at, start)]), out)
    return out


def least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """Offset of the least gram (the first of equals) in each window of ``width`` grams."""
    key = (grams & ~PLACE_MASK) | np.arange(len(grams), dtype=np.uint64)
    n = len(key)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    return (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & PLACE_MASK).astype(np.int64)


def stretches(raw: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text's overlapping stretches with their places; each window lies in one of them."""
    step = STRETCH - length
    for base in range(0, len(raw) - length + 1, step):
        yield base, raw[base : base + step + length - 1]


def together(parts: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Parts (their last value: bytes) in lists of ``most`` bytes at most, or of one that is longer."""
    kept, size = [], 0
    for p in parts:
        if kept and size + len(p[-1]) > most:
            yield kept
            kept, size = [], 0
        kept.append(p)
        size += len(p[-1])
    if kept:
        yield kept


def anchors_together(parts: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """(kid, anchor, first window, last window, gram, all they cover, half window before, half window after).

    parts: kid, place in the text, bytes. They are looked at as one string, of whose windows
    only those within a part count, as a short text costs more in calls than in bytes.
    A half that the text doesn't hold is 0.
    """
    half = length // 2
    raw = b"".join(p for *_, p in parts)
    size = np.array([len(p) for *_, p in parts])
    ends = np.cumsum(size)
    grams = gram_ids(raw)
    # Window starts, and the part that each lies in.
    windows = size - length + 1
    owner = np.repeat(np.arange(len(parts)), windows)
    starts = np.arange(len(owner)) + np.repeat(ends - size - np.cumsum(windows) + windows, windows)
    at = least_grams(grams, length - GRAM + 1)[starts]
    # Windows of two parts have no anchor in common.
    new = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    first, last = starts[new], starts[np.concatenate([new[1:], [len(at)]]) - 1]
    at, owner = at[new], owner[new]
    whole = stretch_ids(grams, first, last - first + length, 2 * length - GRAM)
    # The distance from a window's start to its anchor is at least half, or what follows is longer than half.
    has_before, has_after = at - first >= half, at - last < half
    before = np.where(has_before, stretch_ids(grams, np.maximum(at - half, 0), np.full(len(at), half + GRAM), half + GRAM), np.uint64(0))
    after = np.where(has_after, stretch_ids(grams, np.minimum(at, len(raw) - half), np.full(len(at), half), half), np.uint64(0))
    kid, base = (np.array(x, np.int64) for x in list(zip(*parts, strict=True))[:2])
    moved = (base - (ends - size))[owner]
    return kid[owner], at + moved, first + moved, last + moved, grams[at], whole, before, after


def anchors(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What anchors_together gives for one text, by stretches and without kid."""
    for base, part in stretches(raw, length):
        yield anchors_together([(0, base, part)], length)[1:]


SIGNED = lambda a: pa.array(np.ascontiguousarray(a).view(np.int64))


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, new = set(), []
            for i, k in enumerate(b.column(0).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    new.append((i, k))
            parts = ((k, base, part) for i, k in new for base, part in stretches(b.column(1)[i].as_py(), length))
            found = [anchors_together(some, length) for some in together(parts, min(AT_ONCE, STRETCH))]
            if found:
                kid, at, first, last, *ids = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [kid, at, (at - first).astype(np.int32), (last - at).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *map(SIGNED, ids)], names=["kid", "at", "back", "ahead", "gram", "whole", "before", "after"])

    return run


def _cell_rows(length: int):
    """Identifiers of the cells of each anchor that isn't settled."""

    def of(raw: bytes, found: list[dict]) -> tuple[np.ndarray, ...]:
        at, lo, hi = (np.array([x[c] for x in found], np.int64) for c in ("at", "lo", "hi"))
        grams = gram_ids(raw)
        # Distances from a window's start to its anchor, by cells on one grid for all anchors.
        cells = np.arange((length - GRAM) // CELL + 1)
        row, cell = np.nonzero((cells[None] * CELL <= hi[:, None]) & (cells[None] * CELL + CELL - 1 >= lo[:, None]))
        near, far, a = cell * CELL, cell * CELL + CELL - 1, at[row]
        share = stretch_ids(grams, a - near, np.full(len(a), length - CELL + 1), length - CELL + 1)
        inside = (far <= hi[row]) & (near >= lo[row])
        size = np.where(inside, length + CELL - 1, length)
        start = np.where(inside, a - far, np.clip(a - near, 0, len(raw) - length))
        cover = np.where(inside, stretch_ids(grams, start, size, length + CELL - 1), np.uint64(0))
        return a, cell.astype(np.int32), share, cover, inside, np.maximum(lo[row], near), np.minimum(hi[row], far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                for i in range(0, len(found), 2000):
                    a, cell, share, cover, inside, lo, hi = of(raw, found[i : i + 2000])
                    columns = [pa.array(np.full(len(a), k, np.int64)), pa.array(a), pa.array(cell), SIGNED(share), SIGNED(cover), pa.array(inside), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["kid", "at", "cell", "share", "cover", "inside", "lo", "hi"])

    return run


def _window_rows(length: int):
    """Identifiers of the single windows of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                grams = gram_ids(text.as_py())
                for i in range(0, len(found), 2000):
                    part = found[i : i + 2000]
                    at, lo, hi, share = (np.array([x[c] for x in part], np.int64) for c in ("at", "lo", "hi", "share"))
                    row = np.repeat(np.arange(len(at)), hi - lo + 1)
                    d = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
                    one = stretch_ids(grams, at[row] - d, np.full(len(row), length), length)
                    rest = np.array([x["rest"] for x in part])[row]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int64)), pa.array(at[row]), pa.array(d.astype(np.int32)), pa.array(share[row]), SIGNED(one), pa.array(rest)], names=["kid", "at", "d", "share", "one", "rest"])

    return run


def kept_bytes(raw: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs, and what is kept."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, [x["s"] for x in spans], 1)
    np.add.at(edge, [x["e"] for x in spans], -1)
    gone = np.cumsum(edge)[:-1] > 0
    change = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    runs = list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True))
    return runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


SPANS = "array<struct<s:bigint,e:bigint>>"


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            out = [kept_bytes(t.as_py(), s) for t, s in zip(part.column(1), part.column(2).to_pylist(), strict=True)]
            runs = [[{"s": s, "e": e} for s, e in x] for x, _ in out]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array([k for _, k in out], pa.binary())], names=["kid", "spans", "kept"])


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets (keys) that hold two places (kid, at) or more.

    They are stored, so that joins with them read plain exchanges on both sides and
    Spark can split the partition of a hot bucket.
    """
    place = F.xxhash64("kid", "at")
    buckets = rows.groupBy(*keys).agg(F.min(place).alias("_a"), F.max(place).alias("_z")).where(F.col("_a") != F.col("_z")).select(*keys)
    return stored(buckets, "repeated-buckets")


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (kid, raw): texts that may hold repeats, and the spans (kid, s, e) of repeats between different texts or places."""
    half = length // 2
    rows = stored(docs.where(F.octet_length("raw") >= length).mapInArrow(_anchor_rows(length), "kid long, at long, back int, ahead int, gram long, whole long, before long, after long"), "anchors")
    common = stored(rows.join(repeated(rows, ["gram"]), "gram", "left_semi"), "common-grams")
    discard(rows)
    settled = stored(common.groupBy("gram", "whole").agg(F.min(F.struct("kid", "at")).alias("a"), F.max(F.struct("kid", "at")).alias("z")), "refined-buckets")
    marked = stored(common.join(settled, ["gram", "whole"]).withColumn("sure", F.col("a") != F.col("z")), "marked")
    discard(common, settled)
    # A settled bucket sends one suffix on, for the other buckets of its gram to meet.
    some = marked.where(~F.col("sure") | (F.struct("kid", "at") == F.col("a"))).select("kid", "at", "back", "ahead", "before", "after", "sure").distinct()
    flag = lambda c: repeated(some.where(F.col(c) != 0), [c]).withColumn(f"{c}_met", F.lit(True))
    halves = some.join(flag("before"), "before", "left").join(flag("after"), "after", "left")
    lo = F.greatest(-F.col("ahead"), F.when(F.col("after_met"), F.lit(0)).otherwise(F.lit(half)))
    hi = F.least(F.col("back"), F.when(F.col("before_met"), F.lit(length)).otherwise(F.lit(half - 1)))
    open_ = stored(halves.where("before_met or after_met").select("kid", "at", lo.alias("lo"), hi.alias("hi")).where("lo <= hi"), "open-anchors")
    sure = marked.where("sure").select("kid", "at", (F.col("at") - F.col("back")).alias("s"), (F.col("at") + F.col("ahead") + length).alias("e"))
    wanted = sure.select("kid").union(open_.select("kid")).distinct()
    texts = stored(docs.dropDuplicates(["kid"]).join(wanted, "kid", "left_semi").select("kid", "raw"), "texts-with-common-grams")
    by_text = open_.groupBy("kid").agg(F.collect_set(F.struct("at", "lo", "hi")).alias("found"))
    cells = stored(texts.join(by_text, "kid").select("kid", "raw", "found").mapInArrow(_cell_rows(length), "kid long, at long, cell int, share long, cover long, inside boolean, lo int, hi int"), "cells")
    shared = repeated(cells, ["cell", "share"])
    covered = repeated(cells.where("inside"), ["cell", "cover"]).withColumn("all", F.lit(True))
    met = cells.join(shared, ["cell", "share"], "left_semi").join(covered, ["cell", "cover"], "left")
    state = stored(met.withColumn("all", F.col("inside") & F.coalesce("all", F.lit(False))).select("kid", "at", "cell", "share", "all", "lo", "hi"), "cell-states")
    discard(cells)
    full = stored(state.where("all").groupBy("kid", "at").agg(F.min("cell").alias("first"), F.max("cell").alias("last")), "repeating-cells")
    # All windows of an anchor overlap, so what lies between two repeats is covered.
    outer = F.col("first").isNull() | (F.col("cell") < F.col("first")) | (F.col("cell") > F.col("last"))
    judged = stored(state.join(full, ["kid", "at"], "left").withColumn("rest", ~F.col("all") & outer).select("kid", "at", "cell", "share", "lo", "hi", "rest"), "cells-to-split")
    discard(state)
    # Their windows are held against those of all cells in the same buckets, settled or not.
    split = judged.join(stored(judged.where("rest").select("cell", "share").distinct(), "cells-in-doubt"), ["cell", "share"], "left_semi")
    lists = split.groupBy("kid").agg(F.collect_list(F.struct("at", "lo", "hi", "share", "rest")).alias("found"))
    windows = stored(texts.join(lists, "kid").select("kid", "raw", "found").mapInArrow(_window_rows(length), "kid long, at long, d int, share long, one long, rest boolean"), "windows")
    discard(judged)
    twice = repeated(windows, ["d", "share", "one"])
    start = F.col("at") - F.col("d")
    ones = windows.where("rest").join(twice, ["d", "share", "one"], "left_semi").select("kid", "at", start.alias("s"), (start + length).alias("e"))
    blocks = full.select("kid", "at", (F.col("at") - F.col("last") * CELL - (CELL - 1)).alias("s"), (F.col("at") - F.col("first") * CELL + length).alias("e"))
    # One span for each anchor: its first to its last repeat.
    refined = ones.unionByName(blocks).unionByName(sure).groupBy("kid", "at").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = stored(refined.select("kid", "s", "e"), "repeats")
    discard(windows, full, marked)
    return texts, spans


def named(rows: DataFrame) -> DataFrame:
    """rows (with raw) with kid, a long that names the text. Names that two texts share are replaced by negative ones."""
    digest = F.sha2("raw", 256)
    rows = rows.withColumn("kid", F.conv(F.substring(digest, 1, NAME_DIGITS), 16, 10).cast("long"))
    seen = rows.select("kid", digest.alias("digest"))
    shared = stored(seen.groupBy("kid").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("kid"), "shared-names")
    if shared.limit(1).count() == 0:
        return rows
    renamed = stored(seen.join(shared, "kid", "left_semi").select(F.col("digest").alias("_digest")).distinct().withColumn("_kid", -1 - F.monotonically_increasing_id()), "renamed")
    renamed = F.broadcast(renamed) if renamed.count() <= MOST_RENAMED else renamed
    out = rows.withColumn("_digest", digest).join(renamed, "_digest", "left")
    return out.withColumn("kid", F.coalesce("_kid", "kid")).drop("_kid", "_digest")


def without_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, the removed runs (``spans``, of bytes) and ``kept``, the bytes that stay, of each row."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("doc_id"), raw.alias("raw"))
    rows = named(rows)
    texts, spans = repeated_spans(rows.select("kid", "raw"), length)
    by_text = spans.groupBy("kid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    cut = texts.join(by_text, "kid").select("kid", "raw", "spans").mapInArrow(_kept_rows, f"kid long, spans {SPANS}, kept binary")
    size = F.octet_length("raw").cast("long")
    copies = rows.where(size >= length).groupBy("kid").agg(F.count("*").alias("n")).where("n > 1").select("kid", F.lit(True).alias("_copied"))
    # A text that is all repeats has nothing left, whatever else was found in it.
    changes = stored(cut.join(copies, "kid", "full_outer").select("kid", "_copied", F.when(F.col("_copied").isNull(), F.col("spans")).alias("spans"), F.when(F.col("_copied").isNull(), F.col("kept")).alias("kept")), "changed-texts")
    out = rows.withColumn("n_bytes", size).join(changes, "kid", "left")
    copied = F.col("_copied").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, all_of_it).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.when(copied, F.lit("").cast("binary")).otherwise(F.coalesce("kept", "raw")).alias("kept"),
    )


def dedup(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of each row, from its text without repeats."""
    out = without_repeats(df, length, id_col, text_col)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6(spark, sf_dir: str) -> DataFrame:
    """What each document loses to byte strings of 400 that stand elsewhere too."""
    return dedup(table(spark, sf_dir, "documents"))
