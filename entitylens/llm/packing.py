"""Packing by concatenate-and-cut.

All documents' ids form one stream, which is cut every ``window`` ids. The first
pass tokenizes each partition, stores its ids (two bytes each) with the count of
ids before each document in its partition, and so the partition totals. A prefix
sum over the totals gives every partition's offset in the stream; the second
pass reads the stored ids where they lie and cuts each document at the windows'
borders it spans. A document that lies on a border gives one record on each
side. Only the last sequence needs padding, and every id lies in exactly one
piece. Ids are never shuffled: only the offsets, one row for an input partition,
are sent to the tasks, up to MOST_OFFSETS of them; beyond that they are joined.

The stream's order is that of the stored table, which restarts read again, so
lost executors change nothing.

Defined cases: a null text is an empty one, whose only id is the closing 0; very
long texts are encoded whole, one at a time; a null id stays null; repeated rows
are packed each; empty input gives no pieces; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylens.llm.common import stored, table
from entitylens.llm.token_counts import path_of

#: Offsets of input partitions that are broadcast at most: 16 bytes each.
MOST_OFFSETS = 250_000
#: How a byte-level tokenizer of the library cuts texts before it merges.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The library writes bytes as letters: printable ones as themselves, the others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}


def merge_ranks(path: str, model) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as ranks by which merging gives the same ids; None if that isn't certain.

    Certain means: plain byte-level BPE without normalizer, with all 256 bytes; the merges stand in the order of
    the ids of what they make, each makes one token, and all tokens beyond the bytes are made so; and merging the
    bytes of each token by the file's own rules gives that token. Then two parts that make a token when put
    together stand side by side only if they are that token's own merge, so merging by rank takes the same steps.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    bpe, cut = spec["model"], spec["pre_tokenizer"] or {}
    odd = [bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    if bpe["type"] != "BPE" or any(odd) or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    special, letters = {t["content"] for t in spec["added_tokens"]}, byte_letters()
    vocab = {w: i for w, i in bpe["vocab"].items() if w not in special}
    if any(not set(w) <= letters.keys() for w in vocab) or not letters.keys() <= vocab.keys():
        return None
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    order = [vocab.get(w, -1) for w in made]
    whole = sorted(vocab, key=vocab.get) == sorted(letters, key=vocab.get) + made and all(a < b for a, b in zip(order, order[1:], strict=False))
    if not whole or any([t.value for t in model.tokenize(w)] != [w] for w in vocab):
        return None
    return {bytes(letters[c] for c in w): i for w, i in vocab.items()}


class IdEncoder:
    """Ids of whole texts, as little-endian 16-bit numbers, as the tokenizers library gives them.

    Where merging by rank is certain to give the library's ids, texts are encoded so,
    which is several times faster; those that hold a special token's string, and
    any other vocabulary, go through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path, self.model.model)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        library = [i for i, t in enumerate(texts) if self.fast is None or any(s in t for s in self.special)]
        out: list[bytes] = [b""] * len(texts)
        for i, found in zip(library, self.model.encode_batch_fast([texts[i] for i in library], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u2").tobytes()
        apart = set(library)
        for i, t in enumerate(texts):
            if i not in apart:
                out[i] = self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u2").tobytes()
        return out


@lru_cache(maxsize=1)
def encoder(name: str) -> IdEncoder:
    """One for each Python worker."""
    return IdEncoder(path_of(name))


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most):
            size += int(sizes[end])
            end += 1
        yield at, end
        at = end


def tokenized(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: its partition, the ids before it there, its own ids."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    last = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        model = encoder(tokenizer)
        for b in batches:
            texts = b.column(1)
            for i, j in _slices(np.asarray(pc.binary_length(texts)), 4 << 20):
                ids = [x + last for x in model.encode(texts.slice(i, j - i).to_pylist())]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int32)), b.column(0).slice(i, j - i), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], names=["_part", "doc_id", "_before", "doc_tokens", "_ids"])

    return rows.mapInArrow(run, f"_part int, doc_id {kind}, _before long, doc_tokens long, _ids binary")


def pack(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence.

    Each piece's ids are cut (binary, little-endian 32-bit) and their checksum is taken
    of them; keep_ids leaves them in the result.
    """
    docs = stored(tokenized(df, tokenizer, end_id, id_col, text_col), "token-ids")
    totals = docs.groupBy("_part").agg(F.sum("doc_tokens").alias("_total"))
    # One row for each input partition, not for each document.
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select("_part", F.coalesce(F.sum("_total").over(running), F.lit(0)).alias("_base")), "offsets")
    bases = F.broadcast(bases) if bases.count() <= MOST_OFFSETS else bases
    placed = docs.join(bases, "_part").select("doc_id", (F.col("_base") + F.col("_before")).alias("_at"), "doc_tokens", "_ids")
    kind = placed.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ids of many documents at once would take much memory.
        for b in (b.slice(i, j - i) for b in batches for i, j in _slices(np.asarray(b.column(2)), 1 << 20)):
            at, n = (np.asarray(b.column(i)) for i in (1, 2))
            pieces = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // window + nth
            begin = np.maximum(at[row], sequence * window)
            end = np.minimum((at + n)[row], (sequence + 1) * window)
            ids = b.column(3)
            cut = []
            now, wide = -1, b""
            for r, i, j in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist(), strict=True):
                if r != now:
                    now, wide = r, memoryview(np.frombuffer(ids[r].as_buffer(), "<u2").astype("<u4").tobytes())
                cut.append(bytes(wide[4 * i : 4 * j]))
            columns = [b.column(0).take(pa.array(row)), *map(pa.array, (begin - at[row], end - begin, n[row], sequence, begin - sequence * window))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], names=names)

    pieces = placed.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)


def op7(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024."""
    return pack(table(spark, sf_dir, "documents"))
