"""Token counts: lengths of encodings, without keeping the ids.

Texts are cut at safe boundaries, where the tokenizer can never join what
stands on both sides: before a run of blanks, and before a line feed. The
vocabulary is read to prove that (no piece holds a blank mark after another
character, or a line feed; no normalisation). Each distinct chunk of a batch is
encoded once, and counts of recent chunks are kept in a bounded table, so a long
text is no heavier than its chunks. Encoding runs over slices of chunks that
hold about equally many bytes.

Defined cases: null counts as empty text, of 0 bytes and 0 tokens; repeated rows
are counted each; special strings in texts are plain text, as the library has
them by default; empty input gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylens.llm.common import table

#: Counts kept at most in each Python worker.
KEPT_CHUNKS = 400_000
#: Bytes of chunks given to the library at once.
SLICE_BYTES = 1 << 20
#: Longer chunks hold no safe boundary (one unbroken run) and are not kept.
KEPT_LENGTH = 200

CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
BLANK = "▁"


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts the pieces of texts as SentencePieceProcessor.encode gives them."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        probe = "ﬁé é  x \n y "
        plain = len(self.model.encode(" ")) == 1 and self.model.decode(self.model.encode(probe)) == probe
        self.safe = plain and not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.kept: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
                size += len(texts[end])
                end += 1
            out += map(len, self.model.encode(texts[at:end], num_threads=1))
            at = end
        return out

    def _learn(self, chunks: set[str]) -> dict[str, int]:
        """Counts of chunks. The library puts one blank before what it gets, so a chunk
        that begins with blanks goes without one of them, and after a line feed the
        blank before it counts as a piece of its own. Blanks alone stand behind a letter."""
        ask = sorted(chunks)
        as_texts, extra = [], []
        for c in ask:
            if c[0] == "\n":
                as_texts.append(c)
                extra.append(1)
            elif c.strip(" "):
                as_texts.append(c[1:] if c[0] == " " else "\n" + c)
                extra.append(0 if c[0] == " " else 2)
            else:
                as_texts.append("\n" + c)
                extra.append(2)
        return {c: n - e for c, n, e in zip(ask, self._encoded(as_texts), extra, strict=True)}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self._encoded(texts)
        # A text's own first blank is part of its first chunk.
        # A blank mark in a text is a blank to the library.
        chunks = [CHUNK.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        found = self.kept
        new = {c for cs in chunks for c in cs if c not in found}
        if new:
            if len(found) + len(new) > KEPT_CHUNKS:
                found = self.kept = {}
                new = {c for cs in chunks for c in cs}
            fresh = self._learn(new)
            if len(fresh) > KEPT_CHUNKS or any(len(c) > KEPT_LENGTH for c in fresh):
                found = {**found, **fresh}
                self.kept.update((c, n) for c, n in list(fresh.items())[:KEPT_CHUNKS] if len(c) <= KEPT_LENGTH)
            else:
                found.update(fresh)
        one = found.__getitem__
        return [sum(map(one, cs)) for cs in chunks]




def token_counts(df: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row of df."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path_of(model))
        for b in batches:
            texts = b.column(1)
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            counts: list[int] = []
            lengths = [int(n) for n in sizes]
            at = 0
            while at < len(lengths):
                end, size = at, 0
                while end < len(lengths) and (end == at or size + lengths[end] <= 8 << 20):
                    size += lengths[end]
                    end += 1
                counts += counter.counts(texts.slice(at, end - at).to_pylist())
                at = end
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    """The tokens of each whole document."""
    return token_counts(table(spark, sf_dir, "documents"))
