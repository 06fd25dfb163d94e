"""Quality by weak supervision: rules vote or abstain, and a posterior decides.

Each rule looks at whole-text figures and votes for a good (+1) or bad (-1)
document, or abstains (0). The votes of all documents, counted by pattern (at
most 3 to the number of rules, whatever the corpus), go through
expectation-maximisation on the driver: it estimates how often each rule is right
on good and on bad documents, and the share of good ones, without labels. A document is kept if its posterior
probability of being good reaches ``threshold``; no rule can reject it alone.

Defined cases: a null or empty text has no words, fails the base check and is
not kept; repeated rows count and get the same verdict each; empty input gives
no rows; other columns pass through unless named like one that is added.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylens.llm.common import stored, table

SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
IS_LETTER = np.array([chr(i).isascii() and chr(i).isalnum() or i >= 128 for i in range(256)])
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_lines", "n_symbol_words"]

#: (name, bad if, good if) on the figures; neither: the rule abstains.
RULES = [
    ("word_length", lambda x: not 2 <= x["word_chars"] / x["n_words"] <= 15, lambda x: 3 <= x["word_chars"] / x["n_words"] <= 10),
    ("symbols", lambda x: x["n_symbols"] > 0.1 * x["n_words"], lambda x: x["n_symbols"] < 0.02 * x["n_words"]),
    ("symbol_words", lambda x: x["n_symbol_words"] > 0.1 * x["n_words"], lambda x: x["n_symbol_words"] < 0.02 * x["n_words"]),
    ("letters", lambda x: x["n_letters"] < 0.9 * x["n_bytes"], lambda x: x["n_letters"] > 0.94 * x["n_bytes"]),
    ("repeated_lines", lambda x: x["n_dup_lines"] > 0.3 * x["n_lines"], lambda x: x["n_dup_lines"] <= 0.05 * x["n_lines"]),
    ("repeated_words", lambda x: x["n_repeat_words"] > 0.3 * x["n_words"], lambda x: x["n_repeat_words"] < 0.1 * x["n_words"]),
    ("line_words", lambda x: x["n_words"] < 2 * x["n_lines"], lambda x: x["n_words"] >= 5 * x["n_lines"]),
]


def figures(text: str | None) -> dict[str, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = {k for k, n in Counter(windows).items() if n > 1}
            hit = np.fromiter((k in often for k in windows), bool, len(windows))
            covered = np.zeros(len(words), bool)
            for d in range(3):
                covered[d : d + len(hit)] |= hit
            repeats = int(covered.sum())
    symbol_at = np.flatnonzero(IS_SYMBOL[joined])
    ends = np.cumsum([len(w) for w in words]) if len(symbol_at) else symbol_at
    return {
        "n_words": len(words),
        "word_chars": int(np.count_nonzero((joined & 0xC0) != 0x80)),
        "n_symbols": len(symbol_at),
        "n_symbol_words": len(np.unique(np.searchsorted(ends, symbol_at, "right"))),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeats,
        "n_letters": int(np.count_nonzero(IS_LETTER[joined])),
        "n_lines": len(lines),
        "n_bytes": len(joined),
    }


def pattern(x: dict[str, int]) -> int:
    """The rules' votes in base 3, first rule lowest: 0 abstains, 1 good, 2 bad."""
    if not x["n_words"]:
        return 0
    return sum(3**i * (2 if bad(x) else int(good(x))) for i, (_, bad, good) in enumerate(RULES))


def votes(code: int) -> list[int]:
    return [(0, 1, -1)[code // 3**i % 3] for i in range(len(RULES))]


Model = tuple[float, list[list[list[float]]]]


def fit(counts: dict[int, int], rounds: int = 200) -> Model:
    """Share of good documents, and for each rule how often it abstains, votes good
    and votes bad on good and on bad documents; all from counts of patterns.

    The rounds start from the view that each bad vote leaves a third of the odds
    and each good vote adds a tenth, which also says which class is the good one.
    """
    codes = sorted(counts)
    v = np.array([votes(c) for c in codes]).reshape(len(codes), len(RULES))
    n = np.array([counts[c] for c in codes], float)
    cast = np.stack([v == 0, v > 0, v < 0]).astype(float)
    good = 1 / (1 + np.exp(-(1 + 0.1 * (v > 0).sum(1) - 1.1 * (v < 0).sum(1))))
    share, how = 0.8, np.full((2, 3, len(RULES)), 1 / 3)
    for _ in range(rounds):
        for k, w in enumerate((n * good, n * (1 - good))):
            # Half a vote of each kind is added, so that no share is 0.
            how[k] = (np.einsum("p,cpr->cr", w, cast) + 0.5) / (w.sum() + 1.5)
        share = float(np.clip((n @ good + 1) / (n.sum() + 2), 0.02, 0.98))
        logit = np.einsum("cpr,cr->p", cast, np.log(how[0] / how[1])) + math.log(share / (1 - share))
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return share, how.tolist()


def posterior(code: int, model: Model) -> float:
    share, how = model
    kinds = [code // 3**i % 3 for i in range(len(RULES))]
    logit = math.log(share / (1 - share)) + sum(math.log(how[0][c][r] / how[1][c][r]) for r, c in enumerate(kinds))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def base_fails(x: dict[str, int]) -> bool:
    return x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]


def counted(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns in keep, the figures and the pattern of each row."""
    rows = df.select(*[F.col(c) for c in keep if c != text_col], F.col(text_col).alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} long" for n in FIGURES] + ["_pattern int, base_failed boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [figures(t.as_py()) for t in b.column(b.num_columns - 1)]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns += [pa.array([x[n] for x in found], pa.int64()) for n in FIGURES]
            columns += [pa.array([pattern(x) for x in found], pa.int32()), pa.array([base_fails(x) for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + FIGURES + ["_pattern", "base_failed"])

    return rows.mapInArrow(run, schema)


def fitted(rows: DataFrame) -> Model:
    """Accuracies from the patterns of all rows; what is collected has at most 3^7 rows."""
    return fit({r["_pattern"]: r["n"] for r in rows.groupBy("_pattern").agg(F.count("*").alias("n")).collect()})


def verdicts(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    spark = rows.sparkSession
    scores = [(c, posterior(c, model)) for c in range(3 ** len(RULES))]
    # 3^7 rows, whatever the input.
    known = F.broadcast(spark.createDataFrame(scores, "_pattern int, quality double"))
    return rows.join(known, "_pattern").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Figures, posterior ``quality`` and ``kept`` of each row."""
    rows = stored(counted(df, text_col, [id_col]), "quality-figures")
    return verdicts(rows, fitted(rows), threshold)


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that are kept, with df's columns.

    The model is fitted on all rows; the second pass computes the votes again next
    to the text, so that no text is shuffled or stored.
    """
    model = fitted(counted(df, text_col, []))
    passing = np.array([posterior(c, model) >= threshold for c in range(3 ** len(RULES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [figures(t.as_py()) for t in b.column(text_col)]
            yield b.filter(pa.array([not base_fails(x) and bool(passing[pattern(x)]) for x in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """Each document's figures, base check and joint verdict."""
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
