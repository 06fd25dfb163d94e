"""Block-max postings: the best rows for a question without reading most of its words' rows.

The postings of a term (a word, or two words in a row) lie in blocks of ids. A block's
head holds how many rows it has, and its peaks: the frequencies and lengths of rows that
no other row of the block beats in both. They give the greatest score in the block,
whatever the corpus' mean length is by then. ``top`` reads heads first: they give each term's share of the
corpus and each block's greatest possible score. The blocks that could be best are
scored, and the k-th score found there is a threshold; of the others only those are read
that could beat it, or tie with it at a smaller id. Heads and hits are different columns,
so the first pass reads heads only, and blocks are clustered by term.

Terms of three words or more have no blocks. Their places come from the inverted table of
words, and become blocks of the same form within the query.

Rows of several layers (a snapshot and the small writes over it) are one index: a hit
counts if no later layer touched its id. Bounds of blocks hold as they are, and a term's
share is the heads' sum less the hits that are out of date, which lie in few blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylens.functions.scalars import total
from entitylens.operators.lexical import B, DECIMALS, K1, LEAST_IDF, WEIGHTS, KeywordIndex, phrase_hits, phrases

#: Ids of one block.
IDS = 4096
#: Blocks that are scored for the threshold hold this many times k rows, if there are so many.
AHEAD = 2
HEAD = ["term", "block", "n", "first", "peaks"]
#: Bounds are compared with scores that were computed and rounded on another way.
SLACK = 1e-9


def terms_of(words: Column, weight: float) -> Column:
    """(term, weight) of a column's words and its pairs of neighbours."""
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(words, pairs), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def block_of(key: Column) -> Column:
    return F.floor(key / IDS).cast("long")


def blocked(hits: DataFrame) -> DataFrame:
    """Blocks of hits: term, id, f, n_words, and their block where it is known."""
    hits = hits if "block" in hits.columns else hits.withColumn("block", block_of(F.col("id")))
    one = F.struct("id", "f", F.col("n_words").cast("int").alias("n_words"))
    by = hits.groupBy("term", "block").agg(F.count("*").cast("int").alias("n"), F.min("id").alias("first"), F.sort_array(F.collect_list(one)).alias("hits"))
    kinds = by.withColumn("peaks", F.array_distinct(F.transform("hits", lambda h: F.struct(h["f"].alias("f"), h["n_words"].alias("n_words")))))
    beaten = lambda a: F.exists("peaks", lambda b: (b != a) & (b["f"] >= a["f"]) & (b["n_words"] <= a["n_words"]))
    return kinds.withColumn("peaks", F.filter("peaks", lambda a: ~beaten(a))).select(*HEAD, "hits")


def block_postings(indexed: DataFrame) -> DataFrame:
    """HEAD and hits of all words and pairs of words."""
    each = F.concat(*[terms_of(F.regexp_extract_all(c, F.lit("[^ ]+"), F.lit(0)), w) for c, w in WEIGHTS.items()])
    # Rows meet by block before they become terms; both groups then lie in one partition, and no term is shuffled.
    rows = indexed.select("id", "n_words", *WEIGHTS, block_of(F.col("id")).alias("block")).repartition("block")
    flat = rows.select("block", "id", "n_words", F.explode(each).alias("t")).select("block", "id", "n_words", "t.term", "t.w")
    return blocked(flat.groupBy("term", "block", "id").agg(F.max("n_words").alias("n_words"), F.sum("w").alias("f")))


@dataclass(frozen=True)
class BlockIndex:
    """Blocks of terms, the words' index for longer phrases, and what small writes made out of date.

    blocks may have a column layer; dead: id and last, the last layer that touched the id.
    """

    blocks: DataFrame
    words: KeywordIndex
    dead: DataFrame | None = None
    read: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(indexed: DataFrame) -> BlockIndex:
        return BlockIndex(block_postings(indexed), KeywordIndex.of(indexed))

    def _rows(self, wanted: list[list[str]]) -> DataFrame:
        """The blocks of all phrases, the same for short and for long ones."""
        short = [" ".join(p) for p in wanted if len(p) <= 2]
        rows = self.blocks if "layer" in self.blocks.columns else self.blocks.withColumn("layer", F.lit(0))
        found = rows.where(F.col("term").isin(short)).select(*HEAD, "layer", "hits")
        if longer := [p for p in wanted if len(p) > 2]:
            spark = self.blocks.sparkSession
            asked = spark.createDataFrame([(" ".join(p), p) for p in longer], "p string, words array<string>")
            made = blocked(phrase_hits(asked, self.words.postings).select(F.col("p").alias("term"), "id", "f", "n_words"))
            found = found.unionByName(made.withColumn("layer", F.lit(1 << 30)).select(found.columns))  # up to date as they are
        return found

    def _hits(self, blocks: DataFrame) -> DataFrame:
        """term, id, f, n_words of blocks, without hits that are out of date."""
        flat = blocks.select("term", "layer", F.explode("hits").alias("h")).select("term", "layer", "h.*")
        if self.dead is None:
            return flat.drop("layer")
        # Bounded where layers are laid: so many touched ids at most.
        gone = F.broadcast(self.dead.select(F.col("id").alias("_id"), "last"))
        return flat.join(gone, (F.col("id") == F.col("_id")) & (F.col("layer") < F.col("last")), "left_anti").drop("layer")

    def _shares(self, rows: DataFrame, names: list[str]) -> dict[str, int]:
        """How many rows hold each term; one row a term reaches the driver."""
        counts = rows.groupBy("term").agg(F.sum("n").alias("n"))
        if self.dead is not None:
            touched = F.broadcast(self.dead.select(block_of(F.col("id")).alias("block")).distinct())
            near = rows.join(touched, "block", "left_semi")
            all_there = near.groupBy("term").agg(F.sum("n").alias("n"))
            counts = counts.unionByName(all_there.select("term", (-F.col("n")).alias("n"))).unionByName(self._hits(near).groupBy("term").agg(F.count("*").alias("n")))
            counts = counts.groupBy("term").agg(F.sum("n").alias("n"))
        found = {r["term"]: r["n"] for r in counts.collect()}
        return {n: found.get(n, 0) for n in names}

    def _part(self, share: int, f: Column, n_words: Column) -> Column:
        """A phrase's part of the score; the inverse share is at least LEAST_IDF."""
        df, n = F.lit(float(share)), F.lit(float(self.words.n_rows))
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n_words / F.lit(float(self.words.mean_words))))

    def top(self, terms: list[str], k: int, mask: DataFrame | None = None) -> DataFrame:
        """id and bm25 of the k best rows, of those whose id is in mask; equal scores by id."""
        wanted = phrases(terms)
        names = [" ".join(p) for p in wanted]
        spark = self.blocks.sparkSession
        if not wanted:
            return spark.createDataFrame([], "id long, bm25 double")
        rows = self._rows(wanted)
        shares = self._shares(rows.drop("hits") if self.dead is None else rows, sorted(set(names)))

        def part(f: Column, n_words: Column) -> Column:
            return reduce(lambda e, t: F.when(F.col("term") == t, self._part(shares[t], f, n_words)).otherwise(e), shares, F.lit(0.0))

        # A phrase that is asked for twice counts twice.
        times = F.create_map(*[F.lit(x) for t in shares for x in (t, float(names.count(t)))])
        most = F.array_max(F.transform("peaks", lambda p: part(p["f"], p["n_words"])))
        heads = rows.select("term", "block", "n", "first", (most * times[F.col("term")]).alias("most"))
        # A row's hits may lie in several layers, as long phrases have one of their own.
        per = heads.groupBy("block").agg(F.sum("most").alias("most"), F.max("n").alias("n"), F.min("first").alias("first"))

        def scored(blocks: DataFrame) -> DataFrame:
            hits = self._hits(rows.join(F.broadcast(blocks), "block", "left_semi"))
            hits = hits if mask is None else hits.join(mask.select("id"), "id", "left_semi")
            held = hits.select("id", "term", part(F.col("f"), F.col("n_words")).alias("p"))
            by = held.groupBy("id").agg(*[F.max(F.when(F.col("term") == t, F.col("p"))).alias(f"p{i}") for i, t in enumerate(shares)])
            at = {t: F.coalesce(F.col(f"p{i}"), F.lit(0.0)) for i, t in enumerate(shares)}
            return by.select("id", F.round(total([at[n] for n in names]), DECIMALS).alias("bm25"))

        best_first = Window.orderBy(F.desc("most"), "first").rowsBetween(Window.unboundedPreceding, -1)
        # k blocks are enough to hold AHEAD * k rows if each has so many; the window sees no more.
        ahead = per.orderBy(F.desc("most"), "first").limit(AHEAD * k).withColumn("before", F.coalesce(F.sum("n").over(best_first), F.lit(0))).where(F.col("before") < AHEAD * k)
        order = [F.desc("bm25"), "id"]
        last = scored(ahead.select("block")).orderBy(*order).limit(k).collect()
        kept = per
        if len(last) == k:
            least, at = last[-1]["bm25"], last[-1]["id"]
            kept = per.where((F.col("most") > least + SLACK) | ((F.col("most") >= least - SLACK) & (F.col("first") <= at)))
        self.read.update(blocks=per, kept=kept)
        return scored(kept.select("block")).orderBy(*order).limit(k)

    def share_read(self) -> float:
        """Of the blocks that the last search could have read, the part that its second pass did."""
        n = self.read["blocks"].count()
        return self.read["kept"].count() / n if n else 0.0
