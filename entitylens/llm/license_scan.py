"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along paths.

Each line of a file is a header candidate, and a licence file (by name) is a
candidate as a whole. A candidate is a sparse vector of its words, weighted by
how rare they are among all lines of all files; the weights of the templates'
words are counted on the whole corpus (a table of the templates' vocabulary,
whatever the corpus's size), and other words weigh as unseen ones. The template
with the greatest cosine names the file's own licence, if it reaches the
threshold. Standard headers, short licence texts and the titles of long ones
(``license_headers``) are held against every run of lines that is about as long;
a run weighs words by the same line counts. A line without any of a template's heavy words can't reach it, by the
Cauchy-Schwarz inequality, and is passed over.

A file without a licence of its own inherits from the nearest directory above
it that declares one. Only distinct directories are joined with their
ancestors, so a directory with a third of all files is one row there.

Defined cases: a null or empty text has no licence of its own; very long texts are
scanned whole, line by line; columns of df named ``own_license``, ``score``, ``license``,
``license_dir`` or with the helpers' names (``_path``, ``_whole``, ``_text``, ``_dir``,
``_declares``) are left out and replaced, all others pass through; a null path is
the root; equal cosines go to the template named first in the alphabet; a
directory that declares several takes the most frequent, then the first in the
alphabet; repeated rows are scanned each; empty input gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylens.llm.common import stored, table
from entitylens.llm.license_headers import HEADERS

TEMPLATES = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.6
WORD = re.compile(r"[a-z]+|[0-9]+")
#: Columns that the scan makes or needs for itself.
MADE = ("own_license", "score", "license", "license_dir", "near", "_path", "_whole", "_text", "_dir", "_declares")
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying)[^/]*$"


def words_of(text: str) -> list[str]:
    # Only ASCII letters are folded, so that every engine finds the same words.
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Templates:
    """Template vectors under given line counts of their words."""

    def __init__(self, templates: dict[str, str], df: dict[str, int], n: int, threshold: float):
        self.threshold = threshold
        self.unseen = math.log(1 + n) + 1
        counts = {k: Counter(words_of(t)) for k, t in sorted(templates.items())}
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for c in counts.values() for w in c}
        self.vectors = {k: {w: tf * self.idf[w] for w, tf in c.items()} for k, c in counts.items()}
        self.norms = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in self.vectors.items()}
        self.heavy = frozenset().union(*[self._heavy(k) for k in self.vectors])

    def _heavy(self, k: str) -> set[str]:
        """Words of which a line that reaches the threshold holds one: the others together are too short."""
        by_weight = sorted(self.vectors[k], key=lambda w: self.vectors[k][w])
        light, total = set(), 0.0
        for w in by_weight:
            total += self.vectors[k][w] ** 2
            if math.sqrt(total) >= (self.threshold - 1e-9) * self.norms[k]:
                break
            light.add(w)
        return set(by_weight) - light

    def best(self, words: list[str]) -> tuple[float, str] | None:
        if self.heavy.isdisjoint(words):
            return None
        own = {w: tf * self.idf.get(w, self.unseen) for w, tf in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        found = None
        for k, v in self.vectors.items():
            s = round(sum(x * own[w] for w, x in v.items() if w in own) / norm / self.norms[k], 6)
            if s >= self.threshold and (found is None or s > found[0]):
                found = (s, k)
        return found


class Headers(Templates):
    """Vectors of longer texts, each held against runs of lines with about as many words."""

    def __init__(self, headers: list[tuple[str, str]], df: dict[str, int], n: int, threshold: float):
        self.licenses = {f"{i:03}": k for i, (k, _) in enumerate(headers)}
        texts = {f"{i:03}": t for i, (_, t) in enumerate(headers)}
        super().__init__(texts, df, n, threshold)
        self.sizes = sorted({len(words_of(t)) for t in texts.values()})

    def best_run(self, lines: list[list[str]]) -> tuple[float, str] | None:
        """The best of all runs of lines that reach a template's length at their last line."""
        lines = [x for x in lines if x]
        # By the Cauchy-Schwarz inequality again, for all words of the text at once.
        words = self.idf.keys() & set().union(*lines)
        if not any(sum(x * x for w, x in v.items() if w in words) >= ((self.threshold - 1e-5) * self.norms[k]) ** 2 for k, v in self.vectors.items()):
            return None
        marked = [i for i, x in enumerate(lines) if not self.heavy.isdisjoint(x)]
        found = None
        for size in self.sizes if marked else ():
            starts = set()
            for i in marked:
                before = 0
                while i >= 0 and i not in starts and before < size:
                    starts.add(i)
                    i -= 1
                    before += len(lines[i]) if i >= 0 else 0
            for i in starts:
                words, end = [], i
                while end < len(lines) and len(words) < size:
                    words += lines[end]
                    end += 1
                h = self.best(words)
                # Of equal scores the first name.
                if h and (found is None or (-h[0], self.licenses[h[1]]) < (-found[0], found[1])):
                    found = (h[0], self.licenses[h[1]])
        return found


def line_counts(df: DataFrame, text_col: str, templates: dict[str, str]) -> tuple[dict[str, int], int]:
    """Lines that hold each of the templates' words, and all lines; collects the vocabulary's counts."""
    vocabulary = frozenset(w for t in templates.values() for w in words_of(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0):
                for line in (text.as_py() or "").split("\n"):
                    words = words_of(line)
                    if words:
                        seen[""] += 1
                        seen.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    total = df.select(text_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = {r["w"]: r["n"] for r in total.collect()}
    return counts, counts.get("", 0)


def own_licenses(df: DataFrame, text_col: str, path: Column, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, headers: list[tuple[str, str]] = HEADERS) -> DataFrame:
    """df without its text, with _path, own_license and score."""
    df_counts, n = line_counts(df, text_col, templates | {f"_header{i}": t for i, (_, t) in enumerate(headers)})
    vectors, runs = Templates(templates, df_counts, n, threshold), Headers(headers, df_counts, n, threshold)
    names = [c for c in df.columns if c not in (text_col, *MADE)]
    path = F.coalesce(path, F.lit(""))
    rows = df.select(*names, path.alias("_path"), path.rlike(LICENSE_FILE).alias("_whole"), F.col(text_col).alias("_text"))
    fields = rows.schema.fields[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, whole in zip(b.column(b.num_columns - 1), b.column(b.num_columns - 2).to_pylist(), strict=True):
                text = text.as_py() or ""
                # Of equal scores the first name.
                lines = [words_of(part) for part in text.split("\n")]
                hits = [h for words in (lines + [[w for x in lines for w in x]] * whole) if (h := vectors.best(words))]
                hits += [h] if (h := runs.best_run(lines)) else []
                found.append(min(hits, key=lambda h: (-h[0], h[1]), default=(None, None)))
            columns = b.columns[:-2] + [pa.array([k for _, k in found], pa.string()), pa.array([s for s, _ in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in fields], "own_license", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["own_license string", "score double"])
    return rows.mapInArrow(run, schema)


def inherited(files: DataFrame, declares: Column) -> DataFrame:
    """files (with _path, own_license) with license and license_dir: own, or the nearest ancestor directory's."""
    placed = files.withColumn("_dir", F.regexp_replace("_path", "(^|/)[^/]*$", "")).withColumn("_declares", declares & F.col("own_license").isNotNull())
    said = placed.where("_declares").groupBy("_dir", "own_license").agg(F.count("*").alias("n"))
    of_dir = said.groupBy("_dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license"))["own_license"].alias("license"))
    dirs = placed.where("own_license is null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    depth = F.when(F.col("_dir") == "", F.lit(0)).otherwise(F.size(parts))
    above = dirs.withColumn("_up", F.explode(F.sequence(F.lit(0), depth))).withColumn("_above", F.array_join(F.slice(parts, F.lit(1), depth - F.col("_up")), "/"))
    nearest = above.join(of_dir.withColumnRenamed("_dir", "_above"), "_above").groupBy("_dir").agg(F.min(F.struct("_up", "_above", "license")).alias("near"))
    out = placed.join(nearest, "_dir", "left")
    return out.withColumns({
        "license": F.coalesce("own_license", "near.license"),
        "license_dir": F.when(F.col("own_license").isNull(), F.col("near._above")),
    }).drop("_dir", "_declares", "near")


def document_paths(doc_id: Column, source: Column, lang: Column) -> Column:
    """Places for documents, which have none: source/language/(id // 512)/(id // 64)/name.

    One in four is a licence file, a third of them in each of the three lower directories; so directories at
    several depths declare, and many don't.
    """
    i = F.coalesce(doc_id, F.lit(0))
    level = F.when(i % 4 != 0, F.lit(0)).otherwise(F.floor(i / 4) % 3)
    top = F.concat_ws("/", F.coalesce(source, F.lit("?")), F.coalesce(lang, F.lit("?")))
    upper, lower = F.floor(i / 512).cast("string"), F.floor(i / 64).cast("string")
    name = F.concat(F.when(i % 4 == 0, F.lit("LICENSE-")).otherwise(F.lit("file-")), i.cast("string"))
    return F.when(level == 0, F.concat_ws("/", top, upper, lower, name)).when(level == 1, F.concat_ws("/", top, upper, name)).otherwise(F.concat_ws("/", top, name))


def op3(spark, sf_dir: str) -> DataFrame:
    """The licence of each document as a file among others, its own or the nearest declaring ancestor's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = document_paths(F.col("doc_id"), F.col("source"), F.col("lang"))
    files = stored(own_licenses(docs, "text", path), "own-licenses")
    return inherited(files, F.col("_path").rlike(LICENSE_FILE)).select("doc_id", "own_license", "score", "license", "license_dir")


_VALUES = ", ".join(f"('{k}', '{t}')" for k, t in TEMPLATES.items())
OP3_SQL = rf"""
WITH t(name, txt) AS (VALUES {_VALUES}),
tw AS (SELECT name, w, count(*) AS tf FROM (SELECT name, unnest(regexp_extract_all(lower(txt), '[a-z]+|[0-9]+')) AS w FROM t) GROUP BY ALL),
line AS (SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+|[0-9]+') AS ws
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)),
place AS (SELECT doc_id, coalesce(source, '?') || '/' || coalesce(lang, '?') AS d2, CASE WHEN doc_id % 4 <> 0 THEN 0 ELSE (doc_id // 4) % 3 END AS level,
  CASE WHEN level < 2 THEN d2 || '/' || (doc_id // 512) END AS d3, CASE WHEN level = 0 THEN d3 || '/' || (doc_id // 64) END AS d4 FROM documents),
flat AS MATERIALIZED (SELECT doc_id, i, w, count(*) AS tf FROM (SELECT doc_id, i, unnest(ws) AS w FROM line) GROUP BY ALL),
lw AS MATERIALIZED (FROM flat UNION ALL SELECT doc_id, -1 - doc_id AS i, w, sum(tf) AS tf FROM flat WHERE doc_id % 4 = 0 GROUP BY ALL),
total AS (SELECT count(*) AS n FROM line WHERE len(ws) > 0),
idf AS (SELECT w, ln((1 + n)::DOUBLE / (1 + (SELECT count(*) FROM flat WHERE flat.w = v.w))) + 1 AS x FROM (SELECT DISTINCT w FROM tw) v, total),
tn AS (SELECT name, sqrt(sum((tf * x) ** 2)) AS norm FROM tw JOIN idf USING (w) GROUP BY name),
dots AS (SELECT i, name, sum(lw.tf * tw.tf * x * x) AS dot FROM lw JOIN tw USING (w) JOIN idf USING (w) GROUP BY ALL),
ln_ AS (SELECT doc_id, i, sqrt(sum((tf * coalesce(x, ln(1 + n) + 1)) ** 2)) AS norm FROM lw LEFT JOIN idf USING (w), total GROUP BY ALL),
hit AS (SELECT doc_id, name, round(dot / ln_.norm / tn.norm, 6) AS score FROM dots JOIN ln_ USING (i) JOIN tn USING (name)),
own AS (SELECT doc_id, name AS own_license, score FROM hit WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) = 1),
file AS (SELECT place.*, own_license, own.score AS score, coalesce(d4, d3, d2) AS d FROM place LEFT JOIN own USING (doc_id)),
said AS (SELECT d, own_license AS license FROM (SELECT d, own_license, count(*) AS n FROM file WHERE own_license IS NOT NULL AND doc_id % 4 = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, own_license) = 1)
SELECT doc_id, own_license, score, coalesce(own_license, s4.license, s3.license, s2.license) AS license,
  CASE WHEN own_license IS NOT NULL THEN NULL WHEN s4.license IS NOT NULL THEN d4 WHEN s3.license IS NOT NULL THEN d3 WHEN s2.license IS NOT NULL THEN d2 END AS license_dir
FROM file LEFT JOIN said s4 ON s4.d = d4 LEFT JOIN said s3 ON s3.d = d3 LEFT JOIN said s2 ON s2.d = d2
"""
