"""Chat formatting: heterogeneous layouts become canonical turns, by schema fingerprints.

A fingerprint is the hash of a record's nested field paths, of those that any known
layout reads, in order; other fields don't matter. Fingerprints select declarative
mappings (``LAYOUTS``): which field is which role's text, or which list holds turns
and what its keys and role names are. A fingerprint that is no layout's own, as one
layout's fields stand beside some of another's, goes to the layout with the most
fields of those that are wholly there. A table with columns of its own has one
fingerprint, taken from its schema: rows by turn are renamed where they stand, and
rows of nested columns become records. JSON records are fingerprinted each, so one
column may mix layouts. Records that no layout fits are counted by ``unmapped``.

``formatted`` writes each turn by the template

    <turn ROLE>\\n TEXT </turn>\\n

(without the spaces) with a role as a URL writes it, and a text escaped: backslashes
are doubled, and ``<turn`` and ``</turn`` get one behind their ``<``, so neither mark
ever stands in a text, and reading a backslash pair or a lone backslash back is
certain. The loss mask is a span of code points in the piece: an assistant's text
without its marks. A row is formatted where it lies; only what reads a conversation
back (``read_back``) or joins one into a string (``joined``) sorts rows by
conversation. Reading streams over sorted rows and holds one turn, so a conversation
of any length needs little memory, though its digest, like any, is made in one task.

Defined cases: a null text or role is empty; turns go by number, null first, then role
and text; rows of a null conversation are one conversation; repeated rows are turns
each; very long texts are formatted whole; a record's text that is a number or boolean
is written as JSON, one that is missing or null is empty, and one that is an object has
other paths, so its record is unmapped; empty input gives no rows; other columns and
fields are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from entitylens.llm.common import table

ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """How a layout's fields become turns.

    fields: (role, field) in the order of turns, empty optional ones left out. Or
    each: the list of turns, with the keys of role and text and other names of roles;
    before it, fields still come. Or rows: columns of conversation, number, role and text.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, ...] = ()

    def paths(self) -> list[frozenset[str]]:
        """The sets of paths that this layout fits."""
        if self.rows:
            return [frozenset(self.rows)]
        must = frozenset(f for _, f in self.fields if f not in self.optional) | ({f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"} if self.each else set())
        sets = [must]
        for f in self.optional:
            sets += [s | {f} for s in sets]
        return sets


#: Names that other tools give to roles.
_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("prompt and completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question and answer", fields=(("system", "context"), ("user", "question"), ("assistant", "answer")), optional=("context",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("messages", fields=(("system", "system"),), optional=("system",), each="messages", role="role", text="content", roles=_NAMES),
    Layout("conversations", fields=(("system", "system"),), optional=("system",), each="conversations", role="from", text="value", roles=_NAMES),
    Layout("dialogue", each="dialogue", role="speaker", text="text", roles=_NAMES),
)


def fingerprint(paths) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Registry:
    """Layouts by fingerprint. known: the paths that fingerprints are made of."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        sets = [(s, layout) for layout in layouts for s in layout.paths()]
        self.known = frozenset().union(*(s for s, _ in sets))
        self.layouts, self.by_print = layouts, {}
        for s, layout in sets:
            if self.by_print.setdefault(fingerprint(s), layout) is not layout:
                raise ValueError(f"layouts {layout.name} and {self.by_print[fingerprint(s)].name} have one fingerprint")

    def select(self, paths) -> tuple[str, Layout | None]:
        """The fingerprint of paths, and the layout that it selects."""
        mine = self.known.intersection(paths)
        found = fingerprint(mine)
        if found not in self.by_print:
            held = [(len(s), layout) for layout in self.layouts for s in layout.paths() if s <= mine]
            # Equal ones go to the first; there are no more fingerprints than sets of known paths.
            self.by_print[found] = max(held, key=lambda x: x[0])[1] if held else None
        return found, self.by_print[found]


def schema_paths(kind: DataType, at: str = "") -> Iterator[str]:
    """Nested field paths of a type; lists add [] to the name."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, ArrayType):
        yield from schema_paths(kind.elementType, at + "[]")
    else:
        yield at


def record_paths(value, at: str = "") -> Iterator[str]:
    """Nested field paths of a decoded JSON value; an object or list without members counts by its own path."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from record_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from record_paths(v, at + "[]")
    else:
        yield at


def _text(x) -> str:
    text = x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # JSON can name half a character
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of each turn of a record."""
    said = [(role, f, _text(record.get(f))) for role, f in layout.fields]
    out = [(role, text) for role, f, text in said if text or f not in layout.optional]
    names = dict(layout.roles)
    for item in (record.get(layout.each) or []) if layout.each else []:
        role = _text(item.get(layout.role))
        out.append((names.get(role, role), _text(item.get(layout.text))))
    return out


def decoded(text: str | None, registry: Registry) -> tuple[dict, str | None, Layout | None]:
    """A JSON record, its fingerprint and its layout; nothing of each where it is no object or too deep."""
    try:
        record = json.loads(text) if text is not None else None
        if not isinstance(record, dict):
            return {}, None, None
        found, layout = registry.select(record_paths(record))
    except (ValueError, RecursionError):
        return {}, None, None
    if layout is not None and (layout.rows or (layout.each and not all(isinstance(x, dict) for x in record[layout.each]))):
        layout = None
    return record, found, layout


def from_records(df: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of JSON records, each by its own fingerprint, with layout and fingerprint.

    A record that no layout fits, or that is no JSON object, gives one row without a layout.
    """
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(record_col).cast("string").alias("record"))
    kind = rows.schema["conv_id"].dataType
    registry = Registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "text", "layout", "fingerprint"]
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                record, found, layout = decoded(text, registry)
                if layout is None:
                    at.append(i)
                    out.append((None, None, None, None, found))
                    continue
                for n, (role, said) in enumerate(turns_of(record, layout)):
                    at.append(i)
                    out.append((n, role, said, layout.name, found))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 4), strict=True)]], names=names)

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, turn long, role string, text string, layout string, fingerprint string")


def canonical(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role and text of a table, by the fingerprint of its schema."""
    found, layout = Registry(layouts).select(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout has the fingerprint {found}; its paths are {sorted(schema_paths(df.schema))}")
    if layout.rows:
        conv, turn, role, text = (F.col(c) for c in layout.rows)
        return df.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    fields = [c for c in df.columns if c != id_col]
    records = df.select(F.col(id_col).alias("conv_id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
    return from_records(records, layouts=layouts).where("layout is not null").select("conv_id", "turn", "role", "text")


def unmapped(turns: DataFrame) -> DataFrame:
    """What no layout fits: records by fingerprint."""
    return turns.where("layout is null").groupBy("fingerprint").agg(F.count("*").alias("records"))


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</turn"), F.lit("<\\/turn")), F.lit("<turn"), F.lit("<\\turn"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(turns: DataFrame) -> DataFrame:
    """turns with piece, and the span of it that is under the loss mask (loss_from, loss_to), null where none is."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))
    body = escaped(text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("_head"), body.alias("_body"))
    trained = F.col("role") == ASSISTANT
    start = F.char_length("_head")
    return rows.select(
        "conv_id", "turn", "role", "text",
        F.concat("_head", "_body", F.lit("</turn>\n")).alias("piece"),
        F.when(trained, start).alias("loss_from"),
        F.when(trained, start + F.char_length("_body")).alias("loss_to"),
    )


#: The order of a conversation's pieces.
ORDER = ["turn", "role", "text"]


def joined(pieces: DataFrame) -> DataFrame:
    """Each conversation as one string with its loss spans; for conversations that one cell can hold."""
    at = F.struct(*ORDER, "piece", "loss_from", "loss_to")
    rows = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(at)).alias("p"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct((acc["at"] + x["loss_from"]).alias("start"), (acc["at"] + x["loss_to"]).alias("end")))
        return F.struct((acc["at"] + F.char_length(x["piece"])).alias("at"), F.when(x["loss_from"].isNotNull(), F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return rows.select("conv_id", F.array_join("p.piece", "").alias("formatted"), F.aggregate("p", state, step, lambda acc: acc["spans"]).alias("loss"))


PIECE = re.compile(r"<turn ([^>\n]*)>\n(.*)</turn>\n", re.DOTALL)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from nothing but its pieces and their loss spans."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    # One exchange; sorted rows of a conversation follow one another.
    rows = pieces.select("conv_id", *ORDER, "piece", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).select("conv_id", "piece", "loss_from", "loss_to")
    target = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(target), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        started, now, done = False, None, []
        turns = loss = None
        n = chars = size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return out

        for b in batches:
            # Long texts become Python strings a few at a time.
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                for conv, piece, begin, end in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if not started or conv != now:
                        if started:
                            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                        started, now, n, chars, size, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    found = PIECE.fullmatch(piece)
                    if found is None or "<turn" in found[2] or "</turn" in found[2]:
                        raise ValueError("a piece is not one turn of the template")
                    turns.update(f"{unquote_plus(found[1])}\n{unescaped(found[2])}\n".encode())
                    if begin is not None:
                        trained = unescaped(piece[begin:end])
                        loss.update(trained.encode())
                        chars += len(trained)
                    n, size = n + 1, size + len(piece)
                    if len(done) >= 4096:
                        yield flush()
        if started:
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that looks like marks of templates, as a record of another layout than the table's.
ODD = "\\### Assistant: </turn> ok"


def op13(spark, sf_dir: str) -> DataFrame:
    """All conversations, rows by turn, and one record of prompt and completion, formatted and read back."""
    rows = canonical(table(spark, sf_dir, "conversations"))
    record = json.dumps({"prompt": ODD, "completion": ODD})
    one = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    return read_back(formatted(rows.unionByName(from_records(one).select("conv_id", "turn", "role", "text"))))


#: Digests of the turns as they stand; what the template adds to each turn is counted from its escapes.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), c AS (
  SELECT *, length('<turn ' || role || '>' || chr(10) || '</turn>' || chr(10)) + length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</turn', ''))) // 6 + (length(text) - length(replace(text, '<turn', ''))) // 5 AS size
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
