"""Immutable snapshots of the entity table, published by small numbered pointer files.

Each write makes a new snapshot and then a pointer with the next number. The pointer
is written whole under another name and then gets its own in one step, which fails
where that name is taken; the highest one counts. So a write that stops anywhere
leaves the snapshot before it, a pointer is either absent or whole, and of two writers
that began at one snapshot the second fails instead of hiding the first. All files go
through the Hadoop file system, so a store can lie wherever Spark can write and a
rename that never replaces is one step, as in HDFS or a local folder.

Readers keep the snapshot they opened. Folders that no kept pointer names are removed
by later writes once they are older than ``GRACE_S``, which must be longer than any
write and any reading of an engine that lags behind ``KEPT_POINTERS`` writes.

Rows lie in files by ranges of ids. A manifest beside them names the least and greatest
id of each file, its rows, and a small Bloom filter of its ids; looking ids up, the next
page behind an id, and deletes read the manifest and then only files that can hold them.
A snapshot's figures (rows, words, greatest id) are kept in its record: a small write adds
its own and takes off those of the rows it replaced, which it looks up.

A small write leaves the snapshot's files alone and lays a delta over them: its rows,
their postings, and the ids that it touched. A row counts if no later layer touched
its id. The touched ids are broadcast, so reading shuffles nothing; once they would be
too many for that, or a write is a large share of the table, the next snapshot is
written whole and its deltas are done with.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylens.operators import bitmaps
from entitylens.operators.blocks import BlockIndex, block_postings
from entitylens.operators.ingest import embedding_text, enriched, indexed, ingest_stats, latest, numbered, upserted, validated
from entitylens.operators.lexical import KeywordIndex, postings
from entitylens.operators.vectors import Embedder, HashEmbedder, embedded, try_embedder
from entitylens.plans.engine import Engine, NotFound
from entitylens.shipping import ship

RECORD = ["id", "name", "description", "industry", "location", "founded_year", "employee_count", "revenue_range", "topics", "revenue_min", "revenue_max", "updated_at"]
#: Rows of one live call at most.
LIVE_ROWS = 5000
#: Messages about invalid rows that are reported.
SHOWN_ERRORS = 20


#: Pointer files that are kept, and the seconds that folders stay which none of these names.
KEPT_POINTERS = 10
GRACE_S = 24 * 3600
#: Deltas over a snapshot, the ids in them, and the ids as a share of the rows, at most.
MOST_DELTAS = 16
MOST_TOUCHED = 500_000
TOUCHED_SHARE = 0.1


#: What a snapshot's folder holds: 2 has blocks of postings and bitmaps too, 3 a manifest and rows by id.
PARTS, BY_ID = 2, 3
#: Bits of a file's Bloom filter, which tells small files of scattered ids apart.
BLOOM = 32_768
#: Ids that are looked up by the manifest at most; more are joined.
LOOKED_UP = 1000


class Conflict(RuntimeError):
    """Another writer published a snapshot meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[int], Embedder] = HashEmbedder, dim: int = 384):
        self.spark, self.path = ship(spark), path.rstrip("/")
        self.model = try_embedder(embedder, dim)
        self.dim = self.model.dim if self.model else dim
        self._make = lambda: embedder(dim)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- files -------------------------------------------------------------

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _pointers(self) -> list[str]:
        """Names of the pointer files, the newest first."""
        top = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted((n for n in names if n.startswith("pointer-") and n.endswith(".json")), reverse=True)

    def _renamed(self, begun, target) -> None:
        """Gives a file its name unless that is taken, in one step."""
        if self._fs.getScheme() == "file":
            # A local rename would replace; a second link to the file never does.
            os.link(begun.toUri().getPath(), target.toUri().getPath())
            self._fs.delete(begun, False)
            return
        jvm = self.spark.sparkContext._jvm
        never = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = never
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(begun, target, options)

    def _begun(self, now: dict):
        """A record written whole, under a name that nobody reads."""
        begun = self._path(f"{self.path}/begun-{uuid.uuid4().hex}.json")
        out = self._fs.create(begun, False)
        out.write(json.dumps(now).encode())
        out.close()
        return begun

    def _point(self, now: dict, before: dict) -> dict:
        """Publishes a snapshot's record; before is the one that the writer began with."""
        now = now | {"version": before.get("version", 0) + 1}
        begun = self._begun(now)
        try:
            self._renamed(begun, self._path(f"{self.path}/pointer-{now['version']:012}.json"))
        except Exception as e:
            self._fs.delete(begun, False)
            raise Conflict(f"snapshot {now['version']} was published meanwhile") from e
        self._expire()
        return now

    def _named(self, record: dict) -> set[str]:
        """The folders that a record reads."""
        return {record.get("snapshot"), record.get("vectors"), *(d["name"] for d in record.get("deltas", []))} - {None}

    def _expire(self) -> None:
        """Removes pointers beyond the last ones, and old folders and files that none of these reads."""
        pointers = self._pointers()
        for old in pointers[KEPT_POINTERS:]:
            self._fs.delete(self._path(f"{self.path}/{old}"), False)
        kept = set().union(*(self._named(json.loads(text)) for n in pointers[:KEPT_POINTERS] if (text := self._read(n))))
        limit = (time.time() - GRACE_S) * 1000
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if name.startswith(("snapshot-", "delta-", "vectors-", "begun-")) and name not in kept and f.getModificationTime() < limit:
                self._fs.delete(f.getPath(), True)

    def meta(self) -> dict:
        """The current snapshot's name and figures; empty before the first write."""
        for name in self._pointers()[:1]:
            try:
                return json.loads(self._read(name) or "")
            except ValueError as e:
                raise RuntimeError(f"{self.path}/{name} is damaged; pointers are published whole") from e
        return {}

    def set_meta(self, key: str, value) -> dict:
        """Keeps a value of one's own with the snapshot, and with those that follow."""
        now = self.meta()
        return self._point(now | {"own": now.get("own", {}) | {key: value}}, now)

    def get_meta(self, key: str):
        now = self.meta()
        return now.get("own", {}).get(key, now.get(key))

    # -- tables ------------------------------------------------------------

    def entities(self) -> DataFrame | None:
        now = self.meta()
        return self._layered(now, "entities") if now.get("snapshot") else None

    def _layered(self, now: dict, part: str) -> DataFrame:
        """The rows of a record's table, part, whose ids no later layer touched."""
        base = self.spark.read.parquet(f"{self.path}/{now['snapshot']}/{part}")
        deltas = list(enumerate(now.get("deltas", []), 1))
        if not deltas:
            return base
        read = lambda name, sub, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{sub}")
        rows, touched = base.withColumn("_layer", F.lit(0)), None
        for k, delta in deltas:
            if delta["rows"]:
                rows = rows.unionByName(read(delta["name"], part, base.schema).withColumn("_layer", F.lit(k)))
            ids = read(delta["name"], "touched", "id long").select(F.col("id").alias("_touched"), F.lit(k).alias("_by"))
            touched = ids if touched is None else touched.unionByName(ids)
        last = touched.groupBy("_touched").agg(F.max("_by").alias("_last"))
        # MOST_TOUCHED rows at most.
        return rows.join(F.broadcast(last), (F.col("id") == F.col("_touched")) & (F.col("_layer") < F.col("_last")), "left_anti").drop("_layer")

    def vectors(self, model: str | None = None) -> DataFrame | None:
        """The vectors, or None if there are none, another model made them, or their files aren't those that were written.

        Rows and lengths were counted when they were written, and files are compared by name
        and size, so no vector is read here. Records without that are counted.
        """
        now = self.meta()
        if not now.get("vectors") or model is not None and now.get("model") != model:
            return None
        written = now.get("vector_files")
        if written and (written["rows"] != now.get("vector_rows") or written["dim"] != now.get("dim") or self._extent(now["vectors"]) != written["extent"]):
            return None
        try:
            found = self.spark.read.parquet(f"{self.path}/{now['vectors']}")
            if written:
                return found
            whole = found.agg(F.count("*"), F.count_if(F.size("embedding") != now.get("dim", self.dim))).first()
        except Exception:  # noqa: BLE001  a search by words goes on without them
            return None
        return found if tuple(whole) == (now.get("vector_rows", whole[0]), 0) else None

    def _extent(self, name: str) -> str | None:
        """A digest of the names and sizes of a folder's files, from its listing; None if it is gone."""
        folder = self._path(f"{self.path}/{name}")
        if not self._fs.exists(folder):
            return None
        files = sorted([f.getPath().getName(), f.getLen()] for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
        return hashlib.sha256(json.dumps(files).encode()).hexdigest()

    def _layers(self, now: dict, part: str) -> list[DataFrame]:
        """A part of the snapshot and of each delta over it, none merged."""
        base = self.spark.read.parquet(f"{self.path}/{now['snapshot']}/{part}")
        read = lambda d: self.spark.read.schema(base.schema).parquet(f"{self.path}/{d['name']}/{part}") if d["rows"] else base.where("false")
        return [base, *map(read, now.get("deltas", []))]

    def _touched(self, now: dict) -> list[DataFrame]:
        return [self.spark.read.schema("id long").parquet(f"{self.path}/{d['name']}/touched") for d in now.get("deltas", [])]

    def index(self) -> KeywordIndex | BlockIndex | None:
        """The inverted tables of the current snapshot; one that was written without blocks has words only."""
        now = self.meta()
        if not now.get("index"):
            return None
        words = KeywordIndex(self._layered(now, "postings"), **now["index"])
        if now.get("parts", 1) < PARTS:
            return words
        rows = [d.withColumn("layer", F.lit(k)) for k, d in enumerate(self._layers(now, "blocks"))]
        touched = [d.withColumn("last", F.lit(k)) for k, d in enumerate(self._touched(now), 1)]
        dead = reduce(DataFrame.unionByName, touched).groupBy("id").agg(F.max("last").alias("last")) if touched else None
        return BlockIndex(reduce(DataFrame.unionByName, rows), words, dead)

    def bitmaps(self) -> DataFrame | None:
        """The bitmap index of the current snapshot, from which matches are counted."""
        now = self.meta()
        return bitmaps.layered(self._layers(now, "bitmaps"), self._touched(now)) if now.get("parts", 1) >= PARTS else None

    def _written(self, name: str, entities: DataFrame) -> DataFrame:
        """Writes entities and their postings into a new folder, and reads the entities back."""
        entities.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/{name}/entities")
        rows = self.spark.read.schema(entities.schema).parquet(f"{self.path}/{name}/entities")
        files = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), F.bitmap_construct_agg(F.pmod(F.xxhash64("id"), F.lit(BLOOM))).alias("bloom"))
        files.repartitionByRange("low").sortWithinPartitions("low").write.parquet(f"{self.path}/{name}/manifest")
        # By term, so that a search reads its words' row groups; by id too, so that a common word is split.
        postings(rows).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{self.path}/{name}/postings")
        block_postings(rows).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{self.path}/{name}/blocks")
        bitmaps.bitmap_index(rows).repartitionByRange("field", "value", "block").sortWithinPartitions("field", "value", "block").write.parquet(f"{self.path}/{name}/bitmaps")
        return rows

    def _figures(self, rows: DataFrame) -> dict:
        """What adds up over rows, and their greatest id."""
        r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.max("id"), F.lit(0)).alias("max")).first()
        return {"n": r["n"], "words": r["words"], "max_id": r["max"]}

    def _retired(self, ids: DataFrame, before: dict) -> dict:
        """The figures of the rows that a write replaces."""
        some = [r["id"] for r in ids.limit(LOOKED_UP + 1).collect()]
        if len(some) <= LOOKED_UP:
            return self._figures(self._looked_up(before, some))
        return self._figures(self._layered(before, "entities").join(F.broadcast(ids), "id", "left_semi"))  # MOST_TOUCHED rows at most

    def _record(self, now: dict, before: dict, ids: DataFrame | None = None, rows: DataFrame | None = None) -> dict:
        """Publishes a record with the figures of its rows: from before's, where ids were touched and rows written, else from all."""
        if ids is None or "figures" not in before:
            figures = self._figures(self._layered(now, "entities"))
        else:
            old, gone = before["figures"], self._retired(ids, before)
            new = self._figures(rows) if rows is not None else {"n": 0, "words": 0, "max_id": 0}
            figures = {k: old[k] - gone[k] + new[k] for k in ("n", "words")}
            figures["max_id"] = max(old["max_id"], new["max_id"])
            if gone["max_id"] == old["max_id"] > new["max_id"]:
                # The greatest id was deleted: its files' column tells the next one.
                figures["max_id"] = self._figures(self._layered(now, "entities").select("id", F.lit(0).alias("n_words")))["max_id"]
        index = {"n_rows": figures["n"], "mean_words": figures["words"] / figures["n"] if figures["n"] else 0.0}
        more = {"rows": figures["n"], "figures": figures, "index": index, "model": self.model.name if self.model else before.get("model"), "at": datetime.now(timezone.utc).isoformat()}
        return self._point(now | more, before)

    # -- by id ---------------------------------------------------------------

    def _manifests(self, now: dict) -> list[tuple[str, DataFrame]]:
        """Folder and manifest of each layer that has rows."""
        names = [(0, now["snapshot"])] + [(k, d["name"]) for k, d in enumerate(now.get("deltas", []), 1) if d["rows"]]
        schema = "file string, low long, high long, n long, bloom binary"
        return [(k, f"{self.path}/{name}/entities", self.spark.read.schema(schema).parquet(f"{self.path}/{name}/manifest")) for k, name in names]

    def _looked_up(self, now: dict, ids: list[int]) -> DataFrame:
        """The rows of these ids (LOOKED_UP at most), from files that can hold them."""
        schema = self.spark.read.parquet(f"{self.path}/{now['snapshot']}/entities").schema
        ids, found = sorted(set(ids)), []
        if now.get("parts", 1) < BY_ID:
            return self._layered(now, "entities").where(F.col("id").isin(ids))
        last = dict.fromkeys(ids, 0)
        for k, touched in enumerate(self._touched(now), 1):
            last |= {r["id"]: k for r in touched.where(F.col("id").isin(ids)).collect()}
        places = self.spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(BLOOM)).alias("p"))
        place = {r["id"]: r["p"] for r in places.collect()}
        for k, folder, manifest in self._manifests(now):
            mine = [i for i in ids if last[i] == k]
            if not mine:
                continue
            near = manifest.where((F.col("low") <= mine[-1]) & (F.col("high") >= mine[0]) & F.exists(F.lit(mine), lambda i: (i >= F.col("low")) & (i <= F.col("high"))))
            held = lambda f, i: f["low"] <= i <= f["high"] and f["bloom"][place[i] // 8] >> place[i] % 8 & 1
            files = [f"{folder}/{f['file']}" for f in near.collect() if any(held(f, i) for i in mine)]
            if files:
                found.append(self.spark.read.schema(schema).parquet(*files).where(F.col("id").isin(mine)))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def rows_of(self, ids: list[int]) -> DataFrame:
        """The rows of some ids."""
        if len(ids) > LOOKED_UP:
            raise ValueError(f"at most {LOOKED_UP} ids are looked up at once")
        return self._looked_up(self.meta(), ids)

    def page_after(self, key: int, limit: int) -> DataFrame:
        """The next rows by id behind an id: from the first files that hold enough of them."""
        now = self.meta()
        touched, up_to, found = sum(d["touched"] for d in now.get("deltas", [])), None, []
        if now.get("parts", 1) < BY_ID:
            return self._layered(now, "entities").where(F.col("id") > key).orderBy("id").limit(limit)
        schema = self.spark.read.parquet(f"{self.path}/{now['snapshot']}/entities").schema
        for k, folder, manifest in self._manifests(now):
            near = manifest.where(F.col("high") > key).select("file", "low", "high", "n").orderBy("low")
            if k == 0:
                # Each row behind the id is in one of so many files, or was touched since.
                files, rows = near.limit(limit + touched + 1).collect(), 0
                for at, f in enumerate(files):
                    rows += f["n"] if f["low"] > key else 0
                    if rows >= limit + touched and at + 1 < len(files):
                        files, up_to = files[: at + 1], f["high"]
                        break
            else:
                files = near.collect()  # of one small write
            if files:
                part = self.spark.read.schema(schema).parquet(*[f"{folder}/{f['file']}" for f in files])
                found.append(part.where((F.col("id") > key) & (F.lit(True) if up_to is None else F.col("id") <= up_to)).withColumn("_layer", F.lit(k)))
        rows = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema).withColumn("_layer", F.lit(0))
        gone = [t.select(F.col("id").alias("_touched"), F.lit(k).alias("_last")) for k, t in enumerate(self._touched(now), 1)]
        if gone:
            # MOST_TOUCHED rows at most.
            rows = rows.join(F.broadcast(reduce(DataFrame.unionByName, gone)), (F.col("id") == F.col("_touched")) & (F.col("_layer") < F.col("_last")), "left_anti")
        return rows.drop("_layer").orderBy("id").limit(limit)

    def _publish(self, entities: DataFrame, before: dict, **more) -> dict:
        """A snapshot with these rows alone."""
        name = f"snapshot-{uuid.uuid4().hex}"
        self._written(name, entities)
        return self._record(before | {"snapshot": name, "deltas": [], "parts": BY_ID} | more, before)

    def _fits(self, now: dict, touched: int) -> bool:
        """Whether a write of that many ids can lie over the snapshot as a delta."""
        deltas = now.get("deltas", [])
        ids = sum(d["touched"] for d in deltas) + touched
        return len(deltas) < MOST_DELTAS and ids <= min(MOST_TOUCHED, TOUCHED_SHARE * now["rows"])

    def _lay(self, rows: DataFrame | None, ids: DataFrame | None, touched: int, before: dict, **more) -> dict:
        """A delta over the snapshot: rows in place of those with their ids, or, with none, these ids deleted."""
        name = f"delta-{uuid.uuid4().hex}"
        if rows is not None:
            rows = self._written(name, rows)
            ids = rows.select("id")
        ids.write.parquet(f"{self.path}/{name}/touched")
        delta = {"name": name, "touched": touched, "rows": rows is not None}
        return self._record(before | {"deltas": [*before.get("deltas", []), delta]} | more, before, ids, rows)

    # -- writes ------------------------------------------------------------

    def prepared(self, raw: DataFrame, highest: int) -> tuple[DataFrame, DataFrame]:
        """Checked rows, and the valid ones as records: numbered, the last of each id, enriched, indexed."""
        if "_seq" not in raw.columns:
            # The order of input, as files and their lines stand.
            raw = raw.withColumn("_seq", F.monotonically_increasing_id())
        checked = validated(raw)
        good = checked.where("error is null").drop("error")
        records = indexed(enriched(latest(numbered(good, highest)))).withColumn("updated_at", F.current_timestamp())
        return checked, records

    def ingest(self, raw: DataFrame, live: bool = False, batch: tuple[str, int] | None = None) -> dict:
        """Upserts raw records; invalid ones are counted and reported, never written.

        batch: a stream's own id and the batch's number in it. The number is published with
        the snapshot, and a batch that comes again is passed over.
        """
        now = self.meta()
        done = now.get("batches", {})
        if batch and done.get(batch[0], -1) >= batch[1]:
            return {"read": 0, "written": 0, "invalid": 0, "errors": [], "corpus_size": now["rows"], "snapshot": now["snapshot"]}
        raw = raw.persist()
        try:
            if live and raw.limit(LIVE_ROWS + 1).count() > LIVE_ROWS:
                raise ValueError(f"at most {LIVE_ROWS} records in one call")
            old = self.entities()
            highest = 0 if old is None else now["figures"]["max_id"] if "figures" in now else old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            checked, records = self.prepared(raw, highest)
            stats = ingest_stats(checked).first().asDict()
            stats["errors"] = [r["error"] for r in checked.where("error is not null").select("error").limit(SHOWN_ERRORS).collect()]
            more = {"batches": done | dict([batch] if batch else [])}
            if old is None:
                made = self._publish(records, now, **more)
            elif self._fits(now, stats["written"]):
                made = self._lay(records.select(*old.columns), None, stats["written"], now, **more)
            else:
                made = self._publish(upserted(old, records.select(*old.columns)), now, **more)
            return stats | {"corpus_size": made["rows"], "snapshot": made["snapshot"]}
        finally:
            raw.unpersist()

    def delete(self, key: int) -> dict:
        now, old = self.meta(), self.entities()
        if old is None or not self._looked_up(now, [key]).limit(1).count():
            raise NotFound(f"no entity has id {key}")
        if self._fits(now, 1):
            return self._lay(None, self.spark.range(key, key + 1), 1, now)
        return self._publish(old.where(F.col("id") != key), now)

    def embed(self) -> dict:
        """Vectors of all entities whose text has none of the current model; others are kept."""
        if self.model is None:
            raise RuntimeError("the embedder could not be made")
        now = self.meta()
        rows = self.entities().withColumn("_text", embedding_text()).withColumn("hash", F.xxhash64("_text"))
        old = self.vectors(self.model.name)
        todo = rows if old is None else rows.join(old.select("id", "hash"), ["id", "hash"], "left_anti")
        made = embedded(todo, F.col("_text"), self._make).join(todo.select("id", "hash"), "id")
        if old is not None:
            made = made.unionByName(old.join(rows.select("id", "hash"), ["id", "hash"], "left_semi").select(*made.columns))
        name = f"vectors-{uuid.uuid4().hex}"
        made.write.parquet(f"{self.path}/{name}")
        n, other = self.spark.read.parquet(f"{self.path}/{name}").agg(F.count("*"), F.count_if(F.size("embedding") != self.dim)).first()
        if other:
            raise RuntimeError(f"{other} vectors haven't {self.dim} dimensions")
        files = {"rows": n, "dim": self.dim, "extent": self._extent(name)}
        return self._point(now | {"vectors": name, "vector_rows": n, "vector_files": files, "dim": self.dim, "model": self.model.name}, now)

    def engine(self) -> Engine:
        """An engine on the current snapshot; later writes don't touch it."""
        found = self.entities()
        if found is None:
            raise NotFound("nothing was ingested yet")
        vectors = self.vectors(self.model.name) if self.model else None
        return Engine(found, None if vectors is None else vectors.select("id", "embedding"), self.model.query if self.model else None, index=self.index(), bitmaps=self.bitmaps(), lookup=partial(self._looked_up, self.meta()))

    def try_engine(self) -> tuple[Engine | None, str | None]:
        """The engine, or why there is none."""
        try:
            return self.engine(), None
        except Exception as e:  # noqa: BLE001  a service starts without an index
            return None, str(e)

    def summary(self) -> dict:
        now = self.meta()
        return {"ready": bool(now), "rows": now.get("rows", 0), "semantic": bool(now.get("vectors")), "model": now.get("model")}
