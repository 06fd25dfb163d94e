"""Continuous ingestion: files of records that arrive in a folder go through the same upsert."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entitylens.sources.companies import CORRUPT, RAW_SCHEMA
from entitylens.store import Store


def ingest_folder(store: Store, folder: str, checkpoint: str, once: bool = True, files: int = 64) -> StreamingQuery:
    """Upserts JSON lines files as they arrive. With once, takes all there are and stops.

    A batch's number is published with its snapshot, under the id that the checkpoint
    gives its stream, so one that runs again after a stop is passed over and stores
    nothing twice. A fresh checkpoint, even at the same place, is another stream with
    an id of its own, whose numbers start anew and hide nothing.
    """
    source = store.spark.readStream.schema(RAW_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files).json(folder)

    def upsert(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch.withColumn("_seq", F.monotonically_increasing_id()), batch=(stream_id(store, checkpoint), number))

    writer = source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def stream_id(store: Store, checkpoint: str) -> str:
    """The id in a checkpoint's metadata, which Spark writes once and keeps over restarts."""
    lines = store.spark.read.text(f"{checkpoint}/metadata").collect()  # one line
    return json.loads(lines[0]["value"])["id"]
