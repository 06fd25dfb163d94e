"""Tables between the stages of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a folder of its own; on a
    cluster that is an error, as executors can't read each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="entitylens-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Spark removes the shuffle files of a statement as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Later stages restart from these files if executors are lost. ``discard``
    removes them once whatever reads them has been written; what is left then goes
    when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/entitylens/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: A filter's bits, as blocks of 32,768: 8 MB at most, however many keys there are.
FILTER_BLOCKS = 2048


def maybe_flagged(df: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """df with _maybe: whether key may be in wanted's one column; true for all that are, and for few others.

    A filter of one bit for each key, made by Spark's bitmap aggregate and broadcast. With n
    keys, one in 67 million / n of the others passes; a join has to decide.
    """
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), c), F.lit(FILTER_BLOCKS)).cast("int")
    place = lambda c: F.pmod(F.xxhash64(F.lit("place"), c), F.lit(32_768))
    k = F.col(wanted.columns[0])
    # Bits meet as numbers, as a block that is not full yet is far larger than they are.
    met = wanted.select(block(k).alias("_block"), place(k).alias("_place")).repartition("_block")
    bits = stored(met.groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits")), name)
    at = place(key).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return df.withColumn("_block", block(key)).join(F.broadcast(bits), "_block", "left").select(*df.columns, held.alias("_maybe"))


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """The rows of df whose key may be in wanted's one column, so that others are left out before a join shuffles them."""
    return maybe_flagged(df, key, wanted, name).where("_maybe").select(*df.columns)


def discard(*frames: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
