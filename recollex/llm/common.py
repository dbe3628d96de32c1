"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset, read by Spark only, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's checkpoint folder.

    A session on this machine alone (tests, local mode) that names none gets one here; on a cluster that is an error, as
    executors would not see each other's files.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="recollex-checkpoints-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows that go to a Python worker at a time while an intermediate table is written; whole texts make a batch large.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on at most BATCH_ROWS rows at a time go to a worker, for a result that the caller computes later.

    A plan takes that number when it is run, so it stays set in the session. A number that is smaller already stays as it is.
    """
    before = int(spark.conf.get(_BATCH))
    if not 0 < before <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_BATCH)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    _open.append(path)
    return found


#: Where written() has put the tables that are still referred to.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: Paths of these tables, in the order they were made, as long as they are there.
_open: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _open.remove(path)


def delete(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing which is still to be computed reads; what a result reads stays for the caller."""
    for df in tables:
        if (path := _paths.pop(df, None)) in _open:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def only(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Of the tables that written() makes within, those that are put into the list stay and all others are deleted at the end."""
    before, kept = set(_open), []
    yield kept
    for path in {*_open} - before - {_paths.get(df) for df in kept}:
        _delete(spark, path)


def lower_ascii(c: Column) -> Column:
    """A to Z in lower case; every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of the filter that spares the shuffle of rows that can't match: so many a value, and 32 MB in all at most, which is what
#: a broadcast may take. That is 33 million values; beyond them more and more rows pass, in the end all, and the joins behind
#: the filter shuffle these. Results are the same.
FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 28


def _place(c: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(bits))


def bitmap(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A bitmap of the hashed values of a column, in rows of 4 kB, and its size in bits."""
    n = rows.count()
    size = 1 << 15
    while size < min(FILTER_BITS * n, MOST_FILTER_BITS):
        size *= 2
    place = rows.select(_place(F.col(column), size).alias("place"))
    return place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")), size


def may_be_in(rows: DataFrame, column: str, filter_: tuple[DataFrame, int], holds: bool = True) -> DataFrame:
    """The rows whose value the bitmap may hold, or (holds=False) those whose value it surely does not.

    Every row is in one of the two; a null value counts as any other. A bitmap that fills up only lets more rows through.
    """
    columns, (bits, size) = rows.columns, filter_
    rows = rows.withColumn("_place", _place(F.col(column), size)).withColumn("_part", F.bitmap_bucket_number("_place"))
    found = rows.join(F.broadcast(bits.select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))), "_part", "inner" if holds else "left")
    position = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_place) % 8 as int))")) != 0, F.lit(False))
    return found.where(bit if holds else ~bit).select(columns)
