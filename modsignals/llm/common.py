"""Shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: What separates words where a contract says so.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A table of at most so many rows may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000

#: Spark removes a write's shuffle files when it has ended, instead of when the driver's garbage happens to be collected.
_SHUFFLE_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Writes in here take their shuffle files with them as they end."""
    before = spark.conf.get(_SHUFFLE_FILES_GO, None)
    spark.conf.set(_SHUFFLE_FILES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_FILES_GO)
        else:
            spark.conf.set(_SHUFFLE_FILES_GO, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there. Cuts the lineage; survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing reads any more, and lets Spark drop the shuffle files of steps that have ended."""
    for df in tables:
        files = df.inputFiles()
        context = df.sparkSession.sparkContext
        if files:
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        # Spark's cleaner removes what the driver's collector finds unreachable; left alone, that can be half an hour later.
        context._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; a text of ASCII only takes the faster way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; which of them are null counts."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*(c for f in df.schema for c in (plain(f), F.col(f"`{f.name}`").isNull())))


def crc_rest(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def join_small(rows: DataFrame, small: DataFrame, on: str, small_rows: int, how: str = "inner") -> DataFrame:
    """Joins with a table whose rows were counted: broadcast up to BROADCAST_ROWS, else shuffled (adaptive execution splits hot keys)."""
    return rows.join(F.broadcast(small) if small_rows <= BROADCAST_ROWS else small, on, how)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most about ``most_bytes``, so that what a task makes of them stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file, as a task or the driver finds it.

    ``MODSIGNALS_TOKENIZERS`` names another folder.
    """
    folder = os.environ.get("MODSIGNALS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
