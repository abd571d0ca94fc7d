"""Row numbers over many files: the order that S1, W4 and W6 speak of.

Rows are ordered by file name, then by their place in the file. A scan reads a block of a file from front to back in one
task, so ``monotonically_increasing_id`` orders the rows of a block. The first number of a block and its rows are counted
once; running sums over these few counts, one row per block, give every block the number of rows before it. Rows are neither
sorted nor moved for that, and no task sees more than its share of the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .scratch import scratch_path

FILE, BLOCK, PLACE = "_file", "_block", "_place"


def with_places(scan: DataFrame) -> DataFrame:
    """A file scan with the place of every row: its file, the block of the file, and a number that grows within the block."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(PLACE),
    )


def running_offsets(counts: DataFrame, order: list[str], n: str) -> DataFrame:
    """``counts`` with ``offset``, the sum of ``n`` over all rows before a row in ``order``, which tells all rows apart.

    The rows are cut into ranges. Sums run within a range; what lies before a range is one number per range, of which there
    are as many as tasks.
    """
    spark = counts.sparkSession
    path = scratch_path(spark, "offsets")
    counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(n).alias("total"))
    every = totals.agg(F.collect_list(F.struct("_range", "total"))).scalar()
    zero = F.lit(0).cast("bigint")
    earlier = F.aggregate(F.filter(F.col("_totals"), lambda x: x["_range"] < F.col("_range")), zero, lambda sum_, x: sum_ + x["total"])
    summed = ranged.withColumn("_totals", every).withColumn("offset", F.coalesce(F.sum(n).over(before), zero) + earlier)
    return summed.drop("_range", "_totals")


def with_row_numbers(placed: DataFrame, into: str = "row_no") -> DataFrame:
    """Rows of ``with_places`` with their number from 0, by file name and place in the file.

    Counting the rows of each block is a scan of its own, which reads no column. The table of blocks is broadcast as long as
    Spark finds it small.
    """
    blocks = placed.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_rows"), F.min(PLACE).alias("_first"))
    offsets = running_offsets(blocks, [FILE, BLOCK], "_rows").drop("_rows")
    numbered = placed.join(offsets, [FILE, BLOCK]).withColumn(into, F.col("offset") + F.col(PLACE) - F.col("_first"))
    return numbered.drop(FILE, BLOCK, PLACE, "offset", "_first")
