"""One huge JSON object that maps communities to lists of ids, read by many tasks (S3, K4).

Such a file is one record, so Spark's JSON reader gives it to one task. Here it is read as text cut at quotation marks, which
any number of tasks can do from any place of the file. What a piece is depends on the pieces before it: every second one
is the inside of a string, and a string is a community if a colon follows it, else an id of the community named last. Both are
found within the blocks of the file; one row per block carries over what goes from a block to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .positions import BLOCK, FILE, PLACE, running_offsets, with_places
from .scratch import scratch_path

QUOTE = '"'


def _ends_escaped(piece: Column) -> Column:
    """Whether the quotation mark after a piece belongs to the string: an odd number of backslashes stands before it."""
    return F.length(F.regexp_extract(piece, r"(\\*)$", 1)) % 2 == 1


def _unescaped(inside: Column) -> Column:
    return F.from_json(F.concat(F.lit('["'), inside, F.lit('"]')), "array<string>")[0]


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_id_object(spark: SparkSession, path: "str | list[str]") -> DataFrame:
    """(subreddit, post_fullname) of files that hold one JSON object each, with lists of ids as its values.

    Commas, brackets and escapes inside names and ids are part of them. Only strings are ids; a null in a list gives no row,
    and neither does a community without ids. Files may be of any size, but not compressed as a whole if they are to be
    read by several tasks.
    """
    pieces = with_places(spark.read.option("lineSep", QUOTE).text(path))
    # A quotation mark that is part of a string does not end it: the string goes on in the next piece.
    pieces = _kept(pieces.withColumn("_ends", (~_ends_escaped(F.col("value"))).cast("bigint")), "json-pieces")
    blocks = pieces.groupBy(FILE, BLOCK).agg(F.sum("_ends").alias("_all"))
    offsets = running_offsets(blocks, [FILE, BLOCK], "_all")
    start = offsets.groupBy(FILE).agg(F.min("offset").alias("_start"))
    before = offsets.join(start, FILE).select(FILE, BLOCK, (F.col("offset") - F.col("_start")).alias("_before"))
    within = Window.partitionBy(FILE, BLOCK).orderBy(PLACE)
    part = F.col("_before") + F.sum("_ends").over(within) - F.col("_ends")
    numbered = pieces.join(before, [FILE, BLOCK]).withColumn("_part", part)
    # Every part is one piece, but for a string with quotation marks in it; those are put together again.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, PLACE, "value"))), lambda x: x["value"])
    parts = numbered.groupBy(FILE, "_part").agg(F.min(BLOCK).alias(BLOCK), F.array_join(ordered, QUOTE).alias("value"))
    return _ids(_kept(parts, "json-parts"))


def _ids(parts: DataFrame) -> DataFrame:
    """Ids with their community from the parts of files: text between strings at even numbers, strings at odd ones."""
    strings = parts.where("_part % 2 = 1").select(FILE, BLOCK, "_part", "value")
    names = parts.where("_part % 2 = 0 AND ltrim(value) LIKE ':%'").select(FILE, (F.col("_part") - 1).alias("_part"), F.lit(True).alias("_name"))
    marked = strings.join(names, [FILE, "_part"], "left").withColumn("_name", F.coalesce("_name", F.lit(False)))
    marked = _kept(marked, "json-strings")
    opened = marked.groupBy(FILE, BLOCK).agg(F.max_by("value", F.when(F.col("_name"), F.col("_part"))).alias("_opened"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = opened.select(FILE, BLOCK, F.last("_opened", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy(FILE, BLOCK).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = marked.withColumn("_community", F.last(F.when(F.col("_name"), F.col("value")), ignorenulls=True).over(so_far))
    joined = named.where(~F.col("_name")).join(carried, [FILE, BLOCK])
    community = F.coalesce("_community", "_carried")
    return joined.select(_unescaped(community).alias("subreddit"), _unescaped(F.col("value")).alias("post_fullname"))
