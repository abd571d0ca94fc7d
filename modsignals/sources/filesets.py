"""Files that one write left behind, taken together: what S4 and S5 choose among.

A write in Spark leaves a folder of part files whose modification times differ, so the newest *file* is only a piece of the
newest run. A file-set is the unit instead: part files of one folder form one, any other file is one by itself, and a
pattern can name the run inside a path where neither holds. A set is as new as its newest file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part-"


def listed_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path and modificationTime of the files that match, or lie in folders that match; their content is not read.

    A pattern that matches nothing gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        return files.load(pattern).select("path", "modificationTime")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp")


def file_set(path: Column, run: str | None = None) -> Column:
    """The name of the file-set of a path; ``run`` is a pattern whose first group takes the run's name out of a path."""
    if run is not None:
        return F.regexp_extract(path, run, 1)
    name = F.substring_index(path, "/", -1)
    return F.when(F.startswith(name, F.lit(PART)), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)


def newest_sets(files: DataFrame, by: Sequence[str] = (), time: str = "modificationTime") -> DataFrame:
    """For each value of ``by``, the name of its newest file-set, ties to the larger name. ``files`` has file_set and ``time``."""
    sets = files.groupBy(*by, "file_set").agg(F.max(time).alias("_time"))
    return sets.groupBy(*by).agg(F.max_by("file_set", F.struct("_time", "file_set")).alias("file_set"))


def newest_paths(spark: SparkSession, pattern: str, run: str | None = None, community: str | None = None) -> list[str]:
    """All files of the newest file-set, or of that of every community.

    ``community`` is a pattern whose first group takes the whole community out of a path, so ``foo`` never picks up a file of
    ``foo_bar`` (T20). The names come to the driver, which needs them to plan the scan of just these files.
    """
    files = listed_files(spark, pattern).withColumn("file_set", file_set(F.col("path"), run))
    by = []
    if community is not None:
        files = files.withColumn("community", F.regexp_extract("path", community, 1)).where("community <> ''")
        by = ["community"]
    newest = newest_sets(files, by)
    return sorted(row["path"] for row in files.join(newest, [*by, "file_set"], "left_semi").select("path").collect())
