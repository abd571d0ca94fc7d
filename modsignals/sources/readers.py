"""Readers with explicit schemas: S1, S2, S3, S4, S5, S13."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import parse_labels
from ..operators.joins import join_hot
from ..schemas import (
    COUNT_FIELDS,
    PASS1,
    PASS2_COMPLETE,
    POSTS,
    TERM_RECORD,
    USER_ACTIVITY,
    cast_to,
    names,
)
from ..small import small_table
from .filesets import file_set, listed_files, newest_paths, newest_sets
from .positions import BLOCK, FILE, PLACE, with_places, with_row_numbers
from .replace import standing_path

FILE_TIME = "_file_time"
# Quotes inside quoted fields are doubled, and fields may hold line breaks.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _read_csv(
    spark: SparkSession, path: "str | list[str]", ddl: str, with_files: bool = False, with_place: bool = False
) -> DataFrame:
    """A CSV table of the given columns.

    Fields are read as text and cast afterwards: whole numbers written as ``12.0`` because a column
    has gaps, and times in either ISO form, then come out right instead of as null. A field with line breaks
    keeps its file in one task, so large tables belong in many files, as Spark writes them.
    """
    text = ", ".join(f"{n} string" for n in names(ddl))
    raw = spark.read.options(**CSV_OPTIONS).schema(text).csv(standing_path(spark, path) if isinstance(path, str) else path)
    if with_files:
        raw = raw.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_modification_time").alias(FILE_TIME))
        ddl += f", {FILE} string, {FILE_TIME} timestamp"
    if with_place:
        raw = with_places(raw)
        ddl += f", {FILE} string, {BLOCK} bigint, {PLACE} bigint"
    whole = [f.split(" ")[0] for f in ddl.split(", ") if f.endswith(" bigint")]
    as_number = {n: F.coalesce(F.col(n).try_cast("bigint"), F.col(n).try_cast("double").try_cast("bigint")) for n in whole}
    return cast_to(raw.withColumns(as_number) if as_number else raw, ddl)


def read_posts(spark: SparkSession, path: "str | list[str]") -> DataFrame:
    """Flat posts with parsed ``labels`` and ``row_no``, the position of the row.

    Empty text reads back as null; words like ``null`` or ``NA`` stay text (T8). ``row_no`` counts from 0 through all files
    in the order of their names. For that the rows of every file are counted when this is called, a scan of its own.
    """
    posts = _read_csv(spark, path, POSTS, with_place=True)
    return with_row_numbers(posts.withColumn("labels", parse_labels(F.col("moderation_labels"))))


def read_user_activity(spark: SparkSession, path: "str | list[str]") -> DataFrame:
    return _read_csv(spark, path, USER_ACTIVITY)


def read_pass1(spark: SparkSession, path: "str | list[str]") -> DataFrame:
    """S2 from CSV."""
    return _read_csv(spark, path, PASS1)


def read_newest_pass1(spark: SparkSession, pattern: str, community: str | None = None, run: str | None = None) -> DataFrame:
    """S5 on raw files: of every community, the rows of its newest file-set, all its parts (``filesets``).

    ``community`` is a pattern whose first group takes the whole community out of a path; then the newest files are found
    from names and times alone, and only they are read. Without it the community is read from the rows, which means all files.
    Either way ``foo`` never picks up a file of ``foo_bar`` (T20). ``run`` names the file-set in a path where folders do not.
    A pattern that matches nothing gives no rows.
    """
    if community is not None:
        paths = newest_paths(spark, pattern, run, community)
        return _read_csv(spark, paths, PASS1) if paths else spark.createDataFrame([], PASS1)
    if listed_files(spark, pattern).isEmpty():
        return spark.createDataFrame([], PASS1)
    rows = _read_csv(spark, pattern, PASS1, with_files=True).withColumn("file_set", file_set(F.col(FILE), run))
    newest = newest_sets(rows, ["subreddit"], FILE_TIME)
    return join_hot(rows, newest, ["subreddit", "file_set"], "left_semi").drop(FILE, FILE_TIME, "file_set")


def read_complete(spark: SparkSession, path: "str | list[str]") -> DataFrame:
    return _read_csv(spark, path, PASS2_COMPLETE)


def read_snapshot_table(spark: SparkSession, path: str, ddl: str = PASS1) -> DataFrame:
    """A partitioned snapshot table written by ``write_snapshot``; filters on run_id and subreddit prune folders."""
    return spark.read.schema(f"{ddl}, run_id string").parquet(path)


def read_cohort_ids(spark: SparkSession, path: "str | list[str]", single_object: bool = False) -> DataFrame:
    """S3: (subreddit, post_fullname) from JSON that maps a community to its ids.

    ``write_cohort_ids`` writes one object per line. ``single_object`` reads files that hold one object over
    many lines, each of which one task reads; ``json_object.read_id_object`` reads a huge one with many.
    """
    text = spark.read.text(path, wholetext=single_object)
    return _id_rows(text.select("value"))


def _id_rows(text: DataFrame) -> DataFrame:
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("subreddit", "ids"))
    return parsed.select("subreddit", F.explode("ids").alias("post_fullname"))


def read_newest_cohort_ids(spark: SparkSession, pattern: str, single_object: bool = True, run: str | None = None) -> DataFrame:
    """S4 on raw files: ids of the newest file-set, all its parts (``filesets``); empty when there is none.

    The newest files are found from names and times alone; no other file is read. ``run`` names the file-set in a path where
    folders do not.
    """
    paths = newest_paths(spark, pattern, run)
    if not paths:
        return spark.createDataFrame([], "subreddit string, post_fullname string")
    return read_cohort_ids(spark, paths, single_object)


def read_partials(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Partial sums of all runs written by ``write_partials``, with their run_id; a filter on it reads only those runs."""
    return spark.read.schema(f"{ddl}, run_id string").parquet(path)


def read_term_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested term records written by ``write_term_records``; ``N/A`` counts become null."""
    as_text = TERM_RECORD
    for name in COUNT_FIELDS:
        as_text = as_text.replace(f"{name}:bigint", f"{name}:string")
    records = spark.read.schema(f"{as_text}, collect_date date").json(path)

    def parsed(video: Column) -> Column:
        for name in COUNT_FIELDS:
            video = video.withField(name, video[name].try_cast("bigint"))
        return video

    return records.withColumn("video_details", F.transform("video_details", parsed))


def term_table(spark: SparkSession, terms: Sequence[str]) -> DataFrame:
    """A parameter list as a table, with its order."""
    return small_table(spark, list(enumerate(terms)), "term_no int, search_term string")
