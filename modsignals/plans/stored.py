"""Registered queries over what the library itself has stored: file-sets, layouts, partial sums, histories and streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import author_history as history
from ..operators import authors, cohort, partials, stats, terms
from ..schemas import PASS1, RAW_STATUS
from ..sources import json_object, layout, readers, writers
from ..sources.scratch import scratch_path
from ..streaming import capture, recheck
from . import bindings as b
from . import queries as q

PARTS = 8
CAPTURED = "2024-01-20 00:00:00"
CLOSED = "2030-01-01 00:00:00"


def _in_parts(df: DataFrame) -> DataFrame:
    """Dealt to several tasks, so that a write leaves several files."""
    return df.repartition(PARTS)


# ---- file-sets and row numbers --------------------------------------------------------------------------------------


def newest_ids_roundtrip(spark, folder):
    """Two runs of id files, each a folder of several parts; the earlier one holds other ids."""
    path = scratch_path(spark, "id_files")
    ids = b.table(spark, folder, "documents").select(F.col("lang").alias("subreddit"), F.col("doc_id").cast("string").alias("post_fullname"))
    writers.write_cohort_ids(cohort.cohort_id_lists(ids.withColumn("post_fullname", F.concat(F.lit("old"), "post_fullname"))), f"{path}/run_0")
    writers.write_cohort_ids(_in_parts(cohort.cohort_id_lists(ids, most=20)), f"{path}/run_1")
    return readers.read_newest_cohort_ids(spark, f"{path}/run_*", single_object=False)


def newest_rows_roundtrip(spark, folder):
    """S5 where only the rows tell the community: two runs in folders of several parts, the later one without one community."""
    path = scratch_path(spark, "row_files")
    newest = q._event_cohort(spark, folder)
    _in_parts(newest.withColumn("initial_score", F.lit(-1).cast("bigint"))).write.options(**writers.CSV_WRITE_OPTIONS).csv(f"{path}/run_0")
    _in_parts(newest.where("subreddit <> 'signup'")).write.options(**writers.CSV_WRITE_OPTIONS).csv(f"{path}/run_1")
    return readers.read_newest_pass1(spark, f"{path}/run_*").select("subreddit", "post_fullname", "initial_score", "author_username")


def _posts_in_files(spark, folder) -> DataFrame:
    """Flat posts read back from CSV files that hold them in the order of their ids, in contiguous ranges."""
    path = scratch_path(spark, "posts_in_files")
    ordered = q._document_posts(spark, folder).repartitionByRange(PARTS, "row_no").sortWithinPartitions("row_no")
    writers.write_csv(ordered.drop("labels", "row_no"), path)
    return readers.read_posts(spark, path)


def post_row_numbers(spark, folder):
    return _posts_in_files(spark, folder).select("row_no", "post_uri", "has_moderation")


def sample_from_files(spark, folder):
    return stats.sample_moderated(_posts_in_files(spark, folder))


def label_top_from_files(spark, folder):
    return stats.label_top(_posts_in_files(spark, folder), 10)


def json_object_roundtrip(spark, folder):
    """The newest ids of every community as one JSON object in one file, read in pieces."""
    path = scratch_path(spark, "id_object")
    ids = cohort.newest_submissions(b.event_submissions(spark, folder))
    lists = ids.groupBy("subreddit").agg(F.array_sort(F.collect_list("fullname")).alias("ids"))  # at most 100 a community
    whole = lists.agg(F.map_from_entries(F.collect_list(F.struct("subreddit", "ids"))).alias("all"))
    whole.select(F.to_json("all", {"pretty": "true"}).alias("value")).write.text(path)
    return json_object.read_id_object(spark, path)


# ---- terms and communities ------------------------------------------------------------------------------------------


def listed_terms(spark, folder):
    """The list of terms as a table, with the hits of each; a term without hits stays in the list."""
    hits = terms.match_terms(b.table(spark, folder, "documents").select("doc_id", "text"), b.TERMS, "text")
    counts = hits.groupBy("search_term").agg(F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("first_doc"))
    joined = readers.term_table(spark, b.TERMS).join(counts, "search_term", "left")
    return joined.select("term_no", "search_term", F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"), "first_doc")


def skipped_community(spark, folder):
    """A community without ids is skipped, although its posts were captured and re-checked."""
    submissions = b.document_submissions(spark, folder)
    ids = submissions.where("subreddit <> 'es'").select("subreddit", F.col("fullname").alias("post_fullname"))
    status = cohort.status_flags(b.raw_status(spark, folder))
    pass1 = cohort.pass1_rows(submissions, q._snapshot(spark, folder), b.RUN_TS)
    return cohort.community_totals(cohort.complete_cohort(pass1, ids, status))


def status_ties(spark, folder):
    """Re-checks at the same time, told apart by their score."""
    raw = b.raw_status(spark, folder).withColumn("rechecked_at_utc", F.lit(b.FIRST_CHECK).cast("timestamp"))
    return q._plain_times(cohort.latest_status(cohort.status_flags(raw), tie_break=("final_score",)))


# ---- layouts, partial sums, histories -------------------------------------------------------------------------------


def _document_pass1(spark, folder, run_ts=b.RUN_TS) -> DataFrame:
    return cohort.pass1_rows(b.document_submissions(spark, folder), q._snapshot(spark, folder), run_ts)


def bucketed_status(spark, folder):
    """J1 over two tables laid out by post."""
    path = scratch_path(spark, "bucketed")
    name = path.rsplit("-", 1)[1]
    pass1 = layout.write_bucketed(_document_pass1(spark, folder), f"pass1_{name}", f"{path}/pass1", PARTS)
    status = layout.write_bucketed(cohort.status_flags(b.raw_status(spark, folder)), f"status_{name}", f"{path}/status", PARTS)
    return q._plain_times(layout.complete_bucketed(pass1, status))


def _runs(df: DataFrame, column: str):
    """The rows in three parts that stand for three runs."""
    part = F.pmod(F.xxhash64(column), F.lit(3))
    return [df.where(part == n) for n in range(3)]


def _run_partials(spark, folder, frame, ddl, counted) -> DataFrame:
    """Partial sums of three runs, written run by run and read together."""
    path = scratch_path(spark, "partials")
    for number, run in enumerate(frame):
        writers.write_partials(counted(run), path, f"run_{number}")
    return readers.read_partials(spark, path, ddl)


def _post_partials(spark, folder) -> DataFrame:
    return _run_partials(spark, folder, _runs(q._found_posts(spark, folder), "post_uri"), partials.POST_PARTIALS, partials.post_partials)


def basic_stats_of_runs(spark, folder):
    return partials.statistics(_post_partials(spark, folder))


def report_of_runs(spark, folder):
    return partials.report(_post_partials(spark, folder))


def removal_rates_of_runs(spark, folder):
    complete = _runs(q._document_complete(spark, folder), "post_fullname")
    return partials.removal_rates(_run_partials(spark, folder, complete, partials.CHECK_PARTIALS, partials.check_partials))


def author_versions(spark, folder):
    """The author dimension after three runs, merged run by run."""
    sightings = b.changing_authors(spark, folder)
    path = scratch_path(spark, "author_history")
    current = spark.createDataFrame([], history.HISTORY)
    for number, run in enumerate(b.RUNS):
        snapshot = authors.author_snapshot(sightings, only_run=run)
        current, closed = history.merge_run(current, snapshot, run)
        current.write.parquet(f"{path}/current_{number}")
        closed.write.parquet(f"{path}/closed/run={number}")
        current = spark.read.schema(history.HISTORY).parquet(f"{path}/current_{number}")
    closed = spark.read.schema(history.HISTORY).parquet(f"{path}/closed")
    return q._plain_times(current.unionByName(closed.select(*current.columns)))


# ---- streams --------------------------------------------------------------------------------------------------------


def captured_stream(spark, folder):
    """The first capture as a stream: every drop arrives twice, every post is captured once."""
    path = scratch_path(spark, "capture")
    drops = b.document_submissions(spark, folder).withColumn("captured_at", F.lit(b.RUN_TS).cast("timestamp"))
    for number in range(2):
        _in_parts(drops).write.json(f"{path}/drops/{number}", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    rows = capture.capture(capture.read_drops(spark, f"{path}/drops/*", files_per_batch=PARTS), q._snapshot(spark, folder))
    capture.write_captures(rows, f"{path}/captures", f"{path}/state").awaitTermination()
    back = readers.read_snapshot_table(spark, f"{path}/captures", PASS1)
    return q._plain_times(back.drop("run_id")).select("subreddit", "post_fullname", "title", "initial_score", "captured_at_utc", "author_username")


def recheck_stream(spark, folder):
    """J1 as a join of two streams, equal to the left join of the batch."""
    path = scratch_path(spark, "recheck")
    pass1 = _document_pass1(spark, folder, CAPTURED)
    writers.write_snapshot(pass1, f"{path}/captures", CAPTURED)
    writers.write_snapshot(recheck.closing_row(spark, PASS1, "captured_at_utc", CLOSED, subreddit="none"), f"{path}/captures", CLOSED)
    for number, when in enumerate((b.FIRST_CHECK, b.SECOND_CHECK)):
        checks = b.raw_status(spark, folder).where(F.col("rechecked_at_utc") == F.lit(when).cast("timestamp"))
        _in_parts(checks).write.parquet(f"{path}/checks/{number}")
    recheck.closing_row(spark, RAW_STATUS, "rechecked_at_utc", CLOSED, fullname="closing").write.parquet(f"{path}/checks/2")
    joined = recheck.recheck(recheck.read_captures(spark, f"{path}/captures"), recheck.read_rechecks(spark, f"{path}/checks/*"))
    recheck.write_rows(joined, f"{path}/complete", f"{path}/join_state").awaitTermination()
    return recheck.last_rechecks(spark, f"{path}/complete").select("subreddit", "post_fullname", *cohort.STATUS_FIELDS[:-1])


def status_state(spark, folder):
    """A19 kept as state: three drops, the newest re-check in the first, the oldest in the last."""
    path = scratch_path(spark, "status")
    raw = b.raw_status(spark, folder)
    newest = F.col("rechecked_at_utc") == F.lit(b.SECOND_CHECK).cast("timestamp")
    even = F.pmod(F.xxhash64("fullname"), F.lit(2)) == 0
    for number, drop in enumerate((raw.where(newest & even), raw.where(~newest & ~even), raw.where((newest & ~even) | (~newest & even)))):
        _in_parts(drop).write.parquet(f"{path}/checks/{number}")
    stream = recheck.read_rechecks(spark, f"{path}/checks/*", files_per_batch=PARTS)
    recheck.write_status(stream, f"{path}/changes", f"{path}/state").awaitTermination()
    return q._plain_times(recheck.read_status(spark, f"{path}/state"))


QUERIES = {
    f.__name__: f
    for f in (
        newest_ids_roundtrip,
        newest_rows_roundtrip,
        post_row_numbers,
        sample_from_files,
        label_top_from_files,
        json_object_roundtrip,
        listed_terms,
        skipped_community,
        status_ties,
        bucketed_status,
        basic_stats_of_runs,
        report_of_runs,
        removal_rates_of_runs,
        author_versions,
        captured_stream,
        recheck_stream,
        status_state,
    )
}
