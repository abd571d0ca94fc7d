"""The registered queries. Each takes (spark, folder), reads whole tables and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PREVIEW_CHARS
from ..functions.buckets import bucket_label
from ..functions.labels import is_bad_label_json, joined_label_values, parse_labels
from ..functions.text import title_preview
from ..operators import authors, cohort, posts, report, stats, terms, users
from ..operators import videos as video_ops
from ..schemas import PASS1, PASS2_COMPLETE
from ..sources import readers, writers
from ..sources.scratch import scratch_path
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]

# ---- posts ----------------------------------------------------------------------------------------------------------


def _document_posts(spark: SparkSession, folder: str) -> DataFrame:
    return posts.flatten_posts(b.raw_posts(spark, folder), b.RUN_TS, keep=("row_no",))


def _found_posts(spark: SparkSession, folder: str) -> DataFrame:
    return posts.flatten_posts(b.searched_posts(spark, folder), b.RUN_TS, keep=("row_no",))


_FLAT = (
    "search_term", "post_uri", "post_text", "author_handle", "author_display_name", "author_followers",
    "author_following", "author_posts", "likes_count", "repost_count", "reply_count", "has_moderation", "created_at",
)


def _label_text():
    return F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["type"], x["value"], x["created"])), "|")


def flatten_posts(spark, folder):
    flat = _document_posts(spark, folder)
    return flat.select(*_FLAT, F.size("labels").cast("bigint").alias("n_labels"), _label_text().alias("label_text"))


def term_match_top100(spark, folder):
    documents = b.table(spark, folder, "documents")
    hits = terms.search_top(documents, b.TERMS, "text", [F.asc("doc_id")], 100, rank="rank")
    return hits.select("search_term", F.col("rank").cast("bigint").alias("rank"), "doc_id")


def basic_stats(spark, folder):
    return stats.basic_statistics(_found_posts(spark, folder))


def moderation_by_term(spark, folder):
    return stats.moderation_by_term(_found_posts(spark, folder))


def moderation_by_bucket(spark, folder):
    return stats.moderation_by_bucket(_document_posts(spark, folder))


def bucket_of_balance(spark, folder):
    return stats.moderation_by_bucket(b.balance_posts(spark, folder))


def bucket_rates(spark, folder):
    return stats.bucket_rates(_document_posts(spark, folder))


def follower_categories(spark, folder):
    return b.table(spark, folder, "customer").select(
        "c_custkey", bucket_label(F.col("c_acctbal")).alias("follower_category")
    )


def label_totals(spark, folder):
    return stats.label_totals(_document_posts(spark, folder))


def label_distribution(spark, folder):
    return stats.label_distribution(_document_posts(spark, folder))


def label_top10(spark, folder):
    # About a hundred values, many with equal counts.
    value = F.get_json_object("props", "$.k")
    events = b.table(spark, folder, "events").select(
        F.col("event_id").alias("row_no"), F.array(F.struct(value.alias("value"))).alias("labels")
    )
    return stats.label_top(events, 10)


def label_json_parsed(spark, folder):
    flat = _document_posts(spark, folder).withColumn("parsed", parse_labels(F.col("moderation_labels")))
    return flat.select(
        "post_uri",
        F.size("parsed").cast("bigint").alias("n_labels"),
        joined_label_values(F.col("parsed")).alias("label_values"),
        is_bad_label_json(F.col("moderation_labels")).alias("bad_json"),
    )


def _odd_label_posts(spark, folder):
    """Label text with null values, without values, and of no JSON at all."""
    text = """CASE lang WHEN 'de' THEN '[{"value": null}, {"value": "a"}]' WHEN 'fr' THEN '[{"other": 1}, 7, {"value": "b"}]'
                        WHEN 'es' THEN 'no json' ELSE '[]' END"""
    posts = b.table(spark, folder, "documents").selectExpr("doc_id", f"{text} AS moderation_labels")
    return posts.withColumn("labels", parse_labels(F.col("moderation_labels")))


def label_json_odd(spark, folder):
    return _odd_label_posts(spark, folder).select(
        "doc_id",
        F.size("labels").cast("bigint").alias("n_labels"),
        joined_label_values(F.col("labels")).alias("label_values"),
        is_bad_label_json(F.col("moderation_labels")).alias("bad_json"),
    )


def label_totals_odd(spark, folder):
    return stats.label_totals(_odd_label_posts(spark, folder))


def engagement_comparison(spark, folder):
    return stats.engagement_comparison(b.event_posts(spark, folder))


def sample_moderated(spark, folder):
    raw = b.raw_posts(spark, folder, shown=f"left(text, {PREVIEW_CHARS})")
    return stats.sample_moderated(posts.flatten_posts(raw, b.RUN_TS, keep=("row_no",)))


def top_term(spark, folder):
    return stats.top_term(_found_posts(spark, folder))


def summary_report(spark, folder):
    return report.summary_report(_found_posts(spark, folder))


def report_text(spark, folder):
    found = report.summary_report(_found_posts(spark, folder))
    return report.report_lines(found, "MODERATION ANALYSIS", b.RUN_TS)


def report_file(spark, folder):
    path = scratch_path(spark, "report")
    writers.write_report(report_text(spark, folder), path)
    return spark.read.text(path)


def term_match_long(spark, folder):
    """A list beyond what is searched inline, with terms shorter than a piece."""
    hits = terms.match_terms(b.table(spark, folder, "documents"), b.MANY_TERMS, "text")
    return hits.groupBy("search_term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


# ---- users ----------------------------------------------------------------------------------------------------------


def author_feed(spark, folder):
    feeds = users.author_feeds(b.user_posts(spark, folder))
    return feeds.select("handle", F.posexplode("feed").alias("pos", "entry")).select(
        "handle", F.col("pos").cast("bigint").alias("pos"), F.col("entry.post.uri").alias("event_id")
    )


def user_activity(spark, folder):
    active = users.user_activity(
        b.handles(spark, folder), b.profiles(spark, folder), users.author_feeds(b.user_posts(spark, folder))
    )
    return active.withColumn("label_values", joined_label_values(F.col("labels"))).drop("labels", "all_labels")


def user_activity_csv(spark, folder):
    path = scratch_path(spark, "user_activity")
    active = users.user_activity(
        b.handles(spark, folder), b.profiles(spark, folder), users.author_feeds(b.user_posts(spark, folder))
    )
    writers.write_csv(active.drop("labels"), path)
    return readers.read_user_activity(spark, path).drop("all_labels")


# ---- submissions and cohorts ------------------------------------------------------------------------------------------


def _snapshot(spark, folder):
    return authors.author_snapshot(b.raw_authors(spark, folder), only_run=b.RUN_TS)


def author_snapshot(spark, folder):
    return _snapshot(spark, folder)


def post_author_info(spark, folder):
    # The snapshot of all runs, of which one is named.
    submissions = b.event_submissions(spark, folder).select("fullname", "author")
    every_run = authors.author_snapshot(b.raw_authors(spark, folder))
    return authors.with_author(submissions, every_run, run_ts=b.RUN_TS).drop("author")


def _plain_times(df: DataFrame) -> DataFrame:
    """Times as epoch microseconds, which every client reads the same way."""
    for name, dtype in df.dtypes:
        if dtype == "timestamp":
            df = df.withColumn(name, F.unix_micros(name))
    return df


def _event_cohort(spark, folder):
    return cohort.newest_cohort(b.event_submissions(spark, folder), _snapshot(spark, folder), b.RUN_TS)


def newest_cohort(spark, folder):
    return _plain_times(_event_cohort(spark, folder))


def _event_id_lists(spark, folder):
    newest = cohort.newest_submissions(b.event_submissions(spark, folder))
    ids = newest.select("subreddit", F.col("fullname").alias("post_fullname"))
    return cohort.cohort_id_lists(ids)


def cohort_ids(spark, folder):
    lists = _event_id_lists(spark, folder)
    return lists.select(
        "subreddit",
        F.size("post_fullnames").cast("bigint").alias("n_ids"),
        F.array_min("post_fullnames").alias("first_id"),
        F.array_max("post_fullnames").alias("last_id"),
    ).groupBy("subreddit").agg(F.sum("n_ids").alias("n_ids"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def status_flags(spark, folder):
    return _plain_times(cohort.latest_status(cohort.status_flags(b.raw_status(spark, folder))))


def _document_complete(spark, folder):
    submissions = b.document_submissions(spark, folder)
    ids = submissions.select("subreddit", F.col("fullname").alias("post_fullname"))
    status = cohort.status_flags(b.raw_status(spark, folder))
    return cohort.complete_cohort(cohort.pass1_rows(submissions, _snapshot(spark, folder), b.RUN_TS), ids, status)


def rejected_submissions(spark, folder):
    return cohort.rejected_submissions(b.order_submissions(spark, folder))


def cohort_status(spark, folder):
    newest = cohort.newest_submissions(b.document_submissions(spark, folder))
    ids = newest.select("subreddit", F.col("fullname").alias("post_fullname"))
    return _plain_times(cohort.cohort_status(cohort.status_flags(b.raw_status(spark, folder)), ids))


def cohort_status_left(spark, folder):
    return _plain_times(_document_complete(spark, folder))


def removal_rates(spark, folder):
    return cohort.removal_rates(_document_complete(spark, folder))


def community_totals(spark, folder):
    return cohort.community_totals(_document_complete(spark, folder))


def _event_runs(spark, folder):
    return b.table(spark, folder, "events").select(
        F.col("event_type").alias("subreddit"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("run_day"),
        F.col("event_id").alias("post_fullname"),
    )


def latest_run(spark, folder):
    return cohort.latest_run(_event_runs(spark, folder), by="run_day").withColumn("run_day", F.col("run_day").cast("string"))


def latest_snapshot(spark, folder):
    return cohort.latest_per_community(_event_runs(spark, folder), by="run_day").select(
        "subreddit", F.col("run_day").cast("string").alias("run_day"), "post_fullname"
    )


# ---- videos ---------------------------------------------------------------------------------------------------------

MAX_HITS = len(b.TERMS) * 10


def _hits(spark, folder, region=None):
    return video_ops.search_videos(b.videos(spark, folder), b.TERMS, region=region)


def _rows(spark, folder, hits):
    return video_ops.video_rows(hits, b.video_details(spark, folder), MAX_HITS)


def _found_and_rows(spark, folder):
    hits = _hits(spark, folder)
    return video_ops.videos_found(hits, b.TERMS), _rows(spark, folder, hits)


def video_hits_ranked(spark, folder):
    return _hits(spark, folder, region="US").withColumn("rank", F.col("rank").cast("bigint"))


def video_rows(spark, folder):
    return _rows(spark, folder, _hits(spark, folder)).withColumn("rank", F.col("rank").cast("bigint"))


def video_title_preview(spark, folder):
    """Hits as the search service gives them, ranked, with their titles cut for display."""
    raw = terms.match_terms(b.videos(spark, folder), b.TERMS, "search_text").select(
        "search_term",
        "relevance_pos",
        F.struct(F.col("id").cast("string").alias("videoId")).alias("id"),
        F.struct(F.concat_ws(" ", "title", "title", "title", "title", "title").alias("title"), F.col("channel").alias("channelTitle")).alias("snippet"),
    )
    return video_ops.rank_hits(raw).select("search_term", F.col("rank").cast("bigint").alias("rank"), "video_id", title_preview(F.col("title")).alias("title"))


def videos_found(spark, folder):
    return video_ops.videos_found(_hits(spark, folder), b.TERMS)


def video_signals_by_term(spark, folder):
    return video_ops.signals_by_term(_rows(spark, folder, _hits(spark, folder)))


def video_signals_overall(spark, folder):
    return video_ops.signals_overall(*_found_and_rows(spark, folder))


def _term_records(spark, folder):
    return video_ops.nest_terms(*_found_and_rows(spark, folder))


def _unnested(records: DataFrame) -> DataFrame:
    return records.select("search_term", "videos_found", F.inline_outer("video_details")).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def video_nested(spark, folder):
    return _unnested(_term_records(spark, folder))


# ---- union and round trips -----------------------------------------------------------------------------------------


def union_snapshots(spark, folder):
    """The status columns exist in one side only and are null in the other."""
    first = b.document_submissions(spark, folder).select(
        F.col("fullname").alias("post_fullname"), "subreddit", F.col("score").alias("initial_score")
    )
    second = cohort.status_flags(b.raw_status(spark, folder)).select("is_locked", "post_fullname", "final_score")
    return cohort.combine_snapshots(first, second)


def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "posts_csv")
    writers.write_csv(_document_posts(spark, folder).drop("labels", "row_no"), path)
    back = readers.read_posts(spark, path)
    return back.select(*_FLAT, F.size("labels").cast("bigint").alias("n_labels"), _label_text().alias("label_text"))


def pass1_csv_roundtrip(spark, folder):
    path = scratch_path(spark, "pass1_csv")
    writers.write_csv(_event_cohort(spark, folder), path)
    return _plain_times(readers.read_pass1(spark, path))


def newest_files_roundtrip(spark, folder):
    """Two runs as folders of several parts per community; the later run lacks one of them, whose earlier parts are read then."""
    path = scratch_path(spark, "community_files")
    newest = _event_cohort(spark, folder)
    runs = (newest.withColumn("initial_score", F.lit(-1).cast("bigint")), newest.where("subreddit <> 'signup'"))
    for number, run in enumerate(runs):
        files = run.withColumn("community", F.col("subreddit")).repartition(4).write.partitionBy("community")
        files.options(**writers.CSV_WRITE_OPTIONS).csv(f"{path}/run_{number}")
    back = readers.read_newest_pass1(spark, f"{path}/run_*/community=*/*.csv", r"/community=([^/]+)/")
    return back.select("subreddit", "post_fullname", "initial_score", "author_username")


def partitioned_roundtrip(spark, folder):
    path = scratch_path(spark, "pass1")
    pass1 = cohort.pass1_rows(b.document_submissions(spark, folder), _snapshot(spark, folder), b.RUN_TS)
    writers.write_snapshot(pass1, path, b.RUN_TS)
    back = readers.read_snapshot_table(spark, path, PASS1)
    return back.select(
        "run_id", "subreddit", "post_fullname", "title", "selftext", "initial_score", "post_age_seconds_at_capture",
        "author_username", "author_unavailable",
    )


def complete_roundtrip(spark, folder):
    path = scratch_path(spark, "complete")
    writers.write_snapshot(_document_complete(spark, folder), path, b.RUN_TS)
    return _plain_times(readers.read_snapshot_table(spark, path, PASS2_COMPLETE))


def json_roundtrip(spark, folder):
    path = scratch_path(spark, "cohort_ids")
    writers.write_cohort_ids(_event_id_lists(spark, folder), path)
    return readers.read_cohort_ids(spark, path)


def term_records_roundtrip(spark, folder):
    path = scratch_path(spark, "term_records")
    writers.write_term_records(_term_records(spark, folder), path, b.RUN_TS)
    back = _unnested(readers.read_term_records(spark, path))
    return back.withColumn("video_id", F.col("video_id").cast("bigint"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        flatten_posts,
        term_match_top100,
        basic_stats,
        moderation_by_term,
        moderation_by_bucket,
        bucket_of_balance,
        bucket_rates,
        follower_categories,
        label_totals,
        label_distribution,
        label_top10,
        label_json_parsed,
        label_json_odd,
        label_totals_odd,
        engagement_comparison,
        sample_moderated,
        top_term,
        summary_report,
        report_text,
        report_file,
        term_match_long,
        author_feed,
        user_activity,
        user_activity_csv,
        author_snapshot,
        post_author_info,
        newest_cohort,
        cohort_ids,
        status_flags,
        rejected_submissions,
        cohort_status,
        cohort_status_left,
        removal_rates,
        community_totals,
        latest_run,
        latest_snapshot,
        video_hits_ranked,
        video_rows,
        video_title_preview,
        videos_found,
        video_signals_by_term,
        video_signals_overall,
        video_nested,
        union_snapshots,
        csv_roundtrip,
        pass1_csv_roundtrip,
        newest_files_roundtrip,
        partitioned_roundtrip,
        complete_roundtrip,
        json_roundtrip,
        term_records_roundtrip,
    )
}
