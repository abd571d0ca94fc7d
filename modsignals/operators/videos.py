"""Video search results and their signals: S11, S12, J2, W1, P7, P8, P14, A14, A15, A16, A21, F7, F8."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import VIDEO_REGION, VIDEO_TYPE, VIDEOS_PER_TERM
from ..functions.rates import percent
from ..functions.text import watch_url
from ..schemas import VIDEO_RECORD_FIELDS
from ..small import small_table
from .terms import search_top
from .topk import top_k_per_group

# Hits are narrow rows (ids, a title, a channel); this many of them stay far below Spark's own broadcast limit.
BROADCAST_HITS = 20_000


def search_videos(
    videos: DataFrame,
    terms: Sequence[str],
    k: int = VIDEOS_PER_TERM,
    region: str | None = VIDEO_REGION,
    kind: str | None = VIDEO_TYPE,
) -> DataFrame:
    """The first ``k`` videos of every term by relevance, ranked from 1.

    The rank is given before any details are looked up, so later misses leave gaps (T10).
    """
    if region is not None:
        videos = videos.where(F.col("region") == region)
    if kind is not None:
        videos = videos.where(F.col("type") == kind)
    hits = search_top(videos, terms, "search_text", [F.asc("relevance_pos"), F.asc("id")], k, rank="rank")
    return hits.select("search_term", "rank", F.col("id").alias("video_id"), "title", "channel")


def rank_hits(raw_hits: DataFrame, k: int = VIDEOS_PER_TERM) -> DataFrame:
    """W1, W2 for hits that already carry their term and position."""
    order = [F.asc("relevance_pos"), F.asc("id.videoId")]
    return top_k_per_group(raw_hits, ["search_term"], order, k, rank="rank").select(
        "search_term",
        "rank",
        F.col("id.videoId").alias("video_id"),
        F.col("snippet.title").alias("title"),
        F.col("snippet.channelTitle").alias("channel"),
    )


def _count(path: str) -> Column:
    """Counts arrive as text, or not at all."""
    return F.col(path).try_cast("bigint")


def video_rows(hits: DataFrame, details: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Hits with details; a hit without details is dropped.

    ``details`` has one row per id and is the large side. ``max_hits`` is a proven bound of the number of hits
    (terms times hits per term): up to ``BROADCAST_HITS`` the hits are broadcast and the details are only
    scanned; beyond it, or without it, Spark chooses.
    """
    if max_hits is not None and max_hits <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    flat = details.select(
        F.col("id").alias("video_id"),
        _count("statistics.viewCount").alias("view_count"),
        _count("statistics.likeCount").alias("like_count"),
        _count("statistics.commentCount").alias("comment_count"),
        F.col("status.embeddable").alias("embeddable"),
        F.col("status.publicStatsViewable").alias("public_stats_viewable"),
        F.col("status.madeForKids").alias("made_for_kids"),
    )
    rows = hits.join(flat, "video_id").withColumn("url", watch_url(F.col("video_id")))
    return rows.select("search_term", *VIDEO_RECORD_FIELDS)


def videos_found(hits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Hits per listed term before the details join, 0 for terms without any."""
    listed = small_table(hits.sparkSession, [(t,) for t in terms], "search_term string")
    counted = hits.groupBy("search_term").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0).cast("bigint")).alias("videos_found")
    return listed.join(counted, "search_term", "left").select("search_term", found)


def _signals() -> list[Column]:
    """a null flag counts in neither test."""
    return [
        F.count_if(F.col("embeddable").eqNullSafe(False)).alias("non_embeddable"),
        F.count_if(F.col("public_stats_viewable").eqNullSafe(False)).alias("hidden_stats"),
        F.count_if(F.col("made_for_kids").eqNullSafe(True)).alias("kids"),
    ]


def _with_percent(df: DataFrame, base: str) -> DataFrame:
    parts = ("non_embeddable", "hidden_stats", "kids")
    return df.select("*", *[percent(F.col(p), F.col(base)).alias(f"{p}_pct") for p in parts])


def signals_by_term(rows: DataFrame) -> DataFrame:
    """Signals over the *detailed* videos of each term (T9). Terms without any have no row."""
    counted = rows.groupBy("search_term").agg(F.count("video_id").alias("videos"), *_signals())
    return _with_percent(counted, "videos").orderBy("search_term")


def signals_overall(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Signals over all videos *found* (T9); percentages are null when there were none."""
    totals = found.agg(F.sum("videos_found").alias("total_videos"), F.count("*").alias("terms"))
    counted = rows.agg(*_signals())
    # Two one-row aggregates, put side by side by adding them up rather than by a cross join.
    columns = ("total_videos", "terms", "non_embeddable", "hidden_stats", "kids")
    zero = F.lit(0).cast("bigint")
    both = totals.unionByName(counted, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in columns]
    )
    return _with_percent(both, "total_videos")


def nest_terms(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One record per listed term with its videos in rank order.

    ``rows`` is bounded per term by the search limit.
    """
    record = F.struct(*VIDEO_RECORD_FIELDS)
    nested = rows.groupBy("search_term").agg(F.array_sort(F.collect_list(record)).alias("video_details"))
    return found.join(nested, "search_term", "left").select(
        "search_term",
        "videos_found",
        F.coalesce("video_details", F.array()).alias("video_details"),
    )


def unnest_terms(records: DataFrame) -> DataFrame:
    """The flat rows of ``nest_terms`` output."""
    return records.select("search_term", F.inline("video_details"))
