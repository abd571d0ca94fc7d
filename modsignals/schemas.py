"""Explicit schemas, as DDL. No reader in this package infers a schema."""

RAW_LABELS = "array<struct<val:string,cts:string>>"
LABEL = "struct<type:string,value:string,created:string>"
LABELS = f"array<{LABEL}>"

RAW_POST_FIELDS = (
    "uri string, likeCount bigint, repostCount bigint, replyCount bigint, "
    "author struct<handle:string,displayName:string,followersCount:bigint,followsCount:bigint,postsCount:bigint>, "
    "record struct<text:string,createdAt:string>, "
    f"labels {RAW_LABELS}, embed struct<labels:{RAW_LABELS}>"
)
RAW_POST = "search_term string, " + RAW_POST_FIELDS

POSTS = (
    "timestamp timestamp, search_term string, post_uri string, post_text string, author_handle string, "
    "author_display_name string, author_followers bigint, author_following bigint, author_posts bigint, "
    "likes_count bigint, repost_count bigint, reply_count bigint, has_moderation boolean, "
    "moderation_labels string, created_at string"
)

RAW_PROFILE = (
    "handle string, displayName string, followersCount bigint, followsCount bigint, postsCount bigint"
)
RAW_FEED = (
    "handle string, feed array<struct<post:struct<uri:string,"
    f"labels:{RAW_LABELS},embed:struct<labels:{RAW_LABELS}>>>>"
)

USER_ACTIVITY = (
    "handle string, display_name string, followers bigint, following bigint, total_posts bigint, "
    "posts_analyzed bigint, posts_with_moderation bigint, moderation_rate double, unique_labels bigint, "
    "all_labels string"
)

RAW_AUTHOR = (
    "run_ts timestamp, seen_no bigint, username string, created_utc double, "
    "link_karma bigint, comment_karma bigint, is_verified boolean"
)

RAW_SUBMISSION = (
    "fullname string, created_utc double, subreddit string, title string, selftext string, domain string, "
    "score bigint, num_comments bigint, upvote_ratio double, link_flair_text string, author string"
)

PASS1 = (
    "post_fullname string, created_utc timestamp, captured_at_utc timestamp, "
    "post_age_seconds_at_capture double, subreddit string, title string, selftext string, domain string, "
    "initial_score bigint, initial_num_comments bigint, initial_upvote_ratio double, link_flair_text string, "
    "author_username string, author_account_age_days bigint, author_total_karma bigint, "
    "author_link_karma bigint, author_comment_karma bigint, author_is_verified boolean, "
    "author_unavailable boolean"
)

COHORT_IDS = "run_ts timestamp, subreddit string, post_fullname string"

RAW_STATUS = (
    "fullname string, selftext string, title string, author string, removed_by_category string, "
    "is_robot_indexable boolean, locked boolean, archived boolean, score bigint, num_comments bigint, "
    "upvote_ratio double, rechecked_at_utc timestamp"
)

STATUS = (
    "post_fullname string, final_score bigint, final_num_comments bigint, final_upvote_ratio double, "
    "is_removed_official boolean, is_removed_content boolean, is_removed_inferred boolean, "
    "removed_by_category string, is_deleted boolean, is_deleted_author boolean, is_deleted_content boolean, "
    "is_locked boolean, is_archived boolean, rechecked_at_utc timestamp"
)
PASS2_COMPLETE = PASS1 + ", " + STATUS.split(", ", 1)[1]

RAW_VIDEO = (
    "id string, region string, type string, title string, channel string, search_text string, relevance_pos bigint"
)
RAW_VIDEO_DETAILS = (
    "id string, statistics struct<viewCount:string,likeCount:string,commentCount:string>, "
    "status struct<embeddable:boolean,publicStatsViewable:boolean,madeForKids:boolean>"
)
VIDEO_RECORD_FIELDS = (
    "rank", "video_id", "title", "channel", "view_count", "like_count", "comment_count",
    "embeddable", "public_stats_viewable", "made_for_kids", "url",
)
COUNT_FIELDS = ("view_count", "like_count", "comment_count")
TERM_RECORD = (
    "search_term string, videos_found bigint, video_details array<struct<rank:int,video_id:string,"
    "title:string,channel:string,view_count:bigint,like_count:bigint,comment_count:bigint,"
    "embeddable:boolean,public_stats_viewable:boolean,made_for_kids:boolean,url:string>>"
)


def names(ddl: str) -> list[str]:
    """Column names of a flat schema string."""
    return [field.split()[0] for field in ddl.split(", ")]


def cast_to(df, ddl: str):
    """Select the columns of ``ddl`` from ``df`` in order, cast to their declared types.

    A value that does not parse becomes null instead of failing the job.
    """
    from pyspark.sql import functions as F

    picked = []
    for field in ddl.split(", "):
        name, dtype = field.split(" ", 1)
        picked.append(F.col(name).try_cast(dtype).alias(name))
    return df.select(*picked)
