"""Small frames for the tests."""

from pyspark.sql import functions as F

from modsignals import schemas
from modsignals.functions.labels import parse_labels

POST = dict(
    timestamp=None, search_term="t", post_uri="u", post_text="text", author_handle="a", author_display_name="A",
    author_followers=50, author_following=0, author_posts=0, likes_count=0, repost_count=0, reply_count=0,
    has_moderation=False, moderation_labels="[]", created_at="",
)
SUBMISSION = dict(
    fullname="p1", created_utc=1000.0, subreddit="foo", title="title", selftext="body", domain="self", score=1,
    num_comments=2, upvote_ratio=0.5, link_flair_text=None, author="ann",
)
AUTHOR = dict(
    run_ts=None, seen_no=1, username="ann", created_utc=0.0, link_karma=3, comment_karma=4, is_verified=None,
)
STATUS = dict(
    fullname="p1", selftext="body", title="title", author="ann", removed_by_category=None, is_robot_indexable=True,
    locked=False, archived=False, score=1, num_comments=2, upvote_ratio=0.5, rechecked_at_utc=None,
)


def frame(spark, ddl, base, rows):
    """Rows given as differences to ``base``."""
    names = schemas.names(ddl)
    return spark.createDataFrame([tuple({**base, **row}[n] for n in names) for row in rows], ddl)


def posts(spark, *rows):
    """Flat posts with parsed labels and their row number."""
    numbered = [{**row, "row_no": i} for i, row in enumerate(rows)]
    df = frame(spark, schemas.POSTS + ", row_no bigint", POST, numbered)
    return df.withColumn("labels", parse_labels(F.col("moderation_labels")))


def submissions(spark, *rows):
    return frame(spark, schemas.RAW_SUBMISSION, SUBMISSION, rows)


def authors(spark, *rows):
    return frame(spark, schemas.RAW_AUTHOR, AUTHOR, rows)


def statuses(spark, *rows):
    return frame(spark, schemas.RAW_STATUS, STATUS, rows)


def tuples(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def plan(df):
    return df._jdf.queryExecution().toString()
