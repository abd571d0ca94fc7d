"""Flat posts from nested ones: P1, P2, P9, P15, P20."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import extract_labels, has_labels, labels_to_json
from ..functions.times import as_timestamp
from ..schemas import POSTS, names

_TEXT = {
    "post_uri": "uri",
    "post_text": "record.text",
    "author_handle": "author.handle",
    "author_display_name": "author.displayName",
    "created_at": "record.createdAt",
}
_COUNT = {
    "author_followers": "author.followersCount",
    "author_following": "author.followsCount",
    "author_posts": "author.postsCount",
    "likes_count": "likeCount",
    "repost_count": "repostCount",
    "reply_count": "replyCount",
}


def flatten_posts(raw: DataFrame, run_ts=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 15 flat columns, then ``labels`` as an array, then the columns named in ``keep``.

    Absent strings become empty and absent counts zero. ``labels`` is the typed form of the JSON in
    ``moderation_labels``; queries inside Spark use the former, only CSV needs the latter.
    """
    post_labels, embed_labels = F.col("labels"), F.col("embed.labels")
    labels = extract_labels(post_labels, embed_labels)
    columns = {
        "timestamp": as_timestamp(run_ts),
        "search_term": F.col("search_term"),
        "has_moderation": has_labels(post_labels, embed_labels),
        "moderation_labels": labels_to_json(labels),
    }
    columns |= {name: F.expr(f"coalesce({path}, '')") for name, path in _TEXT.items()}
    columns |= {name: F.expr(f"coalesce({path}, 0L)") for name, path in _COUNT.items()}
    return raw.select(*[columns[n].alias(n) for n in names(POSTS)], labels.alias("labels"), *keep)
