"""Per-user activity: S7, S8, J4, A10, A11, A12, F4."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import POSTS_PER_AUTHOR
from ..functions.labels import distinct_label_count, extract_labels, has_labels, labels_to_json
from ..functions.rates import fraction
from .topk import top_k_per_group


def author_feeds(posts: DataFrame, k: int = POSTS_PER_AUTHOR, order=("created", "uri")) -> DataFrame:
    """The newest ``k`` posts of every author as one feed row per handle.

    ``posts`` has handle, uri, labels, embed and the ``order`` columns, whose descending order must be total.
    Arrays hold at most ``k`` posts, newest first, as the cut comes before the collecting.
    """
    newest = top_k_per_group(
        posts.select("handle", "uri", "labels", "embed", *[c for c in order if c != "uri"]),
        ["handle"],
        [F.desc(c) for c in order],
        k,
        rank="_pos",
        spread=1,  # with very many authors a task holds few posts of one, and the group limit alone bounds a hot one
    )
    entry = F.struct("_pos", F.struct("uri", "labels", "embed").alias("post"))
    return newest.groupBy("handle").agg(F.array_sort(F.collect_list(entry)).alias("_entries")).select(
        "handle",
        F.transform("_entries", lambda e: F.struct(e["post"].alias("post"))).alias("feed"),
    )


def user_activity(handles: DataFrame, profiles: DataFrame, feeds: DataFrame) -> DataFrame:
    """A10 with J4, A11, A12: one row per listed handle that has a profile and a feed.

    ``profiles`` and ``feeds`` hold one row per handle. A missing or null feed drops the user; an empty one
    keeps it with a rate of 0. All counting happens inside the row, so the two joins are the only shuffles.
    The rate is a fraction (T4). ``labels`` is the typed form of ``all_labels``.
    """
    posts = F.transform(
        "feed",
        lambda e: F.struct(
            has_labels(e["post"]["labels"], e["post"]["embed"]["labels"]).alias("flag"),
            extract_labels(e["post"]["labels"], e["post"]["embed"]["labels"]).alias("labels"),
        ),
    )
    zero = F.lit(0).cast("bigint")
    joined = (
        handles.select("handle")
        .join(profiles, "handle")
        .join(feeds.where(F.col("feed").isNotNull()), "handle")
        .withColumn("_posts", posts)
    )
    return joined.select(
        "handle",
        F.coalesce("displayName", F.lit("")).alias("display_name"),
        F.coalesce("followersCount", zero).alias("followers"),
        F.coalesce("followsCount", zero).alias("following"),
        F.coalesce("postsCount", zero).alias("total_posts"),
        F.size("_posts").cast("bigint").alias("posts_analyzed"),
        F.size(F.filter("_posts", lambda p: p["flag"])).cast("bigint").alias("posts_with_moderation"),
        F.flatten(F.transform("_posts", lambda p: p["labels"])).alias("labels"),
    ).select(
        "handle",
        "display_name",
        "followers",
        "following",
        "total_posts",
        "posts_analyzed",
        "posts_with_moderation",
        F.coalesce(fraction(F.col("posts_with_moderation"), F.col("posts_analyzed")), F.lit(0.0)).alias(
            "moderation_rate"
        ),
        distinct_label_count(F.col("labels")).alias("unique_labels"),
        labels_to_json(F.col("labels")).alias("all_labels"),
        "labels",
    )
