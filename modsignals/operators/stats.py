"""Statistics over flat posts: A1-A9, A17, F1, F2, P16-P19, W3, W4, W6.

The input is the output of ``flatten_posts`` or of ``read_posts``; its grain is (search term, post), and a post
found under two terms counts twice everywhere (T6).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PREVIEW_CHARS, SAMPLE_POSTS, TOP_LABELS
from ..functions.buckets import bucket_dimension, bucket_ord
from ..functions.labels import is_bad_label_json, joined_label_values
from ..functions.rates import fraction, percent, percent_of_rounded
from ..functions.text import preview


def _moderated():
    return F.count_if(F.col("has_moderation"))


#: Engagement numbers of a post and what their means are called.
METRICS = {"likes_count": "avg_likes", "repost_count": "avg_reposts", "reply_count": "avg_replies"}


def basic_statistics(posts: DataFrame) -> DataFrame:
    """A1, A2, A3, A17 in one pass. The rate is unrounded; on no rows it is null.

    Posts are summed by author and term first, so that only those sums meet the two distinct counts.
    """
    sums = [f(m).alias(f"{n}_{m}") for m in METRICS for n, f in (("sum", F.sum), ("n", F.count))]
    return statistics_of_sums(posts.groupBy("author_handle", "search_term").agg(F.count("*").alias("n"), _moderated().alias("m"), *sums))


def statistics_of_sums(parts: DataFrame) -> DataFrame:
    """A1, A2, A3, A17 from sums by author, term and whatever else, which add up."""
    zero = F.lit(0).cast("bigint")
    n, m = F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("m"), zero)
    return parts.agg(
        n.alias("total_posts"),
        m.alias("moderated_posts"),
        percent(m, n).alias("moderation_rate_pct"),
        F.countDistinct("author_handle").alias("unique_authors"),
        F.countDistinct("search_term").alias("search_terms"),
        *[fraction(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(name) for c, name in METRICS.items()],
    )


def moderation_by_term(posts: DataFrame) -> DataFrame:
    """Rate by term, highest first, ties by term (T17). Null terms vanish."""
    return (
        posts.where(F.col("search_term").isNotNull())
        .groupBy("search_term")
        .agg(_moderated().alias("moderated"), F.count("has_moderation").alias("total"))
        .withColumn("rate_pct", percent_of_rounded(F.col("moderated"), F.col("total")))
        .orderBy(F.desc("rate_pct"), F.asc("search_term"))
    )


def top_term(posts: DataFrame) -> DataFrame:
    """Term with the highest unrounded rate, as a fraction; ties go to the first term by name."""
    return (
        posts.where(F.col("search_term").isNotNull())
        .groupBy("search_term")
        .agg(fraction(_moderated(), F.count("has_moderation")).alias("rate_frac"))
        .where(F.col("rate_frac").isNotNull())
        .orderBy(F.desc("rate_frac"), F.asc("search_term"))
        .limit(1)
    )


def _bucket_counts(posts: DataFrame) -> DataFrame:
    """All four buckets with their counts (T2). The counted side has at most one row per bucket."""
    counted = (
        posts.select("has_moderation", bucket_ord(F.col("author_followers")).alias("bucket_ord"))
        .where(F.col("bucket_ord").isNotNull())
        .groupBy("bucket_ord")
        .agg(_moderated().alias("moderated"), F.count("has_moderation").alias("total"))
    )
    zero = F.lit(0).cast("bigint")
    return bucket_dimension(posts.sparkSession).join(F.broadcast(counted), "bucket_ord", "left").select(
        "bucket_ord",
        "follower_category",
        F.coalesce("moderated", zero).alias("moderated"),
        F.coalesce("total", zero).alias("total"),
    )


def _in_bucket_order(buckets: DataFrame) -> DataFrame:
    """Four rows need no range partitioning to be sorted."""
    return buckets.coalesce(1).sortWithinPartitions("bucket_ord")


def moderation_by_bucket(posts: DataFrame) -> DataFrame:
    """A5: counts and rate of each follower bucket, in bucket order; the rate of an empty one is null."""
    return _bucket_counts(posts).withColumn(
        "rate_pct", percent_of_rounded(F.col("moderated"), F.col("total"))
    ).transform(_in_bucket_order)


def bucket_rates(posts: DataFrame) -> DataFrame:
    """Unrounded rate of each bucket, as a fraction."""
    rate = fraction(F.col("moderated"), F.col("total")).alias("rate_frac")
    return _bucket_counts(posts).select("bucket_ord", "follower_category", rate).transform(_in_bucket_order)


def _label_rows(posts: DataFrame, *keep: str) -> DataFrame:
    """one row per label that has a value."""
    return (
        posts.select(*keep, F.posexplode("labels").alias("label_pos", "label"))
        .select(*keep, "label_pos", F.col("label.value").alias("value"))
        .where(F.col("value").isNotNull())
    )


def label_totals(posts: DataFrame) -> DataFrame:
    """Labels applied and different values among them."""
    return _label_rows(posts).agg(
        F.count("*").alias("total_labels"), F.countDistinct("value").alias("unique_labels")
    )


def label_distribution(posts: DataFrame) -> DataFrame:
    """Count per label value, most frequent first, ties by first appearance.

    ``row_no`` gives the order of appearance of posts.
    """
    # One number instead of a pair, so the aggregation hashes and need not sort its input.
    place = F.expr("CAST(row_no AS decimal(20,0)) * CAST(4294967296 AS decimal(10,0)) + label_pos")
    first = F.min(place).alias("first_seen")
    return (
        _label_rows(posts, "row_no")
        .groupBy("value")
        .agg(F.count("*").alias("n"), first)
        .orderBy(F.desc("n"), F.asc("first_seen"), F.asc("value"))
        .drop("first_seen")
    )


def label_top(posts: DataFrame, n: int = TOP_LABELS) -> DataFrame:
    """The ``n`` most frequent values."""
    return label_distribution(posts).limit(n)


def label_json_check(posts: DataFrame) -> DataFrame:
    """How many posts came with label text that is no JSON; they count as having no labels."""
    bad = F.count_if(is_bad_label_json(F.col("moderation_labels")))
    return posts.agg(F.count("*").alias("total_posts"), bad.alias("n_bad_json"))


def engagement_comparison(posts: DataFrame) -> DataFrame:
    """Mean of three metrics for moderated and other posts, in one pass, a metric per row.

    A null flag is in neither group. Without moderated posts the result is empty; without others their
    means are null (T27).
    """
    metrics = {"Likes": "likes_count", "Reposts": "repost_count", "Replies": "reply_count"}
    yes, no = F.col("has_moderation"), ~F.col("has_moderation")
    means = []
    for number, column in enumerate(metrics.values()):
        means.append(F.avg(F.when(yes, F.col(column))).alias(f"yes{number}"))
        means.append(F.avg(F.when(no, F.col(column))).alias(f"no{number}"))
    one_row = posts.agg(_moderated().alias("n"), *means).where("n > 0")
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"yes{number}").alias("moderated"),
            F.col(f"no{number}").alias("non_moderated"),
        )
        for number, metric in enumerate(metrics)
    ]
    return one_row.select(F.inline(F.array(*rows)))


def sample_moderated(posts: DataFrame, n: int = SAMPLE_POSTS) -> DataFrame:
    """The first ``n`` moderated posts in input order (``row_no``, from 0)."""
    return (
        posts.where("has_moderation")
        .orderBy("row_no")
        .limit(n)
        .select(
            (F.col("row_no") + 1).alias("post_no"),
            "author_handle",
            "author_followers",
            preview(F.col("post_text"), PREVIEW_CHARS).alias("text_preview"),
            "search_term",
            joined_label_values(F.col("labels")).alias("label_values"),
            "likes_count",
            "repost_count",
        )
        .orderBy("post_no")
    )
