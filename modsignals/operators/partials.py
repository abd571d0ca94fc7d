"""Statistics over many runs from sums that add up: A1-A4, A8, A9, A13, A17, A20 and K7 without reading posts again.

A run leaves a small table of partial counts, one row per (term, author, follower bucket). Reports over any choice of runs add
these up. The author stays in the grain, as different authors (A2) do not add up otherwise; the texts are never needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_ord
from ..functions.rates import percent
from .report import report_of_counts
from .stats import METRICS, statistics_of_sums

POST_PARTIALS = (
    "search_term string, author_handle string, bucket_ord int, n bigint, m bigint, known bigint, "
    + ", ".join(f"sum_{c} bigint, n_{c} bigint" for c in METRICS)
)
CHECK_PARTIALS = (
    "subreddit string, n_cohort bigint, n_checked bigint, n_official bigint, n_inferred bigint, known_inferred bigint, "
    "n_locked bigint, known_locked bigint"
)


def post_partials(posts: DataFrame) -> DataFrame:
    """Counts of a run's found posts by term, author and follower bucket."""
    sums = [f(c).alias(f"{short}_{c}") for c in METRICS for short, f in (("sum", F.sum), ("n", F.count))]
    return posts.groupBy("search_term", "author_handle", bucket_ord(F.col("author_followers")).alias("bucket_ord")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_moderation")).alias("m"), F.count("has_moderation").alias("known"), *sums
    )


def statistics(partials: DataFrame) -> DataFrame:
    """A1, A2, A3, A17 over the runs whose partials are given."""
    return statistics_of_sums(partials)


def report(partials: DataFrame) -> DataFrame:
    """K7 with A1, A8 and A9 over the runs whose partials are given."""
    counts = partials.groupBy("search_term", "bucket_ord").agg(*[F.sum(c).alias(c) for c in ("n", "m", "known")])
    return report_of_counts(counts)


def check_partials(complete: DataFrame) -> DataFrame:
    """Counts of a run's completed cohort by community."""
    flag = lambda name, short: (F.count_if(F.col(name)).alias(f"n_{short}"), F.count(name).alias(f"known_{short}"))
    return complete.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_cohort"),
        F.count("is_removed_official").alias("n_checked"),
        F.count_if(F.col("is_removed_official")).alias("n_official"),
        *flag("is_removed_inferred", "inferred"),
        *flag("is_locked", "locked"),
    )


def removal_rates(partials: DataFrame) -> DataFrame:
    """A13, A2, A20 over the runs whose partials are given."""
    add = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return partials.agg(
        add("n_cohort").alias("n_cohort"),
        add("n_checked").alias("n_checked"),
        percent(add("n_official"), add("n_checked")).alias("official_pct"),
        percent(add("n_inferred"), add("known_inferred")).alias("inferred_pct"),
        percent(add("n_locked"), add("known_locked")).alias("locked_pct"),
        F.countDistinct("subreddit").alias("subreddits"),
    )


def community_totals(partials: DataFrame) -> DataFrame:
    """A20 by community over the runs whose partials are given."""
    return partials.groupBy("subreddit").agg(F.sum("n_cohort").alias("n_cohort"), F.sum("n_checked").alias("n_checked"))
