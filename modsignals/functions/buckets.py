"""Follower buckets: right-closed, zero and below in no bucket."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FOLLOWER_BUCKETS
from ..small import small_table


def bucket_ord(followers: Column) -> Column:
    """Order number of the bucket, or null outside every bucket."""
    picked = None
    for number, _, low, high in FOLLOWER_BUCKETS:
        inside = followers > low if high is None else (followers > low) & (followers <= high)
        picked = F.when(inside, number) if picked is None else picked.when(inside, number)
    return picked


def bucket_label(followers: Column) -> Column:
    number = bucket_ord(followers)
    label = None
    for key, text, _, _ in FOLLOWER_BUCKETS:
        label = F.when(number == key, text) if label is None else label.when(number == key, text)
    return label


def bucket_dimension(spark: SparkSession) -> DataFrame:
    """The four buckets as a table."""
    rows = [(number, label) for number, label, _, _ in FOLLOWER_BUCKETS]
    return small_table(spark, rows, "bucket_ord int, follower_category string")
