"""Snapshot tables laid out by post, so that repeated runs join without shuffling them.

Rows are dealt into a fixed number of buckets by a hash of their keys and sorted within a bucket. Two tables with the same
keys and number of buckets join bucket by bucket, and one row per key is found without a shuffle. A pass-1 table is written
once and met by every later re-check, so the price of the layout is paid once as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.cohort import STATUS_FIELDS, latest_status

POST_KEY = ("post_fullname",)


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str] = POST_KEY) -> DataFrame:
    """Writes ``df`` to ``path`` as table ``name`` in ``buckets`` buckets, replacing it, and returns the table.

    Rows are dealt to the buckets before they are written, so that a bucket is one file. ``buckets`` should give files that
    one task can sort, some hundred megabytes each.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, ddl: str, buckets: int, keys: Sequence[str] = POST_KEY) -> DataFrame:
    """A table written before, known to a session that has not seen it; nothing is read or written."""
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({ddl}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def complete_bucketed(pass1: DataFrame, status: DataFrame) -> DataFrame:
    """J1 over two tables of one layout: pass-1 rows with their last status, bucket by bucket.

    ``status`` may hold the whole history of re-checks; its last row per post is found within the buckets.
    """
    extra = [c for c in pass1.columns if c != "post_fullname"]
    return pass1.join(latest_status(status), "post_fullname", "left").select("post_fullname", *extra, *STATUS_FIELDS)
