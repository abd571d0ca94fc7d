"""The author dimension over many runs: P4 and W5 kept up to date run by run, with the time each version was valid.

Within a run the first sighting wins (T18), which ``author_snapshot`` decides. Over the runs an author has a version for every
change of what a run saw. A run meets only the versions that are valid now; closed ones are written once and never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import as_timestamp

#: What makes a version. The age grows with every run and is no change.
VERSION_FIELDS = ("username", "link_karma", "comment_karma", "total_karma", "is_verified", "author_unavailable")
HISTORY = (
    "lookup_name string, username string, link_karma bigint, comment_karma bigint, total_karma bigint, "
    "is_verified boolean, author_unavailable boolean, valid_from timestamp, valid_to timestamp"
)


def merge_run(current: DataFrame, snapshot: DataFrame, run_ts) -> tuple[DataFrame, DataFrame]:
    """The versions valid after a run, and those that the run has closed.

    ``current`` holds the versions valid before it (``HISTORY``; ``valid_to`` null), ``snapshot`` one row per author the run
    saw. An author the run did not see keeps its version, one seen unchanged does as well. Runs must come in order.
    """
    run = as_timestamp(run_ts)
    seen = snapshot.select("lookup_name", F.struct(*VERSION_FIELDS).alias("_seen"))
    known = current.select("lookup_name", F.struct(*VERSION_FIELDS).alias("_known"), "valid_from")
    met = known.join(seen, "lookup_name", "full")
    kept = F.col("_seen").isNull() | F.col("_seen").eqNullSafe(F.col("_known"))
    version = F.when(kept, F.col("_known")).otherwise(F.col("_seen"))
    start = F.when(kept, F.col("valid_from")).otherwise(run)
    valid = met.select("lookup_name", version.alias("_version"), start.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    ended = met.where(~kept & F.col("_known").isNotNull())
    closed = ended.select("lookup_name", F.col("_known").alias("_version"), "valid_from", run.alias("valid_to"))
    flat = ("lookup_name", "_version.*", "valid_from", "valid_to")
    return valid.select(*flat), closed.select(*flat)


def rebuild(snapshots: DataFrame) -> DataFrame:
    """The same history from the snapshots of all runs at once (``run_ts``, ``lookup_name`` and the fields)."""
    by_author = Window.partitionBy("lookup_name").orderBy("run_ts")
    version = F.struct(*VERSION_FIELDS)
    changed = snapshots.withColumn("_before", F.lag(version).over(by_author)).where(F.col("_before").isNull() | ~version.eqNullSafe(F.col("_before")))
    until = F.lead("run_ts").over(by_author)
    return changed.select("lookup_name", *VERSION_FIELDS, F.col("run_ts").alias("valid_from"), until.alias("valid_to"))


def valid_at(history: DataFrame, when: "Column | str") -> DataFrame:
    """The versions valid at a time, one per author seen until then."""
    at = as_timestamp(when)
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
