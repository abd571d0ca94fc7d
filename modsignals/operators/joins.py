"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CHECKED_ROWS = 50_000


def broadcast_checked(df: DataFrame, rows: int = CHECKED_ROWS) -> DataFrame:
    """Mark a grouped table of narrow rows for broadcast if it has at most ``rows`` of them; else leave it as it is.

    Spark learns the size of a grouped table only after the large side of the join has been shuffled as
    well. Counting up to ``rows`` beforehand reads just the grouping columns and saves that shuffle. This is the one
    place where an operator runs a job before its result is asked for.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(large: DataFrame, small: DataFrame, keys: list[str], how: str, spread: Column | None = None) -> DataFrame:
    """Join ``large`` with the keyed table ``small`` on equal ``keys``.

    Adaptive execution splits a hot key over many tasks only if both inputs come straight out of a shuffle.
    A side that was just grouped by the key does not: it is already in place, and the hot key would end
    up in one task. Joining on a key derived from the columns makes both sides go through a shuffle of
    their own, which costs one more pass over ``small``. If ``small`` turns out to be small enough, Spark still
    broadcasts it.

    A ``large`` row with a null key matches nothing. With ``spread``, such rows are dealt out by that
    column instead of all meeting at one place.
    """
    derived = "concat_ws('\\u0001', 'k', " + ", ".join(keys) + ")"
    complete = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    key = F.expr(f"CASE WHEN {complete} THEN {derived} END")
    right = small.withColumn("_key", key)
    if spread is not None:
        key = F.coalesce(key, F.concat(F.lit("n"), F.xxhash64(spread).cast("string")))
    left = large.withColumn("_key", key)
    # The derived key is told apart by its columns, which are compared as well.
    return left.join(right, ["_key", *keys], how).drop("_key").select(*large.columns, *[
        c for c in small.columns if c not in keys and how != "left_semi"
    ])
