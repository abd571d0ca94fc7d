"""Top-k per group and one-row-per-key: W1, W2, W5, A19."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 16


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str | None = None,
    spread: int = SPREAD,
) -> DataFrame:
    """First ``k`` rows of every group, with their 1-based rank if ``rank`` names a column.

    Spark's group limit already cuts each input task to ``k`` rows per group before the shuffle. A hot
    group would still send ``k`` rows from *every* input task to one reducer, so groups are first
    split over ``spread`` sub-groups by input partition, cut to ``k`` each, and only the survivors
    (at most ``k * spread`` per group) meet. The split does not change the result: the top ``k`` of a
    group are among the top ``k`` of its parts. ``order`` must be total within a group.
    """
    name = rank or "_rank"
    if spread > 1:
        part = df.withColumn("_part", F.spark_partition_id() % F.lit(spread))
        df = _keep(part, [*keys, "_part"], order, k, "_part_rank").drop("_part", "_part_rank")
    kept = _keep(df, keys, order, k, name)
    return kept if rank else kept.drop(name)


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # Rows of equal order are told apart by their content, so reruns pick the same one.
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W5, first wins (T18). An aggregate, so each task sends one row per key however hot the key is."""
    return _one_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W5 and A19, last wins."""
    return _one_per_key(df, keys, order, F.max_by)
