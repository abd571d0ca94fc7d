"""Exact duplicates by a heavy-hitter split.

A Misra-Gries pass finds the digests that may hold more than a stated share of the rows. Their true counts and the row that
stays are computed and broadcast, and their rows are decided where they are read. All other digests, each of which holds
less than that share, meet by an ordinary shuffle: each group is added up before it, and the sums are joined back.

Null text counts as empty. Rows without an id take part; a group whose ids are all null keeps one of its rows. Rows that
repeat an id with an equal text count in ``group_size``; one of them stays. An empty table gives an empty result. Other
columns are never read here, so their names are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_hash, saved

#: A digest with more than this share of all rows is taken out before the shuffle. At most 1/SUPPORT digests are broadcast.
SUPPORT = 0.001


def digest(text: str):
    return F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)


def _decision() -> tuple[Column, ...]:
    """Of a group: the largest id, the largest key among the rows that have it, and the rows. A null is smaller than any id."""
    last = F.max(F.struct("doc_id", "row_key"))
    return F.max("doc_id").alias("keep_id"), last["row_key"].alias("keep_key"), F.count(F.lit(1)).alias("group_size")


def heavy_digests(keyed: DataFrame, support: float, rows: int) -> DataFrame:
    """digest, keep_id, keep_key, group_size of every digest with more than ``support`` of the rows: at most 1/support rows."""
    maybe = keyed.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return (
        keyed.join(F.broadcast(maybe), "digest")
        .groupBy("digest")
        .agg(*_decision())
        .filter(F.col("group_size") > support * rows)
    )


def _decisions(keyed: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """digest, keep_id, keep_key, group_size: of the heavy digests, and of all others."""
    heavy = saved(heavy_digests(keyed, support, keyed.count()), "heavy-digests")
    rest = keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return heavy, rest.groupBy("digest").agg(*_decision())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Each row's group: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when they are after A-Z to a-z; the largest id stays.

    The groups of the rest are added up map-side and joined back, so that no task has to hold the rows of a group.
    """
    keyed = saved(
        docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest")).withColumn("row_key", F.monotonically_increasing_id()),
        "digests",
    )
    heavy, rest = _decisions(keyed, support)
    decided = keyed.join(F.broadcast(heavy), "digest")
    shuffled = keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(rest, "digest")
    return decided.unionByName(shuffled).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_key") == F.col("keep_key")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is known by its id and a hash of all its columns. Of rows of equal text the one with the largest id stays, then
    the one with the largest hash; rows without an id come after all others. Rows that are equal in all columns are one.
    Rows of heavy digests that go are removed where they are read; of the others, texts are shuffled once to meet the
    decision.
    """
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), row_hash(docs).alias("row_key")
    )
    heavy, rest = _decisions(saved(keyed.drop("row"), "digests"), support)
    stays = F.col("row_key") == F.col("keep_key")
    decided = keyed.join(F.broadcast(heavy), "digest").filter(stays)
    shuffled = keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(rest, "digest").filter(stays)
    # Rows that are equal in all columns are still there together.
    once = [rows.groupBy("digest").agg(F.first("row").alias("row")).select("row.*") for rows in (decided, shuffled)]
    return once[0].unionByName(once[1])
