"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Each source gets words in proportion to its weight but never more than ``max_epochs`` times what it holds; what the clamped
sources leave is shared again among the others until nothing is above its cap. A source then takes every document a whole
number of times, and once more the documents whose seeded hash lies below the source's cut, so that its words come to the
target within half a document. The cut is found by histograms of the hash, so no task sees a source's rows in one piece.

Null text has no words. A null source is a source of its own, last in order. A source without words gets nothing. If the caps
together are below the total, every source is taken to its cap. Rows that repeat id and text share one hash and are taken
alike. An empty table gives an empty result. Columns beyond those named are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, saved

SEED = 20240607
#: Bits of the hash that one histogram tells apart, and the bits of the whole hash.
_STEP, _BITS = 12, 63


def words_in(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def seeded(seed: int, id_col: str, text_col: str) -> Column:
    """63 bits that depend on the seed, the id and the text only, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the given ones in turn, by the sources' code point order, null last. One row per source, so one small window."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), place % len(weights)))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight). The driver sees one level per round, never the sources."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    whole = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    total = share * (whole["n"] or 0)
    level = total / whole["w"] if whole["w"] else 0.0
    while True:
        clamped = F.col("weight") * F.lit(level) >= cap
        now = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)).alias("held"), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if not now["open"]:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if level else F.lit(0.0))
        # Clamped sources only grow in number, so the level only rises; it stands still when no source is newly clamped.
        risen = (total - now["held"]) / now["open"]
        if risen <= level:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = risen


def _boundary(rows: DataFrame, goals: DataFrame, bits: int, hint) -> DataFrame:
    """For each source the first prefix of ``bits`` bits at which its words reach the goal, and what is left of the goal before it."""
    by = Window.partitionBy("key").orderBy("prefix")
    sums = (
        rows.select("key", F.shiftright("hash", _BITS - bits).alias("prefix"), "size")
        .groupBy("key", "prefix")
        .agg(F.sum("size").alias("n"))
        .withColumn("before", F.sum("n").over(by) - F.col("n"))
    )
    return (
        sums.join(hint(goals.select("key", "goal")), "key")
        .filter((F.col("before") < F.col("goal")) & (F.col("before") + F.col("n") >= F.col("goal")))
        .groupBy("key")
        .agg(F.min("prefix").alias("at"), F.max(F.col("goal") - F.col("before")).alias("goal"))
    )


def repetitions(rows: DataFrame, targets: DataFrame, sources: int) -> DataFrame:
    """source, source_size, target, whole, cut: each document is taken ``whole`` times, and once more if its hash is at most ``cut``.

    ``rows`` has source, size and hash. Two histograms of 12 bits narrow the cut to a 16-millionth of the hashes; only rows
    in that piece are put in order.
    """
    hint = F.broadcast if sources <= BROADCAST_ROWS else (lambda df: df)
    key = F.struct("source")
    goals = targets.select(
        key.alias("key"),
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole"),
    ).withColumn("goal", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goals = saved(goals, "mix-goals")
    rows = rows.select(key.alias("key"), "size", "hash")
    near, left = rows, goals
    for step in (1, 2):
        left = saved(_boundary(near, left, step * _STEP, hint), "mix-boundaries")
        near = near.join(hint(left.select("key", "at")), "key").filter(F.shiftright("hash", _BITS - step * _STEP) == F.col("at")).drop("at")
    order = Window.partitionBy("key").orderBy("hash")
    same = Window.partitionBy("key", "hash")
    last = (
        near.join(hint(left), "key")
        .withColumn("upto", F.sum("size").over(order))
        .withColumn("half", F.col("upto") - F.sum("size").over(same) / 2)
        .groupBy("key")
        .agg(
            F.max(F.when(F.col("half") <= F.col("goal"), F.col("hash"))).alias("inside"),
            F.max(F.shiftleft("at", _BITS - 2 * _STEP) - 1).alias("below"),
        )
        .select("key", F.coalesce("inside", "below").alias("cut"))
    )
    return goals.join(hint(last), "key", "left").select(
        "source", "source_size", "target", "whole", F.when(F.col("goal") > 0, F.coalesce("cut", F.lit(2**63 - 1))).otherwise(-1).alias("cut")
    )


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame, int]:
    """The sized documents (doc_id, source, size, hash), the sources' plan, and the number of sources."""
    sized = saved(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), seeded(seed, id_col, text_col).alias("hash")
        ),
        "mix-sizes",
    )
    sources = saved(cycled_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-sources")
    n = sources.count()
    return sized, saved(repetitions(sized, water_fill(sources, share, max_epochs), n), "mix-plan"), n


def _times() -> Column:
    return F.col("whole") + F.when(F.col("hash") <= F.col("cut"), 1).otherwise(0)


def mix_counts(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document."""
    sized, plan, n = plan_mix(docs, **settings)
    small = F.broadcast(plan) if n <= BROADCAST_ROWS else plan
    return sized.join(small, sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken")
    )


def mix_documents(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as it is taken. Texts are not shuffled; the plan is brought to them."""
    _, plan, n = plan_mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    plan = plan.select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    times = F.col("__whole") + F.when(seeded(seed, id_col, text_col) <= F.col("__cut"), 1).otherwise(0)
    taken = docs.join(F.broadcast(plan) if n <= BROADCAST_ROWS else plan, F.col(source_col).eqNullSafe(F.col("__source")))
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
