"""Connected components of a link table, by the smallest node reachable."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


#: Links whose rows go to one file in the tables of a round, however many partitions a shuffle has.
FILE_LINKS = 20_000


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of the links (a, b).

    Each round takes the smallest label among the neighbours and then the label of the label, so that what is known of a
    chain doubles from round to round. Every round is a table of its own; the driver sees one number per round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = saved(both, "edges")
    # No table of a round has more rows than there are edges.
    files = math.ceil(edges.count() / FILE_LINKS) or 1
    few = lambda df: saved(df.coalesce(files), "labels")
    labels = few(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        of_b = labels.select(F.col("node").alias("b"), "label")
        near = edges.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        once = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        once = few(once)
        further = once.select(F.col("node").alias("label"), F.col("label").alias("further"))
        # A label is a node of the same component, so it has a label itself.
        twice = few(once.join(further, "label").select("node", "was", F.least("label", "further").alias("label")))
        if twice.filter("label <> was").isEmpty():
            return twice.select("node", F.col("label").alias("component"))
        labels = twice.select("node", "label")
