"""Jaccard join of word n-grams with R-trees over count vectors.

1. Each text becomes the set of its WORDS-word shingles. Texts with equal sets are one class; a class stands for all its texts.
2. Shingles are hashed into groups. Two sets that link differ in at most d elements, so of more than d groups at least one holds
   the same elements in both. Classes with an equal group meet in that group's bucket; no link is missed (see ``group_keys``).
3. The sizes of SPACE coarser groups are a class's point. Two sets share at most the sum of their points' smaller coordinates,
   which leaves out most pairs. Within a bucket, first every member is held against the bucket's hub; then, where members lie in
   several components, blocks of them are indexed in an R-tree, whose boxes bound whole subtrees in the same way, and members of
   other components search it.
4. Pairs that survive are verified on their full sets. Links join classes to components.

Pairs inside a component need no test, so no step returns the pairs of a group: the trees first give each component's best
pair, and all surviving pairs only between components that are still apart after that. A hub with many members, and a bucket with many odd
members, are dealt out over several tasks. The links of step 4 are between different sets; texts of one set carry its class.

Null text counts as empty. A text without words links with nothing. Rows that repeat are members of one class. Ids that are
null take no part in the choice of the smallest id. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .common import discard, saved, shuffle_files_go, slices
from .components import components

WORDS, PERCENT = 4, 85
#: Coordinates of a point, and children of a node of the tree.
SPACE, FAN = 256, 32
#: The largest coordinate that a point states; it stands for any larger one, too.
FULL = 2**16 - 1
#: Members that meet a hub in one task; members of a bucket that are indexed, and that search, in one place.
TOGETHER, BLOCK = 200, 1000
#: Shingles of the texts in one bucket of the table of texts, some hundred megabytes.
BUCKET_SHINGLES = 20_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- sets, groups and points ----------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2 * WORDS)
def _weights(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{n} words, place {k}") | 1 for k in range(n)], np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text with fewer words than a shingle has one, all its words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    places = len(words) - n + 1
    return np.unique(_mixed(sum((hashes[k : k + places] * w for k, w in enumerate(_weights(n))), np.zeros(places, np.uint64))))


def most_different(top: int) -> int:
    """The most elements that two linked sets have singly, if the smaller one has at most ``top``."""
    return (100 - PERCENT) * (top + 100 * top // PERCENT) // (100 + PERCENT)


@lru_cache(maxsize=4096)
def levels(size: int) -> tuple[tuple[int, int, int], ...]:
    """(top, groups, spare) of the levels at which a set of this size is grouped.

    A level's top is the largest size of a pair's smaller set, so a set stands at its own level and, if sets at or below the
    next lower top can link with it, also at that one. Sets that link with equal ones only stand at none.
    """
    least = next(t for t in count(1) if most_different(t))
    tops = [least]
    while tops[-1] < size:
        tops.append(tops[-1] * 3 // 2)
    found = tops[-1:] if size >= least else []
    if len(tops) > 1 and size <= 100 * tops[-2] // PERCENT:
        found.append(tops[-2])
    return tuple((t, most_different(t) + 1 + (most_different(t) + 1) // 25, (most_different(t) + 1) // 25) for t in found)


def group_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the set's groups at its levels; sets that link have a key in common.

    Of a level's groups at most most_different(top) differ. Were the rest empty in both sets, they would say nothing; a set with
    more empty groups than are spare is therefore grouped anew by another hash until one leaves few enough empty. Of two sets
    that link, the one that ends first has, at its last hash, a group that is not empty and equals the other's.
    """
    out = [np.empty(0, np.uint64)]
    for top, groups, spare in levels(len(shingles)):
        for seed in count():
            hashed = _mixed(shingles ^ np.uint64(xxhash.xxh3_64_intdigest(f"{top}:{seed}")))
            group = (hashed >> np.uint64(20)) % np.uint64(groups)
            sums = np.zeros(groups, np.uint64)
            np.add.at(sums, group, hashed)
            filled = np.flatnonzero(np.bincount(group.astype(np.int64), minlength=groups))
            out.append(_mixed(sums[filled] + _mixed((filled + 1).astype(np.uint64) * np.uint64(2 * top + 1) + np.uint64(seed << 40))))
            if groups - len(filled) <= spare:
                break
    return np.concatenate(out)


def point(shingles: np.ndarray) -> np.ndarray:
    """The number of shingles in each of SPACE groups, FULL for more than that."""
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % SPACE, minlength=SPACE), FULL).astype("<u2")


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, doc_id, text_hash, n_shingles, set_key, point, keys: one row per document, written once. ``node`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
            keys = [group_keys(s).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            columns = {
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "point": pa.array([point(s).tobytes() for s in sets], pa.binary()),
                "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys]))),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    shape = "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, point binary, keys array<bigint>"
    return saved(_texts(docs, id_col, text_col).mapInArrow(run, shape).withColumn("node", F.monotonically_increasing_id()), "ngram-sketches")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def texts_by_node(docs: DataFrame, points: DataFrame, id_col: str, text_col: str) -> tuple[str, DataFrame]:
    """The name of a table, and the table: node, text of the documents in ``points``, in buckets by node.

    Every later step joins the texts by node. Dealt out once, they are not shuffled again by any of them.
    """
    spark = docs.sparkSession
    keys, shown = points.select("node", "doc_id", "text_hash").alias("k"), _texts(docs, id_col, text_col).alias("t")
    same = F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.text_hash") == F.col("t.text_hash"))
    shingles = points.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles / BUCKET_SHINGLES))
    # Both sides grow with the corpus, whatever a small one looks like: they are merged, not broadcast.
    # Written in between, so that the files of one shuffle are gone before the next has its own.
    found = saved(shown.join(keys.hint("merge"), same).select("node", "text"), "ngram-found")
    dealt = found.repartition(buckets, "node")
    # A row that repeats would bring its text again for the same node.
    once = dealt.groupBy("node").agg(F.any_value("text").alias("text"))
    path = scratch_path(spark, "ngram-texts")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with shuffle_files_go(spark):
        once.write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(name)
    discard(found)
    return name, spark.table(name)


# ---- bounds and the tree --------------------------------------------------------------------------------------------


def _points(column) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, SPACE)


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most elements that sets of these points can share; more than any set has where both have a full coordinate."""
    smaller = np.minimum(a, b)
    bound = smaller.sum(axis=1, dtype=np.int64)
    return bound + (np.int64(1) << 40) * (smaller >= FULL).any(axis=1) if smaller.size and smaller.max() >= FULL else bound


def enough(shared, sizes):
    """Whether ``shared`` elements, or a bound of them, are enough to link sets of ``sizes`` elements taken together."""
    return (100 + PERCENT) * shared >= PERCENT * sizes


class CountTree:
    """An R-tree over points, loaded at once: sorted into slabs of close size and, within a slab, by the coordinate that differs most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = FAN * FAN
        for at in range(0, len(order), slab):
            part = order[at : at + slab]
            widest = int(np.ptp(points[part], axis=0).argmax())
            order[at : at + slab] = part[np.argsort(points[part, widest], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        # From the leaves up: the upper corners of the boxes, and the smallest and largest size below.
        self.levels = []
        high, least, most = self.points, self.sizes, self.sizes
        while len(high) > FAN:
            starts = np.arange(0, len(high), FAN)
            high, least, most = np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((high, least, most))

    def search(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the points that can link with a set of this point and size, and the bounds of what they share."""
        under = None
        for high, least, most in reversed(self.levels):
            # The last node of a level can have fewer children than the others.
            node = np.arange(len(high)) if under is None else under[under < len(high)]
            fits = (100 * most[node] >= PERCENT * size) & (PERCENT * least[node] <= 100 * size)
            node = node[fits]
            node = node[enough(most_shared(high[node], point), size + least[node])]
            under = (node[:, None] * FAN + np.arange(FAN)).ravel()
        at = np.arange(len(self.points)) if under is None else under[under < len(self.points)]
        bound = most_shared(self.points[at], point)
        hit = enough(bound, size + self.sizes[at])
        return self.order[at[hit]], bound[hit]


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """a, b, bound of the pairs (a, b) whose points leave them possible; ``points`` has node, n_shingles, point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = most_shared(_points(batch.column("pa")), _points(batch.column("pb")))
            whole = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bound, pa.int64())], ["a", "b", "bound"])
            yield whole.filter(pa.array(enough(bound, batch.column("sizes").to_numpy())))

    of = lambda x: points.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("sizes", F.col("na") + F.col("nb"))
    close = both.filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return close.select("a", "b", "pa", "pb", "sizes").mapInArrow(run, "a bigint, b bigint, bound bigint")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link by their full sets; ``texts`` has node, text.

    The texts of ``b`` come to the text of ``a``, at most about TOGETHER of them in one place.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    guests = pairs.join(many, "a").select(F.col("b").alias("node"), "a", part.alias("part"), F.lit(1).alias("guest"))
    hosts = many.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("guest"))
    # The texts lie in buckets by node, so that only the nodes of the pairs move to meet them.
    met = hosts.unionByName(guests).join(texts, "node").repartition("a", "part").sortWithinPartitions("a", "part", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = None
        for batch in batches:
            a, b = [], []
            for at, guest, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "guest", "node", "text")), strict=True):
                shingles = shingle_set(text)
                if not guest:
                    host = shingles
                    continue
                shared = len(np.intersect1d(host, shingles, assume_unique=True))
                if shared and enough(shared, len(host) + len(shingles)):
                    a.append(at)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.select("a", "guest", "node", "text").mapInArrow(run, "a bigint, b bigint")


# ---- buckets --------------------------------------------------------------------------------------------------------


def bucket_members(classes: DataFrame) -> DataFrame:
    """bucket, hub, node of the buckets that several classes share; the hub is its smallest node.

    Of buckets with the same members, such as a pair of near copies has by the hundred, one is kept: who meets whom stays as it is.
    """
    # Dealt out once: the keys are counted and joined where they lie.
    keys = classes.select("node", F.explode("keys").alias("bucket")).repartition("bucket")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    shared = keys.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"), *marks).filter("n > 1")
    kept = shared.groupBy("n", "hub", "mark0", "mark1").agg(F.min("bucket").alias("bucket")).select("bucket", "hub")
    return saved(keys.join(kept.hint("merge"), "bucket"), "ngram-members")


def between_components(members: DataFrame, labels: DataFrame, points: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of members of one bucket that lie in different components and can link; hubs were held against all before.

    Of each bucket the members outside its largest component are indexed, in blocks, and every block is searched by all
    members. With ``best`` a place gives one pair for each component, the one with the highest bound, so that what it gives
    does not grow faster than its members.
    """
    guests = members.filter("node <> hub").join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    guests = saved(guests, "ngram-guests")
    counts = guests.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        counts.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))
        .filter("many > 1")
    )
    blocks = lambda n: F.ceil(F.expr(n) / BLOCK).cast("int")
    rows = guests.join(mixed.select("bucket", "main", blocks("rows").alias("parts"), blocks("rows - most").alias("blocks")), "bucket")
    rows = saved(rows.join(points, "node"), "ngram-mixed")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = ("node", "component", "n_shingles", "point")
    asking = rows.select("bucket", one("parts").alias("part"), every("blocks").alias("block"), F.lit(1).alias("asks"), *own)
    indexed = rows.filter("component <> main").select("bucket", every("parts").alias("part"), one("blocks").alias("block"), F.lit(0).alias("asks"), *own)
    place = ("bucket", "part", "block")
    met = indexed.unionByName(asking).repartition(*place).sortWithinPartitions(*place, "asks").select(*place, "asks", *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, found = None, [], None, {}
        for batch in batches:
            for bucket, part, block, asks, node, component, size, point_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, part, block) != at:
                    yield from _pair_rows(found)
                    at, held, tree, found = (bucket, part, block), [], None, {}
                if not asks:
                    held.append((node, component, size, point_))
                    continue
                if tree is None:
                    nodes, parts, sizes = (np.array([x[k] for x in held], np.int64) for k in range(3))
                    tree = CountTree(_points([x[3] for x in held]), sizes)
                near, bound = tree.search(_points([point_])[0], size)
                other = parts[near] != component
                for k, score in zip(near[other].tolist(), bound[other].tolist(), strict=True):
                    a, b = sorted((node, int(nodes[k])))
                    for key in (component, int(parts[k])) if best else ((a, b),):
                        if key not in found or found[key] < (score, a, b):
                            found[key] = (score, a, b)
            # What a place has found so far leaves with the batch, so that a task holds no more than a batch gives.
            yield from _pair_rows(found)
            found = {}

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _pair_rows(found: dict) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found.values()], pa.int64()) for k in (1, 2)], ["a", "b"])


# ---- the whole ------------------------------------------------------------------------------------------------------


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with these as ca and cb."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")


def _best_across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of the pairs (a, b, bound) between two components only the one with the highest bound."""
    ends = F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")
    best = _across(pairs, labels).groupBy(*ends).agg(F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("pair"))
    return best.select("pair.a", "pair.b")


def class_components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and set_key, component_id for every class."""
    full = sketches(docs, id_col, text_col)
    sketch = saved(full.drop("keys"), "ngram-sketches-short")
    nodes = sketch.filter("n_shingles > 0").groupBy("set_key").agg(F.min("node").alias("node"), F.min("doc_id").alias("first_id"))
    nodes = saved(nodes, "ngram-classes")
    members = bucket_members(full.select("node", "keys").join(nodes.select("node").hint("merge"), "node", "left_semi"))
    discard(full)
    involved = members.select("node").distinct()
    points = saved(sketch.join(involved, "node", "left_semi").select("node", "doc_id", "text_hash", "n_shingles", "point"), "ngram-points")
    table, texts = texts_by_node(docs, points, id_col, text_col)
    rows, points = points, saved(points.select("node", "n_shingles", "point"), "ngram-points-short")
    discard(rows)

    to_hub = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = saved(bounded(to_hub, points), "ngram-near")
    closest = near.groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a"))
    links = saved(verified(closest, texts), "ngram-links")
    labels = components(links)
    steps = (
        lambda: _best_across(near, labels),
        lambda: _across(near, labels),
        lambda: _across(between_components(members, labels, points, best=True), labels),
        lambda: _across(between_components(members, labels, points, best=False), labels),
    )
    for step in steps:
        pairs = saved(step().select("a", "b"), "ngram-pairs")
        links = saved(links.unionByName(verified(pairs, texts)), "ngram-links")
        labels = components(links)
        # The step's shuffle files, with the texts of its pairs, go before the next one writes its own.
        discard(pairs)
    discard(texts)
    docs.sparkSession.sql(f"DROP TABLE {table}")

    joined = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return sketch, joined.join(smallest, "component").select("set_key", "component_id")


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    sketch, classes = class_components(docs, id_col, text_col)
    joined = sketch.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
