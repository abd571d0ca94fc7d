"""Near duplicates by MinHash with sequential Bayesian verification.

1. Each text becomes the set of its 5-word shingles and a signature of minimal hashes. Texts with equal sets are one class;
   from here on a class stands for all its texts.
2. Signatures are cut into bands. Classes that share a band's bucket are candidates, first each with its bucket's hub only.
3. A candidate pair's signatures are compared batch by batch. It is dropped as soon as the posterior probability of a
   similarity at or above the threshold falls below the miss probability.
4. Survivors are confirmed on their full sets. Links join classes to components.
5. Where a bucket still holds several components, the members outside its largest one are compared with all its members of
   other components, in blocks, by the same tests. What comes back are links that join two components.

So no candidate pair that lies between two components goes untested; pairs inside a component need no test. A hub with many
members is dealt out over several tasks, and no step returns the pairs of a group.

Null text counts as empty. A text without words links with nothing. Rows that repeat are members of one class. Ids that are
null take no part in the choice of the smallest id. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, row_hash, saved
from .components import components

WORDS, PERCENT = 5, 75
BANDS, BAND_ROWS = 48, 4
HASHES = BANDS * BAND_ROWS
#: Hashes compared at a time, and the probability with which a pair at the threshold may be dropped by them.
BATCH, MISS = 32, 1e-6
#: Members that meet a hub in one task; members and odd members of a bucket that meet in one block.
TOGETHER, BLOCK = 200, 1000
SEED = 7


# ---- sets and signatures --------------------------------------------------------------------------------------------


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text with fewer words than a shingle has one, all its words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    # A weighted sum of independent word hashes, mixed. The weights are odd and depend on the place and the number of words.
    weights = np.array([xxhash.xxh3_64_intdigest(f"{n}:{k}") | 1 for k in range(n)], np.uint64)
    mixed = sum((hashes[k : len(words) - n + 1 + k] * weights[k] for k in range(n)), np.zeros(len(words) - n + 1, np.uint64))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, 2**64, (HASHES, 1), np.uint64) | np.uint64(1), random.integers(0, 2**64, (HASHES, 1), np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each minimal hash: two sets agree in one with their similarity, but for one part in 65,536."""
    a, b = _multipliers()
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(low, (a * shingles[None, at : at + 512] + b).min(axis=1), out=low)
    # The minimum's leading bits are nearly always zero, so bits from a further mix are taken.
    low ^= low >> np.uint64(32)
    low *= np.uint64(0xD6E8FEB86659FD93)
    return (low >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, doc_id, text_hash, n_shingles, set_key, signature: one row per document, written once. ``node`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signs = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                signs.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_key", "signature"],
            )

    shape = "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, signature binary"
    return saved(_texts(docs, id_col, text_col).mapInArrow(run, shape).withColumn("node", F.monotonically_increasing_id()), "sketches")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


# ---- tests of pairs -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def least_agreements() -> tuple[int, ...]:
    """After each batch, the fewest agreements with which a pair stays.

    With a uniform prior, the posterior of a similarity at or above t after m agreements in n is the probability of at most
    m successes in n + 1 trials of probability t.
    """
    t, out = PERCENT / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The agreements of signatures row by row, or -1 where the pair is dropped on the way."""
    found, alive = np.zeros(len(a), int), np.arange(len(a))
    for k, least in enumerate(least_agreements()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        found[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        dropped = found[alive] < least
        found[alive[dropped]] = -1
        alive = alive[~dropped]
    return found


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _close_sizes(a: str, b: str):
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def alike(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """a, b, same of the pairs (a, b) that survive the batches; ``signs`` has node, n_shingles, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = agreements(_signatures(batch.column("sa")), _signatures(batch.column("sb")))
            whole = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int64())], ["a", "b", "same"])
            yield whole.filter(pa.array(same >= 0))

    of = lambda x: signs.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(_close_sizes("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, same bigint")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has node, text.

    The texts of ``b`` are brought to the text of ``a``, at most about TOGETHER of them in one place.
    """
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    member = pairs.join(tasks, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    hub = tasks.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    met = member.unionByName(hub).join(texts, "node").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            left, right = [], []
            for a, part, role, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "node", "text")), strict=True):
                shingles = shingle_set(text)
                if role == 0:
                    at, own = (a, part), shingles
                elif at == (a, part):
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(own) + len(shingles) - both):
                        left.append(a)
                        right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return met.select("a", "part", "role", "node", "text").mapInArrow(run, "a bigint, b bigint")


# ---- candidates -----------------------------------------------------------------------------------------------------


def band_rows(signs: DataFrame) -> DataFrame:
    """bucket, band, node: one row per class and band."""
    width = 2 * BAND_ROWS
    places = F.sequence(F.lit(0), F.lit(BANDS - 1))
    band = F.transform(places, lambda i: F.struct(F.xxhash64(i, F.substring("signature", i * width + 1, F.lit(width))).alias("bucket"), i.cast("tinyint").alias("band")))
    return signs.select("node", F.explode(band).alias("b")).select("b.bucket", "b.band", "node")


class Block:
    """The odd members of a bucket that one task holds, and the comparison of further members with them."""

    def __init__(self):
        self.joined: dict[int, int] = {}
        self.sets: dict[int, np.ndarray] = {}

    def begin(self, band: int) -> None:
        self.band, self.nodes, self.rows, self.texts = band, [], [], []
        self.table = None
        self.sets.clear()

    def root(self, component: int) -> int:
        while component in self.joined:
            component = self.joined[component]
        return component

    def ask(self, node: int, component: int, size: int, sign: bytes, text: str) -> None:
        self.nodes.append(node)
        self.rows.append((component, size, sign))
        self.texts.append(text)

    def _set(self, node: int, text: str) -> np.ndarray:
        if node not in self.sets:
            self.sets[node] = shingle_set(text)
        return self.sets[node]

    def compare(self, node: int, component: int, size: int, sign: bytes, text: str) -> Iterator[tuple[int, int]]:
        """Links from a member to odd members of components not yet joined with its own."""
        if self.table is None:
            self.table = (
                np.array([c for c, _, _ in self.rows]),
                np.array([n for _, n, _ in self.rows]),
                np.frombuffer(b"".join(x for _, _, x in self.rows), "<u2").reshape(-1, HASHES),
            )
        components_, sizes, signs = self.table
        close = np.flatnonzero((components_ != component) & (100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size)))
        if not len(close):
            return
        own = np.broadcast_to(np.frombuffer(sign, "<u2"), (len(close), HASHES))
        others = signs[close]
        # Two members meet in every bucket that they share; only the first counts.
        first = (own == others).reshape(-1, BANDS, BAND_ROWS).all(axis=2).argmax(axis=1) == self.band
        close = close[first]
        close = close[agreements(own[first], others[first]) >= 0]
        close = [k for k in close if self.root(int(components_[k])) != self.root(component)]
        if not close:
            return
        mine = self._set(node, text)
        sets = [self._set(self.nodes[k], self.texts[k]) for k in close]
        both = np.add.reduceat(np.isin(np.concatenate(sets), mine, assume_unique=False), np.cumsum([0, *map(len, sets)])[:-1], dtype=np.int64)
        for k, n, other in zip(close, both, sets, strict=True):
            here, there = self.root(component), self.root(int(components_[k]))
            if here != there and 100 * n >= PERCENT * (len(mine) + len(other) - n):
                self.joined[max(here, there)] = min(here, there)
                yield node, self.nodes[k]


def between_components(members: DataFrame, labels: DataFrame, signs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join components which share a bucket.

    Of each bucket that holds several components, the members outside its largest one are the queries. Queries and members
    are each cut into blocks, and every block of queries meets every block of members in one place.
    """
    labelled = members.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    labelled = saved(labelled, "bucket-members")
    counts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        counts.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("component", "n").alias("main"))
        .filter("many > 1")
        .select(
            "bucket", "main", F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("rows") - F.col("most")) / BLOCK).cast("int").alias("blocks")
        )
    )
    rows = saved(labelled.join(mixed, "bucket"), "mixed-buckets")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    data = rows.select("bucket", "band", one_of("parts").alias("part"), all_of("blocks").alias("block"), F.lit(1).alias("role"), "node", "component")
    queries = rows.filter("component <> main").select(
        "bucket", "band", all_of("parts").alias("part"), one_of("blocks").alias("block"), F.lit(0).alias("role"), "node", "component"
    )
    full = signs.select("node", "n_shingles", "signature").join(texts, "node")
    place = ("bucket", "part", "block")
    met = data.unionByName(queries).join(full, "node").repartition(*place).sortWithinPartitions(*place, "role")
    columns = (*place, "band", "role", "node", "component", "n_shingles", "signature", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block()
        for batch in batches:
            found = []
            for bucket, part, piece, band, role, *row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (bucket, part, piece) != at:
                    at = (bucket, part, piece)
                    block.begin(band)
                if role == 0:
                    block.ask(*row)
                elif block.rows:
                    found.extend(block.compare(*row))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met.select(*columns).mapInArrow(run, "a bigint, b bigint")


# ---- the whole ------------------------------------------------------------------------------------------------------


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with these as ca and cb."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")


def class_components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and set_key, component, component_id for every class."""
    sketch = sketches(docs, id_col, text_col)
    classes = saved(
        sketch.filter("n_shingles > 0").groupBy("set_key").agg(F.min("node").alias("node"), F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles")),
        "classes",
    )
    signs = sketch.join(classes.select("node"), "node", "left_semi")
    bands = saved(band_rows(signs), "bands")
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "hub")
    members = saved(bands.join(buckets, "bucket"), "members")
    involved = saved(members.select("node").distinct(), "involved")
    signs = saved(sketch.join(involved, "node", "left_semi").select("node", "doc_id", "text_hash", "n_shingles", "signature"), "involved-signatures")
    keys = signs.select("node", "doc_id", "text_hash").alias("k")
    shown = _texts(docs, id_col, text_col).alias("t")
    same_text = F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.text_hash") == F.col("t.text_hash"))
    # A row that repeats would give its text twice; links are distinct, so that does no harm.
    texts = saved(shown.join(keys, same_text).select("node", "text"), "involved-texts")

    to_hub = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = saved(alike(to_hub, signs), "alike")
    best = near.groupBy("b").agg(F.max_by("a", "same").alias("a"))
    links = saved(confirmed(best, texts).distinct(), "links")
    labels = components(links)
    links = saved(links.unionByName(confirmed(_across(near, labels).select("a", "b"), texts)).distinct(), "links")
    labels = components(links)
    links = saved(links.unionByName(between_components(members, labels, signs, texts)).distinct(), "links")
    labels = components(links)

    joined = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return sketch, joined.join(smallest, "component").select("set_key", "component", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    sketch, classes = class_components(docs, id_col, text_col)
    return (
        sketch.select("doc_id", "n_shingles", "set_key")
        .join(classes, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    The row with the smallest id stays, ids that are null last; of rows that share it, one, chosen by hashes of the text and
    of all columns. Documents without words link with nothing, so all of them stay, repeats too.
    """
    sketch, classes = class_components(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash"))
    winners = sketch.filter("n_shingles > 0").join(classes, "set_key").groupBy("component").agg(first.alias("first")).select("component", "first.*")

    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = docs.filter(text.rlike(WORD))
    doc_id, text_hash, whole = F.col(id_col).cast("bigint"), F.xxhash64(text), row_hash(docs)
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_hash.cast("string"), whole.cast("string")).alias("key")
    rows = worded.select(doc_id.alias("doc_id"), text_hash.alias("text_hash"), key).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.text_hash") == F.col("w.text_hash"))
    kept = saved(rows.join(winners.alias("w"), same).groupBy("component").agg(F.max("key").alias("key")).select("key"), "kept-rows")
    # Rows that are equal in all columns share a key; they lie together after the join.
    met = worded.select(F.struct("*").alias("row"), key).join(kept, "key")
    return met.groupBy("key").agg(F.first("row").alias("row")).select("row.*").unionByName(docs.filter(~text.rlike(WORD)))
