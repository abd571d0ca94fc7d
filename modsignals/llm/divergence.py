"""Divergence of sources within a language, by Gustavson's row accumulation over a term-major index.

1. Tasks count the terms of their documents by language and source. Counts and document counts meet by (language, term);
   terms with enough documents stay. Grouped by term they are the term-major index: a row per kept term, with its postings,
   one for every source that has it.
2. A group's probability of a term is p(count); without the term it is the group's zero baseline p(0). The divergence of two
   groups over all terms is what two baselines give for every term, corrected by each group's own terms against the other's
   baseline (from a histogram of the group's probabilities), and corrected again for the terms that both have.
3. Only the last correction needs both groups' terms. A task takes a block of the index; each group of the block goes through
   its terms, and every posting of such a term is added to one accumulator with a place for each peer. What leaves the task
   is one number per group and peer with something in common, not one per pair of postings. These numbers are added up.

A hot source, term or language is counted within tasks first, and a term's postings are at most one per source. All
arithmetic is exact: counts times 1,000,000,000 are decimals, everything else fits 64 bits.

Null text, language and source count as ''. Rows that repeat count as often as they stand there; ids are not read. A group
without terms has its part `pair`; where a language has no kept term at all, its values are 0. Ties go to the smaller item by
its bytes. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.topk import top_k_per_group
from .common import saved

LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Counts that a task holds before it sends them on, and the bytes of terms longer than LONG among them.
HELD, HELD_BYTES, LONG = 600_000, 20_000_000, 64
#: Postings that a group scatters at a time, about.
SLICE = 500_000
# What a term may hold; other bytes separate. Letters in lower case, and all of a character beyond ASCII.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


# ---- counts and the index -------------------------------------------------------------------------------------------


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; ``docs`` has lang, source, text without nulls.

    A task sends what it has counted whenever that grows beyond HELD, so a term can come in several rows.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def flush(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in counts.items():
            terms = pa.array(list(n), pa.binary())
            found = [pa.array(n.values(), pa.int64()), pa.array([docs_[t] for t in n], pa.int64())]
            of = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), [x]).dictionary_decode() for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*of, terms, *found], names)
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, held_bytes = defaultdict(lambda: (Counter(), Counter())), 0, 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                n, docs_ = counts[lang, source]
                distinct, before = set(terms), len(n)
                n.update(terms)
                docs_.update(distinct)
                held += len(n) - before
                if max(map(len, distinct)) > LONG:
                    held_bytes += sum(len(t) for t in distinct if len(t) > LONG)
                if held > HELD or held_bytes > HELD_BYTES:
                    yield from flush(counts)
                    held, held_bytes = 0, 0
        yield from flush(counts)

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return counted.withColumn("term", F.col("term").cast("string"))


def term_index(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The term-major index: lang, term, n_lang, postings of (source, n) for every kept term; written once."""
    # Dealt by term once; adding up by source and gathering the postings then need no further shuffle.
    dealt = term_counts(docs).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("postings")
    )
    return saved(by_term.filter(F.col("docs") >= least).drop("docs"), "term-index")


# ---- probabilities --------------------------------------------------------------------------------------------------


def _p(count: str, total: str, size: str) -> Column:
    scaled = f"CAST({count} + 1 AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))"
    return F.expr(f"1 + CAST({scaled} AS DECIMAL(38, 0)) DIV CAST({total} + {size} AS DECIMAL(20, 0))")


def _f(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) DIV ({q})"


def group_table(docs: DataFrame, index: DataFrame) -> DataFrame:
    """lang, source, no, size, total, p0, own, lang_total of every group that occurs: its number in the language, the kept terms
    of the language, the group's count of them, its baseline and how many of them it has; written once.
    """
    totals = index.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("n_lang").alias("lang_total"))
    every = docs.select("lang", "source").distinct()
    joined = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "own", "size", "lang_total"])
    # The result has a row for each pair of sources, so the sources of a language are few next to it.
    numbered = joined.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return saved(numbered.withColumn("p0", F.when(F.col("size") > 0, _p("0", "total", "size"))), "groups")


def posting_table(index: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, source, no, p, p0, q of every posting of a kept term; q is the language's probability."""
    flat = index.select("lang", "term", "n_lang", F.inline("postings"))
    joined = flat.join(groups, ["lang", "source"])
    return joined.select("lang", "term", "source", "no", _p("n", "total", "size").alias("p"), "p0", _p("n_lang", "lang_total", "size").alias("q"))


# ---- rows of the product --------------------------------------------------------------------------------------------


def _floored(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def common_terms(postings: DataFrame) -> DataFrame:
    """lang, no, peer, common, shared: for each ordered pair of groups with terms in common, how many, and what these change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, block in _by_lang(batch):
                yield from _rows(lang, *_arrays(block))

    by_term = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "p0")).alias("postings"))
    shape = "lang string, no int, peer int, common bigint, shared bigint"
    found = by_term.select("lang", "postings").mapInArrow(run, shape)
    return found.groupBy("lang", "no", "peer").agg(F.sum("common").alias("common"), F.sum("shared").alias("shared"))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column("postings").take(pa.array(np.flatnonzero(codes == code)))


def _arrays(block: pa.Array) -> tuple[np.ndarray, ...]:
    """Where each term's postings begin, and the group, probability and baseline of every posting."""
    flat = block.flatten()
    starts = np.concatenate([[0], np.cumsum(np.diff(block.offsets.to_numpy()))])
    return starts, *(flat.field(k).to_numpy() for k in range(3))


def _rows(lang: str, starts: np.ndarray, no: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
    term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    peers = int(no.max(initial=-1)) + 1
    baseline = np.ones(peers, np.int64)
    baseline[no] = p0
    order = np.argsort(no, kind="stable")
    bounds = np.searchsorted(no[order], np.arange(peers + 1))
    for group in range(peers):
        own = order[bounds[group] : bounds[group + 1]]  # the group's postings, one per term that it has
        if not len(own):
            continue
        shared, common = np.zeros(peers, np.int64), np.zeros(peers, np.int64)
        # The index rows of a slice of its terms at a time, scattered to the peers.
        lengths = np.diff(starts)[term[own]]
        slices = np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum(), SLICE), "left")
        for part in np.split(np.arange(len(own)), slices[1:]):
            many = lengths[part]
            first = np.repeat(starts[term[own[part]]] - (np.cumsum(many) - many), many)
            at = first + np.arange(many.sum())
            mine, theirs, their_base = np.repeat(p[own[part]], many), p[at], p0[at]
            change = _floored(mine, theirs) - _floored(mine, their_base) - _floored(np.int64(baseline[group]), theirs)
            np.add.at(shared, no[at], change)
            np.add.at(common, no[at], 1)
        met = np.flatnonzero(common)
        met = met[met != group]
        columns = [pa.array([lang] * len(met), pa.string()), pa.array([group] * len(met), pa.int32()), pa.array(met, pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(common[met]), pa.array(shared[met])], ["lang", "no", "peer", "common", "shared"])


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of a language's sources."""
    left = groups.select("lang", "source", "no", "size", "p0", "own")
    right = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("peer"), F.col("p0").alias("q0"), F.col("own").alias("peer_own"))
    pairs = left.join(right, "lang").filter("no <> peer")
    # What a group's terms give against a baseline depends on its probabilities alone, of which it has few different ones.
    steps = postings.groupBy("lang", "no", "p").agg(F.count(F.lit(1)).alias("many"))
    base = groups.select("lang", F.col("no").alias("other"), F.col("p0").alias("b"))
    against = steps.join(base, "lang").filter("no <> other").groupBy("lang", "no", "other")
    against = against.agg(F.expr(f"sum(many * ({_f('p', 'b')}))").alias("over"), F.expr(f"sum(many * ({_f('b', 'p')}))").alias("under"))
    mine = against.select("lang", "no", F.col("other").alias("peer"), "over")
    theirs = against.select("lang", F.col("other").alias("no"), F.col("no").alias("peer"), "under")
    keys = ["lang", "no", "peer"]
    joined = pairs.join(mine, keys, "left").join(theirs, keys, "left").join(common_terms(postings), keys, "left")
    joined = joined.fillna(0, ["over", "under", "common", "shared"])
    # A common term was taken off twice by the two corrections, and its own value is in ``shared``.
    value = F.expr(f"over + under + shared + (size - own - peer_own + common) * ({_f('p0', 'q0')})")
    return joined.select("lang", "source", "item", F.coalesce(value, F.lit(0)).cast("bigint").alias("value"))


# ---- the whole ------------------------------------------------------------------------------------------------------


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` for the other sources, ``term`` for the terms a source has beyond its language."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    docs = docs.select(*filled)
    index = term_index(docs, least)
    groups = group_table(docs, index)
    postings = saved(posting_table(index, groups), "postings")
    order = [F.desc("value"), F.asc("item")]
    pairs = pair_values(postings, groups).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    over = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    terms = top_k_per_group(over, ["lang", "source"], order, top, "rank")
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
