"""Language-model scores from a probabilistic suffix tree over words.

A context is a word or two that stand before a token; the end of a text stands before its first word. A context is kept if
what follows it diverges from what follows the context that is one word shorter. A kept context's distribution gives followers
that occur LEAST times after it what they have, less a discount, and shares the rest among all other tokens in proportion to the
shorter context's distribution. Below all contexts lie the single words with add-half smoothing. A token is scored in the
longest kept context before it.

All counts are exact and over all training rows. Every word, pair and triple that occurs LEAST times is counted, whatever the
corpus: sequences are known by 64-bit codes, counted by a shuffle, and weighed against the next shorter ones by joins, level by
level. What a text gains is a sum over its sequences, of what each context's words without a row get and of what a sequence's
own row has more than that. Only the most frequent, at most HOT, are sent to tasks; a text's other sequences meet their values
by a join, as do words outside those at hand. A bitmap of bounded size spares most sequences without a value that way; it leaves
none out that has one.

Null text counts as empty: only the end. Rows that repeat are counted and scored each. Without training rows every token has
probability one. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, discard, saved, slices

#: Occurrences that a sequence needs to be counted as a follower of its context, and words of the longest context.
LEAST, DEPTH = 2, 2
#: Values of words and sequences that are sent to every task, at most; the others are joined, in so many passes over the texts.
HOT, PASSES = 1_000_000, 2
#: Divergence per occurrence (nats) and gain in all that a kept context has over the shorter one.
DIVERGENCE, GAIN = 0.01, 10.0
DISCOUNT = 0.5
#: At most so many of the most frequent words are at hand in every task.
AT_HAND = 250_000
#: Sequences of a range of codes that is added up in one place, about, if all differ.
RANGE = 400_000
#: Sequences, or words of single stretches of texts, at which a task hands on what it has counted.
STRETCH = 1_000_000
#: Sequences asked for, or values, at which a task hands on what it has put into ranges; it holds them several times for that.
HANDED_ON = 400_000
#: Tokens of a pass over the texts for a range of codes that is looked up in one place, about.
LOOKED_UP = 500_000
#: Values of the part of a table that one task keeps for a join, or of a range that is looked up, about.
HASHED = 1_000_000
#: Most bits of a bitmap of codes, and the blocks that it is made in, as powers of two.
MOST_BITS, BLOCK_BITS = 27, 8
#: Fixed values of the split into training and held-out rows.
PARTS, HELD = 5, 1
_BREAK = -2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (crc_rest(F.col(id_col), PARTS) == HELD).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_of(text: str) -> list[bytes]:
    """The words of one text; ``split`` gives those of many."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all texts, each text's words by their places among these, and how many words each text has."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return pa.array([], pa.string()), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    starts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    # Of bytes only A-Z change, so the texts stay where they are.
    lower = data.slice(starts[0], starts[-1] - starts[0]).to_pybytes().lower()
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(starts - starts[0]), pa.py_buffer(lower)))
    each = words.flatten()
    there = pc.binary_length(each).to_numpy() > 0  # space at the ends of a text gives empty ones
    encoded = each.dictionary_encode()
    lengths = np.diff(np.append(0, np.cumsum(there))[words.offsets.to_numpy()])
    return encoded.dictionary, encoded.indices.to_numpy()[there], lengths


# ---- counting -------------------------------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: occurrences in training rows, for every word of all rows. The empty word stands for the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            return pa.concat_tables(waiting).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches()

        for batch in slices(batches, "text"):
            words, at, lengths = split(batch.column("text"))
            train = ~batch.column("held").to_numpy(zero_copy_only=False)
            counts = np.bincount(at[np.repeat(train, lengths)], minlength=len(words))
            ends = pa.array([""], pa.string()), pa.array([train.sum()], pa.int64())
            waiting += [pa.table([words, pa.array(counts, pa.int64())], ["word", "c"]), pa.table(ends, ["word", "c"])]
            size += len(words) + 1
            if size > STRETCH:
                yield from out()
                waiting, size = [], 0
        if waiting:
            yield from out()

    return docs.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The code of a sequence from those of its sequence without the last word and without the first."""
    x = left * _MIX + right
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """The words at hand by place, the end first, and their codes; a word's code is Spark's ``xxhash64``."""

    places: dict[bytes, int]
    codes: np.ndarray

    def line(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places (-1 for a word not at hand) and codes of all texts' tokens in one line, each text between two ends, with breaks; the texts' lengths."""
        words, at, lengths = split(texts)
        spelt = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
        get = self.places.get
        places = np.fromiter((get(w, -1) for w in spelt), np.int64, len(spelt))
        of_words = self.codes[places]
        rare = spelt[places < 0]
        of_words[places < 0] = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in rare), np.uint64, len(rare))
        ends = np.cumsum(lengths + 3) - 1
        starts = ends - lengths - 2
        line = np.zeros(int((lengths + 3).sum()), np.int64)
        codes = np.full(len(line), self.codes[0])
        is_word = np.ones(len(line), bool)
        is_word[starts] = is_word[starts + 1] = is_word[ends] = False
        line[starts] = _BREAK
        line[is_word], codes[is_word] = places[at], of_words[at]
        return line, codes, lengths + 1


def longer(codes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the sequences that are one word longer and end at the same places, and where there are such."""
    out, there = np.zeros_like(codes), np.zeros_like(whole)
    out[1:] = _mixed(codes[:-1], codes[1:])
    there[1:] = whole[:-1] & whole[1:]
    return out, there


def _bitmap_power(count: int) -> int:
    """How many bits a bitmap of so many codes has, as a power of two."""
    return min(MOST_BITS, max(16, (16 * count).bit_length()))


class Seen:
    """A bitmap of codes. It has every code that it was made of, and a small share of others; it only spares rows the way to a join."""

    def __init__(self, power: int):
        self.power, self.bits = power, np.zeros(1 << (power - 6), np.uint64)

    def add(self, codes: np.ndarray) -> None:
        at = codes >> np.uint64(64 - self.power)
        np.bitwise_or.at(self.bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    @classmethod
    def of(cls, table: DataFrame) -> Seen:
        """Of the codes of a table, which are dealt out by range."""
        seen = cls(_bitmap_power(table.count()))
        power, block = seen.power, 1 << (seen.power - 6 - BLOCK_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = cls(power)
            for batch in batches:
                own.add(batch.column("code").to_numpy().view(np.uint64))
            blocks = own.bits.reshape(-1, block)
            filled = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([blocks[k].tobytes() for k in filled], pa.binary())], ["block", "bits"])

        dealt = table.select("code").repartition(F.shiftrightunsigned("code", 64 - BLOCK_BITS))
        # Written first, so that the codes' shuffle files are gone before anything else is.
        blocks = saved(dealt.mapInArrow(run, "block bigint, bits binary"), "bitmap")
        for row in blocks.toLocalIterator():
            seen.bits[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["bits"], np.uint64)
        discard(blocks)
        return seen

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = codes >> np.uint64(64 - self.power)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class Places:
    """The places of codes in a sorted table. Codes are hashes, so nearly each first few bits of one lead to a place or two."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, max(1, len(codes).bit_length())
        heads = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.starts = np.append(np.searchsorted(codes, heads), len(codes)).astype(np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code in the table, or -1."""
        head = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, ends = self.starts[head], self.starts[head + 1]
        out = np.full(len(codes), -1, np.int64)
        asked = np.flatnonzero(at < ends)
        while len(asked):
            hit = self.codes[at[asked]] == codes[asked]
            out[asked[hit]] = at[asked[hit]]
            asked = asked[~hit]
            at[asked] += 1
            asked = asked[at[asked] < ends[asked]]
        return out


def in_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes in order, where each of these was, and where equal ones begin."""
    order = np.argsort(codes)
    codes = codes[order]
    return codes, order, np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])


def count_grams(docs: DataFrame, words: Words, length: int, seen: Seen | None, parts_bits: int) -> DataFrame:
    """context, low, n: sequences of ``length`` and one more words, by the codes of all but the last and all but the first, that
    training rows hold LEAST times. ``seen`` has the shorter sequences that they hold LEAST times.

    What a task has counted leaves it in one row for each of 2 ** ``parts_bits`` ranges of the sequences' codes, and a range is
    added up in one place. Nearly all long sequences differ, so a row for each would cost more than its counting.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, seen))
    shift = np.uint64(64 - parts_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = shared.value
        waiting, size = [], 0

        def out() -> pa.RecordBatch:
            context, low = (np.concatenate(x) for x in zip(*waiting, strict=True))
            codes, order, starts = in_runs(_mixed(context, low))
            first, n = order[starts], np.diff(starts, append=len(codes))
            # The codes are in order, so a range of them is a slice.
            return pa.RecordBatch.from_arrays(_ranges(codes[starts] >> shift, context[first], low[first], n.astype(np.int32)), ["part", "context", "low", "n"])

        for batch in slices(batches, "text"):
            line, codes, _ = words.line(batch.column("text"))
            whole = line != _BREAK
            for _ in range(length - 1):
                codes, whole = longer(codes, whole)
            both = np.flatnonzero(whole[1:] & whole[:-1])
            if seen:
                there = seen.has(codes)
                both = both[there[both] & there[both + 1]]
            waiting.append((codes[both], codes[both + 1]))
            size += len(both)
            if size >= STRETCH:
                yield out()
                waiting, size = [], 0
        if size:
            yield out()

    counted = docs.filter("NOT held").select("text").mapInArrow(run, "part bigint, context binary, low binary, n binary")
    return counted.groupBy("part").applyInArrow(_added_up, "context bigint, low bigint, n bigint")


def _ranges(parts: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The different parts, which are in order, and each column's numbers of a part as bytes."""
    starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])[: len(parts)])
    ends = np.append(starts, len(parts))
    return [pa.array(parts[starts].astype(np.int64)), *(_bytes(x, ends) for x in columns)]


def _by_part(codes: np.ndarray, parts_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the codes' ranges, and the ranges in this order; few bits are put in order faster than whole codes."""
    parts = (codes >> np.uint64(64 - parts_bits)).astype(np.uint16 if parts_bits <= 16 else np.uint64)
    order = np.argsort(parts, kind="stable")
    return order, parts[order]


def _bytes(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The numbers from each end to the next as bytes, which Spark moves whole, where it would move a list's elements one by one."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * numbers.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])


def _added_up(rows: pa.Table) -> pa.Table:
    """The sequences of one range that occur LEAST times."""
    context, low, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("context", np.uint64), ("low", np.uint64), ("n", np.int32)))
    _, order, starts = in_runs(_mixed(context, low))
    total = np.add.reduceat(n[order].astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    often = total >= LEAST
    first = order[starts[often]]
    return pa.table([pa.array(x.view(np.int64)) for x in (context[first], low[first], total[often])], ["context", "low", "n"])


# ---- the tree -------------------------------------------------------------------------------------------------------


def _level(context: np.ndarray, n: np.ndarray, total: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept contexts, their rest and their followers' logs, for followers given by context, count and probability below."""
    size = len(total)
    heavy, p_lower = np.bincount(context, n, size), np.minimum(np.bincount(context, lower, size), 1 - 1e-12)
    total = np.maximum(total, 1).astype(float)
    share = n / total[context]
    left = np.maximum(total - heavy, 0) / total
    gain = np.bincount(context, n * np.log(share / lower), size).astype(float)  # whole numbers where there is nothing
    with np.errstate(divide="ignore", invalid="ignore"):
        gain += np.where(left > 0, total * left * np.log(left / (1 - p_lower)), 0)
    followers = np.bincount(context, minlength=size)
    kept = (followers > 0) & (gain >= GAIN) & (gain >= DIVERGENCE * total)
    rest = np.where(kept, np.log10(np.where(kept, (left + DISCOUNT * followers / total) / (1 - p_lower), 1)), 0.0)
    return kept, rest, np.log10((n - DISCOUNT) / total[context])


def meet(rows: DataFrame, values: DataFrame, on: str, count: int, how: str = "inner") -> DataFrame:
    """Joined by hash tables of ``count`` values' parts, none of which has many more than HASHED; both sides are dealt out, neither is put in order."""
    parts = count // HASHED + 1
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows, values = rows.repartition(parts, on), values.repartition(parts, on)
    return rows.join(values.hint("shuffle_hash"), on, how)


def grow(grams: DataFrame, below: DataFrame, last: bool) -> DataFrame:
    """code, n, log, value, context of one level; ``below`` has code, n, log of the sequences that are one word shorter.

    Of the last level, which has none above it, only rows with a value are given, without logs.

    A sequence's row has the log of its last word after the others, and what that is more than a word without a row gets there.
    A kept context's row has what a word without a row gets, over its log in the shorter context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not rows:
            return
        context, low, n, total, lower = (rows.column(c).to_numpy() for c in ("context", "low", "n", "total", "lower"))
        own, first, at = np.unique(context, return_index=True, return_inverse=True)
        kept, rest, logs = _level(at, n, total[first], 10.0**lower)
        in_kept = kept[at]

        def out(codes, n, log, value, is_context) -> pa.RecordBatch:
            if last:
                has = value != 0
                codes, n, value = codes[has], n[has], value[has]
                log = np.zeros(len(n))
            columns = [pa.array(codes, pa.int64()), pa.array(n, pa.int64()), pa.array(log, pa.float64()), pa.array(value, pa.float64()), pa.array(np.full(len(n), is_context))]
            return pa.RecordBatch.from_arrays(columns, ["code", "n", "log", "value", "context"])

        codes = _mixed(context.view(np.uint64), low.view(np.uint64)).view(np.int64)
        yield out(codes, n, np.where(in_kept, logs, lower), np.where(in_kept, logs - lower - rest[at], 0.0), False)
        yield out(own[kept], total[first][kept], np.zeros(kept.sum()), rest[kept], True)

    of_low = below.select(F.col("code").alias("low"), F.col("log").alias("lower"))
    of_context = below.select(F.col("code").alias("context"), F.col("n").alias("total"))
    # Sequences grow with the corpus: they are dealt out, not broadcast.
    count = below.count()
    met = meet(meet(grams, of_low, "low", count), of_context, "context", count).repartition("context")
    shape = "code bigint, n bigint, log double, value double, context boolean"
    return saved(met.select("context", "low", "n", "total", "lower").mapInArrow(run, shape), "contexts")


# ---- scoring --------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """What scoring tasks know: the words at hand with their base logs, which are known, which are frequent; frequent codes, sorted, with their values; the codes with a value."""

    words: Words
    base: np.ndarray
    known: np.ndarray
    frequent: np.ndarray
    codes: np.ndarray
    values: np.ndarray
    seen: Seen

    def __post_init__(self):
        values = np.append(self.values, 0.0)
        self.held = Places(self.codes)
        self.at_place = np.append(values[self.held.find(self.words.codes)], [0.0, 0.0])

    def gains(self, line: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the frequent codes give at each place of the line, and the codes, with their places, that a table has to be asked for."""
        values = np.append(self.values, 0.0)
        frequent = np.append(self.frequent, [False, False])
        whole = line != _BREAK
        before = np.zeros_like(whole)  # only what stands before a token is its context
        before[:-1] = whole[:-1] & whole[1:]
        is_frequent = frequent[line]
        out = np.where(before & is_frequent, self.at_place[line], 0.0)
        places, asked = [], []
        for length in range(1, DEPTH + 2):
            at = np.flatnonzero(whole if length > 1 else before & ~is_frequent)
            # A word that is not at hand has its base log to be asked for, too.
            at = at[self.seen.has(codes[at]) | ((line[at] == -1) & (length == 1))]
            held = self.held.find(codes[at]) if length > 1 else np.full(len(at), -1)
            out[at] += values[held]
            places.append(at[held < 0])
            asked.append(codes[at[held < 0]])
            codes, whole = longer(codes, whole)
        return out, np.concatenate(places), np.concatenate(asked)


def by_range(values: DataFrame, parts_bits: int, power: int) -> DataFrame:
    """part, codes, k, b, g, bits: code and k, b, g of the values as bytes, in one row for each of 2 ** ``parts_bits`` ranges of codes,
    in order and summed by code, with the range's piece of a bitmap of 2 ** ``power`` bits of the codes that have a g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting)
            order, parts = _by_part(rows.column("code").to_numpy().view(np.uint64), parts_bits)
            columns = _ranges(parts, *(rows.column(c).to_numpy()[order] for c in ("code", "k", "b", "g")))
            return pa.RecordBatch.from_arrays(columns, ["part", "codes", "k", "b", "g"])

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= HANDED_ON:
                yield out()
                waiting, size = [], 0
        if size:
            yield out()

    def in_one(rows: pa.Table) -> pa.Table:
        codes, order, starts = in_runs(np.concatenate(_numbers(rows.column("codes"), np.uint64)))
        codes, sums = codes[starts], [np.add.reduceat(np.concatenate(_numbers(rows.column(c), float))[order], starts) for c in ("k", "b", "g")]
        own = Seen(power - parts_bits)
        own.add(codes[sums[2] != 0] << np.uint64(parts_bits))
        lists = [pa.array([x.tobytes()], pa.binary()) for x in (codes, *sums, own.bits)]
        return pa.table([rows.column("part").slice(0, 1), *lists], ["part", "codes", "k", "b", "g", "bits"])

    shape = "part bigint, codes binary, k binary, b binary, g binary"
    return values.mapInArrow(run, shape).groupBy("part").applyInArrow(in_one, shape + ", bits binary")


def _numbers(lists: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in lists]


def _looked_up(batches: Iterator[pa.RecordBatch], parts_bits: int) -> Iterator[pa.RecordBatch]:
    """What stretches of texts get from ranges: a row for each stretch and range, with the texts that got something and their sums."""
    same = np.uint64(parts_bits)  # the codes of a range have their first bits in common, so places are found by the next ones
    for batch in batches:
        for asked, *values in zip(*(batch.column(c) for c in ("asked", "codes", "k", "b", "g")), strict=True):
            asked, texts, found = asked.values, [], []
            held, *more = (np.frombuffer(x.as_buffer() or b"", kind) for x, kind in zip(values, (np.uint64, float, float, float), strict=True))  # null if the range has no values
            places = Places(held << same)
            for at, codes in zip(_numbers(asked.field("at"), np.int32), _numbers(asked.field("codes"), np.uint64), strict=True):
                rows = places.find(codes << same)
                at, rows = at[rows >= 0], rows[rows >= 0]
                got = np.flatnonzero(np.bincount(at))
                texts.append(got.astype(np.int32).tobytes())
                found.append(np.stack([np.bincount(at, x[rows])[got] for x in more]).tobytes())
            columns = [asked.field("stretch"), asked.field("own"), pa.array(texts, pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["stretch", "own", "at", "found"])


def _added_to_own(rows: pa.Table) -> pa.Table:
    """The texts of one stretch, with what ranges gave them added to their own sums."""
    own = pa.ipc.open_stream(rows.column("own").drop_null()[0].as_buffer()).read_all()
    sums = np.stack([own.column(c).to_numpy().astype(float) for c in ("n_known", "base", "gain")])
    for at, found in zip(_numbers(rows.column("at"), np.int32), _numbers(rows.column("found"), float), strict=True):
        sums[:, at] += found.reshape(3, -1)
    columns = [*own.columns[:3], pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
    return pa.table(columns, own.column_names)


def score_texts(docs: DataFrame, shared: Broadcast, values: DataFrame, parts_bits: int) -> DataFrame:
    """doc_id, held, n_tokens, n_known, base, gain; ``values`` has, by range, codes and k, b, g, what they add to the last three, of what tasks do not know; ``shared`` is the tree.

    What a stretch of texts asks for leaves its task in one row for each range of codes, as what is counted does, and meets the
    values of that range, in one row, by a join; what it gets goes back to the stretch, whose first row has the texts' own sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        base, known = np.append(tree.base, [0.0, 0.0]), np.append(tree.known, [False, False])
        stretch, waiting, size, texts = TaskContext.get().partitionId() << 33, [], 0, 0

        def out() -> pa.RecordBatch:
            own, at, codes = zip(*waiting, strict=True)
            own, at, codes = pa.Table.from_batches(own), np.concatenate(at), np.concatenate(codes)
            order, parts = _by_part(codes, parts_bits)
            part, at, codes = _ranges(parts, at[order], codes[order])
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, own.schema) as stream:
                    stream.write_table(own)
                sent = sink.getvalue().to_pybytes()
            # The texts' own sums are a row that asks for nothing; its part only deals it out.
            nothing = pa.array([b""], pa.binary())
            columns = [
                pa.concat_arrays([pa.array([stretch % (1 << parts_bits)], pa.int64()), part]),
                pa.array(np.full(len(part) + 1, stretch)),
                pa.concat_arrays([nothing, at]),
                pa.concat_arrays([nothing, codes]),
                pa.concat_arrays([pa.array([sent], pa.binary()), pa.nulls(len(part), pa.binary())]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "stretch", "at", "codes", "own"])

        for batch in slices(batches, "text"):
            line, codes, n_tokens = tree.words.line(batch.column("text"))
            gain, places, asked = tree.gains(line, codes)
            breaks = line == _BREAK
            starts = np.flatnonzero(breaks)
            scored = ~breaks  # the break and the end before the text are no tokens
            scored[starts + 1] = False
            sums = [np.add.reduceat(x, starts) if len(starts) else np.empty(0) for x in (np.where(scored, known[line], 0), np.where(scored, base[line], 0), gain)]
            columns = [batch.column("doc_id"), batch.column("held"), pa.array(n_tokens, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            own = pa.RecordBatch.from_arrays(columns, ["doc_id", "held", "n_tokens", "n_known", "base", "gain"])
            waiting.append((own, (np.cumsum(breaks)[places] + (texts - 1)).astype(np.int32), asked))
            size, texts = size + len(asked), texts + len(starts)
            if max(size, texts) >= HANDED_ON:
                yield out()
                stretch, waiting, size, texts = stretch + 1, [], 0, 0
        if texts:
            yield out()

    asked = docs.mapInArrow(run, "part bigint, stretch bigint, at binary, codes binary, own binary")
    # Ranges are dealt out one by one, both sides alike, so that a task holds few of them.
    asked = asked.repartition(1 << parts_bits, "part").groupBy("part").agg(F.collect_list(F.struct("stretch", "at", "codes", "own")).alias("asked"))
    held = values.select("part", "codes", "k", "b", "g").repartition(1 << parts_bits, "part")
    met = asked.join(held.hint("shuffle_hash"), "part", "left").select("asked", "codes", "k", "b", "g")
    found = met.mapInArrow(lambda batches: _looked_up(batches, parts_bits), "stretch bigint, own binary, at binary, found binary")
    return saved(found.groupBy("stretch").applyInArrow(_added_to_own, "doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base double, gain double"), "scores")


def _power(rows: DataFrame, column: str, most: int) -> tuple[int, int, int]:
    """The least power of two that at most ``most`` rows reach, so that these are a filter of the table and nothing is put in order; how many rows do, and do not."""
    digits = F.when(F.col(column) > 0, F.length(F.bin(column))).otherwise(0)
    many = rows.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).collect()
    reach = lambda k: sum(r["n"] for r in many if r["digits"] > k)
    k = next(k for k in range(64) if reach(k) <= most)
    return 2**k, reach(k), reach(-1) - reach(k)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's length, its score by single words, and its score by the tree."""
    rows = _rows(docs, id_col, text_col)
    counted = saved(count_words(rows), "word-counts")
    whole = counted.filter("c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = whole["n"] or 0, whole["v"]
    words = counted.select("word", "c", (F.col("c") > 0).cast("bigint").alias("known"), F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("base"))

    # The end first, then by training count.
    enough, _, rare = _power(words, "c", AT_HAND)
    at_hand = words.filter((F.col("c") >= enough) | (F.col("word") == "")).select("word", "c", "base", F.xxhash64("word").alias("code")).toPandas()
    at_hand = at_hand.assign(end=at_hand["word"] == "").sort_values(["end", "c", "word"], ascending=[False, False, True])
    hand = Words({w.encode("utf-8", "surrogatepass"): k for k, w in enumerate(at_hand["word"])}, at_hand["code"].to_numpy(np.int64).view(np.uint64))

    below = words.filter(F.col("c") >= LEAST).select(F.xxhash64("word").alias("code"), F.col("c").alias("n"), F.col("base").alias("log"))
    levels, seen, parts_bits = [], None, max(4, (n // RANGE).bit_length())
    for length in range(1, DEPTH + 1):
        # Written in between, so that the files of the counting, the largest shuffle, are gone before the joins have theirs.
        grams = saved(count_grams(rows, hand, length, seen, parts_bits), "grams")
        levels.append(grow(grams, below, length == DEPTH))
        discard(grams)
        below = levels[-1].filter("NOT context")
        seen = Seen.of(below) if length < DEPTH else None
        # What nothing names any more goes with its shuffle files before the next level writes its own.
        gc.collect()
        docs.sparkSession.sparkContext._jvm.System.gc()
    values = reduce(DataFrame.unionByName, levels).filter("value <> 0").select("code", "n", "value")
    often, frequent, others = _power(values, "n", HOT)
    hot = values.filter(F.col("n") >= often).groupBy("code").agg(F.sum("value").alias("value")).toArrow()
    hot_codes, hot_values = hot["code"].to_numpy().view(np.uint64), hot["value"].to_numpy()
    order = np.argsort(hot_codes)
    none = F.lit(0.0).alias("k"), F.lit(0.0).alias("b")
    rest = values.filter(F.col("n") < often).select("code", *none, F.col("value").alias("g"))
    not_at_hand = words.filter((F.col("c") < enough) & (F.col("word") != ""))
    rest = rest.unionByName(not_at_hand.select(F.xxhash64("word").alias("code"), F.col("known").cast("double").alias("k"), F.col("base").alias("b"), F.lit(0.0).alias("g")))
    parts_bits = max(4, max(n // PASSES // LOOKED_UP, (others + rare) // HASHED).bit_length())
    power = max(_bitmap_power(frequent + others), parts_bits + 6)
    held = saved(by_range(rest, parts_bits, power), "values")
    # All that is read of the levels is in there.
    discard(counted, *levels)
    seen, piece = Seen(power), 1 << (power - parts_bits - 6)
    for row in held.select("part", "bits").toLocalIterator():
        seen.bits[row["part"] * piece : (row["part"] + 1) * piece] = np.frombuffer(row["bits"], np.uint64)
    seen.add(hot_codes)
    counts = at_hand["c"].to_numpy(np.int64)
    tree = Tree(hand, at_hand["base"].to_numpy(float), counts > 0, counts >= often, hot_codes[order], hot_values[order], seen)
    # Sent once for all passes, as each executor writes a copy. One pass's shuffle files go before the next one writes its own.
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    passes = [score_texts(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PASSES)) == k), shared, held, parts_bits) for k in range(PASSES)]
    shared.destroy()
    discard(held)
    return reduce(DataFrame.unionByName, passes).select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("base") + F.col("gain")).alias("score"),
    )
