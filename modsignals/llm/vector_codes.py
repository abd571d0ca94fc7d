"""Vector codes of an integer product quantiser, found by Walsh-Hadamard transforms.

A component x counts as floor(1024 * x). A vector is cut into PARTS equal parts, and every part position has a codebook of
ENTRIES entries, trained in ROUNDS rounds on all vectors. Parts and entries are padded with zeros to a power of two and
transformed once. The transform keeps squared distances but for a factor, the padded width, so the nearest entry is found
from squared differences of coefficients, taken in sequency order (from smooth to busy). An entry is out as soon as what is
summed up exceeds the whole distance of the best guess. All numbers are integers, so results are exact and reruns agree.

Tasks hold the codebooks (PARTS * ENTRIES entries, whatever the input) and send, per round, at most one row per entry; these
rows are added up by entry, and only the new codebooks come to the driver. A hot label or a repeated vector changes nothing
in that.

Vectors that are null or hold null or non-finite components are dropped. A shorter vector counts as padded with zeros to the
longest, and the longest to a multiple of PARTS. Null ids count as the largest; of rows with equal ids the smaller vector
comes first. With fewer than ENTRIES rows the codebooks are shorter. Magnitudes beyond 64-bit arithmetic are computed with
whole numbers of any size; an error that no long holds is null, and so is the sum of its label. An empty table gives an
empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Coefficients that are compared with every entry before any is left out; rows of vectors handled at a time.
FIRST, TOGETHER = 4, 512
_LONG = 2**63


# ---- the transform --------------------------------------------------------------------------------------------------


def sequency_order(width: int) -> np.ndarray:
    """For each sequency, the place of its function in the order that the butterflies give: the reversed bits of its Gray code."""
    bits = width.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(width)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row in sequency order; a row is padded with zeros to a power of two."""
    width = 1 << max(rows.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(rows), width), rows.dtype)
    out[:, : rows.shape[1]] = rows
    step = 1
    while step < width:
        pairs = out.reshape(len(rows), -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), width)
        step *= 2
    return out[:, sequency_order(width)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed part the nearest transformed entry, ties to the lower index, and the scaled squared distance."""
    width = parts.shape[1]
    partial = ((parts[:, None, :FIRST] - entries[None, :, :FIRST]) ** 2).sum(axis=2)
    guess = partial.argmin(axis=1)
    most = ((parts - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(partial <= most[:, None])
    found, at = partial[row, entry], FIRST
    while at < width:
        further = slice(at, 2 * at)
        found = found + ((parts[row, further] - entries[entry, further]) ** 2).sum(axis=1)
        alive = found <= most[row]
        row, entry, found, at = row[alive], entry[alive], found[alive], 2 * at
    # Rows come in order, and within a row entries do; the first of the least is wanted.
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(found, starts) if len(starts) else found
    hit = np.flatnonzero(found == np.repeat(least, np.diff(starts, append=len(row))))
    first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[first], found[first]


# ---- vectors as integers --------------------------------------------------------------------------------------------


def _whole(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 2**52 else int(x) * SCALE


def integers(column: pa.Array, dimension: int, wide: bool) -> np.ndarray:
    """One row of integers per vector, padded with zeros to ``dimension``; Python's integers where 64 bits may not do."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dimension), object if wide else np.int64)
    values = np.array([_whole(float(x)) for x in flat], object) if wide else np.floor(flat * SCALE).astype(np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


class Quantiser:
    """The codebooks as tasks use them: PARTS lists of at most ENTRIES entries, each a list of integers."""

    def __init__(self, books: list[list[list[int]]], dimension: int, wide: bool):
        self.dimension, self.wide = dimension, wide
        self.books = books

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Part number, its integers, the indexes of the nearest entries and the squared distances."""
        rows = integers(batch.column("vector"), self.dimension, self.wide)
        width = self.dimension // PARTS
        for p in range(PARTS):
            own = rows[:, p * width : (p + 1) * width]
            if not width:
                yield p, own, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                continue
            entries = transform(np.array(self.books[p], own.dtype))
            index, scaled = nearest(transform(own), entries)
            yield p, own, index, scaled // entries.shape[1]


def _sums(vectors: DataFrame, model: Quantiser) -> DataFrame:
    """part, entry, n, sums of the parts that each entry is nearest to; each task adds up its own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model.dimension // PARTS
        total = np.zeros((PARTS, ENTRIES, width), object if model.wide else np.int64)
        count = np.zeros((PARTS, ENTRIES), np.int64)
        for batch in _slices(batches):
            for p, own, index, _ in model.parts(batch):
                np.add.at(total[p], index, own)
                np.add.at(count[p], index, 1)
        part, entry = np.nonzero(count)
        yield _sum_rows(part, entry, count[part, entry], total[part, entry])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(lambda: [0, 0])
        for batch in batches:
            for part, entry, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = total[part, entry]
                at[0] += n
                at[1] = at[1] + np.array([int(x) for x in sums], object)
        keys = list(total)
        yield _sum_rows([p for p, _ in keys], [e for _, e in keys], [total[k][0] for k in keys], [total[k][1] for k in keys])

    shape = "part int, entry int, n bigint, sums array<string>"
    return vectors.select("vector").mapInArrow(add, shape).repartition("part", "entry").mapInArrow(merge, shape)


def _sum_rows(part, entry, n, sums) -> pa.RecordBatch:
    # Sums travel as decimal text, since no fixed width holds them in every case.
    text = [[str(int(x)) for x in row] for row in sums]
    arrays = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(text, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, ["part", "entry", "n", "sums"])


def _coded(vectors: DataFrame, model: Quantiser) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, errors = [""] * batch.num_rows, [0] * batch.num_rows
            for _, _, index, distance in model.parts(batch):
                codes = [c + f"{i:02x}" for c, i in zip(codes, index.tolist(), strict=True)]
                errors = [e + d for e, d in zip(errors, distance.tolist(), strict=True)]
            errors = pa.array([e if e < _LONG else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), errors], ["vec_id", "label", "code", "error"]
            )

    fields = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error bigint")


# ---- the whole ------------------------------------------------------------------------------------------------------


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    picked = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    return picked.filter(F.col("vector").isNotNull() & F.forall("vector", _finite))


def train(vectors: DataFrame) -> Quantiser:
    """The codebooks after ROUNDS rounds over all of ``vectors``."""
    sizes = vectors.agg(F.max(F.size("vector")).alias("size"), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))).alias("most")).first()
    dimension = -(-(sizes["size"] or 0) // PARTS) * PARTS
    padded = 1 << max(dimension // PARTS - 1, 0).bit_length()
    wide = (sizes["most"] or 0) * SCALE * padded >= 2**30
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).toArrow().column("vector")
    rows = integers(first.combine_chunks().cast(pa.list_(pa.float64())), dimension, wide).tolist()
    width = dimension // PARTS
    books = [[row[p * width : (p + 1) * width] for row in rows] for p in range(PARTS)]
    for _ in range(ROUNDS if rows else 0):
        for found in _sums(vectors, Quantiser(books, dimension, wide)).collect():  # at most PARTS * ENTRIES rows
            books[found["part"]][found["entry"]] = [int(x) // found["n"] for x in found["sums"]]
    return Quantiser(books, dimension, wide)


def codebook_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    vectors = saved(kept_vectors(rows, id_col, vector_col, label_col), "vectors")
    model = train(vectors)
    coded = saved(_coded(vectors, model), "codes")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(F.count("error") == F.count(F.lit(1)), whole.try_cast("bigint"))
    labels = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(model.books)).alias("codebooks_sha256"))
