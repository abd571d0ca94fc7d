"""Document fingerprints from closed syncmers over words.

A text's words are hashed. Every run of K words is looked at through its inner runs of S words: it becomes an anchor when the
smallest inner hash lies at its first or last place. The choice depends on the K words alone, so a passage has the same
anchors in whatever text it stands. A text with fewer than K words has one anchor, made of all of them; a text without words
has none. Null text counts as empty. Equal texts have equal anchors.

The next document is the one that follows in descending order of id, then of a hash of the text, ids that are null last; the
first follows the last. A single document follows itself. Rows that repeat an id are each a document. Other columns are never
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

K, S = 3, 1
#: Rows in one piece of the order, and the most pieces; their borders and first rows are all that is gathered.
PIECE_ROWS, MOST_PIECES = 500, 65_536
#: Anchors that the printed fingerprint names.
PRINTED = 16


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<at: int, hash: long>>: the anchors of a text with their word positions."""
    if not 0 < s < k - 1:
        raise ValueError("a closed syncmer needs 0 < s < k - 1")
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)), lambda w: F.xxhash64(w))

    def run(w: Column, i: Column, n: int) -> Column:
        return F.xxhash64(*(F.get(w, i + j) for j in range(n)))

    def closed(inner: Column, i: Column) -> Column:
        at = [F.get(inner, i + j) for j in range(k - s + 1)]
        middle = reduce(F.least, at[1:-1]) if len(at) > 3 else at[1]
        return F.least(at[0], at[-1]) <= middle

    def chosen(w: Column, inner: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - k), lambda i: closed(inner, i))
        return F.transform(places, lambda i: F.struct(i.alias("at"), run(w, i, k).alias("hash")))

    def anchors(w: Column) -> Column:
        inner = w if s == 1 else F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: run(w, i, s))
        whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(w).alias("hash")))
        many = chosen(w, inner) if s == 1 else let(inner, lambda m: chosen(w, m))
        return F.when(F.size(w) >= k, many).otherwise(F.slice(whole, 1, F.least(F.size(w), F.lit(1))))

    return let(words, anchors)


def anchor_set(text: Column) -> Column:
    return F.array_distinct(F.transform(syncmers(text), lambda a: a["hash"]))


def printed(anchors: Column) -> Column:
    """The number of anchors, a hash of them all, and the smallest ones, in order."""
    return let(
        F.sort_array(anchors),
        lambda a: F.concat_ws(
            ":", F.size(a).cast("string"), F.lower(F.hex(F.xxhash64(a))), F.array_join(F.transform(F.slice(a, 1, PRINTED), lambda x: F.lower(F.hex(x))), ".")
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared anchors over the anchors of both; 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _pieces(docs: DataFrame) -> tuple[Column, int]:
    """The piece of the order in which an id lies, by borders from approximate quantiles; higher ids lie in higher pieces."""
    rows = docs.count()
    n = min(MOST_PIECES, -(-rows // PIECE_ROWS))
    if n < 2:
        return F.lit(0), 1
    borders = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"]
    borders = sorted(set(borders or ()))
    table = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")
    if not borders:
        return F.lit(0), 1
    steps = [1 << b for b in reversed(range(len(borders).bit_length()))]
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) < F.col("doc_id"), F.lit(False)), at + step).otherwise(at)
    )
    return F.coalesce(found, F.lit(0)), n


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """doc_id, text, extra and the window in which ``lead`` finds the next document.

    The order is cut into pieces; each piece also gets, as an extra row at its end, the first document of the piece that
    follows. So one shuffle of the texts by piece does it, and no task sees the whole order.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    piece, _ = _pieces(docs)
    keyed = docs.withColumn("piece", piece).withColumn("tie", F.xxhash64("text"))
    first = keyed.groupBy("piece").agg(F.max("doc_id").alias("first_id")).alias("f")
    firsts = (
        keyed.join(F.broadcast(first), "piece")
        .filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("piece", "first_id")
        .agg(F.min("tie").alias("first_tie"))
    )
    # One row per piece: the last document of the next higher piece looks for this one; that of the lowest for the very first.
    order = Window.orderBy("piece")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("first_id", "first_tie", F.coalesce(F.lead("piece").over(order), F.min("piece").over(everything)).alias("also"))
    place = lambda piece, extra: F.struct(piece.cast("int").alias("piece"), F.lit(extra).alias("extra"))
    own = place(F.col("piece"), False)
    rows = (
        keyed.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")), "left")
        .withColumn("p", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, place(F.col("also"), True)))))
        .select("doc_id", "text", "tie", "p.piece", "p.extra")
    )
    return rows, Window.partitionBy("piece").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the first as many characters of another (or all of it)."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document."""
    rows, order = beside_next(docs, id_col, text_col)
    texts = rows.withColumn("edited", edited(F.col("text"), F.lead("text").over(order)))
    hashed = texts.select(
        "piece",
        "extra",
        "tie",
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.coalesce(F.col("edited"), F.lit("")).cast("binary"), 256).alias("edited_sha256"),
        anchor_set(F.col("text")).alias("own"),
        anchor_set(F.when(~F.col("extra"), F.col("edited"))).alias("changed"),
    )
    return (
        hashed.withColumn("following", F.lead("own").over(order))
        .filter(~F.col("extra"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            printed(F.col("own")).alias("fingerprint"),
            printed(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("following")).alias("near_next"),
        )
    )
