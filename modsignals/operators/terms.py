"""Term search over a text column: S6, S11, J5, F4."""

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..small import small_table
from .topk import top_k_per_group

# A test of one absent term costs about a fortieth of a search by pattern; the limit is set from that. TOGETHER tests make one array.
INLINE_TERMS, TOGETHER = 32, 32
GRAM = 3
# Characters of terms in one pattern, and of a term in it: a pattern is compiled per task, and its nesting is bounded by a term's length.
PATTERN_CHARS, PATTERN_TERM = 20_000, 100
# Characters of terms looked up in one pass; such a table is a few dozen megabytes at most once broadcast.
PASS_CHARS = 1_000_000


def match_terms(df: DataFrame, terms: Sequence[str], text: "str | Column", inline: int = INLINE_TERMS) -> DataFrame:
    """One row per (row, matching term), with the term in ``search_term``.

    A term matches when the lower-cased text contains the lower-cased term. Rows without a match are
    dropped (F4); a row matching two terms appears twice (T6); a repeated term repeats its rows.

    The search is a narrow map-side pass without a shuffle. Up to ``inline`` terms become generated
    code over the text. Longer lists become one pattern, a tree of the terms' letters, so the cost per row follows the text
    and not the length of the list; terms shorter than three characters are found early in most texts and stay tests of their
    own. Lists too long for a pattern are looked up by three-character pieces, and a list too long to be broadcast safely is
    searched in several passes.
    """
    column = F.col(text) if isinstance(text, str) else text
    terms = list(terms)
    if len(terms) <= inline:
        return _match_inline(df, terms, column)
    # Patterns and pieces are cut here, texts are lower-cased by Spark; both agree on terms without special casing.
    cut = [t for t in terms if len(t.lower()) >= GRAM and (t.isascii() or t == t.lower())]
    known = set(cut)
    others = [t for t in terms if t not in known]
    if sum(map(len, cut)) <= PATTERN_CHARS and all(len(t) <= PATTERN_TERM for t in cut):
        return _match_by_pattern(df, cut, others, column)
    passes = [_match_by_gram(df, part, column) for part in _parts(cut)]
    if others:
        passes.append(_match_listed(df, others, column))
    return reduce(DataFrame.unionByName, passes)


def with_terms(df: DataFrame, terms: Sequence[str], text: "str | Column", into: str = "search_terms") -> DataFrame:
    """J5 with the matching terms of a row as one array, for short lists: for joins that come before the explode."""
    column = F.col(text) if isinstance(text, str) else text
    listed = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    # The numbers of the terms found, as text: generated code without an array. Being exploded, the one value stays where it is;
    # a plain column would be made once more for the filter, with a lower-cased text for every term.
    found = F.explode_outer(F.array(F.concat_ws(",", *_hits(terms, lambda i, t: F.lit(str(i))))))
    hit = df.withColumn("_low", F.lower(column)).withColumn("_found", found).drop("_low").where("_found <> ''")
    return hit.withColumn(into, F.transform(F.split("_found", ","), lambda i: F.get(listed, i.try_cast("int")))).drop("_found")


def _hits(terms: Sequence[str], value) -> list[Column]:
    """For every term ``value`` if the text holds it, else null."""
    return [F.when(F.contains(F.col("_low"), F.lower(F.lit(t))), value(i, t)) for i, t in enumerate(terms)]


def _tests(terms: Sequence[str]) -> list[Column]:
    """Arrays of the terms found and nulls; short ones, so that the generated code of none grows too long to be compiled."""
    tests = _hits(terms, lambda i, t: F.lit(t))
    return [F.array(*tests[at : at + TOGETHER]) for at in range(0, len(tests), TOGETHER)]


def _exploded(low: DataFrame, arrays: Sequence[Column]) -> DataFrame:
    if len(arrays) == 1:
        exploded = low.withColumn("search_term", F.explode_outer(arrays[0]))
    else:
        parts = low.withColumns({f"_part{k}": part for k, part in enumerate(arrays)})
        exploded = parts.withColumn("search_term", F.explode_outer(F.concat(*[f"_part{k}" for k in range(len(arrays))]))).select(*low.columns, "search_term")
    # The outer form keeps Spark from deriving a filter on the array, which would make the array a second time.
    return exploded.where(F.col("search_term").isNotNull()).drop("_low")


def _match_inline(df: DataFrame, terms: Sequence[str], text: Column) -> DataFrame:
    return _exploded(df.withColumn("_low", F.lower(text)), _tests(terms) or [F.array().cast("array<string>")])


def _pattern(needles: Sequence[str]) -> str:
    """A pattern that at every place of a text holds the longest needle which begins there, and consumes nothing."""
    tree: dict = {}
    for needle in needles:
        at = tree
        for char in needle:
            at = at.setdefault(char, {})
        at[""] = {}

    def branch(node: dict) -> str:
        ways = [f"\\x{{{ord(char):x}}}{branch(below)}" for char, below in sorted(node.items()) if char]
        if len(ways) == 1 and "" not in node:
            return ways[0]
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}" if ways else ""

    return f"(?=({branch(tree)}))"


def _replaced(found: Column, by: dict[str, list[str]]) -> Column:
    """The array with every key of ``by`` replaced by its list."""
    if not by:
        return found
    lists = F.create_map(*[F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x) for pair in by.items() for x in pair])
    return F.flatten(F.transform(found, lambda needle: F.coalesce(F.try_element_at(lists, needle), F.array(needle))))


def _match_by_pattern(df: DataFrame, terms: Sequence[str], others: Sequence[str], text: Column) -> DataFrame:
    spelled: dict[str, list[str]] = {}
    for term in terms:
        spelled.setdefault(term.lower(), []).append(term)
    # Where a needle stands, so do the needles that it begins with.
    begins = {n: [n[:k] for k in range(GRAM, len(n)) if n[:k] in spelled] for n in spelled}
    found = F.array_distinct(F.regexp_extract_all(F.col("_low"), F.lit(_pattern(list(spelled))), F.lit(1))) if spelled else None
    arrays = _tests(others) if len(others) <= len(spelled) + INLINE_TERMS else [_listed(others)]
    if spelled:
        nested = {n: [n, *shorter] for n, shorter in begins.items() if shorter}
        found = F.array_distinct(_replaced(found, nested)) if nested else found
        arrays.append(_replaced(found, {n: t for n, t in spelled.items() if t != [n]}))
    return _exploded(df.withColumn("_low", F.lower(text)), [F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


def _listed(terms: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("_low"), F.lower(t)))


def _match_listed(df: DataFrame, terms: Sequence[str], text: Column) -> DataFrame:
    return df.withColumn("_low", F.lower(text)).withColumn("search_term", F.explode(_listed(terms))).drop("_low")


def _parts(terms: Sequence[str]) -> list[list[str]]:
    parts, size = [[]], 0
    for term in terms:
        if parts[-1] and size + len(term) > PASS_CHARS:
            parts.append([])
            size = 0
        parts[-1].append(term)
        size += len(term)
    return parts


def _anchors(terms: Sequence[str]) -> list[tuple[str, str, str]]:
    """(anchor piece, lower-cased term, term): the piece of each term that fewest terms share."""
    pieces = {t: [t.lower()[i : i + GRAM] for i in range(len(t.lower()) - GRAM + 1)] for t in terms}
    shared = Counter(p for t in pieces for p in set(pieces[t]))
    return [(min(pieces[t], key=lambda p: (shared[p], p)), t.lower(), t) for t in terms]


def _match_by_gram(df: DataFrame, terms: Sequence[str], text: Column) -> DataFrame:
    # The table of terms is bounded by PASS_CHARS. Every term hangs on exactly one piece and pieces are
    # distinct within a text, so no pair comes out twice.
    anchors = small_table(df.sparkSession, _anchors(terms), "_gram string, _needle string, search_term string")
    chars = F.split(F.col("_low"), "")
    grams = F.transform(
        F.col("_chars"),
        lambda c, i: F.concat(c, F.get(F.col("_chars"), i + 1), F.get(F.col("_chars"), i + 2)),
    )
    # The pieces are made in a step of their own: from there on, exploding, looking up and checking run as one
    # generated loop that copies no text until a term is found. The outer form keeps Spark from deriving a filter
    # on the array, which would make the pieces a second time; empty texts fall out in the join.
    return (
        df.withColumn("_low", F.lower(text))
        .withColumn("_chars", chars)
        .withColumn("_grams", F.array_distinct(grams))
        .withColumn("_gram", F.explode_outer("_grams"))
        .drop("_chars", "_grams")
        .join(F.broadcast(anchors), "_gram")
        .where(F.contains(F.col("_low"), F.col("_needle")))
        .drop("_low", "_gram", "_needle")
    )


def search_top(
    df: DataFrame,
    terms: Sequence[str],
    text: "str | Column",
    order: Sequence[Column],
    k: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` hits of every term (J5 then W2, rank W1)."""
    return top_k_per_group(match_terms(df, terms, text), ["search_term"], order, k, rank)
