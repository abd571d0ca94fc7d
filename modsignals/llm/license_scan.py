"""Licence scan by ordered signature rules.

A text that holds none of the gate's keywords is done after one look. Of the others, each rule runs only if its own keywords
are in the text; it gives intervals of words. An interval that lies within another one is suppressed; of equal ones the rule
with priority stays. The base phrases are places of their own, reported always.

Null text counts as empty: no words, no labels, score 0. Places that overlap are all counted. Rows that repeat are scanned
each for itself. Other columns are never read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let
from .license_rules import BASE, rules

#: What is between words, in lower-cased text and in text as it came.
_BETWEEN_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Texts that any rule can match hold one of these.
GATE = rf"(?i)licen|cc0|spdx|gpl|rights{_GAP}reserved|proprietary|public{_GAP}domain|cc{_GAP}by|creative(?:{_GAP})?commons|permission|redistribut|without{_GAP}restriction|neither{_GAP}the{_GAP}name|advertising|source{_GAP}code{_GAP}form|commercial|bsd|warranty|no{_GAP}attribution"

#: The cheap half of the gate: one of these is in every such text.
GATE_WORDS = (
    "licen", "cc0", "spdx", "gpl", "reserved", "proprietary", "public", "cc", "creative", "permission", "redistribut", "restriction", "neither",
    "advertising", "source", "commercial", "bsd", "attribution", "warranty",
)

_OPEN, _CLOSE = "\x01", "\x02"  # never part of normalised text


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), _BETWEEN_LOWER, " "))


def gate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in GATE_WORDS)) & F.regexp_like(text, F.lit(GATE))


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    same = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + j) == p for j, p in enumerate(parts)))
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), lambda i: F.coalesce(same(i), F.lit(False)))


def _rule_table() -> Column:
    """All rules as one constant."""
    fields = ("rank", "label", "first", "second", "pattern", "weight")
    rows = [dict(zip(fields, (*rule[:4], rf"(?<![^ ])(?:{rule[4]})(?![^ ])", rule[5]), strict=True)) for rule in rules()]
    shape = "array<struct<rank: int, label: string, first: string, second: string, pattern: string, weight: double>>"
    return F.from_json(F.lit(json.dumps(rows)), shape)


def _intervals(norm: Column, rule: Column) -> Column:
    """The words that one rule covers, by marking its matches and finding the marked words again."""
    marked = F.split(F.regexp_replace(norm, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}")), " ")

    def found(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        starts = F.filter(places, lambda i: F.startswith(F.get(words, i), F.lit(_OPEN)))
        ends = F.filter(places, lambda i: F.endswith(F.get(words, i), F.lit(_CLOSE)))
        return F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(
                s.alias("start"), (-e).alias("minus_end"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight")
            ),
        )

    return let(marked, found)


def detections(norm: Column) -> Column:
    """array<struct<start, minus_end, rank, label, weight>>: what the rules find, contained intervals suppressed."""
    able = F.filter(_rule_table(), lambda r: F.contains(norm, r["first"]) & F.contains(norm, r["second"]))
    sure = F.filter(able, lambda r: F.regexp_like(norm, r["pattern"]))
    # By start, then the longest, then priority: what ends no later than an interval before it lies within that one.
    ordered = F.sort_array(F.flatten(F.transform(sure, lambda r: _intervals(norm, r))))
    return let(
        ordered,
        lambda all_: F.aggregate(
            all_,
            F.struct(F.lit(-1).alias("end"), F.slice(all_, 1, 0).alias("kept")),
            lambda acc, d: F.when(
                -d["minus_end"] > acc["end"], F.struct((-d["minus_end"]).alias("end"), F.concat(acc["kept"], F.array(d)).alias("kept"))
            ).otherwise(acc),
            lambda acc: acc["kept"],
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (array of start and label), found (array of detections)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gated = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"),
        F.when(gate(text), normalised(text)).alias("norm"),
    )

    def places(words: Column, phrase: str, label: str) -> Column:
        return F.transform(_phrase_starts(words, phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    def base(words: Column) -> Column:
        return F.flatten(F.array(*(places(words, phrase, label) for phrase, label in BASE)))

    return gated.select(
        "doc_id",
        "n_words",
        F.when(F.col("norm").isNotNull(), let(F.split("norm", " "), base)).alias("base"),
        F.when(F.col("norm").isNotNull(), let(F.col("norm"), detections)).alias("found"),
    )


def _joined(labels: Column) -> Column:
    return F.coalesce(F.array_join(F.sort_array(F.array_distinct(labels)), ","), F.lit(""))


def licence_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scan as one row of figures and labels per document."""
    base = F.transform("base", lambda b: b["label"])
    found = F.transform("found", lambda d: d["label"])
    best = F.array_max(F.transform("found", lambda d: d["weight"]))
    return scan(docs, id_col, text_col).select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).cast("long").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, found)).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
