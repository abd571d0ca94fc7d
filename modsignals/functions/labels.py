"""Moderation-label columns: P2, P3, P9, P15, P17, A11, A12."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import UNKNOWN
from ..schemas import LABEL, LABELS, RAW_LABELS


def _tagged(raw: Column, kind: str) -> Column:
    present = F.coalesce(raw, F.array().cast(RAW_LABELS))
    return F.transform(
        present,
        lambda x: F.struct(
            F.lit(kind).alias("type"),
            F.coalesce(x["val"], F.lit(UNKNOWN)).alias("value"),
            F.coalesce(x["cts"], F.lit(UNKNOWN)).alias("created"),
        ),
    )


def extract_labels(post_labels: Column, embed_labels: Column) -> Column:
    """Labels of the post, then those of its embed. A null list counts as empty (T15) and a
    null value or time as ``unknown`` (T5)."""
    return F.concat(_tagged(post_labels, "post"), _tagged(embed_labels, "embed"))


def has_labels(post_labels: Column, embed_labels: Column) -> Column:
    """P9 from the raw lists, so that queries which only need the flag never build the label array."""
    return F.coalesce(F.size(post_labels) > 0, F.lit(False)) | F.coalesce(
        F.size(embed_labels) > 0, F.lit(False)
    )


def _parsed_label(text: Column) -> Column:
    """A value that is there but null is ``unknown`` (T5); one that is absent stays null."""
    label = F.from_json(text, LABEL)
    there = F.array_contains(F.json_object_keys(text), "value")
    return label.withField("value", F.when(there, F.coalesce(label["value"], F.lit(UNKNOWN))))


def parse_labels(json_text: Column) -> Column:
    """Label JSON to an array. Null, ``[]`` and malformed text give an empty array.

    Elements are parsed one by one, so one stray non-object does not lose its neighbours.
    """
    elements = F.from_json(json_text, "array<string>")
    objects = F.filter(elements, lambda e: F.json_object_keys(e).isNotNull())
    parsed = F.transform(objects, _parsed_label)
    return F.coalesce(parsed, F.array().cast(LABELS))


def is_bad_label_json(json_text: Column) -> Column:
    """Text that is present but is no JSON at all."""
    return F.coalesce((F.trim(json_text) != "") & F.try_parse_json(json_text).isNull(), F.lit(False))


def labels_to_json(labels: Column) -> Column:
    """P15. Null fields keep their key."""
    return F.to_json(labels, {"ignoreNullFields": "false"})


def label_values(labels: Column) -> Column:
    return F.transform(labels, lambda x: F.coalesce(x["value"], F.lit(UNKNOWN)))


def joined_label_values(labels: Column) -> Column:
    """P17."""
    return F.array_join(label_values(labels), ", ")


def distinct_label_count(labels: Column) -> Column:
    """Number of different label values in one array."""
    return F.size(F.array_distinct(label_values(labels))).cast("bigint")
