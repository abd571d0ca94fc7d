"""Personal data by boosting over candidate spans.

Generators of high recall propose spans, which may overlap: addresses, dotted numbers, digit chains, numbers with a plus,
grouped ids and long mixed tokens. A span of one of the four base kinds that passes its kind's check is always reported.
Boosted trees, which see format and context but not those checks, score every candidate; per kind, a threshold is calibrated
on candidates kept out of the fit so that what lies above it is right as often as asked. Candidates above it that touch no
base span are reported as well.

The trees learn from the candidates themselves: a span is taken as right if it passes its kind's check, or, for tokens, has a
known form. They are fitted on at most SAMPLE_ROWS candidates, those with the smallest hashes.

Null text counts as empty. Rows that repeat are each scanned. Without candidates, or if all of them are alike, nothing is
fitted and only base spans are reported. Positions are code points, ends exclusive. Other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved

#: The base kinds in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "token")

#: Bound of the fitting sample, its seed, and the precision that the thresholds are calibrated to.
SAMPLE_ROWS, SEED, PRECISION = 20_000, 17, 0.95

# Quantifiers are possessive where nothing could be given back, and a run is entered at its first character only, so that a
# long run is read once. The matches are those of the plain patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GROUPED = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
#: Every number of a base kind lies within a run of these characters, seven at least.
NUMERIC_RUN = r"(?<![+0-9\x20().-])[+0-9\x20().-]{7,}+"
TOKEN = r"(?<![A-Za-z0-9/+_=-])[A-Za-z0-9/+_=-]{14,}+"
#: Tokens of these forms are keys or passwords.
KNOWN_TOKEN = r"^AKIA[0-9A-Z]{16}$|^(?i:password|passwd|pwd|secret|token|api_?key)=|^gh[pousr]_[A-Za-z0-9]{30,}|^[0-9a-f]{32,}$"
CUES = r"(?i)(?:phone|tel|call|fax|mobile|card|visa|pay|account|e-?mail|contact|ip|host|server|password|passwd|secret|token|key|ssn|id)[^A-Za-z0-9]*$"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost matches that don't overlap."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    empty = F.array().cast("array<struct<start: int, end: int, hit: string>>")

    def step(x, acc, i):
        start = acc["at"] + F.char_length(F.get(x["gaps"], i))
        end = start + F.char_length(F.get(x["hits"], i))
        found = F.struct(start.alias("start"), end.alias("end"), F.get(x["hits"], i).alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def walk(x):
        return F.aggregate(
            F.sequence(F.lit(0), F.size(x["hits"]) - 1),
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, i: step(x, acc, i),
            lambda acc: acc["out"],
        )

    return let(both, lambda x: F.when(F.size(x["hits"]) > 0, walk(x)).otherwise(empty))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' weighted sum is a multiple of ten: every second one from the right doubled, nines cast out."""

    def value(i):
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The check of a kind; for the kinds that are not base ones, whether the form is a known one."""
    if kind == "ip":
        return F.regexp_like(hit, F.lit(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(hit)).between(9, 15)
    if kind == "token":
        return F.regexp_like(hit, F.lit(KNOWN_TOKEN))
    return F.lit(True)


def _of_kind(kind: str, found: Column, offset=None) -> Column:
    at = F.lit(0) if offset is None else offset
    return F.transform(
        found,
        lambda s: F.struct(
            (s["start"] + at).alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (s["end"] + at).alias("end"),
            s["hit"].alias("hit"),
            passes(kind, s["hit"]).alias("right"),
        ),
    )


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, hit, right>>: what all generators propose, overlaps included."""
    empty = F.array().cast("array<struct<start: int, kind: int, end: int, hit: string, right: boolean>>")

    def in_run(run):
        parts = (("ip", IP), ("card", CARD), ("phone", PHONE), ("id", GROUPED))
        return F.concat(*(_of_kind(kind, spans(run["hit"], pattern), run["start"]) for kind, pattern in parts))

    runs = F.filter(spans(text, NUMERIC_RUN), lambda r: F.char_length(_digits(r["hit"])) >= 4)
    mixed = F.filter(spans(text, TOKEN), lambda t: F.regexp_like(t["hit"], F.lit("[0-9]")) & F.regexp_like(t["hit"], F.lit("[A-Za-z]")))
    emails = F.when(F.contains(text, F.lit("@")), _of_kind("email", spans(text, EMAIL))).otherwise(empty)
    numbers = F.when(
        F.regexp_like(text, F.lit("[0-9]")), F.concat(F.flatten(F.transform(runs, in_run)), _of_kind("token", mixed))
    ).otherwise(empty)
    return F.concat(emails, numbers)


def features(text: Column, c: Column) -> Column:
    """What the trees see of a candidate: its format and what stands beside it."""
    hit, n = c["hit"], F.char_length(c["hit"]).cast("double")
    share = lambda chars: F.char_length(F.regexp_replace(c["hit"], f"[^{chars}]", "")) / n
    before = F.substring(text, F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24)))
    beside = lambda s: F.when(s == "", 0).when(F.regexp_like(s, F.lit(r"\s")), 1).when(F.regexp_like(s, F.lit("[\"'(<:=]")), 2).otherwise(3)
    values = (
        c["kind"],
        n,
        share("0-9"),
        share("A-Z"),
        share("a-z"),
        share("a-f0-9"),
        F.size(F.array_distinct(F.split(hit, ""))) / n,
        F.size(F.split(hit, r"[^0-9A-Za-z]+")),
        F.startswith(hit, F.lit("+")).cast("int"),
        F.contains(hit, F.lit("=")).cast("int"),
        F.regexp_like(before, F.lit(CUES)).cast("int"),
        beside(F.substring(text, c["start"], F.when(c["start"] > 0, 1).otherwise(0))),
        beside(F.substring(text, c["end"] + 1, F.lit(1))),
    )
    return F.array(*(v.cast("double") for v in values))


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, doc_id, found: one row per document, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), candidates(text).alias("spans"))
    described = F.transform(
        "spans",
        lambda c: F.struct(*(c[n].alias(n) for n in ("start", "kind", "end", "right")), features(F.col("text"), c).alias("features")),
    )
    return saved(found.select("doc_id", described.alias("found")).withColumn("row_key", F.monotonically_increasing_id()), "pii-candidates")


def scored(each: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """``each`` (row_key, start, kind, end, right, features) with probability and fold; None if there is nothing to learn."""
    rows = each.withColumn("at", F.abs(F.xxhash64(F.lit(SEED), "row_key", "start", "kind", "end"))).withColumn("held", F.col("at") % 5 == 0)
    sample = saved(
        rows.filter(~F.col("held")).orderBy("at").limit(sample_rows).select(array_to_vector("features").alias("features"), F.col("right").cast("double").alias("label")),
        "pii-sample",
    )
    if sample.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.4, seed=SEED).fit(sample)
    judged = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return judged.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def thresholds(judged: DataFrame, precision: float = PRECISION, bins: int = 50) -> DataFrame:
    """kind, least: the lowest score at and above which held-out candidates of a kind are right often enough."""
    down = Window.partitionBy("kind").orderBy(F.col("bin").desc())
    counts = (
        judged.filter("held")
        .groupBy("kind", F.floor(F.col("p") * bins).alias("bin"))
        .agg(F.sum(F.col("right").cast("long")).alias("good"), F.count(F.lit(1)).alias("n"))
    )
    above = counts.select("kind", "bin", (F.sum("good").over(down) / (F.sum("n").over(down) + 1)).alias("precision"))
    return above.filter(F.col("precision") >= precision).groupBy("kind").agg((F.min("bin") / bins).alias("least"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> DataFrame:
    """doc_id, base and spans (arrays of struct<start, kind, end>) for every document, in order."""
    found = find_candidates(docs, id_col, text_col)
    each = found.select("row_key", F.explode("found").alias("c")).select("row_key", "c.*")
    plain = lambda xs: F.transform(xs, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    base = F.sort_array(plain(F.filter("found", lambda c: c["right"] & (c["kind"] < len(BASE_KINDS)))))
    rows = found.select("row_key", "doc_id", base.alias("base"))
    judged = scored(each, sample_rows)
    if judged is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    judged = saved(judged, "pii-judged")
    # One threshold per kind: a table of six rows at most.
    chosen = judged.join(F.broadcast(thresholds(judged, precision)), "kind").filter(
        (F.col("p") >= F.col("least")) & ~(F.col("right") & (F.col("kind") < len(BASE_KINDS)))
    )
    more = chosen.groupBy("row_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return rows.join(more, "row_key", "left").select(
        "doc_id", "base", F.sort_array(F.concat("base", F.coalesce(free, F.slice("base", 1, 0)))).alias("spans")
    )


def _written(spans_: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_counts(docs: DataFrame, **settings) -> DataFrame:
    """The base spans counted by kind and hashed, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return find_pii(docs, **settings).select(
        "doc_id", *(count(kind) for kind in BASE_KINDS), F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )
