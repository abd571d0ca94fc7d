"""Toxicity by a weighted finite-state grammar over clauses.

Words become tags: insult, threat, target, negation, report, quote or other. Five transducers read a clause's tags one after
the other: negation turns what it governs into something weaker, reported speech marks what others said, a threat counts when
a target follows or stands before it, a target makes an insult heavier, and insults in a row count more than alone. A clause
scores the sum of its matched insults and threats, each by its word's weight and its arcs' factors; words outside such a match
score nothing. A text is judged by its heaviest clause, by its clauses' sum, and by how many clauses match.

A short list of insults and threats is given. More are learned: words and word beginnings that stand in toxic labelled texts
and hardly in others. Then a logistic curve from the three figures to the label is fitted on labelled texts that the words
were not learned from. Both use at most FIT_ROWS labelled texts, those with the smallest hashes, all of them in the training
part; texts that are equal but for case and white space count once. Labels are joined by id; label, language, source and id are no inputs.

Null text counts as empty and scores what no match scores. Labels that are null, or whose id is in no document, teach nothing;
an id labelled twice counts as toxic if one label says so. Without labels of both kinds the given words are all, with a fixed
curve. Rows that repeat are scored each. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, saved
from .transducers import ANY, Arc, Composed, Transducer

#: Bound of the labelled texts that are learned from, and of the learned words.
FIT_ROWS, LEARNED = 40_000, 5_000
#: Lengths of word beginnings that may be learned, and how many toxic texts a learned word needs.
BEGINNINGS, LEAST_TEXTS = (4, 5, 6, 7), 5
#: Share of toxic texts among those that hold a learned word.
PURITY = 0.9
THRESHOLD = 0.7
PARTS, HELD = 3, 1
#: Clause figures to score where nothing could be fitted: intercept, heaviest, sum, matches.
GIVEN_CURVE = (-3.0, 3.0, 0.5, 0.5)
FLUSH = 300_000

INSULTS = dict.fromkeys("idiot idiots moron morons stupid loser losers scum trash garbage worthless pathetic disgusting clown vermin".split(), 1.0)
THREATS = dict.fromkeys("kill hurt destroy beat shoot stab strangle burn crush".split(), 1.0)
TARGETS = frozenset("you your yourself they them he she his her him these those people du dich dir ihr euch sie vous tu te toi ils elles tú ti usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nicht kein keine nie pas jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says called claimed wrote quoted reported alleged accused sagte schrieb nannte dit écrit dijo llamó escribió".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»„]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_QUOTES = frozenset("\"“”«»„")


def grammar() -> Composed:
    """negation, reported speech, threat, target and repetition, composed."""
    stay = {ANY: Arc(0)}
    # A negation governs the next three words.
    weaker = {"insult": Arc(0, "insult", 0.3), "threat": Arc(0, "other")}
    negation = Transducer(
        {
            0: {"negation": Arc(1), ANY: Arc(0)},
            1: {**weaker, "negation": Arc(1), ANY: Arc(2)},
            2: {**weaker, "negation": Arc(1), ANY: Arc(3)},
            3: {**weaker, "negation": Arc(1), ANY: Arc(0)},
        }
    )
    # After a word of saying, or within quotes, what follows in the clause is reported.
    reported = Transducer(
        {
            0: {"report": Arc(1), "quote": Arc(2), ANY: Arc(0)},
            1: {"insult": Arc(1, "insult", 0.5), "threat": Arc(1, "threat", 0.3), ANY: Arc(1)},
            2: {"quote": Arc(0), "insult": Arc(2, "insult", 0.6), "threat": Arc(2, "threat", 0.4), ANY: Arc(2)},
        }
    )
    # A threat needs a target: one that stood before it in the clause, else the next one gives it its weight.
    threat = Transducer(
        {
            0: {"target": Arc(1), "threat": Arc(2, "other"), ANY: Arc(0)},
            1: {"threat": Arc(1, "threat", 1.5), ANY: Arc(1)},
            2: {"target": Arc(1, "threatened", 1.5), ANY: Arc(2)},
        }
    )
    target = Transducer(
        {
            0: {"target": Arc(1), "threatened": Arc(1), ANY: Arc(0)},
            1: {"insult": Arc(1, "insult", 1.5), ANY: Arc(1)},
        }
    )
    repeated = Transducer({0: {"insult": Arc(1), **stay}, 1: {"insult": Arc(1, "insult", 1.2), ANY: Arc(1)}})
    return Composed((negation, reported, threat, target, repeated))


@dataclass
class Lexicon:
    """Weights of insulting words and of word beginnings."""

    words: dict[str, float]
    beginnings: dict[str, float]

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if not found and self.beginnings:
            found = max((self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) > n), default=0.0)
        return found


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.grammar = lexicon, grammar()

    def tag(self, word: str) -> tuple[str, float]:
        if weight := self.lexicon.insult(word):
            return "insult", weight
        if word in THREATS:
            return "threat", THREATS[word]
        for name, group in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("quote", _QUOTES)):
            if word in group:
                return name, 0.0
        return "other", 0.0

    def clause(self, words: list[str]) -> float:
        tags = [self.tag(w) for w in words]
        threats = max((w for t, w in tags if t == "threat"), default=0.0)
        total = 0.0
        for (_, weight), (written, factor) in zip(tags, self.grammar.run(t for t, _ in tags), strict=True):
            if written == "insult" or written == "threat":
                total += weight * factor
            elif written == "threatened":  # the target that completes a threat carries the threat's weight
                total += threats * factor
        return total

    def figures(self, text: str) -> tuple[float, float, float]:
        """The heaviest clause, the sum of all, and the number that match, the last two flattened."""
        low = text.lower()
        insult = self.lexicon.insult
        marked = {w for w in set(_WORD.findall(low)) if w in THREATS or insult(w)}
        if not marked:
            return 0.0, 0.0, 0.0
        scores = []
        for part in _CLAUSE.split(low):
            words = _WORD.findall(part)
            if not marked.isdisjoint(words) and (score := self.clause(words)):
                scores.append(score)
        return max(scores, default=0.0), math.log1p(sum(scores)), math.log1p(len(scores))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id = F.col(id_col).cast("bigint")
    return docs.select(doc_id.alias("doc_id"), (crc_rest(F.col(id_col), PARTS) == HELD).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def labelled_sample(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """text, label, fit: at most ``fit_rows`` labelled training texts; ``fit`` are those that the curve is fitted on."""
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(crc_rest(F.col("doc_id"), PARTS) != HELD).groupBy("doc_id").agg(F.max("label").alias("label"))
    # A bounded number of ids, so that they can be brought to the texts.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = rows.filter(~F.col("held_out")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    words = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    apart = found.withColumn("whole", F.sha2(words.cast("binary"), 256))
    return saved(apart.dropDuplicates(["whole", "label"]).select("text", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("fit")), "toxicity-sample")


def learned_words(sample: DataFrame) -> Lexicon:
    """The given insults, and words and beginnings found in toxic texts; at most LEARNED rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(terms, pa.string()), *(pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0))]
            for c in counts.values():
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = {w for w in _WORD.findall(text.lower()) if w[0] not in _QUOTES and len(w) <= 32}
                terms = words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n}
                counts[int(label > 0)].update(terms)
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield out()
        yield out()

    counted = sample.filter("NOT fit").select("text", "label").mapInArrow(run, "term string, toxic bigint, clean bigint")
    summed = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = summed.filter((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))))
    words, beginnings = dict(INSULTS), {}
    for row in best.orderBy(F.desc("toxic"), "term").limit(LEARNED).collect():
        # Surer and more frequent words weigh more, up to the weight of a given one.
        weight = row["toxic"] / (row["toxic"] + 20 * row["clean"] + 3)
        if row["term"].endswith("*"):
            beginnings[row["term"][:-1]] = weight
        else:
            words[row["term"]] = max(words.get(row["term"], 0.0), weight)
    return Lexicon(words, beginnings)


def fitted_curve(sample: DataFrame, scorer_of) -> tuple[float, ...]:
    """Intercept and weights of the three figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of()
        for batch in batches:
            rows = [list(scorer.figures(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label")], ["figures", "label"])

    rows = sample.filter("fit").select("text", F.least("label", F.lit(1)).cast("double").alias("label")).mapInArrow(run, "figures array<double>, label double")
    rows = saved(rows.select(array_to_vector("figures").alias("features"), "label"), "toxicity-figures")
    if rows.select("label").distinct().count() < 2:
        return GIVEN_CURVE
    # More matches never make a text less toxic.
    model = LogisticRegression(
        regParam=0.001, maxIter=50, lowerBoundsOnCoefficients=_matrix(0.0), upperBoundsOnCoefficients=_matrix(50.0)
    ).fit(rows)
    return (float(model.intercept), *map(float, model.coefficients))


def _matrix(value: float):
    from pyspark.ml.linalg import Matrices

    return Matrices.dense(1, 3, [value] * 3)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = _columns(docs, id_col, text_col)
    lexicon, curve = _learned(rows, labels, id_col, label_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, curve))
    return rows.mapInArrow(_scoring(shared, threshold), "doc_id bigint, held_out boolean, score double, predicted int")


def _learned(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> tuple[Lexicon, tuple[float, ...]]:
    sample = labelled_sample(rows, labels, id_col, label_col, fit_rows)
    lexicon = learned_words(sample)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    return lexicon, fitted_curve(sample, lambda: Scorer(shared.value))


def _probability(curve: tuple[float, ...], figures: tuple[float, ...]) -> float:
    z = curve[0] + float(np.dot(curve[1:], figures))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _scoring(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, curve = shared.value
        scorer = Scorer(lexicon)
        for batch in batches:
            scores = [_probability(curve, scorer.figures(t)) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return run


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """The rows that are not judged toxic, with all their columns, without a shuffle."""
    lexicon, curve = _learned(_columns(docs, id_col, text_col), labels, id_col, label_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, curve))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, curve = shared.value
        scorer = Scorer(lexicon)
        for batch in batches:
            keep = [_probability(curve, scorer.figures(t or "")) < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
