"""Term search and top-k against brute force."""

import random

import frames
import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as tuned
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modsignals.operators import terms as terms_module
from modsignals.operators.terms import match_terms, search_top
from modsignals.operators.topk import first_per_key, last_per_key, top_k_per_group

QUICK = tuned(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def brute_force(texts, terms):
    return sorted((i, t) for i, x in enumerate(texts) if x is not None for t in terms if t.lower() in x.lower())


def matched(spark, texts, terms, inline):
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, x string")
    return sorted(tuple(r) for r in match_terms(df, terms, "x", inline).select("i", "search_term").collect())


TEXTS = ["Free spam, FREE token", "nothing here", "", None, "ends with the", "the", "déjà VU spam", "aaaaaa", "日本語のスパム", "x\ny the z"]
TERMS = ["spam", "free", "the", "e", "déjà vu", "aaa", "aa", "日本語", "スパム", "y the", "absent", "Token", "spam"]


@pytest.fixture(params=["pattern", "pieces"])
def long_list(request, monkeypatch):
    """Lists beyond the inline limit, searched by a pattern or by pieces."""
    if request.param == "pieces":
        monkeypatch.setattr(terms_module, "PATTERN_CHARS", -1)


def test_long_lists_equal_brute_force(spark, long_list):
    assert matched(spark, TEXTS, TERMS, 0) == brute_force(TEXTS, TERMS)
    # Terms that begin with one another, of other cases, repeated, with characters that patterns treat apart and beyond 16 bits.
    terms = ["spa", "spam", "spam,", "SPAM", "free t", "free", "free", "the", "the z", "aaaa", "aaa", "(x)", "a.b", "[a]+", "\\d{2}", "😀😀😀", "ABC"]
    texts = [*TEXTS, "axb a.b (x", "(X) [a]+ \\d{2}", "12", "a😀😀😀b", "😀😀", "spa", "abcabc spaspam,", "fre the\nz"]
    assert matched(spark, texts, terms, 0) == brute_force(texts, terms)
    assert matched(spark, [None, ""], terms, 0) == []


def test_a_long_list_with_only_short_or_odd_terms(spark, long_list):
    assert matched(spark, TEXTS, ["e", "", "İx", "a"], 0) == brute_force(TEXTS, ["e", "", "İx", "a"])


@pytest.mark.parametrize("inline", [100, 0])
def test_both_ways_of_searching_equal_brute_force(spark, inline):
    assert matched(spark, TEXTS, TERMS, inline) == brute_force(TEXTS, TERMS)


@pytest.mark.parametrize("inline", [100, 0])
def test_only_short_terms_and_no_terms(spark, inline):
    assert matched(spark, TEXTS, ["e", "a"], inline) == brute_force(TEXTS, ["e", "a"])
    assert matched(spark, TEXTS, [], inline) == []


@QUICK
@given(
    st.lists(st.one_of(st.none(), st.text("abAB é\n", max_size=12)), min_size=1, max_size=8),
    st.lists(st.text("abAB é\n", min_size=1, max_size=5), min_size=1, max_size=8),
)
def test_search_property(spark, texts, terms):
    wanted = brute_force(texts, terms)
    assert matched(spark, texts, terms, 100) == wanted
    assert matched(spark, texts, terms, 0) == wanted


def test_a_very_long_list_is_searched_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(terms_module, "PATTERN_CHARS", -1)
    monkeypatch.setattr(terms_module, "PASS_CHARS", 10)
    assert matched(spark, TEXTS, TERMS, 0) == brute_force(TEXTS, TERMS)


def test_search_top_ranks_from_one(spark):
    df = spark.createDataFrame([(i, "spam" if i % 2 else "scam spam") for i in range(50)], "i bigint, x string")
    rows = search_top(df.repartition(7), ["spam", "scam", "none"], "x", [F.asc("i")], 4, rank="rank")
    assert sorted(frames.tuples(rows, "search_term", "rank", "i")) == sorted(
        [("spam", n + 1, n) for n in range(4)] + [("scam", n + 1, 2 * n) for n in range(4)]
    )


@pytest.mark.parametrize("spread", [1, 3, 16])
def test_top_k_of_hot_and_small_groups(spark, spread):
    random.seed(spread)
    rows = [("hot" if random.random() < 0.4 else f"g{random.randrange(30)}", random.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v bigint, i bigint").repartition(9)
    got = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("i")], 5, rank="r", spread=spread).collect()
    wanted = set()
    for group in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))[:5]
        wanted |= {(*r, place) for place, r in enumerate(ordered, 1)}
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_one_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(frames.tuples(first_per_key(df, ["k"], ["n"]))) == [("a", 1, None), ("b", 1, "z")]
    assert sorted(frames.tuples(last_per_key(df, ["k"], ["n"]))) == [("a", 2, "x"), ("b", 1, "z")]
