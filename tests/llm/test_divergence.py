"""The source divergence audit against a plain version that goes through every term for every pair."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from modsignals.llm import divergence

SHAPE = "doc_id bigint, text string, lang string, source string, no int, p bigint, term string"


def plain(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        words = [brute.lowered(w) for w in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text or "")]
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def chances(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: chances(counts[lang, s]) for s in sources}, chances(whole)
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def held(spark, rows, shape=SHAPE, **options):
    found = [tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, shape), **options).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)
    return found


def test_against_every_term_of_every_pair(spark):
    random.seed(6)
    words = [f"{a}{b}" for a in ("ab", "Cd", "é", "日", "zz") for b in ("x", "Y", "ß", "ÀÉ", "k")]
    rows = []
    for k in range(300):
        lang, source = random.choice([("en", "s1"), ("en", "s1"), ("en", "s2"), ("en", "é"), ("de", "s1"), ("de", None), (None, "s9"), (None, None)])
        text = "3,".join(random.choices(words, [1 / (1 + i) ** 2 for i in range(len(words))], k=random.randrange(40)))
        rows.append((k, text, lang, source, 1, 2, "t"))
    assert any(r[2] == "pair" and r[4] > 0 for r in held(spark, rows))


def test_odd_rows(spark):
    rows = [(*row, None, None, "d", 3, 4, 5, 6, 7, 8, "b", 9) for row in brute.ODD]
    assert held(spark, rows, brute.SHAPE)
    # No kept term in one language, no text in the other, one source alone in the third.
    rows = [(1, "one", "a", "x"), (2, "two", "a", "y"), (3, None, "b", "x"), (4, "", "b", "y"), (5, "w W w", "c", "x"), (5, "w W w", "c", "x"), (5, "w", "c", "x")]
    found = held(spark, rows, "doc_id bigint, text string, lang string, source string")
    assert {r[4] for r in found if r[0] in "ab"} == {0} and not [r for r in found if r[0] == "c"]


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SHAPE)).collect() == []


def test_more_terms_than_ranks_and_counts_sent_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = [(k, " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(k % 7, 300)), "en", f"s{k % 2}", 1, 2, "t") for k in range(12)]
    rows += [(99, "only in one " * 50, "en", "s0", 1, 2, "t")] * 3
    held(spark, rows)


@pytest.mark.parametrize("total", [10**12, 9 * 10**17])
def test_counts_beyond_64_bits_when_scaled(spark, total):
    row = spark.createDataFrame([(total // 3, total, 1000)], "n bigint, total bigint, size bigint").select(divergence._p("n", "total", "size").alias("p")).first()
    assert row.p == 1 + 10**9 * (total // 3 + 1) // (total + 1000)


def test_rows_are_cut_into_slices(monkeypatch):
    """More postings than one slice takes give the same sums as pair by pair."""
    monkeypatch.setattr(divergence, "SLICE", 700)
    random_ = np.random.default_rng(3)
    groups = [np.sort(random_.choice(40, random_.integers(1, 40), replace=False)) for _ in range(2000)]
    no = np.concatenate(groups)
    p0 = np.arange(10, 50)
    p = random_.integers(60, 5000, len(no))
    starts = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    wanted = defaultdict(int)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        for i in range(a, b):
            for j in range(a, b):
                f = lambda x, y: (x - y) ** 2 // y
                wanted[no[i], no[j]] += int(f(p[i], p[j]) - f(p[i], p0[no[j]]) - f(p0[no[i]], p[j]))
    found = {}
    for batch in divergence._rows("x", starts, no, p, p0[no]):
        found.update({(r["no"], r["peer"]): r["shared"] for r in batch.to_pylist()})
    assert found == {k: v for k, v in wanted.items() if k[0] != k[1]}
