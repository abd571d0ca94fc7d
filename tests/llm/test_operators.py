"""Each operator against a plain version of it, on the smallest tables and on fixtures of its own."""

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modsignals.llm import exact_dedup, license_rules, license_scan, mixing, near_dedup, packing, pii, suffix_tree, syncmers, token_counts, toxicity
from modsignals.llm.common import tokenizer_file
from modsignals.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(brute.DOCS)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def nodes_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- personal data --------------------------------------------------------------------------------------------------


def test_pii_keeps_base_spans(docs, texts):
    for doc_id, row in by_id(pii.pii_counts(docs)).items():
        spans = brute.base_spans(texts[doc_id])
        assert row.base_sha256 == brute.sha(",".join(spans))
        assert set(spans) <= set(row.spans.split(","))
        assert row.n_email + row.n_ip + row.n_card + row.n_phone == len(spans)


def test_pii_patterns_on_odd_texts(spark):
    odd = [
        "a@b.c-d@e.f x", "a@b..c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.4.5", "4111 1111 1111 1111  4111-1111-1111-1111 41111111111111112",
        "+1 (988) 555-2485 4041894974608795 +1", "x" * 50 + "@y.z.", "é@b.co 00001.2.3.4", "1 " * 3000, "+" * 2000 + "1", "a@b" + ".c" * 3000,
    ]
    rows = by_id(pii.pii_counts(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")))
    assert [rows[i].base_sha256 for i in range(len(odd))] == [brute.sha(",".join(brute.base_spans(t))) for t in odd]


def test_pii_adds_what_the_trees_are_sure_of(spark):
    random.seed(3)
    key = lambda: "AKIA" + "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=15)) + "7"
    plain = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=15)) + "7"
    rows = [(i, f"some words {key() if i % 2 else plain()} and more") for i in range(400)]
    found = by_id(pii.pii_counts(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert all(found[i].spans == "token:11:31" for i in range(1, 400, 2))
    assert not any(found[i].spans for i in range(0, 400, 2))


# ---- near duplicates ------------------------------------------------------------------------------------------------


def test_near_groups_against_all_pairs(docs, texts):
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    wanted = brute.smallest_linked(sets)
    for i, row in by_id(near_dedup.near_groups(docs)).items():
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[i]), wanted[i], wanted[i] == i)


def test_near_groups_of_edited_copies(spark):
    """Copies edited so much that many fall short of their bucket's hub and join only over others, next to texts that share a passage."""
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    source = random.choices(vocabulary, k=150)
    shared = random.choices(vocabulary, k=40)
    rows = []
    for k in range(150):
        words = list(source)
        for _ in range(random.randrange(9)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, " ".join(shared + random.choices(vocabulary, k=20 + k))) for k in range(60)]
    found = by_id(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    wanted = brute.smallest_linked({i: brute.shingles(t) for i, t in rows})
    assert {i: r.component_id for i, r in found.items()} == wanted
    assert 1 < len({wanted[i] for i in wanted if i <= 1000}) < 150  # the fixture holds both


def test_batches_drop_only_what_is_unlikely():
    floors = near_dedup.least_agreements()
    assert list(floors) == sorted(floors) and floors[-1] < 0.75 * near_dedup.HASHES
    a = np.arange(near_dedup.HASHES, dtype="<u2")[None]
    b = a.copy()
    b[0, ::4] += 1000
    assert near_dedup.agreements(a, a)[0] == near_dedup.HASHES
    assert near_dedup.agreements(a, b)[0] == 3 * near_dedup.HASHES // 4
    assert near_dedup.agreements(a, a + 1)[0] == -1


def test_signatures_agree_as_sets_do():
    random.seed(2)
    words = [f"w{k}" for k in range(4000)]
    a = " ".join(words)
    b = " ".join(words[:3600] + [f"v{k}" for k in range(400)])
    sa, sb = near_dedup.shingle_set(a), near_dedup.shingle_set(b)
    true = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
    seen = (near_dedup.signature(sa) == near_dedup.signature(sb)).mean()
    assert abs(true - seen) < 0.12


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(139, 90)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {found[k] for k in range(61)} == {0} and {found[k] for k in (90, *range(100, 140))} == {90}


def test_one_row_of_each_component_stays(spark):
    words = [f"w{k}" for k in range(60)]
    text, other = " ".join(words), " ".join([*words[:58], "x", "y"])
    rows = [(None, text, 1, "a"), (None, other, 2, "a"), (None, text, 1, "a"), (5, "only this", 3, "b"), (5, "only this", 4, "b"), (5, "something else here", 5, "b")]
    rows += [(7, None, 6, "c"), (7, None, 6, "c"), (8, " ", 7, "c"), (3, "Only This", 8, "c"), (9, "z " * 9, 9, None), (9, "z " * 9, 9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key int, row string")
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    found = sorted((r.doc_id or 0, r.key) for r in kept.collect())
    assert found[0] in [(0, 1), (0, 2)] and found[1:] == [(3, 8), (5, 5), (7, 6), (7, 6), (8, 7), (9, 9)]
    assert sorted((r.doc_id or 0, r.key) for r in near_dedup.drop_near_duplicates(df.repartition(5)).collect()) == found


# ---- packing --------------------------------------------------------------------------------------------------------


def test_pieces_and_sequences(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(packing.TOKENIZER))
    rows = packing.pack_documents(docs).collect()
    of_doc, of_sequence = {}, {}
    for r in rows:
        of_doc.setdefault(r.doc_id, []).append(r)
        of_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.asarray([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(of_doc[doc_id], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces)])[:-1])
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == 1024 for p in pieces[1:])
        assert len(pieces) == -(-len(ids) // 1024)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    for pieces in of_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces)])[:-1])
        assert sum(p.length for p in pieces) <= 1024
    assert len(of_sequence) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_best_fit_keeps_every_capacity():
    random.seed(1)
    lengths = [random.choice([3, 50, 200, 500, 700]) for _ in range(2000)]
    bins, offsets = packing.best_fit(lengths, (1024, 8, 600_000))
    inside = {}
    for n, k, at in sorted(zip(lengths, bins, offsets, strict=True), key=lambda x: (x[1], x[2])):
        assert at == sum(inside.setdefault(k, []))
        inside[k].append(n)
    assert all(sum(x) <= 1024 and len(x) <= 8 and sum(n * n for n in x) <= 600_000 for x in inside.values())
    assert sum(map(len, inside.values())) == len(lengths)
    with pytest.raises(ValueError):
        packing.best_fit([2000], (1024, 8, 10**9))


@pytest.mark.parametrize("capacities", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 4000), (100, 6, 5000), (100, 3, 2600)])
def test_best_fit_is_the_exhaustive_one(capacities):
    random.seed(9)
    for _ in range(20):
        lengths = [random.randint(1, 50) for _ in range(120)]
        assert packing.best_fit(lengths, capacities) == brute.vector_best_fit(lengths, capacities, packing.WEIGHTS)


def test_best_fit_finds_room_behind_the_first_of_a_class():
    assert packing.best_fit([80, 40, 40, 20], (100, 10, 6500))[0] == [0, 1, 1, 1]


def test_kept_ids_are_whole(spark):
    text = "one two three " * 900
    pieces = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), keep_ids=True).orderBy("piece").collect()
    ids = np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4")
    assert ids[-1] == 2 and packing.ids_of(tokenizer_file(packing.TOKENIZER)).tokenizer.decode(ids[:-1].tolist()) == text


# ---- toxicity -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def given():
    return toxicity.Scorer(toxicity.Lexicon(dict(toxicity.INSULTS), {"lowei": 0.9}))


@pytest.mark.parametrize(
    ("weaker", "stronger"),
    [
        ("the word", "the idiot"),
        ("not an idiot", "an idiot"),
        ("he was called an idiot", "an idiot"),
        ("an idiot", "you idiot"),
        ('"idiot"', "idiot"),
        ("i will kill time", "i will kill you"),
        ("kill the process", "they will kill us"),
        ("not kill you", "kill you"),
        ("you idiot", "you stupid idiot"),
        ("nothing here", "loweient"),
    ],
)
def test_grammar_weighs_clauses(given, weaker, stronger):
    assert given.figures(weaker)[0] < given.figures(stronger)[0]


def test_clauses_are_judged_apart(given):
    assert given.figures("kill time. you there")[0] == 0
    assert given.figures("idiot. moron")[2] == pytest.approx(math.log1p(2))


def test_toxic_words_are_learned_and_held_out_texts_found(spark):
    random.seed(4)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "tel", "sop", "vik", "gan", "hum")]
    rows = []
    for k in range(900):
        text = random.choices(words, k=40)
        if k % 5 == 0:
            text[random.randrange(40)] = random.choice(["zarbul" + random.choice(words), "idiot"])
        rows.append((k, " ".join(text), int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    found = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.predicted == r.toxic for r in found if r.held_out]) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert kept == {r.doc_id for r in found if not r.predicted}


def test_texts_with_fixed_ends_teach_what_stands_between(spark):
    """A source whose texts start and end alike, with an insult that is used only there, and equal texts that count once."""
    random.seed(6)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "tel", "sop", "vik", "gan", "hum")]
    around = "this post was written in the open forum of the town", "all posts here are kept for ever by the keepers of it"
    rows = []
    for k in range(300):
        text = random.choices(words, k=30)
        if k % 3 == 0:
            text[random.randrange(30)] = "zarbul"
        rows.append((k, f"{around[0]} {' '.join(text)} {around[1]}", int(k % 3 == 0)))
    copies = [(1000 + k, " Only  ONE qworx" if k % 2 else "only one qworx ", 1) for k in range(60)]
    df = spark.createDataFrame(rows + copies, "doc_id bigint, text string, toxic int")
    columns = toxicity._columns(df, "doc_id", "text")
    sample = toxicity.labelled_sample(columns, df.select("doc_id", "toxic"), "doc_id", "toxic", toxicity.FIT_ROWS)
    assert sample.count() == 1 + sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(300))
    lexicon = toxicity.learned_words(sample)
    assert lexicon.insult("zarbul") > 0 and not lexicon.insult("qworx")
    found = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df, "doc_id").filter("doc_id < 1000").collect()
    assert np.mean([r.predicted == r.toxic for r in found if r.held_out]) > 0.97


# ---- language model -------------------------------------------------------------------------------------------------


def held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_base_scores_and_gain(docs, texts):
    counts = brute.token_counter(list(texts.items()), held)
    n, v = sum(counts.values()), len(counts)
    rows = by_id(suffix_tree.lm_scores(docs))
    for doc_id, text in texts.items():
        tokens = [*text.encode().lower().split(), b""]
        r = rows[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[t] > 0 for t in tokens), n, held(doc_id))
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())


def test_contexts_are_learned(spark):
    random.seed(6)
    rows = [(k, " ".join(random.choice(["red fox runs", "blue whale swims", "old tree stands"]) for _ in range(20))) for k in range(300)]
    found = suffix_tree.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("held_out").collect()
    # Three equal choices in three words: about 0.477 per three tokens, where single words pay nearly 1 for each.
    per_token = sum(r.score for r in found) / sum(r.n_tokens for r in found)
    assert -0.2 < per_token < -0.14 and all(r.base_score < 4 * r.score for r in found)


def plain_scores(texts, held):
    """The scores by dictionaries, every sequence that training rows hold twice taken."""
    lines = {i: [b"", *suffix_tree.words_of(t), b""] for i, t in texts.items()}
    train = [line for i, line in lines.items() if not held(i)]
    word, pair, triple = (Counter(tuple(x[k : k + n]) for x in train for k in range(n == 1, len(x) - n + 1)) for n in (1, 2, 3))
    n, v = sum(word.values()), len(word)
    log = {1: lambda g: math.log10((word[g] + 0.5) / (n + 0.5 * (v + 1)))}
    for length, grams, contexts in ((2, pair, word), (3, triple, pair)):
        lower, table, rests, of = log[length - 1], {}, {}, {}
        for g, c in grams.items():
            if c >= 2:
                of.setdefault(g[:-1], {})[g] = c
        for context, rows in of.items():
            total, heavy, below = contexts[context], sum(rows.values()), min(sum(10 ** lower(g[1:]) for g in rows), 1 - 1e-12)
            left = max(total - heavy, 0) / total
            gain = sum(c * math.log(c / total / 10 ** lower(g[1:])) for g, c in rows.items()) + (total * left * math.log(left / (1 - below)) if left else 0)
            if gain >= suffix_tree.GAIN and gain >= suffix_tree.DIVERGENCE * total:
                table |= {g: math.log10((c - suffix_tree.DISCOUNT) / total) for g, c in rows.items()}
                rests[context] = math.log10((left + suffix_tree.DISCOUNT * len(rows) / total) / (1 - below))
        log[length] = lambda g, lower=lower, table=table, rests=rests: table[g] if g in table else rests.get(g[:-1], 0.0) + lower(g[1:])
    return {i: sum(log[min(k + 1, 3)](tuple(x[max(0, k - 2) : k + 1])) for k in range(1, len(x))) for i, x in lines.items()}


@pytest.mark.parametrize("hot", [suffix_tree.HOT, 50])
def test_scores_are_those_of_a_plain_tree(docs, texts, monkeypatch, hot):
    """Whether sequences are sent to tasks or joined, none is left out."""
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "AT_HAND", hot)
    wanted = plain_scores(texts, held)
    assert {i: r.score for i, r in by_id(suffix_tree.lm_scores(docs)).items()} == pytest.approx(wanted, rel=1e-9)


def test_what_occurs_twice_counts_however_long_the_corpus(spark):
    """1.6 million training tokens: two occurrences are less than two in a million."""
    random.seed(12)
    train = [i for i in range(60) if not held(i)][:18]
    rows = [(i, " ".join(random.choices("abcdefgh", k=100_000))) for i in train[:16]] + [(i, "quince rhubarb sorrel") for i in train[16:]]
    one = next(i for i in range(60) if held(i))
    found = by_id(suffix_tree.lm_scores(spark.createDataFrame([*rows, (one, "quince rhubarb sorrel")], "doc_id bigint, text string")))[one]
    assert found.train_tokens > 1_500_000 and found.score > found.base_score + 10


def test_followers_share_one(spark):
    """A kept context's followers and rest come to one, over the words below it."""
    base = np.log10(np.array([0.4, 0.3, 0.2, 0.1]))
    kept, rest, logs = suffix_tree._level(np.array([0, 0]), np.array([50, 30]), np.array([100, 0, 0, 0]), 10 ** base[[1, 2]])
    assert kept[0] and not kept[1:].any()
    assert 10 ** logs[0] + 10 ** logs[1] + 10 ** rest[0] * (0.4 + 0.1) == pytest.approx(1)


# ---- licences -------------------------------------------------------------------------------------------------------


def test_rules_are_many_and_compile():
    import re

    assert len(license_rules.rules()) > 300
    for _, label, _, _, pattern, weight in license_rules.rules():
        assert label and re.compile(pattern) and 0 < weight < 1


def test_licences_keep_base_places(docs, texts):
    for doc_id, row in by_id(license_scan.licence_labels(docs)).items():
        n, places, labels = brute.base_licences(texts[doc_id])
        assert (row.n_words, row.n_base, row.base_labels) == (n, len(places), ",".join(labels))
        assert (row.first_word, row.last_word) == ((min(places), max(places)) if places else (None, None))
        assert set(labels) <= set(row.labels.split(",")) | set()


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 0.95),
        ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0", 0.99),
        ("SPDX-License-Identifier: MIT", "mit", 0.99),
        ("Published under CC BY-NC 4.0 terms", "cc-by,cc-by-nc-4.0", 0.95),
        ("the GNU Lesser General Public License v2.1 applies", "lgpl-2.1", 0.7),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 0.95),
        ("mit license, the same mit license", "mit", 0.7),
        ("we commit licenses and account by hand", "", 0.0),
    ],
)
def test_licence_labels(spark, text, labels, score):
    row = license_scan.licence_labels(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.labels, row.score) == (labels, pytest.approx(score))


def test_gate_and_keywords_hold_for_every_alternative(spark):
    import re

    by_place = {}
    for rank, _, first, second, pattern, _ in license_rules.rules():
        by_place.setdefault((rank, pattern), []).append((first, second))
    named = range(len(license_rules.FORMS[:-1]) * len(license_rules.LICENCES))  # frames around a name, which is tried bare below
    every = []
    for (rank, pattern), keywords in by_place.items():
        if rank in named and "identifier" not in pattern:
            continue
        for text in brute.examples(pattern):
            if re.fullmatch(pattern, text):
                every.append(text)
                assert any(first in text and second in text for first, second in keywords), text
    for _, _, needs, frame in license_rules.FORMS:
        assert all(needs in text for text in brute.examples(frame.format(name="x", tag="x")))
    df = spark.createDataFrame([(t,) for t in every], "text string")
    assert len(every) > 1000 and [r.text for r in df.filter(~license_scan.gate(F.col("text"))).collect()] == []


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Expat License", "mit"),
        ("X11 License", "mit"),
        ("Responsible AI License", "openrail"),
        ("Open Data Commons Database License", "odbl-1.0"),
        ("Zero-Clause License", "0bsd"),
        ("Do What The F You Want To Public Licence", "wtfpl"),
        ("This software is provided 'as-is', without any express or implied warranty.", "zlib"),
        ("you can redistribute it and/or modify it under the terms of the GNU", "gpl"),
        ("under 3-clause BSD", "bsd-3-clause"),
        ("creativecommons.org/publicdomain/zero/1.0", "cc0-1.0"),
        ("released under the Expat MIT License", "mit"),
    ],
)
def test_matches_without_further_keywords(spark, text, label):
    row = license_scan.licence_labels(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.labels == label


def test_contained_detections_are_suppressed(spark):
    df = spark.createDataFrame([(1, "released under the terms of the gnu general public license version 3")], "doc_id bigint, text string")
    found = license_scan.scan(df).first().found
    assert [d.label for d in found] == ["gpl-3.0"]


# ---- exact duplicates -----------------------------------------------------------------------------------------------


def test_exact_groups(docs, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(brute.lowered(t), []).append(i)
    for i, row in by_id(exact_dedup.exact_groups(docs)).items():
        group = groups[brute.lowered(texts[i])]
        assert (row.keep_id, row.group_size, row.kept) == (max(group), len(group), i == max(group))
        assert row.text_sha256 == brute.sha(brute.lowered(texts[i]))


def test_heavy_digests_take_the_other_way(spark):
    df = spark.createDataFrame([(k, "Same" if k % 3 else f"text {k // 2}") for k in range(900)], "doc_id bigint, text string")
    keyed = df.select("doc_id", exact_dedup.digest("text").alias("digest")).withColumn("row_key", F.monotonically_increasing_id())
    heavy = exact_dedup.heavy_digests(keyed, 0.1, 900).collect()
    assert [(r.keep_id, r.group_size) for r in heavy] == [(899, 600)]
    for support in (0.0011, 0.9):  # both ways give the same
        rows = exact_dedup.exact_groups(df, support=support).collect()
        assert {(r.keep_id, r.group_size) for r in rows if r.group_size > 2} == {(899, 600)} and sum(r.kept for r in rows) == 1 + 300
    assert exact_dedup.drop_exact_duplicates(df).count() == 301


@pytest.mark.parametrize("support", [0.3, 0.9], ids=["heavy", "shuffled"])
def test_one_row_of_each_text_stays(spark, support):
    rows = [(None, "Same", 1, "a"), (4, "same", 2, "b"), (4, "SAME", 3, None), (4, "same", 2, "b"), (None, "alone", 4, "x"), (None, "Alone", 5, "y"), (1, None, 6, "z"), (2, "", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __key int, row string")
    kept = exact_dedup.drop_exact_duplicates(df, support=support)
    assert kept.columns == df.columns
    found = sorted((r["doc_id"] or 0, r["__key"]) for r in kept.collect())
    assert len(found) == 3 and found[0][1] in (4, 5) and found[1] == (2, 7) and found[2] in [(4, 2), (4, 3)]
    again = exact_dedup.drop_exact_duplicates(df.repartition(5), support=support).collect()
    assert sorted((r["doc_id"] or 0, r["__key"]) for r in again) == found


def test_groups_of_the_rest_are_not_held_by_a_window(docs):
    assert "Window" not in nodes_of(exact_dedup.exact_groups(docs))


# ---- mixing ---------------------------------------------------------------------------------------------------------


def test_water_fill_and_taken_words(docs, texts):
    sources = {r.doc_id: r.source for r in docs.collect()}
    rows = by_id(mixing.mix_counts(docs))
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    held_by = {s: sum(size[i] for i in size if sources[i] == s) for s in set(sources.values())}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(held_by))}
    total, capped = 1.5 * sum(held_by.values()), set()
    while True:
        level = (total - sum(2 * held_by[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in held_by if s not in capped and level * weight[s] > 2 * held_by[s]}
        if not more:
            break
        capped |= more
    for i, r in rows.items():
        s = sources[i]
        assert (r.size, r.source_size) == (size[i], held_by[s])
        assert r.target == pytest.approx(2 * held_by[s] if s in capped else level * weight[s])
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
    for s in held_by:
        of = [r for i, r in rows.items() if sources[i] == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(r.size for r in of) / 2 + 1e-6
    assert rows == by_id(mixing.mix_counts(docs.repartition(7)))
    taken = mixing.mix_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] * size[r.doc_id] for r in taken if size[r.doc_id]} == {i: r.taken for i, r in rows.items() if r.taken}


def test_caps_that_cannot_hold_the_total(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "y")], "doc_id bigint, text string, source string")
    assert all(r.taken == 2 * r.size and r.target == 2 * r.source_size for r in mixing.mix_counts(df, share=5.0).collect())


# ---- token counts ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counts():
    return token_counts.counts_of(tokenizer_file(token_counts.TOKENIZER))


def test_counts_are_the_librarys(docs, texts, counts):
    for i, r in by_id(token_counts.token_counts(docs)).items():
        n = len(counts.tokenizer.encode(texts[i], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[i].encode()), n, n > 2048)
        assert len(counts.tokenizer.encode(texts[i][: r.fits_chars], add_special_tokens=False)) <= 2048


@pytest.mark.parametrize(
    "text", ["<|endoftext|> hi there's 12²3 ÀÉ İx µ ß", "Ωmega ώς ΣΑΣ éa x y", "", "a" * 3000, "日本語 don't I'LL", "<|startoftext|><|endoftext|>", "\x1c\x1da b\x85c", "x\x00y"]
)
def test_counts_at_every_prefix(counts, text):
    for n in range(min(len(text), 200) + 1):
        assert counts.count(text[:n]) == len(counts.tokenizer.encode(text[:n], add_special_tokens=False))


def test_budgets_need_no_encoding(counts, texts):
    for text in list(texts.values())[:25]:
        for budget in (1, 7, 60):
            n = counts.fitting(text, budget)
            fits = lambda k: len(counts.tokenizer.encode(text[:k], add_special_tokens=False)) <= budget  # noqa: B023, E731
            assert fits(n) and not any(fits(k) for k in range(n + 1, min(n + 30, len(text)) + 1) if text[n:k].strip())


def test_prefix_table(spark, counts):
    text = "The quick brown fox, 42 times."
    row = token_counts.prefix_counts(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [counts.count(text[:e]) for e in row.ends] == row.tokens


@pytest.mark.parametrize(
    "text",
    [
        "He said \u201chello\u201d\n\nthen  left the cafe\u0301 " * 8,
        "Ωmega  ώς\n\n日本語の文章 e\u0323\u0301le\u0301phant x\u0301y e\u0301\u0323z " * 4,
        "\u201cİstanbulİ\u201d  aİ don't\u3000\u3000 <|endoftext|> \u0301a " * 4,
        "ハ\u309aレ\u309dカ\u3099" * 15 + " \u1112\u1161\u11ab" * 9,
    ],
)
def test_budgets_of_texts_whose_length_changes(spark, counts, text):
    sizes = [len(counts.tokenizer.encode(text[:k], add_special_tokens=False)) for k in range(len(text) + 1)]
    ends, tokens = counts.at_piece_ends(text)
    assert ends == sorted(set(ends)) and ends[-1] == len(text.rstrip()) and tokens == [sizes[e] for e in ends]
    for budget in range(sizes[-1] + 2):
        n = counts.fitting(text, budget)
        assert sizes[n] <= budget and not any(sizes[k] <= budget for k in range(n + 1, len(text) + 1) if text[n:k].strip() and not _cuts_special(text, k))
    row = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), limit=20).first()
    assert row.over_limit and row.fits_chars == counts.fitting(text, 20)


def _cuts_special(text, k):
    return any(k - n >= 0 and text.startswith("<|endoftext|>", k - n) for n in range(1, 13))


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def test_edited_texts_follow_the_order(docs, texts):
    order = sorted(texts, reverse=True)
    rows = by_id(syncmers.fingerprints(docs))
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(text) // 3
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == brute.sha(text[: len(text) - third] + following[:third])
    assert np.mean([r.near_edited for r in rows.values()]) > 0.6 > 0.1 > np.mean([r.near_next for r in rows.values()])


def test_order_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PIECE_ROWS", 3)
    rows = [(k * k, f"text number {k} with words {'abc' * k}") for k in range(40)]
    found = by_id(syncmers.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for (i, text), (_, following) in zip(rows, rows[-1:] + rows[:-1], strict=True):
        third = len(text) // 3
        assert found[i].edited_sha256 == brute.sha(text[: len(text) - third] + following[:third])


def test_anchors_do_not_depend_on_what_surrounds_them(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    df = spark.createDataFrame([(1, passage), (2, f"before this {passage} and after that")], "doc_id bigint, text string")
    first, second = (r.a for r in df.select("doc_id", syncmers.syncmers(F.col("text"), 5, 2).alias("a")).orderBy("doc_id").collect())
    assert {a.hash for a in first} <= {a.hash for a in second}
    assert {a.at + 2 for a in first} <= {a.at for a in second}
    assert 0.3 < len(first) / 56 < 0.7


# ---- native operators stay native -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "run", [pii.pii_counts, license_scan.licence_labels, exact_dedup.exact_groups, mixing.mix_counts, syncmers.fingerprints], ids=["pii", "licences", "exact", "mixing", "syncmers"]
)
def test_no_python_in_native_plans(docs, run):
    plan = nodes_of(run(docs))
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_counted_sequences_travel_by_range(spark, monkeypatch):
    """What tasks have counted leaves them in a row for each range of codes, and is added up over tasks and flushes."""
    monkeypatch.setattr(suffix_tree, "STRETCH", 50)
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(20)) for _ in range(60)]
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id bigint, held boolean, text string").repartition(3)
    spelt = sorted({w for t in texts for w in t.split()})
    codes = spark.createDataFrame([(w,) for w in ["", *spelt]], "word string").selectExpr("word", "xxhash64(word) AS code").collect()
    code = {r.word: r.code for r in codes}
    hand = suffix_tree.Words({r.word.encode(): k for k, r in enumerate(codes)}, np.array([r.code for r in codes]).view(np.uint64))
    counted = suffix_tree.count_grams(docs, hand, 1, None, 4)
    wanted = Counter((code[a], code[b]) for t in texts for a, b in zip(["", *t.split()], [*t.split(), ""], strict=True))
    assert {(r.context, r.low): r.n for r in counted.collect()} == {pair: n for pair, n in wanted.items() if n >= suffix_tree.LEAST}
    assert "FlatMapGroupsInArrow" in counted._jdf.queryExecution().toString()


def test_split_gives_the_words_of_each_text():
    """Of a part of a column, too; white space at the ends and between gives no words, and only A-Z change."""
    texts = ["out of the slice", "", "  The the\tTHE ", " \n\x0b\x0c\r", "ÄB\u00a0c \u2003d\x1ce\x85f", "\x00 x", "the"]
    for part in (pa.array(texts), pa.array(texts).slice(1), pa.array(texts).slice(1, 1), pa.array(texts).slice(0, 0), pa.array([""])):
        words, at, lengths = suffix_tree.split(part)
        wanted = [suffix_tree.words_of(t) for t in part.to_pylist()]
        assert [words[int(k)].as_py().encode() for k in at] == [w for line in wanted for w in line]
        assert list(lengths) == [len(line) for line in wanted]


def test_codes_are_found_by_their_first_bits():
    """Codes with the same first bits, the least and the largest, absent ones, and an empty table."""
    draw = random.Random(3)
    codes = np.unique(np.array([0, 1, 2, 1 << 63, (1 << 63) + 1, (1 << 64) - 1, *(draw.getrandbits(64) for _ in range(500))], np.uint64))
    asked = np.concatenate([codes[::-1], codes + np.uint64(1)])
    at = {int(c): k for k, c in enumerate(codes)}
    assert list(suffix_tree.Places(codes).find(asked)) == [at.get(int(c), -1) for c in asked]
    assert list(suffix_tree.Places(codes[:0]).find(asked)) == [-1] * len(asked)


def test_scoring_writes_no_lists_of_sequences(docs, monkeypatch):
    """Sequences that are asked for go straight to their join, which puts neither side in order."""
    written = {}

    def noted(df, name):
        written[name] = df._jdf.queryExecution().toString()
        return saved(df, name)

    saved = suffix_tree.saved
    monkeypatch.setattr(suffix_tree, "saved", noted)
    suffix_tree.lm_scores(docs)
    assert "scores" in written and not {"text-scores", "context-values"} & written.keys()
    for name in ("scores", "contexts"):
        assert "ShuffledHashJoin" in written[name] and "SortMergeJoin" not in written[name]


def test_asked_sequences_travel_by_range(docs, texts, monkeypatch):
    """What texts ask for goes to the join in a row for each range, not one for each sequence, over several stretches and ranges; nothing is lost."""
    written = {}

    def noted(df, name):
        written[name] = df._jdf.queryExecution().toString()
        return saved(df, name)

    saved = suffix_tree.saved
    monkeypatch.setattr(suffix_tree, "saved", noted)
    for name, value in (("HOT", 50), ("AT_HAND", 50), ("STRETCH", 500), ("HANDED_ON", 500), ("LOOKED_UP", 1000)):
        monkeypatch.setattr(suffix_tree, name, value, raising=False)
    scores = {i: r.score for i, r in by_id(suffix_tree.lm_scores(docs)).items()}
    assert scores == pytest.approx(plain_scores(texts, held), rel=1e-9)
    assert "Generate" not in written["scores"] and "FlatMapGroupsInArrow" in written["scores"]


def test_range_has_one_row_in_order(spark):
    """Values of a code are summed, and the range's piece of the bitmap has the codes with a gain, the first and last of a range among them."""
    draw = random.Random(8)
    codes = [0, 1 << 60, (1 << 64) - 1, (1 << 63) - 1, 1 << 63, *(draw.getrandbits(64) for _ in range(300))]
    rows = [(c - (1 << 64) if c >> 63 else c, float(k), b, g) for c in codes for k, b, g in ((0, 0.0, 0.5), (1, -2.0, 0.0))]
    rows += [(77, 1.0, -3.0, 0.0)]
    table = spark.createDataFrame(rows, "code bigint, k double, b double, g double").repartition(3)
    bits = np.zeros(1 << 10, np.uint64)
    found = {}
    for r in suffix_tree.by_range(table, 4, 16).collect():
        of_part = np.frombuffer(r.codes, np.uint64)
        assert (np.diff(of_part) > 0).all() and (of_part >> np.uint64(60) == r.part).all()
        found |= {int(c): x for c, *x in zip(of_part, *(np.frombuffer(r[n], float) for n in "kbg"), strict=True)}
        bits[r.part * 64 : (r.part + 1) * 64] = np.frombuffer(r.bits, np.uint64)
    assert found == {c: [1.0, -2.0, 0.5] for c in codes} | {77: [1.0, -3.0, 0.0]}
    wanted = suffix_tree.Seen(16)
    wanted.add(np.array(codes, np.uint64))
    assert (bits == wanted.bits).all()


def test_codes_of_a_range_are_found_by_the_bits_they_differ_in(monkeypatch):
    """Codes that share their first bits do not share their places; a range without values gives nothing."""
    draw, made = random.Random(9), []
    codes = np.array(sorted((5 << 57) | draw.getrandbits(57) for _ in range(2000)), np.uint64)

    class Noted(suffix_tree.Places):
        def __init__(self, codes):
            super().__init__(codes)
            made.append(np.diff(self.starts).max())

    monkeypatch.setattr(suffix_tree, "Places", Noted)
    asked = pa.array([[{"stretch": 3, "at": np.array([0, 2, 2], np.int32).tobytes(), "codes": codes[[7, 9, 9]].tobytes(), "own": None}]] * 2)
    values = [pa.array([x.tobytes(), None], pa.binary()) for x in (codes, np.zeros(2000), np.zeros(2000), np.arange(2000.0))]
    full, empty = suffix_tree._looked_up([pa.RecordBatch.from_arrays([asked, *values], ["asked", "codes", "k", "b", "g"])], 7)
    assert list(np.frombuffer(full["at"][0].as_buffer(), np.int32)) == [0, 2] and list(np.frombuffer(full["found"][0].as_buffer(), float)) == [0, 0, 0, 0, 7, 18]
    assert not empty["at"][0].as_py() and not empty["found"][0].as_py() and made[0] < 10
