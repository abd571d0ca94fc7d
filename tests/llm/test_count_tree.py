"""The n-gram join against all pairs, and the exactness of its groups, bounds and tree."""

import random
import time
from itertools import combinations

import brute
import numpy as np
import pytest

from modsignals.llm import components as components_
from modsignals.llm import count_tree as ct
from modsignals.llm.common import saved

SHAPE = "doc_id bigint, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    n = min(4, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def linked(a, b):
    both = len(a & b)
    return both and 100 * both >= 85 * (len(a) + len(b) - both)


def smallest(sets):
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if linked(sets[a], sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: root(i) for i in sets}


def held(spark, rows):
    found = {r.doc_id: r for r in ct.ngram_groups(spark.createDataFrame(rows, SHAPE)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    wanted = smallest(sets)
    assert {i: r.component_id for i, r in found.items()} == wanted
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    return wanted


def edited(words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        words[random.randrange(len(words))] = random.choice(vocabulary)
    return words


def test_given_texts_against_all_pairs(spark):
    docs = spark.read.parquet(brute.DOCS)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(set(held(spark, rows).values())) < len(rows)


def test_edited_copies_that_join_only_over_others(spark):
    random.seed(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    source, passage = random.choices(vocabulary, k=160), random.choices(vocabulary, k=60)
    rows = [(1000 - k, " ".join(edited(source, random.randrange(7), vocabulary))) for k in range(160)]
    rows += [(2000 + k, " ".join(passage + random.choices(vocabulary, k=20 + k))) for k in range(60)]
    rows += [(3000 + k, " ".join(random.choices(vocabulary[:4], k=random.randrange(12)))) for k in range(60)]
    wanted = held(spark, rows)
    assert 1 < len({wanted[i] for i in wanted if i <= 1000}) < 160  # the fixture holds both


def test_chains_of_growing_texts(spark):
    """Every text is a bit longer than the one before, across all level borders."""
    random.seed(9)
    words, rows = [f"u{k}" for k in range(900)], []
    size = 6
    while size < 900:
        rows.append((len(rows), " ".join(words[:size])))
        size += max(1, size // 9)
    wanted = held(spark, rows)
    assert len(set(wanted.values())) < len(rows) / 2


def test_blocks_and_parts_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 7)
    monkeypatch.setattr(ct, "TOGETHER", 5)
    random.seed(10)
    vocabulary = [f"w{k}" for k in range(500)]
    source = random.choices(vocabulary, k=90)
    held(spark, [(k, " ".join(edited(source, random.randrange(5), vocabulary))) for k in range(90)])


def test_odd_rows(spark):
    found = ct.ngram_groups(brute.odd_docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(row[0]) for row in brute.ODD)
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in found if r.doc_id in (3, 4, 5))
    assert ct.ngram_groups(brute.no_docs(spark)).collect() == []


@pytest.mark.parametrize("size", [6, 7, 9, 12, 17, 40, 80, 333, 1500])
def test_linked_sets_share_a_key(size):
    random_ = np.random.default_rng(size)
    for _ in range(60):
        a = random_.integers(0, 2**64, size, np.uint64)
        shared = -(-85 * size // 100) if random_.random() < 0.5 else int(random_.integers(85 * size // 100 + 1, size + 1))
        more = max(0, 100 * shared // 85 - size)
        b = np.concatenate([a[:shared], random_.integers(0, 2**64, more, np.uint64)])
        x, y = np.unique(a), np.unique(b)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both) and not np.array_equal(x, y):
            assert len(np.intersect1d(ct.group_keys(x), ct.group_keys(y)))


@pytest.mark.parametrize("size", [1, 31, 33, 1500])
def test_tree_finds_what_a_scan_finds(size):
    random_ = np.random.default_rng(size)
    centres = random_.poisson(6, (12, ct.SPACE))
    points = np.maximum(centres[random_.integers(0, 12, size)] + random_.integers(-1, 2, (size, ct.SPACE)), 0)
    sizes = points.sum(axis=1)
    tree = ct.CountTree(points, sizes)
    for q in points[:40]:
        at, bound = tree.search(q, int(q.sum()))
        shared = np.minimum(points, q).sum(axis=1)
        assert sorted(at) == list(np.flatnonzero(185 * shared >= 85 * (sizes + q.sum())))
        assert (bound == shared[at]).all()


def test_points_bound_what_sets_share():
    random_ = np.random.default_rng(1)
    a, b = (np.unique(random_.integers(0, 400, 300).astype(np.uint64) << np.uint64(38)) for _ in range(2))
    assert np.minimum(ct.point(a), ct.point(b)).sum() >= len(np.intersect1d(a, b))


def test_full_coordinates_bound_nothing():
    a, b = np.zeros((1, ct.SPACE), np.uint16), np.zeros((1, ct.SPACE), np.uint16)
    a[0, 3], b[0, 3], b[0, 5] = ct.FULL, ct.FULL, 7
    assert ct.most_shared(a, b)[0] > 2**40 and ct.most_shared(a, b - b)[0] == 0
    same = np.full(ct.FULL + 9, 1 << 43, np.uint64)
    assert ct.point(same).max() == ct.FULL and ct.point(same[:9]).max() == 9


def test_points_rule_out_sets_that_share_much_but_not_enough():
    random_ = np.random.default_rng(5)
    shared, a, b = (random_.integers(0, 2**64, n, np.uint64) for n in (1650, 350, 350))
    x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
    assert not ct.enough(ct.most_shared(ct.point(x)[None], ct.point(y)[None])[0], len(x) + len(y))


def test_buckets_with_the_same_members_are_kept_once(spark):
    rows = [(1, list(range(40))), (2, list(range(40))), (3, list(range(20, 40))), (4, [50])]
    found = {}
    for r in ct.bucket_members(spark.createDataFrame(rows, "node bigint, keys array<bigint>")).collect():
        found.setdefault((r.bucket, r.hub), set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [[1, 2], [1, 2, 3]] and {hub for _, hub in found} == {1}


def test_a_place_gives_one_pair_for_each_component(spark):
    """80 sets that could all link by their points, each a component of its own: 3160 pairs of components."""
    spot = ct.point(np.arange(100, dtype=np.uint64) << np.uint64(40)).tobytes()
    points = spark.createDataFrame([(k, 100, spot) for k in range(81)], "node bigint, n_shingles bigint, point binary")
    members = spark.createDataFrame([(7, 0, k) for k in range(81)], "bucket bigint, hub bigint, node bigint")
    none = spark.createDataFrame([], "node bigint, component bigint")
    assert ct.between_components(members, none, points, best=False).count() == 80 * 79 // 2
    pairs = [(r.a, r.b) for r in ct.between_components(members, none, points, best=True).collect()]
    assert len(pairs) <= 80 and {k for pair in pairs for k in pair} == set(range(1, 81))


def test_shuffle_files_go_with_the_write(spark):
    """A saved table leaves no shuffle files of its write, and the session's own setting stays as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, rows = spark.conf.get(name, None), spark.range(1000).repartition(7, "id")
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    had = blocks()
    assert saved(rows, "shuffle-files").count() == 1000
    until = time.time() + 20
    while blocks() > had and time.time() < until:
        time.sleep(0.1)
    assert blocks() <= had and spark.conf.get(name, None) == before


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (7, 9), (5, 5)]])
def test_components_in_few_files(spark, links, monkeypatch):
    """The tables of a round have as many files as their rows ask for, whatever the number of shuffle partitions."""
    monkeypatch.setattr(components_, "FILE_LINKS", 2)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = components_.components(df)
    assert {(r.node, r.component) for r in found.collect()} == ({(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)} if links else set())
    assert len(found.inputFiles()) <= 3
