"""The integer product quantiser against a plain version of it."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from modsignals.llm import vector_codes as vc

SHAPE = "vec_id bigint, embedding array<float>, label int, code string, part int, n bigint"


def plain(rows, label_at=2):
    """(vec_id, code, error, label_error) and the digest, number by number."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = -(-max((len(r[1]) for r in rows), default=0) // 4) * 4
    whole = [[math.floor(x * 1024) if abs(x) < 2**52 else int(x) * 1024 for x in r[1]] + [0] * (dim - len(r[1])) for r in rows]
    w = dim // 4
    parts = [[v[p * w : (p + 1) * w] for v in whole] for p in range(4)]
    books = [list(part[:256]) for part in parts]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p])) for v in parts[p]]

    for _ in range(4):
        for p in range(4):
            groups = defaultdict(list)
            for v, (_, k) in zip(parts[p], assign(p), strict=True):
                groups[k].append(v)
            for k, vs in groups.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    near = [assign(p) for p in range(4)]
    errors = [sum(near[p][i][0] for p in range(4)) for i in range(len(rows))]
    totals = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        totals[r[label_at]] += e
    fits = lambda x: x if x < 2**63 else None
    out = [(r[0], "".join(f"{near[p][i][1]:02x}" for p in range(4)), fits(errors[i]), fits(totals[r[label_at]])) for i, r in enumerate(rows)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def held(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SHAPE)
    found = vc.vector_codes(frame).collect()
    wanted, digest = plain([(r[0], r[1] and [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=key) == sorted(wanted, key=key)
    assert {r.codebooks_sha256 for r in found} <= {digest}
    return found


def test_codes_against_a_plain_version(spark):
    random.seed(4)
    centres = [[random.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [c + random.gauss(0, 0.2) for c in random.choice(centres)], random.choice([None, 1, 2])) for i in range(700)]
    assert len(held(spark, rows)) == 700


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5] * 8, 1), (5, [0.25] * 8, 1), (5, [0.5] * 8, None), (None, [-0.1] * 8, None), (6, None, 1), (7, [None] * 8, 1),
        (8, [nan] + [0.0] * 7, 1), (9, [0.0] * 7 + [inf], 1), (10, [-inf] * 8, 1), (11, [1.0, 2.0], 2), (12, [], 2), (-3, [0.3] * 5, 2),
    ]
    assert len(held(spark, rows)) == 7
    assert len(held(spark, [(1, [], 1), (2, [], 1)])) == 2


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [3e38 if i % 3 == 0 else 1e30 * i, float(i), 2.0**40 * i, -1e12], i % 2) for i in range(300)]
    found = held(spark, rows)
    assert any(r.error is None for r in found) or all(r.error is not None for r in found)


def test_empty_table(spark):
    assert vc.vector_codes(spark.createDataFrame([], SHAPE)).collect() == []


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [1.0, 1.0, 1.0, 1.0], 0) for i in range(300)]
    assert {r.code for r in held(spark, rows)} == {"00000000"}


@pytest.mark.parametrize("width", [1, 2, 4, 8, 16, 64])
def test_transform_is_in_sequency_order_and_keeps_distances(width):
    functions = vc.transform(np.eye(width, dtype=np.int64))
    changes = (np.diff(functions.T, axis=1) != 0).sum(axis=1)
    assert list(changes) == list(range(width))
    a, b = np.random.default_rng(1).integers(-5000, 5000, (2, 20, width))
    assert (((vc.transform(a) - vc.transform(b)) ** 2).sum(axis=1) == width * ((a - b) ** 2).sum(axis=1)).all()


def test_early_elimination_finds_the_nearest():
    random_ = np.random.default_rng(2)
    parts, entries = random_.integers(-50, 50, (300, 13)), random_.integers(-50, 50, (256, 13))
    index, scaled = vc.nearest(vc.transform(parts), vc.transform(entries))
    distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == distance.argmin(axis=1)).all() and (scaled == 16 * distance.min(axis=1)).all()
