"""Plain versions of the operators, and small tables that hold every odd case."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations

DOCS = "/root/testdata/sf0.001/documents.parquet"
LABELS = "/root/testdata/sf0.001/labels.parquet"

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "b"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta.", "en", "b"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "   \t\n", "de", "a"),
    (None, "no id here, mail me at no.id@example.com", "en", "c"),
    (6, "word " * 30_000, "en", "c"),
    (7, "x" * 50_000, "en", "c"),
    (8, "+" * 3000 + "1" * 3000 + "1 " * 3000, "en", "c"),
    (9, "Licensed under the Apache License, Version 2.0. GNU General Public License v3. CC BY-SA 4.0", "en", "a"),
    (10, "Ünï cödé 日本語 😀 é <|endoftext|> \x00 \x85 fin", "fr", "ä"),
    (11, "card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.1, call +1 (988) 555-2485", "en", "a"),
    (12, "you are an idiot and a moron. they said you are not stupid.", "en", "a"),
]
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, digest string, hash int, piece int, size int, row_key int, node int, found int, base string, piece_no int"


def odd_docs(spark):
    """Rows with nulls, ties, repeats and long texts, and columns with names that the operators use inside."""
    more = (None, None, "d", 3, 4, 5, 6, 7, 8, "b", 9)
    return spark.createDataFrame([(*row, *more) for row in ODD], SHAPE)


def no_docs(spark):
    return spark.createDataFrame([], SHAPE)


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def smallest_linked(sets: dict[int, frozenset]) -> dict[int, int]:
    """The smallest id that each id reaches over links of a similarity of 0.75 or more."""
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: root(i) for i in sets}


def luhn(digits: str) -> bool:
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v // 10 + v % 10 for v in values) % 10 == 0


def base_spans(text: str) -> list[str]:
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    found = [(m.start(), 0, m.end()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                found.append((m.start(), kind, m.end()))
    return [f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(found)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_licences(text: str) -> tuple[int, list[int], list[str]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), [i for i, _ in places], sorted({label for _, label in places})


def token_counter(docs: list[tuple[int, str]], held) -> Counter:
    counts = Counter()
    for doc_id, text in docs:
        if not held(doc_id):
            counts.update(text.encode().lower().split())
            counts[b""] += 1
    return counts


def examples(pattern):
    """Texts for every alternative of a pattern of the licence rules."""
    from re import _constants as code
    from re import _parser as parser

    def of(tree):
        out = [""]
        for kind, arg in tree:
            if kind is code.LITERAL:
                parts = [chr(arg)]
            elif kind is code.ANY:
                parts = ["x"]
            elif kind is code.IN:
                parts = [chr(v) if k is code.LITERAL else "7" if v is code.CATEGORY_DIGIT or k is code.RANGE and v[0] < 65 else "x" for k, v in arg]
            elif kind is code.SUBPATTERN:
                parts = of(arg[-1])
            elif kind is code.BRANCH:
                parts = [e for branch in arg[1] for e in of(branch)]
            else:
                assert kind in (code.MAX_REPEAT, code.MIN_REPEAT)
                parts = of(arg[2]) + ([""] if arg[0] == 0 else [])
            out = [a + b for a in out for b in parts]
        return out

    return sorted({e.strip() for e in of(parser.parse(pattern))})


def vector_best_fit(lengths, capacities, weights):
    """Best fit that looks at every open sequence; documents and attention that cannot bind are not counted."""
    used = [True, capacities[1] < capacities[0], capacities[2] < capacities[0] ** 2]
    left, bins, offsets = [], [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = [n * u for n, u in zip((lengths[i], 1, lengths[i] ** 2), used, strict=True)]
        best = None
        for k, residual in enumerate(left):
            after = [r - n for r, n in zip(residual, need, strict=True)]
            if min(after) < 0:
                continue
            norm = 0.0
            for rest, capacity, weight, u in zip(after, capacities, weights, used, strict=True):
                if u:
                    norm += weight * ((rest / capacity) * (rest / capacity))
            if best is None or (norm, residual, k) < best:
                best = (norm, residual, k)
        if best is None:
            left.append([c * u for c, u in zip(capacities, used, strict=True)])
            best = (0.0, None, len(left) - 1)
        k = best[2]
        bins[i], offsets[i] = k, capacities[0] - left[k][0]
        left[k] = [r - n for r, n in zip(left[k], need, strict=True)]
    return bins, offsets
