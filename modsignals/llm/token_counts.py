"""Exact token counts at every prefix of a text, by dynamic programming.

For each prefix of a piece the program holds the last token of the prefix's encoding and the number of its tokens. A token t
that ends the prefix is that last token exactly if what stands before t is encoded so that its last token and t stay apart
when encoded together; so the counts of longer prefixes follow from those of shorter ones, and each piece is walked once.
A piece that is cut off ends a word too, so every prefix also has its count with the word end.

From these counts follow the length of a text, whether it fits a budget, and the longest prefix that does, without encoding
anything again. Lengths are in characters of the text as it came: each place in the normalised text, in which white space and
accents may be joined, is led back to its place in the text.

Null text counts as empty and has no tokens. Rows that repeat are counted each. An empty table gives an empty result. Other
columns are never read. A special token's string inside a text is that one token, as the library has it by default.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import tokenizer_file

#: Pieces whose counts a task keeps; they are small, and few of them take most of the text.
KEPT_TOTALS = 1_200_000
TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
_END = "</w>"
_RUNS = re.compile(f"[{bpe.SPACE}]+|[^{bpe.SPACE}]+")
_SPACES = re.compile(f"[{bpe.SPACE}]*")
_JOINED = re.compile(f"[{bpe.SPACE}]{{2}}")


def _keeps_length(text: str) -> bool:
    """Whether normalisation changes characters one by one; only İ becomes two when it is lowered."""
    return "İ" not in text and not _JOINED.search(text) and unicodedata.is_normalized("NFC", text)


class PrefixCounts:
    """Counts for one vocabulary whose words end in a mark."""

    def __init__(self, path: str):
        self.tokenizer = bpe.library(path)
        self.ids = self.tokenizer.get_vocab(with_added_tokens=False)
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = {self.ids[a + b]: (self.ids[a], self.ids[b], rank) for rank, (a, b) in reversed([*enumerate(pairs)])}
        # What meets the border from the left is a token's right side, and the other way round.
        self.left = bpe.Kept(lambda token: self._spine(token, 1), len(self.ids))
        self.right = bpe.Kept(lambda token: self._spine(token, 0), len(self.ids))
        # Tokens that end a word, by their letters, and the letters with which any other token begins (-1 if they are none).
        self.closing = {t.removesuffix(_END): i for t, i in self.ids.items() if t.endswith(_END)}
        self.longest = max(map(len, self.closing))
        inner = {t: i for t, i in self.ids.items() if not t.endswith(_END)}
        self.longest_begun = max(map(len, inner))
        self.begun = {t[:n]: -1 for t in inner for n in range(1, len(t))} | inner
        specials = bpe.special_strings(path)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.apart = bpe.Kept(self._apart, bpe.KEPT_PAIRS)
        self.tables = bpe.Kept(self._table, bpe.KEPT_PIECES)
        self.totals = bpe.Kept(self._total, KEPT_TOTALS)
        self.merged = bpe.Kept(self._merged, bpe.KEPT_PIECES)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at one side of a token while it is built, from its first one to itself, each with the rank of the merge that ends it."""
        out, ends = [], math.inf
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out[::-1]
            *halves, ends = self.made[token]
            token = halves[side]

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay two when their strings are encoded as one.

        While both are built, the symbols at the border change. If at some time the two that meet there have a merge of their
        own that comes before the merges that end them, it takes place and the tokens are never made. Of equal merges the
        left one comes first.
        """
        left, right = self.left[pair[0]], self.right[pair[1]]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
            if i == len(left) or j == len(right):
                return True

    def _walk(self, letters: str) -> tuple[list[int], list[int]]:
        """For each prefix that goes on, the last token of its encoding and the number of tokens."""
        begun, apart, size = self.begun, self.apart, len(letters)
        lasts, counts = [-1] * size, [0] * size
        for start in range(size - 1):
            last, more = lasts[start], counts[start] + 1
            for end in range(start + 1, size):
                token = begun.get(letters[start:end])
                if token is None:
                    break
                if token >= 0 and (start == 0 or apart[last, token]):
                    lasts[end], counts[end] = token, more
        return lasts, counts

    def _close(self, letters: str, end: int, lasts: list[int], counts: list[int]) -> int:
        """The number of tokens of a prefix that ends the word."""
        closing, apart = self.closing, self.apart
        for start in range(max(0, end - self.longest), end):
            token = closing.get(letters[start:end])
            if token is not None and (start == 0 or apart[lasts[start], token]):
                return counts[start] + 1
        raise ValueError(f"no encoding of {letters[:end]!r}")

    def _total(self, piece: str) -> int:
        letters = bpe.lettered(piece)
        return self._close(letters, len(letters), *self._walk(letters))

    def _table(self, piece: str) -> array:
        """The number of tokens of each prefix of a piece, by characters, each prefix taken as a whole word."""
        letters = bpe.lettered(piece)
        walked = self._walk(letters)
        ends = accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)
        return array("L", [self._close(letters, end, *walked) for end in ends])

    def pieces(self, text: str) -> list[tuple[str | None, int]]:
        """The pieces of a text with the places where they end; None stands for a special token.

        The place is -1 for a piece that ends within what is normalised together, as between the two signs of a lowered İ: no
        beginning of the text has just the pieces up to there.
        """
        out, at = [], 0
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append((None, at + len(part)))
            elif bpe.is_latin1(part):
                out += [(m.group(), at + m.end()) for m in bpe.BARE.finditer(part.lower())]
            else:
                places = self._places(part)
                out += [(piece, at + places[end] if places[end] >= 0 else -1) for piece, end in self._cut_by_library(part)]
            at += len(part)
        return out

    def _cut_by_library(self, part: str) -> list[tuple[str, int]]:
        """Pieces and their ends in the normalised part."""
        unlettered = {c: b for b, c in enumerate(bpe.byte_letters())}
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))
        return [(bytes(unlettered[c] for c in letters).decode("utf-8", "surrogatepass"), end) for letters, (_, end) in cut]

    def _merged(self, cluster: str) -> tuple[str, list[int]]:
        """A cluster normalised, and for each place in that the place it has in the cluster, or -1."""
        normal = self.tokenizer.normalizer.normalize_str
        norm = normal(cluster)
        places = [-1] * len(norm) + [len(cluster)]
        for n in range(1, len(cluster)):
            if (first := normal(cluster[:n])) + normal(cluster[n:]) == norm:
                places[len(first)] = n
        return norm, places

    def _places(self, part: str) -> list[int]:
        """For each place in the normalised part the place in the part itself, or -1 where it has none."""
        if _keeps_length(part):
            return [*range(len(part) + 1)]
        places, norm, at = [0], [], 0
        for run in _RUNS.findall(part):
            if _keeps_length(run):
                norm.append(self.tokenizer.normalizer.normalize_str(run))
                places += range(at + 1, at + len(run) + 1)
            else:
                inner = at
                for cluster in bpe.clusters().findall(run):
                    merged, ends = self.merged[cluster]
                    norm.append(merged)
                    places += [inner + n if n >= 0 else -1 for n in ends[1:]]
                    inner += len(cluster)
            at += len(run)
        if "".join(norm) != (whole := self.tokenizer.normalizer.normalize_str(part)):  # marks that this Python does not know
            return self.merged[part][1] if len(part) < 1000 else [0, *[-1] * (len(whole) - 1), len(part)]
        return places

    def count(self, text: str) -> int:
        if bpe.is_latin1(text) and not (self.special and self.special.search(text)):
            return sum(map(self.totals.__getitem__, bpe.BARE.findall(text.lower())))
        return sum(1 if piece is None else self.totals[piece] for piece, _ in self.pieces(text))

    def at_piece_ends(self, text: str) -> tuple[list[int], list[int]]:
        """Where pieces end, and the number of tokens up to there."""
        pieces = self.pieces(text)
        sums = accumulate(1 if p is None else self.totals[p] for p, _ in pieces)
        sure = [(end, n) for (_, end), n in zip(pieces, sums, strict=True) if end >= 0]
        return [end for end, _ in sure], [n for _, n in sure]

    def fitting(self, text: str, budget: int) -> int:
        """The length of the longest prefix that has at most ``budget`` tokens, up to its last piece that is cut."""
        pieces = self.pieces(text)
        sums = list(accumulate(1 if p is None else self.totals[p] for p, _ in pieces))
        whole = bisect_right(sums, budget)
        if whole == len(pieces):
            return len(text)
        # From the last sure place before the piece that does not fit to the first one behind it.
        first, last = whole, whole
        while first and pieces[first - 1][1] < 0:
            first -= 1
        while pieces[last][1] < 0:
            last += 1
        before, end = pieces[first - 1][1] if first else 0, pieces[last][1]
        if pieces[whole][0] is None:
            return before
        left = budget - (sums[first - 1] if first else 0)
        start = before + len(_SPACES.match(text[before:end]).group())
        inside = self._inside(text[start:end], [piece for piece, _ in pieces[first : last + 1]], left)
        return start + inside if inside else before

    def _inside(self, part: str, pieces: list[str], left: int) -> int:
        """The length of the longest real prefix of a part that has at most ``left`` tokens."""
        if len(pieces) > 1:
            return next((n for n in range(len(part) - 1, 0, -1) if self.count(part[:n]) <= left), 0)
        piece = pieces[0]
        if _keeps_length(part):
            return max((n for n, tokens in enumerate(self.tables[piece][:-1], 1) if tokens <= left), default=0)
        letters = bpe.lettered(piece)
        walked = self._walk(letters)
        found = clusters_at = at = 0
        for cluster in bpe.clusters().findall(part):
            for n in range(1, len(cluster) + 1):
                if clusters_at + n < len(part) and self._with_tail(letters, at, *walked, bpe.lettered(self.merged[cluster[:n]][0])) <= left:
                    found = clusters_at + n
            clusters_at += len(cluster)
            at += len(bpe.lettered(self.merged[cluster][0]))
        return found

    def _with_tail(self, letters: str, at: int, lasts: list[int], counts: list[int], tail: str) -> int:
        """The number of tokens of the first ``at`` letters and a tail as one word."""
        # No token that is not the first one's begins further back than the longest.
        low = max(0, at - max(self.longest, self.longest_begun))
        word = letters[low:at] + tail
        lasts, counts = lasts[low : at + 1], counts[low : at + 1]
        lasts += [-1] * (len(word) + 1 - len(lasts))
        counts += [0] * (len(word) + 1 - len(counts))
        for start in range(len(word) - 1):
            for end in range(start + 1, len(word)):
                token = self.begun.get(word[start:end])
                if token is None:
                    break
                if end > at - low and token >= 0 and (low + start == 0 or self.apart[lasts[start], token]):
                    lasts[end], counts[end] = token, counts[start] + 1
        for start in range(max(0, len(word) - self.longest), len(word)):
            token = self.closing.get(word[start:])
            if token is not None and (low + start == 0 or self.apart[lasts[start], token]):
                return counts[start] + 1
        raise ValueError(f"no encoding of {word!r}")


@lru_cache(maxsize=4)
def counts_of(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"coalesce(`{text_col}`, '') AS text")


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fits_chars: how many leading characters stay within the limit."""
    path = tokenizer_file(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([k > limit for k in n], pa.bool_()),
                    "fits_chars": pa.array([counts.fitting(t, limit) if k > limit else len(t) for t, k in zip(texts, n, strict=True)], pa.int64()),
                }
            )

    shape = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fits_chars bigint"
    return _columns(docs, id_col, text_col).mapInArrow(run, shape)


def prefix_counts(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ends, tokens: the token count at every place where a piece ends, to answer budgets of any size later."""
    path = tokenizer_file(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(path)
        for batch in batches:
            both = [counts.at_piece_ends(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "ends": pa.array([e for e, _ in both], pa.list_(pa.int32())),
                    "tokens": pa.array([t for _, t in both], pa.list_(pa.int32())),
                }
            )

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ends array<int>, tokens array<int>")
