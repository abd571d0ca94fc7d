"""Tokenizer helpers that run inside tasks: how texts fall into pieces, and what each piece becomes.

The public vocabularies first cut a text into pieces by a fixed pattern and then encode each piece for itself. Most pieces
recur, so a task keeps what it has found for them, in a table of bounded size. For texts within Latin-1 the pieces come from a
pattern of plain character sets, which gives what the library's own pattern gives there; all other texts, and those that hold
a special token's string, are cut by the library itself.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

#: Entries that a task keeps for pieces, and for pairs of tokens.
KEPT_PIECES, KEPT_PAIRS = 400_000, 1_000_000

#: Letters, numbers and white space within Latin-1, and the pieces that both vocabularies set apart.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r\x20\x85\xa0"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BARE = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


#: Fixed value: white space as the library's patterns have it.
SPACE = "\\t-\\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache
def clusters() -> re.Pattern:
    """White space that is joined, or a character, with the marks and letters behind it that may be merged into it or reordered."""
    behind = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if unicodedata.combining(c):
            behind.add(c)
        elif len(parts) == 2 and parts[0][0] != "<":
            behind.add(chr(int(parts[1], 16)))
    return re.compile(f"(?s:[{SPACE}]+|.)[{''.join(map(re.escape, sorted(behind)))}]*")


def is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else the next free one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(free)) for b in range(256)]


def lettered(piece: str) -> str:
    letters = byte_letters()
    return "".join(letters[b] for b in piece.encode("utf-8", "surrogatepass"))


class Kept(dict):
    """A table that fills itself by ``make`` and starts anew when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


@lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer of a vocabulary file, once per worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())
