"""Small weighted transducers over tag sequences, and their composition."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

#: Reads any symbol for which a state has no arc of its own, and writes it as it is.
ANY = "*"


@dataclass(frozen=True)
class Arc:
    """Where to go, what to write (None: what was read), and the factor that the written symbol carries."""

    to: int
    write: str | None = None
    factor: float = 1.0


class Transducer:
    """A deterministic transducer: state 0 is where it starts, every state has an arc for any symbol."""

    def __init__(self, arcs: dict[int, dict[str, Arc]]):
        if any(ANY not in row for row in arcs.values()):
            raise ValueError("every state needs an arc for any other symbol")
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        row = self.arcs[state]
        arc = row.get(symbol) or row[ANY]
        return arc.to, symbol if arc.write is None else arc.write, arc.factor


class Composed:
    """Transducers in a row, each reading what the one before writes; factors multiply. Reached states are kept."""

    def __init__(self, parts: Sequence[Transducer]):
        self.parts = parts
        self.known: dict[tuple, tuple] = {}

    @property
    def start(self) -> tuple[int, ...]:
        return (0,) * len(self.parts)

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
        key = (state, symbol)
        if key not in self.known:
            after, factor = [], 1.0
            for part, at in zip(self.parts, state, strict=True):
                at, symbol, more = part.step(at, symbol)
                after.append(at)
                factor *= more
            self.known[key] = tuple(after), symbol, factor
        return self.known[key]

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        """What is written for each symbol, with its factor."""
        state, out = self.start, []
        for symbol in symbols:
            state, written, factor = self.step(state, symbol)
            out.append((written, factor))
        return out
