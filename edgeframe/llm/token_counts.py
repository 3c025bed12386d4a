"""Token counts by a compiled finite-state tokenizer.

The merge rules become a deterministic transducer (``bpe.Transducer``) whose transitions
carry only how many tokens they emit, so guesses that differ in nothing but the tokens
they have put out fall into one state.  A long text is cut into chunks; each chunk is a map
from the state it is entered in to the state it is left in and the tokens on the way.  Such
maps compose associatively, and a prefix scan over them gives the state at every cut.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from edgeframe.llm.bpe import (Compiled, Merges, Transducer, Words, _with,
                               few_collections)

CHUNK = 1 << 12     # bytes of a piece in one chunk


class CountTransducer(Transducer):
    """A transducer that emits numbers of tokens.  What a guess has put out besides the
    others is a number too, so the smallest one is emitted and the rest kept."""

    empty = 0

    @staticmethod
    def add(out: int, token: int) -> int:
        return out + 1

    @staticmethod
    def shared(outs: list[int]) -> tuple[int, list[int]]:
        low = min(outs, default=0)
        return low, [o - low for o in outs] if low else outs

    def count(self, state: int, data: bytes) -> tuple[int, int]:
        """The state behind ``data`` and the tokens emitted on the way."""
        steps, n = self.next, 0
        for b in data:
            known = steps[state].get(b)
            state, out = known if known is not None else self.step(state, b)
            n += out
        return state, n


class ChunkMap:
    """State map of a stretch of bytes: entry state → (exit state, tokens).

    Only entries that a scan asks for are filled in; the start state is guessed first,
    because a chunk seldom begins inside a token run that remembers more.
    """

    def __init__(self, of: Callable[[int], tuple[int, int]]):
        self.of = of
        self.known: dict[int, tuple[int, int]] = {}

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            self.known[state] = self.of(state)
        return self.known[state]

    def then(self, other: ChunkMap) -> ChunkMap:
        def both(state: int) -> tuple[int, int]:
            middle, a = self(state)
            end, b = other(middle)
            return end, a + b
        return ChunkMap(both)


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """Maps of all prefixes, by doubling: ``log2`` rounds, each of independent pairs."""
    maps, step = list(maps), 1
    while step < len(maps):
        maps = [m if k < step else maps[k - step].then(m) for k, m in enumerate(maps)]
        step *= 2
    return maps


class Counter:
    """Counts the tokens of whole texts as the library with the same JSON file does."""

    def __init__(self, path: str, pattern: str, special: Iterable[str] = ()):
        self.transducer = CountTransducer(Compiled(Merges.from_rules(path)))
        self.words = Words(pattern, self._piece, sum)
        self.special = [s for s in special if s]

    def _piece(self, piece: str) -> int:
        t, data = self.transducer, piece.encode()
        if t.made >= t.limit:
            t.reset()
        if len(data) <= CHUNK:
            state, n = t.count(0, data)
        else:
            cuts = [data[k:k + CHUNK] for k in range(0, len(data), CHUNK)]
            state, n = prefix_scan([ChunkMap(functools.partial(self._chunk, c))
                                    for c in cuts])[-1](0)
        return n + t.ends[state]

    def _chunk(self, data: bytes, state: int) -> tuple[int, int]:
        return self.transducer.count(state, data)

    def count(self, text: str | None) -> int:
        """A special token counts one, and cuts the text where it stands."""
        parts, n = [text or ""], 0
        for s in self.special:
            cut = [p.split(s) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return n + sum(sum(self.words.of(p)) for p in parts if p)


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str, special: tuple[str, ...]) -> Counter:
    made = Counter(path, pattern, special)
    few_collections()
    return made


def count_tokens(docs: DataFrame, path: str, pattern: str, *, special: Iterable[str] = (),
                 limit: int = 512, text: str = "text",
                 keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Per row: UTF-8 bytes, tokens, and whether there are more than ``limit`` tokens.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit.  Rows are
    independent, so ties, repeated rows and other columns have no effect; an empty table
    gives no rows.  A text of any length is one pass over its bytes.
    """
    special = tuple(special)

    def make() -> Callable:
        c = counter(path, pattern, special)

        def of(texts: list) -> dict:
            n = [c.count(t) for t in texts]
            return {"n_bytes": [len(t.encode()) if t else 0 for t in texts],
                    "n_tokens": n, "over_limit": [x > limit for x in n]}

        return of

    return _with(docs, keep, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", make)
