"""Byte-level BPE as a finite-state transducer that is determinised while it runs.

A token sequence is the encoding of its bytes exactly when every two neighbours in it are
the encoding of their own bytes.  So a nondeterministic transducer can guess where tokens
end: it walks the trie of tokens and may end a token where the pair with the token before
fits.  The determinised transducer keeps all guesses that are still possible; what they
agree on is emitted, what they differ in stays in the state.  A guess lives at most as long
as the longest token, so tokens come out after bounded lookahead.  States and transitions
are made on first use and forgotten together when there are too many.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import json
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import regex
from pyspark.sql import DataFrame, functions as F

from edgeframe.llm.common import map_rows

MEMO = 300_000          # words and pieces whose encoding is remembered, in two generations
TRANSITIONS = 800_000   # of the determinised transducer, before it starts afresh
ENCODER_TRANSITIONS = 400_000
MEMO_BYTES = 48 << 20   # of pieces and their ids in one of two generations
ENTRY = 160             # bytes of an entry besides its characters and ids
KEY = 48                # characters of the longest key that is remembered
NO_TOKEN = -1


class Merges:
    """Vocabulary and merge rules.  Ids of merged tokens are in the order of their rules."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], int] | None):
        self.tokens = tokens
        self.ids = {b: i for i, b in tokens.items()}
        self.pairs = pairs

    @classmethod
    def from_ranks(cls, path: str) -> Merges:
        """A file of lines ``base64 rank``; any two tokens merge whose bytes together are one."""
        with open(path, "rb") as f:
            lines = (line.split() for line in f if line.strip())
            return cls({int(rank): base64.b64decode(token) for token, rank in lines}, None)

    @classmethod
    def from_rules(cls, path: str) -> Merges:
        """A JSON model whose rules name the two tokens that merge."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = model["vocab"]
        rules = [r.split(" ") if isinstance(r, str) else r for r in model["merges"]]
        pairs = {(vocab[a], vocab[b]): vocab[a + b] for a, b in rules}
        merged = set(pairs.values())
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()
                  if i in merged or len(t) == 1}
        return cls(tokens, pairs)

    def merge(self, a: int, b: int) -> int:
        if self.pairs is not None:
            return self.pairs.get((a, b), NO_TOKEN)
        return self.ids.get(self.tokens[a] + self.tokens[b], NO_TOKEN)

    def by_definition(self, data: bytes, below: int | None = None) -> list[int]:
        """Merge the lowest rule, leftmost first, until none below ``below`` applies."""
        parts = [self.ids[data[i:i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            made = [self.merge(a, b) for a, b in zip(parts, parts[1:])]
            best = min((m for m in made if m != NO_TOKEN and (below is None or m < below)),
                       default=None)
            if best is None:
                break
            at = made.index(best)
            parts[at:at + 2] = [best]
        return parts


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in JSON vocabularies: printable Latin-1
    characters stand for themselves, the others for code points from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Compiled:
    """Trie of the tokens that are their own encoding, and the test of neighbours."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.halves: dict[int, tuple[int, int]] = {}
        self.child: dict[int, int] = {}     # node * 256 + byte: node
        self.token = [NO_TOKEN]             # of each node
        for i, data in merges.tokens.items():
            if len(data) > 1:
                parts = merges.by_definition(data, below=i)
                if len(parts) != 2 or merges.merge(*parts) != i:
                    continue                # other rules come first: never an outcome
                self.halves[i] = (parts[0], parts[1])
            node = 0
            for b in data:
                nxt = self.child.setdefault(node * 256 + b, len(self.token))
                if nxt == len(self.token):
                    self.token.append(NO_TOKEN)
                node = nxt
            self.token[node] = i
        self._fits: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Do ``a`` and ``b`` stay apart when the bytes of both are encoded together?

        Undo the merges of both sides from the last to the first.  The cut holds if at no
        time a rule across it would have come before the merge that is being undone.
        """
        key = a << 32 | b
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= TRANSITIONS:
                self._fits.clear()
            known = self._fits[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        halves, first = self.halves, None   # first: rules from this one on come too late
        while True:
            across = self.merges.merge(a, b)
            if across != NO_TOKEN and (first is None or across < first):
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            # The right part of the left token, and the left part of the right token, are
            # what touched the cut before.  Equal rules run from left to right.
            if right is None or left is not None and a > b:
                first, a = a, left[1]
            else:
                first, b = b + 1, right[0]


class Transducer:
    """Bytes in, tokens out.  A state is the set of guesses: trie node, last token, and
    what this guess has put out more than all guesses together."""

    def __init__(self, compiled: Compiled, limit: int = TRANSITIONS):
        self.c = compiled
        self.limit = limit
        self.reset()

    empty: object = ()

    @staticmethod
    def add(out: tuple, token: int) -> tuple:
        return (*out, token)

    @staticmethod
    def shared(outs: list[tuple]) -> tuple[tuple, list[tuple]]:
        """What all guesses have put out, and what each has besides."""
        if not any(outs):
            return (), outs
        low, high = min(outs), max(outs)
        k = 0
        while k < len(low) and low[k] == high[k]:
            k += 1
        return low[:k], [o[k:] for o in outs]

    def reset(self) -> None:
        start = ((0, NO_TOKEN, self.empty),)
        self.states = {start: 0}
        self.guesses = [start]
        self.next: list[dict[int, tuple[int, object]]] = [{}]
        self.ends: list[object] = [self.empty]
        self.made = 0

    def step(self, state: int, byte: int) -> tuple[int, object]:
        """A transition: the next state and what is put out."""
        if (known := self.next[state].get(byte)) is not None:
            return known
        child, token, found = self.c.child, self.c.token, []
        for node, last, out in self.guesses[state]:
            to = child.get(node * 256 + byte)
            if to is None:
                continue
            found.append((to, last, out))
            t = token[to]
            if t != NO_TOKEN and (last == NO_TOKEN or self.c.fits(last, t)):
                found.append((0, t, self.add(out, t)))
        emitted, rest = self.shared([g[2] for g in found])
        key = tuple([(g[0], g[1], r) for g, r in zip(found, rest)])
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.guesses)
            self.guesses.append(key)
            self.next.append({})
            self.ends.append(next((r for node, _, r in key if node == 0), None))
        self.next[state][byte] = known = (to, emitted)
        self.made += 1
        return known

    def run(self, state: int, data: bytes) -> tuple[int, list]:
        """All of ``data`` from ``state``; what is put out on the way."""
        steps, outs = self.next, []
        for b in data:
            known = steps[state].get(b)
            state, out = known if known is not None else self.step(state, b)
            if out:
                outs.append(out)
        return state, outs

    def piece(self, data: bytes) -> tuple:
        """The tokens of one piece."""
        if self.made >= self.limit:
            self.reset()
        state, outs = self.run(0, data)
        return (*chain.from_iterable(outs), *self.ends[state])


class Memo(dict):
    """Results of a function: at least the last ``MEMO`` keys, at most twice as many."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of
        self.older: dict = {}

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        if (value := self.older.pop(key, None)) is None:
            value = self.of(key)
        self[key] = value
        return value


class Words:
    """Texts cut where a piece begins for certain: before a space that a character other
    than white space follows.

    That holds for patterns whose pieces take at most one leading space, and white space
    only among itself otherwise.  The part behind such a space is looked up as a whole.
    """

    def __init__(self, pattern: str, of_piece: Callable[[str], tuple],
                 total: Callable[[Iterable], object]):
        self.pieces = regex.compile(pattern).findall
        self.odd = regex.compile(r" (?:\s|$)").search
        self.cut = regex.compile(r" (?=\S)").split
        self.total = total
        self.by_piece = Memo(of_piece)
        self.by_word = Memo(lambda word: self._whole(" " + word))

    def _whole(self, part: str):
        return self.total(map(self.by_piece.__getitem__, self.pieces(part)))

    def of(self, text: str) -> Iterator:
        """What belongs to each part, in order."""
        first, *rest = self.cut(text) if self.odd(text) else text.split(" ")
        yield self._whole(first)
        yield from map(self.by_word.__getitem__, rest)


class TokenTransducer(Transducer):
    """The same transducer in flat tables, a third of the size: a transition without output
    is a number.  One guess at most ends a token at a byte, because the bytes so far have
    one encoding, so the first that fits is it."""

    def reset(self) -> None:
        super().reset()
        self.flat: dict[int, int | tuple[int, tuple]] = {}
        del self.next[:]

    def step(self, state: int, byte: int) -> int | tuple[int, tuple]:
        child, token, fits = self.c.child, self.c.token, self.c.fits
        found, put_out, ended = [], False, False
        for node, last, out in self.guesses[state]:
            to = child.get(node * 256 + byte)
            if to is None:
                continue
            found.append((to, last, out))
            put_out = put_out or out
            if not ended and (t := token[to]) != NO_TOKEN and (last == NO_TOKEN or fits(last, t)):
                found.append((0, t, (*out, t)))
                ended = True
        emitted: tuple = ()
        if put_out or len(found) == 1:
            emitted, rest = self.shared([g[2] for g in found])
            if emitted:
                found = [(g[0], g[1], r) for g, r in zip(found, rest)]
        key = tuple(found)
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.guesses)
            self.guesses.append(key)
            self.ends.append(next((out for node, _, out in key if node == 0), None))
        known = self.flat[state << 8 | byte] = (to, emitted) if emitted else to
        self.made += 1
        return known

    def run(self, state: int, data: bytes) -> tuple[int, list]:
        get, outs = self.flat.get, []
        for b in data:
            known = get(state << 8 | b)
            if known is None:
                known = self.step(state, b)
            if type(known) is int:
                state = known
            else:
                state, out = known
                outs.append(out)
        return state, outs


class PieceIds:
    """Ids of pieces, remembered as bytes in two generations of bounded size.  Long pieces
    are not kept."""

    def __init__(self, pattern: str, of_piece: Callable[[str], tuple]):
        self.pieces = regex.compile(pattern).findall
        self.of_piece = of_piece
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def piece(self, piece: str) -> bytes:
        if (ids := self.young.get(piece)) is None:
            if (ids := self.old.get(piece)) is None:
                ids = array("I", self.of_piece(piece)).tobytes()
            if len(piece) <= KEY:
                self.size += ENTRY + len(piece) + len(ids)
                if self.size > MEMO_BYTES:
                    self.old, self.young, self.size = self.young, {}, 0
                self.young[piece] = ids
        return ids

    def of(self, text: str) -> list[bytes]:
        """Ids of each piece of ``text``, in order."""
        known, piece = self.young.get, self.piece
        return [known(p) or piece(p) for p in self.pieces(text)]


class Encoder:
    """Text to ids: pieces by a pattern, each through the transducer, as a library that
    looks a whole piece up before it merges."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges.from_ranks(path)
        self.transducer = TokenTransducer(Compiled(self.merges), ENCODER_TRANSITIONS)
        self.words = PieceIds(pattern, self._piece)

    def _piece(self, piece: str) -> tuple:
        data = piece.encode()
        whole = self.merges.ids.get(data)
        return (whole,) if whole is not None else self.transducer.piece(data)

    def encode(self, text: str | None) -> list[int]:
        return array("I", b"".join(self.words.of(text))).tolist() if text else []


class Utf8Stream:
    """Incremental UTF-8: bytes in any cuts, whole characters out.

    The state is the bytes of a character that has begun.  A lead byte says how many
    follow; other bytes stand for U+FFFD, as in any lenient decoder.
    """

    def __init__(self) -> None:
        self.begun = b""

    @staticmethod
    def _wanted(lead: int) -> int:
        return 1 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else \
            4 if lead < 0xF5 else 1

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[-back]
            if b >= 0xC0:
                if self._wanted(b) > back:
                    cut -= back
                break
            if b < 0x80:
                break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


def decode(tokens: dict[int, bytes], ids: Sequence[int], block: int = 4096) -> Iterator[str]:
    """Text of ``ids`` in order, block by block; a character may span tokens and blocks."""
    stream = Utf8Stream()
    for at in range(0, len(ids), block):
        yield stream.feed(b"".join(map(tokens.__getitem__, ids[at:at + block])))
    yield stream.finish()


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker; compiling takes a second or two."""
    made = Encoder(path, pattern)
    few_collections()
    return made


def few_collections() -> None:
    """The tables hold no cycles: don't let Python search them for cycles over and over."""
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)


def encode_texts(docs: DataFrame, path: str, pattern: str, *, text: str = "text",
                 keep: Iterable[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and the ids of the whole text; none for a null or empty text."""
    return _with(docs, keep, text, f"`{ids}` array<int>",
                 lambda: (lambda texts, e=encoder(path, pattern):
                          {ids: [e.encode(t) for t in texts]}))


def decode_ids(rows: DataFrame, path: str, pattern: str, *, ids: str = "ids",
               keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and the text of the ids; '' for null or no ids."""
    return _with(rows, keep, ids, f"`{text}` string",
                 lambda: (lambda lists, t=encoder(path, pattern).merges.tokens:
                          {text: ["".join(decode(t, x)) if x else "" for x in lists]}))


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text",
               keep: Iterable[str] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids in the same task: number of tokens, SHA-256 of
    the ids in decimal joined by commas, and SHA-256 of the decoded bytes.

    A null text counts as empty: no ids, digests of nothing.  Rows are independent, so
    ties, repeated rows and other columns have no effect; an empty table gives no rows.
    """
    def make() -> Callable:
        e = encoder(path, pattern)
        names = {i: str(i) for i in e.merges.tokens}
        sha = hashlib.sha256

        def of(texts: list) -> dict:
            out: dict[str, list] = {n: [] for n in ("n_tokens", "ids_sha256",
                                                    "decoded_sha256", "ids")}
            for t in texts:
                ids = e.encode(t)
                back = sha()
                for part in decode(e.merges.tokens, ids):
                    back.update(part.encode())
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(
                    sha(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(back.hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return of

    return _with(docs, keep, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                 + ", ids array<int>" * with_ids, make)


def _with(df: DataFrame, keep: Iterable[str], read: str, made: str,
          make: Callable[[], Callable]) -> DataFrame:
    """Columns ``keep`` as they are, followed by what ``make()`` makes of column ``read``."""
    keep = list(keep)
    kept = df.select([F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keep)]
                     + [F.col(f"`{read}`").alias("read")])
    types = ", ".join(f"k{n} {df.schema[k].dataType.simpleString()}" for n, k in enumerate(keep))

    def outer() -> Callable:
        inner = make()

        def of(*columns: list) -> dict:
            return {f"k{n}": c for n, c in enumerate(columns[:-1])} | inner(columns[-1])

        return of

    out = map_rows(kept, outer, f"{types}, {made}" if types else made)
    return out.withColumnsRenamed({f"k{n}": k for n, k in enumerate(keep)})
