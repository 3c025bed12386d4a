"""Personal data in texts: patterns propose, checksums confirm, words nearby adjust.

Every kind has a pattern that proposes spans, a test that confirms them (digits, Luhn,
mod-97, ranges), a score to begin with and words that raise it when they stand near.  The
four base kinds are reported whenever their test passes, as their definition wants; kinds
that the method adds are reported from a score of ``LEAST`` on.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from edgeframe.llm.bpe import _with

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")     # the order of ties
BASE = KINDS[:4]
LEAST = 0.5
NEAR = 48       # characters on either side in which context counts
CONTEXT = 0.35  # what context adds

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_dotted = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+").finditer
_digits = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})").search
_no_more = re.compile(r"(?![A-Za-z0-9])").match
_ssn = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])").finditer
_separators = str.maketrans("", "", " -().+")

# Words that make a kind likelier, in lower case.
WORDS = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse", "direccion"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "telephone"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "security number", "tax id"),
}
_near = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, w)) + r")").search
         for k, w in WORDS.items()}
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.6, "ssn": 0.2}

# Characters of an IBAN by country.
IBAN = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()
    for c in cs.split()}
_groups = {n: re.compile("(?: ?[A-Z0-9]{4}){%d}" % ((n - 4) // 4)
                         + ("(?: ?[A-Z0-9]{%d})" % (n % 4) if n % 4 else "")).match
           for n in range(15, 35)}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int      # code points
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, ``@``, dotted domain.  Seen from each ``@``: the
    local part is the run of its characters before it, back to the last match."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _domain(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four dotted numbers: chains of numbers are cut after every fourth."""
    for chain in _dotted(text):
        start, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _digits(text):
        if m.end() - m.start() >= 14:
            digits = m.group().translate(_separators)
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _phone(text):
            if 10 <= len(m.group().translate(_separators)) <= 15:
                yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A country has one length; for others all are tried, the longest first.  Behind an
    IBAN the search goes on at its end, else behind the country and check digits."""
    m = _iban(text)
    while m:
        start = m.start()
        known = IBAN.get(text[start:start + 2])
        at = m.end()
        for n in [known] if known else range(34, 14, -1):
            rest = _groups[n](text, m.end())
            if rest and _no_more(text, rest.end()) \
                    and mod97(text[start:rest.end()].replace(" ", "")):
                at = rest.end()
                yield start, at
                break
        m = _iban(text, at)


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _ssn(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


PROPOSE = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans,
           "ssn": ssns}


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind.  A span of an added kind inside or across a base one
    is left out: the base one says more."""
    if not text:
        return []
    found: list[Span] = []
    taken: list[tuple[int, int]] = []
    for kind in KINDS:
        if kind == KINDS[len(BASE)]:
            taken = united(taken)
        for start, end in PROPOSE[kind](text):
            lower = (text[max(0, start - NEAR):start] + " "
                     + text[end:end + NEAR]).lower()
            score = min(1.0, PRIOR[kind] + CONTEXT * bool(_near[kind](lower)))
            if kind in BASE:
                taken.append((start, end))
            elif score < LEAST or overlaps(taken, start, end):
                continue
            found.append(Span(kind, start, end, score))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that meet no other, covering what ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    at = bisect.bisect_left(taken, (end,))
    return at > 0 and taken[at - 1][1] > start


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_spans(docs: DataFrame, *, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Per row: an array of spans (kind, start, end, score, value) of the whole text.

    Null and empty texts have none.  Rows are independent, so ties, repeated rows and
    other columns have no effect; an empty table gives no rows.  Work is linear in the
    length of a text: no pattern starts again inside a run it has already walked.
    """
    def make():
        def of(texts: list) -> dict:
            return {"spans": [[{"kind": s.kind, "start": s.start, "end": s.end,
                                "score": s.score, "value": t[s.start:s.end]} for s in find(t)]
                              for t in texts]}
        return of

    return _with(docs, keep, text, "spans array<struct<kind: string, start: bigint, "
                                   "end: bigint, score: double, value: string>>", make)


def span_digests(docs: DataFrame, *, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans as text."""
    def make():
        def of(texts: list) -> dict:
            all_spans = [find(t) for t in texts]
            base = [[s for s in spans if s.kind in BASE] for spans in all_spans]
            return {f"n_{k}": [sum(s.kind == k for s in b) for b in base] for k in BASE} | {
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                "spans": [joined(s) for s in all_spans],
                "least_score": [min((s.score for s in x), default=None) for x in all_spans]}
        return of

    return _with(docs, keep, text, ", ".join(f"n_{k} bigint" for k in BASE)
                 + ", base_sha256 string, spans string, least_score double", make)
