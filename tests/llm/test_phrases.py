"""Collocations against plain counting, with small ranges, chunks and odd words."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from edgeframe.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, n int, rank string"


def plain(docs, least, depth, within, top):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, depth + 1):
                f.update((lang, *ws[b:b + m]) for b in range(len(ws) - m + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out = {}
    for p, a in often.items():
        lang, ws = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= within * a and
               any(q[k:k + len(ws)] == ws for k in range(1, len(q) - len(ws) + 1))
               for q, b in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k)
                for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, *ws[:k]],
                                         f[lang, *ws[k:]]))
    return sorted((lang, rank, ws.decode(), -a, l, r, total[lang], -score)
                  for lang, rows in out.items()
                  for rank, (score, a, ws, l, r) in enumerate(sorted(rows)[:top], 1))


def docs():
    g = random.Random(5)
    words = ["a", "B", "b", "the", "Of", "\x01", "a\x00b", "é", "\x1c", "x y", "c", "\U0001f600"]
    out = []
    for k in range(300):
        text = "".join(g.choice(words) + g.choice([" ", " ", " ", "\t ", ", ", "\n", " the of "])
                       for _ in range(g.randrange(30)))
        out.append((k, text, g.choice(["en", "en", "en", None, "und", "d\x00e"]), 1, "x"))
    return out + [(300, None, "en", 1, ""), (301, "", None, None, None), (302, " . ", "fr", 1, "")] + \
        [(303, "the same old phrase again and again", "en", 1, "x")] * 8


@pytest.mark.parametrize("part,within", [(phrases.PART, 100), (25, 100), (25, 60)])
def test_against_plain_counting(spark, part, within):
    data = docs()
    got = phrases.collocations(spark.createDataFrame(data, SCHEMA).repartition(3), least=4,
                               within=within, top=15, part=part)
    assert sorted(map(tuple, got.collect())) == plain(data, 4, 5, within, 15)


def test_long_texts_in_chunks(monkeypatch):
    g = random.Random(1)
    text = " ".join(g.choice(["a", "b", "c", "d.", "e"]) for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"], "text": [text, text[:500]]})
    every_pair = bytes([255]) * (phrases.BITS // 8)

    def suffixes():
        c = Counter()
        for b in phrases._suffixes(every_pair, 5)([batch]):
            c.update(dict(zip(b["key"].to_pylist(), b["n"].to_pylist())))
        return c

    def words():
        c = Counter()
        for b in phrases._counted([batch], 100, phrases.BLOCKS):
            if b["kind"][0].as_py() == 0:
                c.update(dict(zip(zip(b["lang"].to_pylist(), b["data"].to_pylist()), b["n"].to_pylist())))
        return c

    whole = suffixes(), words()
    monkeypatch.setattr(phrases, "CHUNK", 40)
    assert (suffixes(), words()) == whole


def test_quicksort_gives_up_rare_parts():
    g = np.random.default_rng(2)
    rows = g.integers(0, 9, (2000, 4)) * g.integers(1, 3, (2000, 1))
    rows[:, 1:] *= np.cumprod(rows[:, :-1] != 0, axis=1)
    weights = g.integers(1, 4, 2000)
    low, high = phrases._ends(rows)
    got = {tuple(rows[r, :d].tolist()): n for d, r, n in
           phrases.quicksort(rows, weights, 40, low, high)}
    want = Counter()
    for row, w in zip(rows.tolist(), weights.tolist()):
        for d in range(1, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    border = {tuple(e[:d]) for e in (low, high) for d in range(1, 5) if e[d - 1]}
    assert got == {p: n for p, n in want.items() if n >= 40 or p in border}


def test_empty_table(spark):
    assert phrases.op12(spark.createDataFrame([], SCHEMA)).count() == 0
