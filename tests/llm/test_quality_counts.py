"""The counts of op3 by brute force, on texts of few words over every character class."""

import random
import re
from collections import Counter

from edgeframe.llm import quality as ql

WORDS = ["a", "b", "A1", "#x", "é", "…", "$|", "\\", "<>", "7", "ok.", "[~]", "日本", "a b"]
GAPS = [" ", " ", "\n", "\t", "  ", "\n\n", "\r\n", "\x0b", "\x0c"]


def expected(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), len(text),
            *[sum(map(len, re.findall(p, text))) for p in ql.CLASSES.values()])


def test_counts(spark):
    g = random.Random(12)
    texts = [None, "", " \n", "a a a", "a a a a", "a\n" * 50, "x y z " * 3000,
             " ".join(str(i) for i in range(5000))]
    texts += ["".join(g.choice(WORDS[:g.randint(2, len(WORDS))]) + g.choice(GAPS)
                      for _ in range(g.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string")
    got = {r.id: r for r in ql.features(docs, "text", "doc_id", "lang").collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_chars,
                *[r[f"c_{c}"] for c in ql.CLASSES]) == expected(t), t
