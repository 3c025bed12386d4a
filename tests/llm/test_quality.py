"""Both distances of the quality filter by brute force, with kept and rejected documents."""

import math
import random
import re
from collections import Counter, defaultdict

from edgeframe.llm import quality as ql

g = random.Random(9)
COMMON = {"en": "the of and to in a is that it for on was".split(),
          "el": "και το να του η της με που την από για δεν".split()}


def prose(lang, n=120):
    letters = "abcdefghilmnoprstu" if lang == "en" else "αβγδεζηθικλμνοπρστυ"
    return " ".join(g.choice(COMMON[lang]) if g.random() < 0.4 else
                    "".join(g.choice(letters) for _ in range(g.randint(6, 10))) for _ in range(n))


def js(p, q):
    half = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q)) / 2))


def classes(text):
    found = [sum(map(len, re.findall(p, text))) for p in ql.CLASSES.values()]
    return [*found, len(text) - sum(found)]


def test_distances_and_rare_languages(spark):
    rows = [(k, prose("en"), "en") for k in range(300)]
    rows += [(300, prose("el"), "el"), (301, prose("el"), "el")]       # under 1 per cent
    rows += [(400 + k, " ".join("".join(g.choice("abcdefghilmnoprstu") for _ in range(
        g.randint(2, 10))) for _ in range(120)), None) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in ql.op3(docs).collect()}

    sums, n, short = defaultdict(lambda: [0] * 7), Counter(), defaultdict(Counter)
    for _, t, lang in rows:
        if lang:
            sums[lang] = [a + b for a, b in zip(sums[lang], classes(t))]
            n[lang] += len(t.split())
            short[lang].update(w.lower() for w in t.split() if len(w) <= ql.SHORT)
    for i, t, _ in rows:
        by_char, by_word = [], []
        for lang in sums:
            mine = classes(t)
            by_char.append(js([x / sum(mine) for x in mine],
                              [x / sum(sums[lang]) for x in sums[lang]]))
            top = sorted(short[lang].items(), key=lambda x: (-x[1], x[0]))[:ql.COMMON]
            q_all = sum(c for _, c in top) / n[lang]
            w = [x.lower() for x in t.split()]
            p = [w.count(x) / len(w) for x, _ in top]
            scale = max(sum(p), q_all)
            by_word.append(js([*[x / scale for x in p], 1 - sum(p) / scale],
                              [*[c / n[lang] / q_all for _, c in top], 0.0]))
        assert abs(got[i].char_distance - min(by_char)) < 1e-6
        assert abs(got[i].word_distance - min(by_word)) < 1e-6
    assert all(got[i].kept for i, _, lang in rows if lang)
    assert not any(got[i].kept or got[i].base_failed for i, _, lang in rows if not lang)
