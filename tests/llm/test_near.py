"""Near copies against all pairs by brute force."""

import random

import pytest

import corpus_pipeline as cp
from edgeframe.llm import near

SF = "/root/testdata/sf0.01"


def shingles(text, width=5):
    p = (text or "").encode().lower().split()
    return frozenset(b" ".join(p[k:k + width]) for k in range(max(1, len(p) - width + 1)))


def kept(texts, least=0.8):
    """Ids that stay, of a dict id -> text: the least of every component of all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            s, t = sets[a], sets[b]
            if min(len(s), len(t)) >= least * max(len(s), len(t)) \
                    and len(s & t) >= least * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in ids})


def test_pipeline_stage_finds_all_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    want = kept({r.doc_id: r.text for r in docs.collect()})
    stage = dict(cp.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == want


@pytest.mark.parametrize("block", [near.BLOCK, 2_000])
def test_planted_copies(spark, monkeypatch, block):
    g = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = {}
    for base in range(12):
        words = [g.choice(vocabulary) for _ in range(60 + 40 * base)]
        for edits in (0, 1, 1, 2, 3, 4, 6, 9):
            w = list(words)
            for _ in range(edits * len(words) // 200 + (edits > 0)):
                w[g.randrange(len(w))] = g.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    texts |= {500: "a b", 501: "A  b", 502: "a c", 503: "", 504: " \n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    monkeypatch.setattr(near.connected, "__kwdefaults__",
                        near.connected.__kwdefaults__ | {"block": block})
    got = sorted(r.doc_id for r in near.drop_near_copies(docs).collect())
    assert got == kept(texts)
    assert len(got) < len(texts)


def test_crowd_of_near_copies_and_chains(spark):
    """Copies that drift: the ends of a chain are far apart, but every link is there."""
    g = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, words = {}, [g.choice(vocabulary) for _ in range(80)]
    for k in range(300):
        words = list(words)
        words[g.randrange(80)] = g.choice(vocabulary)
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near.drop_near_copies(docs).collect()) == kept(texts)


def test_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None, 1), (2, "", 2), (3, long, 3), (4, long + " x", 4), (None, "a b c", 5),
            (None, long, 6), (5, "a b c", 7), (5, "a b c", 8), (6, "a b d", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `__gone` int")
    got = near.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r["__gone"] for r in got.collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert near.drop_near_copies(docs.limit(0)).count() == 0


def test_trees_name_pairs_within_two_bits(spark):
    """The pairs that the vantage-point trees name are decided too, with no band in common."""
    from pyspark.sql import functions as F

    from edgeframe.llm import simhash

    g = random.Random(5)
    words = [f"w{g.randrange(900)}" for _ in range(4_000)]
    texts = {0: " ".join(words)}
    for k in range(1, 30):
        w = list(words)
        w[g.randrange(4_000)] = f"x{k}"
        texts[k] = " ".join(w)
    texts[30] = " ".join(g.sample(words, 4_000))
    fp = {k: simhash.majority(near.shingles(t)) for k, t in texts.items()}
    close = {(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2}
    assert close
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    points = near._sketches(docs, "text", "doc_id", 5, False).select(
        "key", F.col("id").alias("least_id"), "fp", F.array(F.xxhash64("key")).alias("v"))
    points = near.written(points, "points")
    ids = {r.key: r.least_id for r in points.collect()}
    roots = near.connected(docs, points, text="text", id="doc_id", width=5, least=0.8)
    root = {i: key for key, i in ids.items()} | {ids[r.key]: r.root for r in roots.collect()}
    assert all(root[a] == root[b] for a, b in close if 30 not in (a, b))
    assert root[30] not in [root[k] for k in range(30)]
