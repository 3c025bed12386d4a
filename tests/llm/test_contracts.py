"""Queries against definitions written out plainly, over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeframe.llm import langid, mixing, pii, quality, shards, simhash
from edgeframe.session import written

SF = "/root/testdata/sf0.001"
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def valid(kind, text):
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    d = digits(text)
    if kind == "card":
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
                    for k, x in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS)
             for m in re.finditer(PATTERNS[kind], text) if valid(kind, m.group())]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def written_out(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def docs(spark):
    more = [(-1, None), (-2, ""), (-3, "\u00e9 a@b.c +1 (555) 010-9999 4111 1111 1111 1111 10.0.0.256 1.2.3.4"),
            (-4, "x" * 90_000 + " 192.168.0.1"), (-4, "x" * 90_000 + " 192.168.0.1"),
            (None, "mail m@n.org"), (-5, "mail\ndup line\ndup line\n \n \ndup line")]
    extra = spark.createDataFrame(more, "doc_id bigint, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("bigint")})
    return written(spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra), "documents")


def test_personal_data_query(docs):
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for i, t in texts:
        spans = base(t)
        n = Counter(k for k, _, _ in spans)
        want[(i, *(n[k] for k in KINDS), hashlib.sha256(written_out(spans).encode()).hexdigest())] += 1
    rows = pii.span_digests(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                   for r in rows) == want
    assert sum(n for k, n in want.items() if sum(k[1:5])) > 3
    by_id = {i: t for i, t in texts}
    for r in rows:
        got = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        assert {tuple(s) for s in got} >= {(k, str(a), str(b)) for k, a, b in base(by_id[r.doc_id])}


def vector(gram):
    v = np.ones(langid.DIM, np.int64)
    for place, c in zip((2, 1, 0), gram):
        v *= np.roll(langid.letter(ord(c) if c != " " else 0).astype(np.int64), place)
    return v


def bundle(text):
    low = re.sub(" +", " ", "".join(c if langid.letter_table()[ord(c)] else " "
                                    for c in f" {text.lower()} "))
    grams = Counter(low[k:k + 3] for k in range(len(low) - 2))
    return sum((n * vector(g) for g, n in grams.items()), np.zeros(langid.DIM, np.int64)), sum(grams.values())


def test_language_query(spark, docs):
    small = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) < 400)
    rows = small.select("doc_id", "text", "lang").collect()

    def is_held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2

    sums = {}
    for r in rows:
        if not is_held(r.doc_id) and r.text is not None and r.lang is not None:
            v, n = bundle(r.text)
            sums[r.lang] = sums.get(r.lang, 0) + np.rint(v * (langid.UNIT / max(n, 1)))
    want = Counter()
    for r in rows:
        v, _ = bundle(r.text or "")
        if any(langid.letter_table()[ord(c)] for c in r.text or ""):
            cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()}
            top = max(sorted(cos), key=cos.get)
            want[r.doc_id, is_held(r.doc_id), top, round(max(0, cos[top]), 4)] += 1
        else:
            want[r.doc_id, is_held(r.doc_id), "und", 0.0] += 1
    got = langid.op7(small).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in got) == want
    # What held-out rows are labelled with teaches nothing.
    changed = small.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz"))
                               .otherwise(F.col("lang")))
    assert sorted(map(repr, langid.op7(changed).collect())) == sorted(map(repr, got))


def test_long_text_is_taken_apart_in_pieces(monkeypatch):
    text = "Some words, AND\u00e9  more... 12 of them " * 40
    whole = langid.bundles([text, "x"])
    for size in (7, 64):
        monkeypatch.setattr(langid, "CHARS", size)
        for a, b in zip(whole, langid.bundles([text, "x"])):
            assert (a == b).all()
    monkeypatch.setattr(langid, "SLICE", 5)
    for a, b in zip(whole, langid.bundles([text, "x"])):
        assert (a == b).all()
    v, n = bundle(text)
    assert (whole[0][0] == v).all() and whole[1][0] == n


def test_fingerprint_by_definition(docs):
    got = Counter((r.doc_id, r.fingerprint) for r in simhash.op1(docs).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        low = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        ws = re.findall("[^\x20\x09-\x0d]+", low)
        shingles = [" ".join(ws[k:k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0
        want[r.doc_id, f"{fp:016x}"] += 1
    assert got == want


def test_duplicate_lines(docs):
    rows = {r.doc_id: r.n_dup_lines for r in quality.op3(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        seen, n = set(), 0
        for line in (r.text or "").split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                n += line in seen
                seen.add(line)
        if r.doc_id != -4:
            assert rows[r.doc_id] == n
    assert rows[-5] == 2


def test_mixing_order_does_not_depend_on_ranges(docs, monkeypatch):
    want = {(r.id, r.size, r.copies) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "RANGES", 2)        # half of a source holds the edge
    assert {(r.id, r.size, r.copies) for r in mixing.mix(docs).collect()} == want


@pytest.mark.parametrize("id", ["7", None])
@pytest.mark.parametrize("ranges", [3, 1 << 14])
def test_mixing_of_rows_that_share_a_key(docs, monkeypatch, id, ranges):
    """All rows of a source have one id and the same words, so one key."""
    monkeypatch.setattr(mixing, "RANGES", ranges)
    same = docs.select(F.lit(id).alias("doc_id"), "source", F.when(
        F.col("doc_id") % 9 == 0, F.lit(None)).otherwise("a b c d e").alias("text"))
    same = written(same, "same")
    got = mixing.mix(same).collect()
    assert len(got) == same.count()
    by = {}
    for r in got:
        assert r.copies <= 2 and (r.size or not r.copies or r.copies == r.epochs)
        by.setdefault((r.source_size, r.target), []).append(r.copies * r.size)
    sources = same.select("source").distinct().count()
    if len(by) == sources:      # no two sources of one size and target
        for (_, target), taken in by.items():
            assert abs(sum(taken) - target) <= 2.5 + 1e-6
    key = lambda rs: sorted((r.row.at, r.size, r.copies) for r in rs)
    assert key(mixing.mix(written(same, "again")).collect()) == key(got)


def test_equal_ids_share_a_shard_and_slots_have_no_gaps(spark, docs):
    twice = docs.union(docs).withColumn("doc_id", F.col("doc_id") % 50)
    got = shards.op2(twice).collect()
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                          None) is None
