"""Operators of the training-data subpackage against brute force, libraries and SQL, on a
small table with nulls, empty texts, ties, repeated rows, very long texts and columns whose
names clash with internal ones."""

import base64
import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from edgeframe.llm import (bpe, exact, langid, mixing, pii, quality, queries, shards, simhash,
                           token_counts, token_files)

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "row string, bucket string, fp string")
P = pytest.importorskip("public_tokenizers")
rng = random.Random(5)
EN = "the of and to in a is that it for on was with as his they be at one have this".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()


def prose(words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "ing", "er", ","]) for _ in range(n))


@functools.cache
def rows():
    out = []
    for i in range(60):
        out.append((i, prose(EN if i % 2 else DE, 60 + i), "en" if i % 2 else "de", f"s{i % 4}"))
    out += [(60, None, "en", "s0"), (61, "", None, None), (62, " \n\t ", "de", "s1"),
            (63, out[3][1], "en", "s2"), (64, out[3][1], "en", "s0"), (64, out[3][1], "en", "s0"),
            (None, out[5][1], None, None), (66, "a b", "en", "s3"), (67, "a b", "en", "s3"),
            (68, "x" * 50_000 + " y" * 3000, "en", None), (69, "漢字 kana 😀 mail a@b.co", None, "s1"),
            (70, out[7][1] + " more", "en", "s1"), (71, "$%& ### " * 80, "en", "s1")]
    return [(*r, len(r[1] or ""), "r", "b", "f") for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty):
    for name, of in queries.OPERATORS.items():
        assert of(empty).collect() == [], name


def test_simhash(docs):
    got = simhash.op1(docs).collect()
    assert len(got) == len(rows())
    fp = {}
    for r in rows():
        fp[(r[0], r[1])] = simhash.fingerprint(r[1])
    points = sorted(set(fp.values()))
    root = {p: p for p in points}
    for _ in points:
        for a in points:
            root[a] = min(root[b] for b in points if (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), p in fp.items():
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((r[0], f"{fp[r[0], r[1]]:016x}", least[root[fp[r[0], r[1]]]]) for r in rows())
    assert Counter(tuple(r) for r in got) == want


def test_simhash_shards_lose_nothing():
    g = np.random.default_rng(1)
    centers = g.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = set(g.integers(0, 1 << 63, 3000, dtype=np.uint64).tolist())
    for c in centers.tolist():
        for _ in range(60):
            points.add(c ^ (1 << int(g.integers(0, 63))) ^ (1 << int(g.integers(0, 63))))
    p = np.array(sorted(points), np.uint64)

    def comps(pairs):
        parent = list(range(len(p)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(p))]

    at = {int(v): k for k, v in enumerate(p)}
    want = comps((i, j) for i in range(len(p))
                 for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 2) if i < j)
    nodes = simhash.build(p[::7], 20)
    shard_pairs = []
    for _, who in simhash.route(nodes, p):
        a, b = simhash.forest(p[who], 2)
        shard_pairs += [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]
    assert comps(shard_pairs) == want
    near = [(at[int(x)], at[int(y)]) for a, b in simhash.by_neighbours(p, 2) for x, y in zip(a, b)
            if x != y]
    assert comps(near) == want


def test_shards(docs):
    got = shards.op2(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())


def test_quality(docs):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.op3(docs).collect()}
    for r in rows():
        w = (r[1] or "").split()
        c = Counter(zip(w, w[1:], w[2:]))
        again = {k + d for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for d in (0, 1, 2)}
        x = got[r[0], len(w), sum(map(len, w))]
        assert x.n_repeat_words == len(again)
        assert x.n_symbols == sum(ch in "#*$%&|<>" for ch in r[1] or "")
        assert x.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (x.kept and x.base_failed)
    assert all(x.kept for k, x in got.items() if k[0] is not None and k[0] < 60
               and not x.base_failed)


def test_pii():
    text = ("write to a.b@c-d.org, host 10.0.0.300 and 10.0.0.3, card 4111 1111 1111 1111, "
            "call +49 (170) 1234567. IBAN DE89 3704 0044 0532 0130 00; 4111 1111 1111 1112")
    assert [(s.kind, text[s.start:s.end]) for s in pii.find(text)] == [
        ("email", "a.b@c-d.org"), ("ip", "10.0.0.3"), ("card", "4111 1111 1111 1111"),
        ("phone", "+49 (170) 1234567"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert pii.find(None) == pii.find("") == []


def test_exact(docs):
    got = exact.op5(docs).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    for r in got:
        same = next(v for k, v in groups.items()
                    if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == max((i for i in same if i is not None), default=None)
        assert r.group_size == len(same)
    assert sum(r.kept for r in got) == len(groups)
    assert exact.drop_exact_duplicates(docs).count() == len(groups)


def test_bpe(docs):
    import tiktoken
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(r[0], r[1] or ""): lib.encode_ordinary(r[1] or "") for r in rows()}
    digest = {(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(),
               hashlib.sha256(t.encode()).hexdigest()) for (i, t), x in want.items()}
    assert {tuple(r) for r in queries.encode(docs).collect()} == digest
    stream = bpe.Utf8Stream()
    data = "añ漢😀z".encode()
    assert "".join(stream.feed(data[k:k + 1]) for k in range(len(data))) + stream.finish() \
        == "añ漢😀z"


def test_language(docs):
    got = langid.predict(docs, langid.profiles(docs)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == r.lang
        if not (r.text or "").strip():
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.drop_unknown(docs).columns == docs.columns


def test_token_counts(docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((r[0], len((r[1] or "").encode()),
                    len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    got = queries.count(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    c = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN, ("<|endoftext|>",))
    for t in ("<|endoftext|> a<|endoftext|>", "ab" * 9000, "漢字" * 5000 + " '!!'s"):
        assert c.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert 0 <= r.copies <= 2
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (n, target), rs in by.items():
        assert target <= 2 * n + 1e-6
        assert abs(sum(r.copies * r.size for r in rs) - target) <= max(r.size for r in rs)
    assert Counter((r.id, r.size, r.copies) for r in mixing.mix(docs).collect()) == Counter(
        (r.id, r.size, r.copies) for r in got)
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)


def test_token_files(docs, monkeypatch):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = P.path("word_bpe_49k.json")
    parts = token_files.write_tokens(docs, path, length=8, part_bytes=1 << 30)
    got = token_files.read_tokens(parts, "bigint").collect()
    want = Counter()
    for r in rows():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.id, r.n, r.crc) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n
    ids = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    one = parts.first()
    seq, mask = token_files.Part(one.path, one.name).sequence(0)
    assert len(seq) == len(mask) == 8


def test_words_survive_the_change_of_word_tables(monkeypatch):
    path = queries.tokenizer("word_bpe_49k.json")
    monkeypatch.setattr(token_files, "MEMO_BYTES", 1000)
    small = token_files.texts_of.__wrapped__(path)
    for k in range(12):     # words of earlier batches return after the table has changed
        texts = [f"In, the day, w{k}. the", f"x{k - 1} w{k - 1}. In, y{k}", "", None]
        want = [small.library.encode(t or "", add_special_tokens=False).ids for t in texts]
        got = [np.frombuffer(b, small.type).tolist() for b in small.encode(texts)]
        assert got == want


def test_runs_of_words_give_what_the_library_gives():
    texts = token_files.texts_of.__wrapped__(queries.tokenizer("word_bpe_49k.json"))
    g = random.Random(6)
    parts = ["don't", "I'LL", "we'Re", "'s", "'S", "''", "a1b22", "\u0130x", "e\u0301", "\u00e9", "\u0301",
             "\u03a3\u0391\u03a3", "<|endoftext|>", "<|x", "\u212a", "\u00bd", "\u0663", "\u6f22\u5b57", "...", "!?,", "(a)",
             "\u200d", "\U0001f600", "'d", "\x1c", "\x85", "\u00a0", "w" * 60, "-", "_", "\u01c5", "\u1e9e"]
    for _ in range(400):
        text = "".join(g.choice(parts) + g.choice(["", "", " ", "\n"]) for _ in range(12))
        want = texts.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(texts.encode([text])[0], texts.type).tolist() == want, ascii(text)


class Counted:
    """A library that counts the texts it is given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_new_runs_go_to_the_library_together_and_words_are_cut_as_bytes(monkeypatch):
    texts = token_files.texts_of.__wrapped__(queries.tokenizer("word_bpe_49k.json"))
    g = random.Random(9)
    words = ["".join(g.choices("abcdeGHI", k=9)) + g.choice(["", ".", "'s", "'LL,", "7"])
             for _ in range(6000)]
    whole = [" ".join(words[k:k + 60]) for k in range(0, 6000, 60)]
    want = [texts.library.encode(t, add_special_tokens=False).ids for t in whole]
    texts.library = Counted(texts.library)
    monkeypatch.setattr(texts, "pieces", None)      # no word of ASCII letters is cut in Python
    got = [np.frombuffer(b, texts.type).tolist() for b in texts.encode(whole)]
    assert got == want
    assert texts.library.texts < 20                 # one a run before
    upper = [np.frombuffer(b, texts.type).tolist() for b in texts.encode([whole[0].upper()])]
    assert upper == want[:1] and texts.library.texts < 20


def test_runs_without_a_mark_of_their_end_go_to_the_library_singly(monkeypatch):
    texts = token_files.texts_of.__wrapped__(queries.tokenizer("word_bpe_49k.json"))
    whole = ["some words, and 'tis 12 of them", "words's \u00e9t\u00e9, J\u030c j\u030c"]
    want = [texts.library.encode(t, add_special_tokens=False).ids for t in whole]
    for block in (token_files.BLOCK, 1):
        monkeypatch.setattr(token_files, "BLOCK", block)
        for ends in (texts.ends_run, np.zeros_like(texts.ends_run)):
            texts.known, texts.older, texts.ends_run = {}, {}, ends
            got = [np.frombuffer(b, texts.type).tolist() for b in texts.encode(whole)]
            assert got == want


def test_every_letter_gives_what_the_library_gives():
    texts = token_files.texts_of.__wrapped__(queries.tokenizer("word_bpe_49k.json"))
    letters = [chr(c) for c in range(128, 1 << 16) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 32):
        text = "".join(f"q{c}Q '{c}s {c}'s.{c}1{c} " for c in letters[at:at + 32])
        want = texts.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(texts.encode([text])[0], texts.type).tolist() == want, at


def test_rows_that_were_multiplied_are_told_apart(docs):
    from pyspark.sql import functions as F
    twice = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    got = exact.op5(twice).collect()
    assert len(got) == 2 * len(rows())
    assert sum(r.kept for r in got) == len({r[1] or "" for r in rows()})
    assert exact.drop_exact_duplicates(twice).count() == len({r[1] or "" for r in rows()})
    assert mixing.mixed(twice).count() == sum(r.copies for r in mixing.mix(twice).collect())


def test_a_much_repeated_id_fills_several_buckets(docs):
    from pyspark.sql import functions as F
    one = docs.withColumn("doc_id", F.lit(7).cast("bigint"))
    scattered = shards.scatter(one, bucket_bytes=1 << 12)
    assert scattered.select("shard").distinct().count() == 1
    assert scattered.select("bucket").distinct().count() > 5


def test_odd_letters_columns_and_numbers(spark, docs):
    from pyspark.sql import functions as F
    ((owner, codes),) = langid.trigrams(["\U00020000"])     # low bits of this letter are 0
    assert codes.any()
    odd = docs.withColumn("__lang", F.struct(F.lit(1).alias("a b"))).withColumn("__score", F.lit(2))
    out = langid.drop_unknown(odd)
    assert out.columns == odd.columns and out.select("__lang").first()[0][0] == 1
    zeros = "0" * 5000
    assert [(s.kind, s.start) for s in pii.find(f"{zeros}.1.2.3")] == [("ip", 0)]
