"""Rows of the last two pipeline stages: copies against SQL, ids against the library."""

import base64
from collections import Counter

import pytest

import corpus_pipeline as cp
from edgeframe.llm import mixing
from edgeframe.session import written

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


def test_mixed_rows_and_token_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    tiktoken = pytest.importorskip("tiktoken")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    for name in ("language_id", "exact_dedup", "near_dedup"):
        docs = written(stages[name](spark, docs, SF), name)
    path = str(tmp_path / "input.parquet")
    docs.write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    copies = c.execute(f"WITH {mixing.sql()} SELECT doc_id, copies FROM mix_rows").fetchall()
    rows = {r.doc_id: r for r in docs.collect()}
    want = Counter({tuple(rows[i]): n for i, n in copies if n})
    assert {0, 1, 2} >= {n for _, n in copies} and len(want) > 1

    mixed = written(stages["mixing"](spark, docs, SF), "mixing")
    assert Counter(tuple(r) for r in mixed.collect()) == want

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = Counter()
    for i, n in copies:
        if n:
            ids[i, tuple(lib.encode_ordinary(rows[i].text))] += n
    got = Counter((r.doc_id, tuple(r.ids)) for r in stages["encoding"](spark, mixed, SF).collect())
    assert got == ids
