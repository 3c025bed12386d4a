"""The pipeline's stages, each against what its input asks for."""

import pytest

import corpus_pipeline as cp
from edgeframe.llm import langid
from edgeframe.session import written
from tests.llm.test_near import kept

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == columns
        before = {r.doc_id: r.text for r in docs.collect()}
        after = [r.doc_id for r in out.collect()]
        if name == "language_id":
            assert set(after) == {i for i, t in before.items()
                                  if t and langid.letter_table()[[*map(ord, t)]].any()}
        if name == "exact_dedup":
            last = {}
            for i, t in sorted(before.items()):
                last[t] = i
            assert sorted(after) == sorted(last.values())
        if name == "near_dedup":
            assert sorted(after) == kept(before)
        docs = out
    assert stage is cp.STAGES[-2][1]
    assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_odd_tables(spark, name):
    """Empty tables, nulls in every column, empty and long texts, repeated rows."""
    stage = dict(cp.STAGES)[name]
    long = " ".join(f"word{k}" for k in range(20_000))
    rows = [(1, "plain words of one kind", "en", "a", 3), (1, "plain words of one kind", "en", "a", 3),
            (2, None, "en", None, None), (3, "", None, "a", 0), (4, " \n", "en", "a", 2),
            (None, "some other words here", "en", "b", 7), (None, None, None, None, None),
            (5, long, "en", "a", 9), (6, long, None, "b", 9), (7, "12 34", "en", "a", 5)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert stage(spark, written(docs.limit(0), "none"), SF).count() == 0
    got = stage(spark, written(docs, "odd"), SF).collect()
    ids = sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    if name == "language_id":
        assert ids == [None, 1, 1, 5, 6]
    if name == "exact_dedup":
        # One of each text: 1 of the repeated row, the empty text of the largest id, ...
        assert ids == [None, 1, 3, 4, 6, 7]
    if name == "near_dedup":
        # Null, empty and blank texts are one group, and so are the long ones; null ids stay.
        assert ids == [None, None, 1, 1, 2, 5, 7]
    if name == "mixing":
        assert set(ids) <= {r[0] for r in rows} and all(r in rows for r in map(tuple, got))
    if name == "encoding":
        assert len(ids) == len(rows)


def test_noise_is_rejected(spark):
    """Long texts without a trigram of any learned language go, short ones stay."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    han = "".join(chr(0x4E00 + 37 * k % 9000) for k in range(400))
    more = spark.createDataFrame([(-1, han, None), (-2, han[:20], None)], real.schema)
    left = {r.doc_id for r in langid.drop_unknown(real.union(more)).select("doc_id").collect()}
    assert -1 not in left and -2 in left
