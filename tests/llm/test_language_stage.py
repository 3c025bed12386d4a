"""The language stage on a table without labels."""

from edgeframe.llm import langid


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame(
        [(1, "plain words", None), (2, "12 34", None), (3, None, None), (4, "и слова", None)],
        "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in langid.drop_unknown(docs).collect()) == [1, 4]
