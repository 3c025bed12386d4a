"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts with a length of their own, or a prefix of their own among texts of their length, are
settled without their digest; only groups that survive both steps are compared by the
digest of the full content.  What moves between tasks is one narrow row per text: lengths
and hashes are taken where the text is read, and the full digest is a column of a stored
table that only the last step opens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from edgeframe.llm.common import as_scan, free_name, with_row_id
from edgeframe.session import written

PREFIX = 64     # code points of the prefix hash


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as binary; a null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def fingerprinted(docs: DataFrame, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One narrow row per document: row id, id, length, prefix hash, full digest."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = free_name(docs, "__row")
    return with_row_id(docs, row).select(
        F.col(row).alias("row"), F.col(f"`{id}`").alias("id"),
        F.octet_length(whole).alias("size"),
        F.xxhash64(F.substring(whole, 1, PREFIX)).alias("prefix"),
        text_digest(whole).alias("full"))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Groups of two and more equal texts of ``fingerprinted`` rows, by full digest.

    Each step counts rows per key with partial sums, so a key with a third of all rows is
    one row per task; the keys of repeated lengths and prefixes decide which rows the next
    step reads.  They are stored, so the join with them is free to split such a key.
    """
    again = F.col("n") > 1
    sizes = rows.groupBy("size").agg(F.count("*").alias("n")).where(again).select("size")
    by_prefix = written(rows.select("size", "prefix").join(written(sizes, "sizes"), "size",
                                                           "left_semi")
                        .groupBy("size", "prefix").agg(F.count("*").alias("n")).where(again)
                        .select("size", "prefix"), "prefixes")
    return (rows.join(by_prefix, ["size", "prefix"], "left_semi")
            .groupBy("full").agg(F.max(F.struct("id", "row")).alias("stays"),
                                 F.count("*").alias("n")).where(again))


def exact_duplicates(docs: DataFrame, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: row, id, full digest, the id that stays, group size, kept.

    Of equal texts the row with the largest id stays, nulls last; of several rows with
    that id, the last one by file and position.  Null texts equal empty ones.  An empty
    table gives no rows; other columns have no effect.
    """
    rows = written(fingerprinted(docs, text=text, id=id), "texts")
    groups = written(duplicate_groups(rows), "copies")
    alone = F.col("stays").isNull()
    return (rows.select("row", "id", "full").join(groups, "full", "left")
            .select("row", "id", "full",
                    F.when(alone, F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                    (alone | (F.col("stays.row") == F.col("row"))).alias("kept")))


def drop_exact_duplicates(docs: DataFrame, *, text: str = "text",
                          id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` does not keep; same columns."""
    docs, row = as_scan(docs), free_name(docs, "__row")
    found = exact_duplicates(docs, text=text, id=id)
    gone = found.where(~F.col("kept")).select(F.col("row").alias(row))
    return with_row_id(docs, row).join(gone, row, "left_anti").select(
        [F.col(f"`{c}`") for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    """The digest columns of ``exact_duplicates``."""
    return exact_duplicates(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("full")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
