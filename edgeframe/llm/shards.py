"""Shards by a two-pass external shuffle.

Pass one scatters records over buckets that fit in memory, by seeded hashes: the shard is
the one of highest random weight for the document's id, and inside a shard a hash of id
and position picks the bucket, so repeated ids spread.  Pass two reads one bucket at a
time, puts it in order, applies a seeded Fisher-Yates permutation and writes it.  A record
crosses the network once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from edgeframe.llm.common import free_name, small_batches, with_row_id
from edgeframe.session import sized_shuffles, written_path

SHARDS = 40
BUCKET_BYTES = 16 << 20
ROW_BYTES = 16      # of a record besides its text


def weights(id: Column, shards: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                       lambda k: F.struct(F.xxhash64(id, k, F.lit(seed)).alias("w"), k.alias("k")))


def shard_of(id: Column, shards: int, seed: int) -> Column:
    """Highest random weight: one more shard draws only those ids for which it wins."""
    return F.array_max(weights(id, shards, seed))["k"].cast("int")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shard_bytes(docs: DataFrame, *, shards: int = SHARDS, seed: int = 11, text: str = "text",
                id: str = "doc_id") -> dict[int, int]:
    """Bytes of the records of each shard, one number per shard."""
    sums = docs.groupBy(shard_of(F.col(f"`{id}`"), shards, seed).alias("shard")).agg(
        F.sum(size_of(F.col(f"`{text}`"))).alias("bytes")).collect()
    return {r["shard"]: r["bytes"] for r in sums}


def scatter(docs: DataFrame, *, shards: int = SHARDS, seed: int = 11, text: str = "text",
            id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES,
            held: dict[int, int] | None = None) -> DataFrame:
    """Pass one: columns doc (the whole record), shard, bucket, tie (an order of records
    that does not depend on how they arrive).  ``held``: ``shard_bytes``, if known."""
    row = free_name(docs, "__row")
    key = F.col(f"`{id}`")
    at = F.col(row)["at"]
    if held is None:
        held = shard_bytes(docs, shards=shards, seed=seed, text=text, id=id)
    # A shard of a much repeated id has as many buckets as it fills.
    filled = {shard: -(-n // bucket_bytes) for shard, n in held.items()}
    buckets = F.get(F.array(*[F.lit(max(1, filled.get(k, 1))) for k in range(shards)]),
                    F.col("shard"))
    return with_row_id(docs, row).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        shard_of(key, shards, seed).alias("shard"),
        F.xxhash64(key, F.col(row), F.lit(seed + 1)).alias("bucket"),
        F.struct(F.xxhash64(key, F.col(f"`{text}`"), F.lit(seed)).alias("h"),
                 at.alias("at")).alias("tie")) \
        .withColumn("bucket", F.pmod("bucket", buckets).cast("int"))


def shuffle_buckets(scattered: DataFrame, seed: int = 11) -> DataFrame:
    """Pass two: doc, shard, bucket, pos (gapless in the bucket)."""
    small_batches(scattered.sparkSession)
    schema = StructType([scattered.schema["doc"], scattered.schema["shard"],
                         scattered.schema["bucket"]]).add("pos", "long", False)

    def permute(key: tuple, table: pa.Table) -> pa.Table:
        shard, bucket = (k.as_py() for k in key)
        tie = table.column("tie").combine_chunks()
        order = np.lexsort((tie.field("at").to_numpy(zero_copy_only=False),
                            tie.field("h").to_numpy(zero_copy_only=False)))
        dealt = np.random.default_rng([seed, shard, bucket]).permutation(len(order))
        out = table.select(["doc", "shard", "bucket"]).take(pa.array(order[dealt]))
        return out.append_column("pos", pa.array(np.arange(len(order))))

    return scattered.groupBy("shard", "bucket").applyInArrow(permute, schema)


def write_shards(docs: DataFrame, path: str | None = None, **how) -> str:
    """Writes the shuffled records under ``path`` (by default in the shared folder), one
    directory ``shard=n`` each, and returns it.

    Records keep all their columns, in a struct ``doc``, so no name can clash.  A null
    text has no bytes; null ids are one id and share a shard; repeated rows are separate
    records; a very long text fills a bucket of its own.  An empty table writes no records.

    Pass two starts with a task for every 128 MB of records, so what a task reads does not
    grow with the table.
    """
    spark = docs.sparkSession
    path = path or written_path(spark, "shards")
    seed = how.get("seed", 11)
    held = shard_bytes(docs, **{k: v for k, v in how.items() if k != "bucket_bytes"})
    with sized_shuffles(spark, sum(held.values())):
        shuffle_buckets(scatter(docs, held=held, **how), seed).write.partitionBy(
            "shard").parquet(path)
    return path


def read_shards(docs: DataFrame, path: str, columns: Sequence[Column] = ()) -> DataFrame:
    """doc, shard, slot (gapless from 0 in the shard) of what ``write_shards`` wrote.

    ``columns``, expressions over ``doc``, take its place: they are evaluated as the shards
    are read, so whole records do not move again to find their slots.
    """
    schema = StructType().add("doc", StructType(docs.schema.fields)) \
        .add("bucket", "integer").add("pos", "long").add("shard", "integer")
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    # One row per bucket; a shard has as many as its bytes fill.
    first = Window.partitionBy("shard").orderBy("bucket")
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", (F.sum("n").over(first) - F.col("n")).alias("offset"))
    taken = [F.struct(*columns).alias("doc")] if columns else ["doc"]
    return rows.select(*taken, "shard", "bucket", "pos").join(offsets, ["shard", "bucket"]).select(
        "doc.*" if columns else "doc", "shard", (F.col("offset") + F.col("pos")).alias("slot"))


def op2(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """Digest of the written shards; law ``key``: id and shard count decide."""
    text, id = F.col("doc.text"), F.col("doc.doc_id")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    path = write_shards(docs, shards=shards, seed=seed)
    return read_shards(docs, path, [
        id.alias("doc_id"), size_of(text).alias("size"), crc.alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(id, shards + 1, seed).alias("grown_shard")])
