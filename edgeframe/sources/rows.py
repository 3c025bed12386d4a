"""Edges stored in row order, of which a range of rows can be read without the rest.

The files are the ranges of one sort.  An index with a row per file says which rows a file
holds and at which position it begins, so a slice opens only the files that hold its rows;
within them, parquet's own bounds skip row groups.  An edge's position is the start of its
file plus its place in the file: no sort and no window when reading.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.session import leaf_bytes, sized_shuffles

GROUP_BYTES = 32 << 20      # of a row group, the least that is read
INDEX = "file string, first bigint, last bigint, rows bigint, start bigint"
META = "key string, schema string"


def store_rows(edges: DataFrame, path: str, key: str, tiebreak: Sequence[str] = (), *,
               files: int | None = None) -> None:
    """Store ``edges`` under the new folder ``path``, sorted by ``key``, then ``tiebreak``.

    A row with many edges spans several files; equal edges are told apart by their input
    task.  Edges whose row is null come first and are in no slice.  ``files`` defaults to one
    per 128 MB of input.  What ``read_rows`` needs is written last.
    """
    spark = edges.sparkSession
    order = [key, *tiebreak, "_split"]
    split = edges.withColumn("_split", F.spark_partition_id())
    with sized_shuffles(spark, leaf_bytes(edges)):
        ranged = (split.repartitionByRange(*order) if files is None
                  else split.repartitionByRange(files, *order))
        (ranged.sortWithinPartitions(*order).drop("_split").write
         .option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/edges"))
    stored = spark.read.schema(edges.schema).parquet(f"{path}/edges")
    row = F.col(key).cast("bigint")
    held = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("rows"))
    # One row per file, named by the number of its range.
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    earlier = Window.partitionBy(F.lit(0)).orderBy(number, "file").rowsBetween(
        Window.unboundedPreceding, -1)
    held.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).write.parquet(
        f"{path}/index")
    spark.createDataFrame([(key, edges.schema.json())], META).coalesce(1).write.parquet(
        f"{path}/meta")


def _opened(spark: SparkSession, path: str) -> tuple[str, T.StructType, DataFrame]:
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    return (meta["key"], T.StructType.fromJson(json.loads(meta["schema"])),
            spark.read.schema(INDEX).parquet(f"{path}/index"))


def read_rows(spark: SparkSession, path: str, start: int, stop: int,
              pos: str | None = None) -> DataFrame:
    """The edges of the rows ``start`` … ``stop`` - 1, with their position in the whole
    system as ``pos`` if named.

    The names of the files that hold them come to the driver, unless that is every file.
    """
    key, schema, index = _opened(spark, path)
    held = (F.col("last") >= start) & (F.col("first") < stop)
    if index.where(~F.coalesce(held, F.lit(False))).isEmpty():
        folder = [f"{path}/edges"]
    else:
        folder = [f"{path}/edges/{r[0]}" for r in index.where(held).select("file").collect()]
    if not folder:
        empty = spark.createDataFrame([], schema)
        return empty if pos is None else empty.withColumn(pos, F.lit(0).cast("bigint"))
    found = spark.read.schema(schema).parquet(*folder)
    wanted = (F.col(key) >= start) & (F.col(key) < stop)
    if pos is None:
        return found.where(wanted)
    if pos in schema.names:
        raise ValueError(f"edges have a column {pos!r} already")
    numbered = found.where(wanted).select(
        *schema.names, F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_at"))
    starts = index.select(F.col("file").alias("_file"), F.col("start").alias("_start"))
    # One row per file.
    return numbered.join(F.broadcast(starts), "_file").select(
        *schema.names, (F.col("_start") + F.col("_at")).alias(pos))


def read_offsets(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """``(row, start, end)`` of the rows ``start`` … ``stop`` - 1 that have edges."""
    key = _opened(spark, path)[0]
    edges = read_rows(spark, path, start, stop, "_pos")
    return edges.groupBy(F.col(key).cast("bigint").alias("row")).agg(
        F.min("_pos").alias("start"), (F.max("_pos") + 1).alias("end"))
