"""Generated tables: zero-filled tensors and random sparse systems."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.functions.mix import mixed_index, mixed_unit
from edgeframe.functions.vec import V
from edgeframe.operators.offsets import global_position


def zeros(spark: SparkSession, n: int, dim: int = 1, dtype: str = "double",
          name: str = "v") -> DataFrame:
    """``n`` rows of zeros: ``(id, v)`` or ``(id, v_0 … v_{dim-1})``."""
    return spark.range(n).select("id", *V.fill(0, dim, dtype).columns(name))


def random_coo(spark: SparkSession, n_rows: int, n_cols: int, nnz: int,
               dims: Mapping[str, int] | None = None, seed: int = 17,
               selectors: int = 2) -> DataFrame:
    """A random sparse system: ``(edge_id, row, col_1.., values..)``, unsorted by row.

    ``dims`` maps value names to vector sizes.  The same arguments give the same rows
    under any partitioning.
    """
    dims = {"pair": 2, "six": 6} if dims is None else dims
    e = F.col("edge_id")
    cols = [mixed_index(e, n_rows, seed, 0).alias("row")]
    cols += [mixed_index(e, n_cols, seed, k).alias(f"col_{k}") for k in range(1, selectors + 1)]
    stream = selectors + 1
    for name, dim in dims.items():
        values = V([mixed_unit(e, seed, stream + i) for i in range(dim)])
        cols += values.columns(name)
        stream += dim
    return spark.range(nnz).withColumnRenamed("id", "edge_id").select("edge_id", *cols)


def random_csr(spark: SparkSession, n_rows: int, n_cols: int, nnz: int,
               seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """The same in row-offset form: ``offsets(row, start, end)`` and ``edges(pos, col, v)``.

    Row bounds are ``n_rows - 1`` random cut points of ``[0, nnz]`` in sorted order,
    between 0 and ``nnz``; rows may be empty.
    """
    if n_rows <= 0:
        raise ValueError("a sparse system needs at least one row")
    edges = spark.range(nnz).select(
        F.col("id").alias("pos"),
        mixed_index(F.col("id"), n_cols, seed, 1).alias("col"),
        (mixed_unit(F.col("id"), seed, 2) * F.lit(2.0) - F.lit(1.0)).alias("v"),
    )
    cuts = spark.range(n_rows - 1).select(
        "id", mixed_index(F.col("id"), nnz + 1, seed, 0).alias("cut"))
    placed = global_position(cuts, ["cut", "id"], "pos", name="csr-cuts")
    # Cut r-1 ends row r-1 and starts row r: both sides of a row come from one group.
    ends = placed.select(F.col("pos").alias("row"), F.lit(None).cast("bigint").alias("start"),
                         F.col("cut").alias("end"))
    starts = placed.select((F.col("pos") + 1).alias("row"), F.col("cut").alias("start"),
                           F.lit(None).cast("bigint").alias("end"))
    rows = spark.range(n_rows).select(
        F.col("id").alias("row"),
        F.when(F.col("id") == 0, F.lit(0)).cast("bigint").alias("start"),
        F.when(F.col("id") == n_rows - 1, F.lit(nnz)).cast("bigint").alias("end"))
    offsets = rows.unionByName(starts).unionByName(ends).groupBy("row").agg(
        F.max("start").alias("start"), F.max("end").alias("end"))
    return offsets, edges
