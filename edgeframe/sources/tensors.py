"""Named tables: read, write, bring to the driver, snapshot, partition."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def read_tensor(spark: SparkSession, path: str, name: str, dtype: str | None = None,
                *, id: str = "id", values: Mapping[str, str] | list[str] | None = None,
                suffix: str = "") -> DataFrame:
    """Load the dataset ``name`` under ``path`` as ``(id, values…)``.

    ``values`` selects (and with a mapping renames, new name to stored name) the value
    columns; all others by default.  ``dtype`` casts them, element-wise for arrays.
    Only the chosen columns reach the parquet scan.
    """
    df = spark.read.parquet(f"{path}/{name}{suffix}")
    if id not in df.columns:
        raise ValueError(f"{name} has no id column {id!r}; row order is not an identity")
    if values is None:
        values = [c for c in df.columns if c != id]
    if not isinstance(values, Mapping):
        values = {v: v for v in values}

    def cast(out: str, stored: str):
        if dtype is None:
            return F.col(stored).alias(out)
        is_array = isinstance(df.schema[stored].dataType, T.ArrayType)
        return F.col(stored).cast(f"array<{dtype}>" if is_array else dtype).alias(out)

    return df.select(F.col(id).cast("bigint").alias("id"),
                     *[cast(out, stored) for out, stored in values.items()])


def write_tensor(df: DataFrame, path: str, name: str, *, suffix: str = "") -> None:
    """Store ``df`` as the dataset ``name``, replacing an earlier one."""
    df.write.mode("overwrite").parquet(f"{path}/{name}{suffix}")


def collect_tensor(df: DataFrame, order_by: str = "id", limit: int = 1_000_000) -> pd.DataFrame:
    """A small result on the driver in row order; refuses to bring more than ``limit`` rows."""
    rows = df.orderBy(order_by).limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"result has more than {limit} rows; write it instead")
    return rows


def snapshot(state: Mapping[str, DataFrame], path: str, step: int) -> None:
    """Save every named state table of one step."""
    for name, df in state.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/step={int(step)}")


def restore(spark: SparkSession, path: str, step: int, names: list[str]) -> dict[str, DataFrame]:
    """The named state tables as saved at ``step``."""
    return {n: spark.read.parquet(f"{path}/{n}/step={int(step)}") for n in names}


def partition_by(df: DataFrame, key: str | None = None, n: int | None = None,
                 *, ranges: bool = False) -> DataFrame:
    """Spread rows over tasks: evenly without a key, by hash or by ranges of one.

    Rows of one key stay together under ``hash``; prefer ``ranges`` with a unique key
    when a single key may hold a large share.  Without ``n`` adaptive execution sizes
    the partitions.
    """
    if key is None:
        if n is None:
            raise ValueError("an even spread needs a partition count")
        return df.repartition(n)
    spread = df.repartitionByRange if ranges else df.repartition
    return spread(key) if n is None else spread(n, key)
