"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from edgeframe.operators.reduce import infer_num_rows

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}

    def query(self, sql: str | None, name: str | None = None):
        def add(build: Build) -> Build:
            key = name or build.__name__
            if key in self.queries:
                raise ValueError(f"query {key!r} is registered twice")
            self.queries[key] = Query(key, build, sql)
            return build
        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """Size of the id domain of a table whose ids start at 0."""
    return infer_num_rows(table(spark, sf_dir, name), key)


# Six columns order the lineitems of an order; (order, line number) alone is not unique.
EDGE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
EDGE_ORDER_SQL = ", ".join(["l_orderkey", *EDGE_ORDER])
