"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from edgeframe.session import is_scan, written

SPACES = " \t\n\x0b\x0c\r"     # the white space of every contract: U+0020, U+0009 to U+000D
ARROW_ROWS = 512               # whole texts travel in batches of so many rows


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long, so fewer rows than Spark's 10,000 go into one Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str) -> DataFrame:
    """Arrow batches of ``df`` through a function built once per task.

    ``make()`` returns a function of the columns as Python lists (in the order of ``df``)
    that gives a dict of columns for ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_columns = make()
        for batch in batches:
            if batch.num_rows:
                out = of_columns(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(blank, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def as_scan(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain scan of files, else a stored copy.  An operator that takes
    row ids of one table twice takes them from this, so they are the same."""
    return df if is_scan(df) else written(df, "rows")


def with_row_id(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with a column that tells rows apart, the same at every evaluation.

    It is the file and the position in it.  A ``df`` that is no plain scan of files is
    stored first, because positions in a computed result are not repeatable and rows that
    were multiplied share one.
    """
    df = as_scan(df)
    meta = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(meta["file_path"].alias("file"),
                                        meta["row_index"].alias("at")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
