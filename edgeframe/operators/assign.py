"""Column assignment on one table.  None of these moves a row."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeframe.functions.vec import V

Expr = V | Column


def as_vector(expr: Expr) -> V:
    return expr if isinstance(expr, V) else V([expr])


def expand(outputs: Mapping[str, Expr]) -> dict[str, Column]:
    """Output name → column, vectors expanded to ``name_i``."""
    flat: dict[str, Column] = {}
    for name, expr in outputs.items():
        v = as_vector(expr)
        for n, c in zip(v.names(name), v.items):
            if n in flat:
                raise ValueError(f"output column {n!r} is written twice")
            flat[n] = c
    return flat


def _existing(df: DataFrame, name: str, expr: Expr) -> dict[str, Column]:
    cols = expand({name: expr})
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} to write into")
    return cols


def assign(df: DataFrame, name: str, expr: Expr) -> DataFrame:
    """Overwrite (or add) ``name``; later expressions see the new value."""
    return df.withColumns(expand({name: expr}))


def assign_copy(df: DataFrame, name: str, expr: Expr) -> DataFrame:
    """Write into a column that exists, keeping its type."""
    cols = _existing(df, name, expr)
    return df.withColumns({c: e.cast(df.schema[c].dataType) for c, e in cols.items()})


def add_in_place(df: DataFrame, name: str, expr: Expr) -> DataFrame:
    """``name = name + expr`` on a column that exists."""
    cols = _existing(df, name, expr)
    return df.withColumns({c: (F.col(c) + e).cast(df.schema[c].dataType)
                           for c, e in cols.items()})


def edge_map(edges: DataFrame, outputs: Mapping[str, Expr | Callable[[DataFrame], Expr]],
             keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Several outputs per edge in one projection: no gather, no sum, no shuffle."""
    exprs = {n: e(edges) if callable(e) and not isinstance(e, (V, Column)) else e
             for n, e in outputs.items()}
    return edges.select(*keep, *[c.alias(n) for n, c in expand(exprs).items()])
