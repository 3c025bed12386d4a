"""Array forms of the vector operators, for vectors too wide to expand.

``V`` expands a vector to one column per component.  Past a few dozen components two
such vectors exceed the field limit of code generation; these functions keep the
vector in one ARRAY column instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_component(col: Column, i: int) -> Column:
    return F.get(col, F.lit(i))


def array_flatten(col: Column) -> Column:
    """Array of arrays to one row-major array."""
    return F.flatten(col)


def array_repeat_value(value: float, dim: int) -> Column:
    return F.array_repeat(F.lit(float(value)), dim)


def array_map(col: Column, op: Callable[[Column], Column]) -> Column:
    return F.transform(col, op)


def array_broadcast(a: Column, b: Column, op: Callable[[Column, Column], Column],
                    dims: tuple[int, int]) -> Column:
    """``out[i] = a[i % N] op b[i % M]`` over ``max(N, M)`` components.

    An array whose length is not the one that ``dims`` gives fails the query.
    """
    n, m = dims
    a, b = _sized(a, n), _sized(b, m)
    if n == m:
        return F.zip_with(a, b, op)
    return F.transform(
        F.sequence(F.lit(0), F.lit(max(n, m) - 1)),
        lambda i: op(F.get(a, i % F.lit(n)), F.get(b, i % F.lit(m))),
    )


def _sized(a: Column, n: int) -> Column:
    return F.when(F.size(a) == n, a).when(a.isNotNull(), F.raise_error(F.concat(
        F.lit(f"an array of {n} components is needed, not of "), F.size(a).cast("string"))))


def array_norm(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"),
                       lambda acc: F.sqrt(acc))
