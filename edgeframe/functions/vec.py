"""``V``: a fixed-size vector of Spark columns.

A row's vector of k numbers is held as k scalar columns while a plan is built, so
that every operator is an ordinary column expression inside whole-stage code
generation.  The size is known when the plan is built; two vectors of different size
combine cyclically (``out[i] = a[i % N] op b[i % M]``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from numbers import Number

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_TYPES = ("double", "float", "bigint")


class UnsupportedOperation(ValueError, AttributeError):
    """An operation outside the closed set, reported before any job starts."""


def _literal(value: Number, dtype: str) -> Column:
    """A scalar cast to the vector's own type first: a fraction with bigint truncates."""
    if dtype == "bigint":
        return F.lit(int(value)).cast("bigint")
    return F.lit(float(value)).cast(dtype)


def _not_nan(c: Column, dtype: str) -> Column | None:
    return None if dtype == "bigint" else ~F.isnan(c)


class V:
    """A row vector: ``len(v)`` columns of one value type."""

    __slots__ = ("items", "dtype")

    def __init__(self, items: Sequence[Column], dtype: str = "double"):
        if dtype not in VALUE_TYPES:
            raise ValueError(f"value type must be one of {VALUE_TYPES}, got {dtype!r}")
        if not items:
            raise ValueError("a vector needs at least one component")
        self.items = list(items)
        self.dtype = dtype

    # ---- construction -------------------------------------------------------

    @classmethod
    def of(cls, *cols: str | Column, dtype: str = "double") -> V:
        """A vector from columns, each cast to ``dtype``."""
        picked = [F.col(c) if isinstance(c, str) else c for c in cols]
        return cls([c.cast(dtype) for c in picked], dtype)

    @classmethod
    def from_array(cls, col: str | Column, dim: int, dtype: str = "double") -> V:
        """The components of an array column of ``dim`` values.  A null array has null
        components; one of another length fails the query."""
        arr = F.col(col) if isinstance(col, str) else col
        arr = F.when(F.size(arr) == dim, arr).when(arr.isNotNull(), F.raise_error(F.concat(
            F.lit(f"an array of {dim} components is needed, not of "), F.size(arr).cast("string"))))
        return cls([F.get(arr, F.lit(i)).cast(dtype) for i in range(dim)], dtype)

    @classmethod
    def fill(cls, value: Number, dim: int = 1, dtype: str = "double") -> V:
        """A constant vector."""
        return cls([_literal(value, dtype)] * dim, dtype)

    # ---- shape --------------------------------------------------------------

    def __len__(self) -> int:
        return len(self.items)

    def __iter__(self):
        return (V([c], self.dtype) for c in self.items)

    def __getitem__(self, index) -> V:
        """Component of the flattened row; ``v[:, i]`` reads the second index."""
        if isinstance(index, tuple):
            if len(index) != 2:
                raise UnsupportedOperation(f"unsupported index {index!r}")
            index = index[1]
        if not isinstance(index, int):
            raise UnsupportedOperation(f"unsupported index {index!r}")
        return V([self.items[index]], self.dtype)

    def clone(self) -> V:
        return V(self.items, self.dtype)

    def flatten(self) -> V:
        return self.clone()

    def reshape(self, *shape: int) -> V:
        """Row-major values are unchanged; only the number of them is checked."""
        size = 1
        for s in shape:
            size *= s
        if size != len(self):
            raise ValueError(f"cannot reshape {len(self)} values to {shape}")
        return self.clone()

    # ---- output -------------------------------------------------------------

    @property
    def column(self) -> Column:
        if len(self) != 1:
            raise ValueError(f"a vector of {len(self)} has no single column")
        return self.items[0]

    def columns(self, name: str) -> list[Column]:
        """``name`` for a scalar, ``name_0 … name_{k-1}`` for a vector."""
        return [c.alias(n) for c, n in zip(self.items, self.names(name))]

    def names(self, name: str) -> list[str]:
        return [name] if len(self) == 1 else [f"{name}_{i}" for i in range(len(self))]

    def array(self) -> Column:
        return F.array(*self.items)

    def cast(self, dtype: str) -> V:
        return V([c.cast(dtype) for c in self.items], dtype)

    # ---- combination --------------------------------------------------------

    def _other(self, other) -> V:
        if isinstance(other, V):
            if other.dtype != self.dtype:
                raise TypeError(f"value types differ: {self.dtype} and {other.dtype}")
            return other
        if isinstance(other, Column):
            return V([other.cast(self.dtype)], self.dtype)
        if isinstance(other, Number) and not isinstance(other, complex):
            return V([_literal(other, self.dtype)], self.dtype)
        raise TypeError(f"cannot combine a vector with {type(other).__name__}")

    def _zip(self, other: V, op: Callable[[Column, Column], Column]) -> V:
        n, m = len(self), len(other)
        return V([op(self.items[i % n], other.items[i % m]) for i in range(max(n, m))],
                 self.dtype)

    def _each(self, op: Callable[[Column], Column]) -> V:
        return V([op(c) for c in self.items], self.dtype)

    def __add__(self, other) -> V:
        return self._zip(self._other(other), lambda a, b: a + b)

    def __radd__(self, other) -> V:
        return self._other(other) + self

    def __sub__(self, other) -> V:
        return self._zip(self._other(other), lambda a, b: a - b)

    def __rsub__(self, other) -> V:
        return self._other(other) - self

    def __mul__(self, other) -> V:
        return self._zip(self._other(other), lambda a, b: a * b)

    def __rmul__(self, other) -> V:
        return self._other(other) * self

    def __neg__(self) -> V:
        return self._each(lambda a: -a)

    # Division has two meanings.  Same-size vectors and scalar / vector give 0 for a
    # zero divisor; vector / scalar and vectors of different size follow IEEE.

    def __truediv__(self, other) -> V:
        if isinstance(other, V) and len(other) == len(self):
            return self.safe_div(other)
        return self.ieee_div(other)

    def __rtruediv__(self, other) -> V:
        return self._other(other).safe_div(self)

    def safe_div(self, other) -> V:
        """``a / b``, and 0 where ``b`` is 0."""
        zero = _literal(0, self.dtype)
        return self._zip(self._other(other),
                         lambda a, b: F.when(b == zero, zero).otherwise(self._quotient(a, b)))

    def ieee_div(self, other) -> V:
        """``a / b`` with ±inf and NaN for a zero divisor; bigint has neither and raises."""
        if self.dtype == "bigint":
            return self._zip(self._other(other), self._quotient)
        zero = _literal(0, self.dtype)

        # `/` raises on zero under ANSI mode, so zero divisors go through pow(b, -1),
        # which is the signed infinity.
        def divide(a: Column, b: Column) -> Column:
            return F.when(b == zero, (a * F.pow(b, F.lit(-1.0))).cast(self.dtype)).otherwise(
                self._quotient(a, b))

        return self._zip(self._other(other), divide)

    def _quotient(self, a: Column, b: Column) -> Column:
        if self.dtype == "bigint":
            return F.call_function("div", a, b)
        return (a / b).cast(self.dtype)

    def pow(self, other) -> V:
        return self._zip(self._other(other), lambda a, b: F.pow(a, b).cast(self.dtype))

    def __pow__(self, other) -> V:
        return self.pow(other)

    def __rpow__(self, other) -> V:
        return self._other(other).pow(self)

    # ---- element-wise functions ---------------------------------------------

    def exp(self) -> V:
        return self._each(lambda a: F.exp(a).cast(self.dtype))

    def abs(self) -> V:
        return self._each(F.abs)

    def __abs__(self) -> V:
        return self.abs()

    def sign(self) -> V:
        """-1, 0 or 1; NaN and both zeros give 0."""
        zero = F.lit(0.0)
        return self._each(
            lambda a: (F.nanvl(F.signum(a), zero) + zero).cast(self.dtype))

    def norm(self) -> V:
        """Euclidean length of the whole flattened row."""
        total = self.items[0] * self.items[0]
        for c in self.items[1:]:
            total = total + c * c
        return V([F.sqrt(total).cast(self.dtype)], self.dtype)

    # ---- masks ---------------------------------------------------------------

    def _mask(self, other, greater: bool) -> V:
        zero, one = _literal(0, self.dtype), _literal(1, self.dtype)

        def compare(a: Column, b: Column) -> Column:
            big, small = (a, b) if greater else (b, a)
            # Only the side that must be larger can make NaN win the comparison.
            guard, test = _not_nan(big, self.dtype), big > small
            return F.when(test if guard is None else guard & test, one).otherwise(zero)

        return self._zip(self._other(other), compare)

    def lt(self, other) -> V:
        """1 where less, else 0, in the value type."""
        return self._mask(other, greater=False)

    def gt(self, other) -> V:
        return self._mask(other, greater=True)

    def __lt__(self, other) -> V:
        return self.lt(other)

    def __gt__(self, other) -> V:
        return self.gt(other)

    # ---- closed set ----------------------------------------------------------

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        raise UnsupportedOperation(f"unsupported vector operation: {name}")

    def _refuse(self, *_):
        raise UnsupportedOperation("only < and > are defined on vectors")

    __le__ = __ge__ = __eq__ = __ne__ = _refuse
    __hash__ = None

    def __bool__(self):
        raise UnsupportedOperation("a vector has no truth value when the plan is built")

    def __repr__(self) -> str:
        return f"V(dim={len(self)}, dtype={self.dtype})"


def where(cond: V, x, y) -> V:
    """``x`` where ``cond`` is not 0 (NaN counts as not 0), else ``y``; all three cycle."""
    xs, ys = cond._other(x), cond._other(y)
    zero = _literal(0, cond.dtype)
    size = max(len(cond), len(xs), len(ys))
    return V([
        F.when(cond.items[i % len(cond)] != zero, xs.items[i % len(xs)])
        .otherwise(ys.items[i % len(ys)])
        for i in range(size)
    ], cond.dtype)
