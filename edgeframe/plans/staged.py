"""Programs of several stages and tables.

    orders, parts = Vertices("orders", o, "o_orderkey"), Vertices("parts", p, "p_partkey")
    lines = Edges("lines", l)
    used = lines.sum("l_partkey", parts)(lines.value("l_quantity"))
    share = lines.value("l_quantity") / lines.gather("l_partkey")(used)
    result = run({"share": lines.sum("l_orderkey", orders)(share)})

Values belong to a space: one vector per edge of a table, or one per vertex.  Gathering
takes a vertex value to edges, summing takes an edge value to vertices, and a sum is a
vertex value like any other: it can be mapped, combined with columns of the vertices, and
gathered again.  Spaces, shapes, types and columns are checked while the program is
written, before any job.

``run`` cuts the graph behind its outputs into stages at the sums that are gathered again.
A stage joins an edge table once per vertex space and index that its sums need, and sums by
one key share one aggregation.  Sums that a later stage reads are stored in the shared
folder, so no stage repeats another.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from numbers import Number

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.functions.vec import V
from edgeframe.operators.gather import Gather, gather_many
from edgeframe.operators.reduce import addend, global_sum, scatter_sum, total
from edgeframe.session import written

_numbers = itertools.count()
SCALARS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
KEYS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Space:
    """A table whose rows hold values."""

    def __init__(self, name: str, table: DataFrame):
        self.name, self.table = name, table

    def value(self, *columns: str | Column, dtype: str = "double") -> Tensor:
        """Columns of the table as one vector per row."""
        for c in columns:
            if isinstance(c, str):
                self._column(c, SCALARS, "a number")
        v = V.of(*columns, dtype=dtype)
        self.table.select(*v.columns("v"))      # unknown columns fail here
        return Tensor(self, v)

    def fill(self, value: Number, dim: int = 1, dtype: str = "double") -> Tensor:
        return Tensor(self, V.fill(value, dim, dtype))

    def _column(self, name: str, kinds: tuple, what: str) -> None:
        if name not in self.table.columns:
            raise ValueError(f"{self.name} has no column {name!r}")
        if not isinstance(self.table.schema[name].dataType, kinds):
            raise TypeError(f"{self.name}.{name} is not {what}")


class Vertices(Space):
    """Vertices with a unique id."""

    def __init__(self, name: str, table: DataFrame, id: str = "id"):
        super().__init__(name, table)
        self._column(id, KEYS, "an id")
        self.id = id


class Edges(Space):
    """Edges with index and row columns, and columns to keep beside map outputs."""

    def __init__(self, name: str, table: DataFrame, keep: Sequence[str] = ()):
        super().__init__(name, table)
        self.keep = list(keep)

    def gather(self, index: str) -> Callable[[Tensor], Tensor]:
        """A vertex value at the vertex that ``index`` names, one per edge."""
        self._column(index, KEYS, "an index")

        def take(value: Tensor) -> Tensor:
            if not isinstance(value, Tensor) or not isinstance(value.space, Vertices):
                raise TypeError("a gather takes a vertex value")
            node = Gathered(next(_numbers), self, index, value)
            return Tensor(self, V([F.col(c) for c in node.columns], value.v.dtype), {node})

        return take

    def sum(self, key: str, over: Vertices) -> Callable[[Tensor], Tensor]:
        """The sum of an edge value over the edges of each vertex, 0 without any."""
        self._column(key, KEYS, "a row id")

        def add(value: Tensor) -> Tensor:
            if not isinstance(value, Tensor) or value.space is not self:
                raise ValueError(f"a sum over {self.name} takes a value of {self.name}")
            node = Summed(next(_numbers), self, key, over, value)
            return Tensor(over, V([F.col(c) for c in node.columns], value.v.dtype), {node})

        return add


class Tensor:
    """A vector per row of a space.  Operators are those of ``V``."""

    __slots__ = ("space", "v", "uses")
    __hash__ = None

    def __init__(self, space: Space, v: V, uses=frozenset()):
        self.space, self.v, self.uses = space, v, frozenset(uses)

    def __len__(self) -> int:
        return len(self.v)

    def __getitem__(self, index) -> Tensor:
        return Tensor(self.space, self.v[index], self.uses)

    def map(self, of: Callable[[V], V]) -> Tensor:
        return Tensor(self.space, of(self.v), self.uses)

    def with_(self, other, of: Callable[[V, V], V]) -> Tensor:
        """``of`` both vectors; ``other`` may be a number."""
        if isinstance(other, Tensor):
            if other.space is not self.space:
                raise ValueError(f"values of {self.space.name} and {other.space.name} do not "
                                 "meet; gather or sum one of them first")
            return Tensor(self.space, of(self.v, other.v), self.uses | other.uses)
        return Tensor(self.space, of(self.v, other), self.uses)

    def __add__(self, other): return self.with_(other, lambda a, b: a + b)
    def __radd__(self, other): return self.with_(other, lambda a, b: b + a)
    def __sub__(self, other): return self.with_(other, lambda a, b: a - b)
    def __rsub__(self, other): return self.with_(other, lambda a, b: b - a)
    def __mul__(self, other): return self.with_(other, lambda a, b: a * b)
    def __rmul__(self, other): return self.with_(other, lambda a, b: b * a)
    def __truediv__(self, other): return self.with_(other, lambda a, b: a / b)
    def __rtruediv__(self, other): return self.with_(other, lambda a, b: b / a)
    def __pow__(self, other): return self.with_(other, lambda a, b: a ** b)
    def __lt__(self, other): return self.with_(other, lambda a, b: a < b)
    def __gt__(self, other): return self.with_(other, lambda a, b: a > b)
    def __neg__(self): return self.map(lambda a: -a)
    def __abs__(self): return self.map(abs)
    def exp(self): return self.map(V.exp)
    def sign(self): return self.map(V.sign)
    def norm(self): return self.map(V.norm)


@dataclass(frozen=True, eq=False)
class Total:
    """The sum of an edge value over all edges."""

    value: Tensor


@dataclass(frozen=True, eq=False)
class Gathered:
    number: int
    space: Edges
    index: str
    value: Tensor

    @property
    def columns(self) -> list[str]:
        return self.value.v.names(f"_g{self.number}")

    @property
    def level(self) -> int:
        return level(self.value)


@dataclass(frozen=True, eq=False)
class Summed:
    number: int
    space: Edges
    key: str
    over: Vertices
    value: Tensor

    @property
    def columns(self) -> list[str]:
        return self.value.v.names(f"_s{self.number}")

    @property
    def level(self) -> int:
        return level(self.value) + 1


def level(value: Tensor) -> int:
    """Sums that lie one behind the other below a value."""
    return max((u.level for u in value.uses), default=0)


@dataclass
class Result:
    """``maps`` by edge table (kept columns and values), ``rows`` by vertex table (id and
    values), ``totals`` one row; ``stages`` the names of the sums of each stage."""

    maps: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, DataFrame] = field(default_factory=dict)
    totals: DataFrame | None = None
    stages: list[list[str]] = field(default_factory=list)


class _Plan:
    def __init__(self, scale: int | None):
        self.scale = scale
        self.sums: dict[Summed, DataFrame] = {}     # (id, columns) of a group of sums
        self.frames: dict[tuple, DataFrame] = {}

    def vertices(self, space: Vertices, uses: frozenset[Summed]) -> DataFrame:
        """The vertices with the columns of ``uses``, one join per table of sums."""
        tables = {id(self.sums[u]): self.sums[u] for u in sorted(uses, key=lambda u: u.number)}
        key = (space, *tables)
        if key not in self.frames:
            out = space.table
            for sums in tables.values():
                named = sums.withColumnRenamed("id", "_sum_id")
                out = out.join(named, F.col(space.id) == F.col("_sum_id"), "left").drop("_sum_id")
            self.frames[key] = out
        return self.frames[key]

    def edges(self, space: Edges, values: Sequence[Tensor]) -> DataFrame:
        """The edges with all that ``values`` have gathered, one join per vertices and index."""
        nodes = sorted(frozenset().union(*[v.uses for v in values]), key=lambda g: g.number)
        by_side: dict[tuple, list[Gathered]] = {}
        for g in nodes:
            by_side.setdefault((g.value.space, g.index), []).append(g)
        gathers = []
        for (vertices, index), gs in by_side.items():
            table = self.vertices(vertices, frozenset().union(*[g.value.uses for g in gs]))
            gathers += [Gather(table, index, dict(zip(g.columns, g.value.v.items)), vertices.id)
                        for g in gs]
        return gather_many(space.table, gathers)

    def stage(self, nodes: list[Summed], keep: set[Summed]) -> None:
        """The sums of one level; those in ``keep`` are read again and get stored."""
        by_space: dict[Edges, list[Summed]] = {}
        for s in nodes:
            by_space.setdefault(s.space, []).append(s)
        for space, sums in by_space.items():
            on_edges = self.edges(space, [s.value for s in sums])
            by_key: dict[tuple, list[Summed]] = {}
            for s in sums:
                by_key.setdefault((s.key, s.over), []).append(s)
            for (key, over), group in by_key.items():
                out = scatter_sum(on_edges, key, {f"_s{s.number}": s.value.v for s in group},
                                  over.table, id=over.id, scale=self.scale)
                if not keep.isdisjoint(group):
                    out = written(out, "sums")
                self.sums.update((s, out) for s in group)


def _below(values: Sequence[Tensor]) -> list[Summed]:
    """All sums that ``values`` depend on."""
    found: dict[Summed, None] = {}

    def walk(value: Tensor) -> None:
        for u in value.uses:
            if isinstance(u, Summed):
                if u in found:
                    continue
                found[u] = None
            walk(u.value)

    for v in values:
        walk(v)
    return sorted(found, key=lambda s: s.number)


def run(outputs: Mapping[str, Tensor | Total], *, scale: int | None = None,
        once: bool = False) -> Result:
    """The outputs: edge values as maps, vertex values as rows, totals in one row.

    With ``once`` an edge table with map outputs is traversed once for all outputs of the
    last stage: the maps and the addends of the sums and totals are written to the shared
    folder in one job, which also adds up the totals (``observe``, in the tasks that write,
    so a task that is run again counts once); row sums read what was written.
    """
    if not outputs:
        raise ValueError("a program needs an output")
    for name, out in outputs.items():
        if not isinstance(out, (Tensor, Total)):
            raise TypeError(f"output {name!r} is neither a value nor a total")
        if isinstance(out, Total) and not isinstance(out.value.space, Edges):
            raise TypeError(f"output {name!r} is not a total over edges")
    values = [o.value if isinstance(o, Total) else o for o in outputs.values()]
    sums = _below(values)
    plan, result = _Plan(scale), Result()
    again = {s for s in sums if s.level < max((t.level for t in sums), default=0)}
    again |= {s for v in values if isinstance(v.space, Edges) for s in _below([v])}
    maps = {n: o for n, o in outputs.items()
            if isinstance(o, Tensor) and isinstance(o.space, Edges)}
    totals = {n: o.value for n, o in outputs.items() if isinstance(o, Total)}
    for at in range(1, max((s.level for s in sums), default=0) + 1):
        nodes = [s for s in sums if s.level == at]
        result.stages.append([f"{s.space.name}.{s.key}" for s in nodes])
        late = [s for s in nodes if s not in again] if once else []
        plan.stage([s for s in nodes if s not in late], again)
        for space in dict.fromkeys(s.space for s in late):
            mine = [s for s in late if s.space is space]
            if any(m.space is space for m in maps.values()):
                _traverse(plan, result, space, maps, totals, mine)
            else:
                plan.stage(mine, again)
    for space in dict.fromkeys(m.space for m in maps.values()):
        if space.name not in result.maps:
            if once:
                _traverse(plan, result, space, maps, totals, [])
                continue
            mine = {n: m for n, m in maps.items() if m.space is space}
            on_edges = plan.edges(space, list(mine.values()))
            result.maps[space.name] = on_edges.select(
                *space.keep, *[c for n, m in mine.items() for c in m.v.columns(n)])
    rows = {n: o for n, o in outputs.items()
            if isinstance(o, Tensor) and isinstance(o.space, Vertices)}
    for space in dict.fromkeys(r.space for r in rows.values()):
        mine = {n: r for n, r in rows.items() if r.space is space}
        table = plan.vertices(space, frozenset().union(*[r.uses for r in mine.values()]))
        result.rows[space.name] = table.select(
            F.col(space.id).cast("bigint").alias("id"),
            *[c for n, r in mine.items() for c in r.v.columns(n)])
    open_totals = {n: t for n, t in totals.items()
                   if result.totals is None or n not in _names(result.totals, totals)}
    parts = [result.totals] if result.totals is not None else []
    for space in dict.fromkeys(t.space for t in open_totals.values()):
        mine = {n: t for n, t in open_totals.items() if t.space is space}
        parts.append(global_sum(plan.edges(space, list(mine.values())),
                                {n: t.v for n, t in mine.items()}, scale=scale))
    if parts:
        result.totals = _one_row(parts)
    return result


def _one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of one row each, with different columns, side by side."""
    if len(parts) == 1:
        return parts[0]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _names(table: DataFrame, totals: Mapping[str, Tensor]) -> set[str]:
    return {n for n, t in totals.items() if set(t.v.names(n)) <= set(table.columns)}


def _traverse(plan: _Plan, result: Result, space: Edges, maps: Mapping[str, Tensor],
              totals: Mapping[str, Tensor], sums: list[Summed]) -> None:
    """Writes the maps of ``space`` and the addends of its ``sums`` in one job, which adds
    up its totals."""
    mine = {n: m for n, m in maps.items() if m.space is space}
    added = {n: t for n, t in totals.items() if t.space is space}
    on_edges = plan.edges(space, [*mine.values(), *added.values(), *[s.value for s in sums]])
    keys = list(dict.fromkeys(s.key for s in sums))
    out = [F.col(c).alias(f"_keep_{k}") for k, c in enumerate(space.keep)]
    out += [F.col(k).alias(f"_key_{k}") for k in keys]
    out += [c for n, m in mine.items() for c in m.v.columns(n)]
    out += [c for s in sums for c in s.value.v.columns(f"_s{s.number}")]
    summed = {n: c for name, t in added.items() for n, c in zip(t.v.names(name), t.v.items)}
    out += [addend(c, plan.scale).alias(f"_t_{n}") for n, c in summed.items()]
    traversed = on_edges.select(*out)
    seen = Observation()
    if summed:
        traversed = traversed.observe(seen, *[
            total(F.col(f"_t_{n}"), plan.scale).alias(n) for n in summed])
    stored = written(traversed.drop(*[f"_t_{n}" for n in summed]) if summed else traversed, "edges")
    if summed:
        found = seen.get
        row = space.table.sparkSession.createDataFrame(
            [tuple(found[n] for n in summed)],
            ", ".join(f"`{n}` double" if plan.scale is not None or _dtype(added, n) != "bigint"
                      else f"`{n}` bigint" for n in summed))
        result.totals = row if result.totals is None else _one_row([result.totals, row])
    result.maps[space.name] = stored.select(
        *[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(space.keep)],
        *[F.col(c) for n, m in mine.items() for c in m.v.names(n)])
    by_key: dict[tuple, list[Summed]] = {}
    for s in sums:
        by_key.setdefault((s.key, s.over), []).append(s)
    for (key, over), group in by_key.items():
        addends = {f"_s{s.number}": V([F.col(c) for c in s.columns], s.value.v.dtype)
                   for s in group}
        got = scatter_sum(stored, f"_key_{key}", addends, over.table, id=over.id,
                          scale=plan.scale)
        plan.sums.update((s, got) for s in group)


def _dtype(added: Mapping[str, Tensor], column: str) -> str:
    return next(t.v.dtype for n, t in added.items() if column in t.v.names(n))
