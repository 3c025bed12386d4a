"""``EdgeProgram``: a user class whose ``forward`` becomes one DataFrame plan.

    class Revenue(EdgeProgram):
        def forward(self):
            price = self.selector("l_partkey")(
                self.vertices(part, "p_retailprice", id="p_partkey"))
            paid = price * self.edge("l_quantity") * (1.0 - self.edge("l_discount"))
            self.output("paid", paid)
            self.output("by_order", self.reducer("l_orderkey", orders, id="o_orderkey")(paid))

``forward`` runs once, on the driver, over column expressions.  Gathers of one vertex
table through one index become one join, sums by one key one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame

from edgeframe.functions.vec import V
from edgeframe.operators.assign import edge_map
from edgeframe.operators.check import require_inputs
from edgeframe.operators.gather import Gather, gather_many
from edgeframe.operators.reduce import Domain, global_sum, scatter_sum


@dataclass(frozen=True, eq=False)
class VertexTensor:
    """A vector per vertex: an expression over a vertex table."""

    table: DataFrame
    id: str
    value: V

    def map(self, fn) -> VertexTensor:
        """A value computed on the vertices, before any gather."""
        return VertexTensor(self.table, self.id, fn(self.value))


@dataclass(frozen=True, eq=False)
class RowSum:
    key: str
    domain: Domain
    id: str
    value: V


@dataclass(frozen=True, eq=False)
class TotalSum:
    value: V


@dataclass
class ProgramResult:
    """``maps``: one row per edge; ``rows[key]``: one per row; ``totals``: one row."""

    edges: DataFrame
    maps: DataFrame | None = None
    rows: dict[str, DataFrame] = field(default_factory=dict)
    totals: DataFrame | None = None

    def unpersist(self) -> None:
        self.edges.unpersist()


class EdgeProgram:
    """Subclass and write ``forward``; ``run`` gives the results as lazy DataFrames."""

    def __init__(self, edges: DataFrame, *, keep: Sequence[str] = (), scale: int | None = None):
        self.edges = edges
        self.keep = list(keep)
        self.scale = scale
        self._gathers: list[Gather] = []
        self._maps: dict[str, V] = {}
        self._row_sums: dict[str, RowSum] = {}
        self._totals: dict[str, V] = {}

    def forward(self) -> None:
        raise NotImplementedError("write forward()")

    # ---- what forward() may use ----------------------------------------------

    def vertices(self, table: DataFrame, *columns: str | Column, id: str = "id",
                 dtype: str = "double") -> VertexTensor:
        return VertexTensor(table, id, V.of(*columns, dtype=dtype))

    def edge(self, *columns: str | Column, dtype: str = "double") -> V:
        """Values already one per edge."""
        return V.of(*columns, dtype=dtype)

    def selector(self, idx: str):
        if idx not in self.edges.columns:
            raise ValueError(f"the edges have no index column {idx!r}")

        def take(tensor: VertexTensor) -> V:
            if not isinstance(tensor, VertexTensor):
                raise TypeError("a selector takes a vertex tensor")
            name = f"_g{len(self._gathers)}"
            columns = dict(zip(tensor.value.names(name), tensor.value.items))
            self._gathers.append(Gather(tensor.table, idx, columns, tensor.id))
            return V.of(*columns, dtype=tensor.value.dtype)

        return take

    def reducer(self, key: str, domain: Domain = None, *, id: str = "id"):
        if key not in self.edges.columns:
            raise ValueError(f"the edges have no row column {key!r}")
        return lambda value: RowSum(key, domain, id, value)

    def total(self, value: V) -> TotalSum:
        return TotalSum(value)

    def output(self, name: str, value: V | RowSum | TotalSum) -> None:
        if name in self._maps or name in self._row_sums or name in self._totals:
            raise ValueError(f"output {name!r} is written twice")
        if isinstance(value, RowSum):
            self._row_sums[name] = value
        elif isinstance(value, TotalSum):
            self._totals[name] = value.value
        elif isinstance(value, V):
            self._maps[name] = value
        else:
            raise TypeError(f"output {name!r} is not a vector, a row sum or a total")

    # ---- result ----------------------------------------------------------------

    def run(self, *, persist: bool = False, validate: bool = False) -> ProgramResult:
        """``persist`` keeps the gathered edges when several results will be read;
        ``validate`` runs ``require_inputs`` before anything else."""
        self._gathers, self._maps, self._row_sums, self._totals = [], {}, {}, {}
        self.forward()
        if validate:
            require_inputs(self.edges, self._gathers,
                           keys=list(dict.fromkeys(s.key for s in self._row_sums.values())))
        on_edges = gather_many(self.edges, self._gathers)
        if persist:
            on_edges = on_edges.persist(StorageLevel.MEMORY_AND_DISK)
        result = ProgramResult(on_edges)
        if self._maps:
            result.maps = edge_map(on_edges, self._maps, self.keep)
        by_key: dict[str, dict[str, RowSum]] = {}
        for name, s in self._row_sums.items():
            by_key.setdefault(s.key, {})[name] = s
        for key, sums in by_key.items():
            first = next(iter(sums.values()))
            if any(s.domain is not first.domain or s.id != first.id for s in sums.values()):
                raise ValueError(f"row sums by {key!r} must share one row domain")
            result.rows[key] = scatter_sum(
                on_edges, key, {n: s.value for n, s in sums.items()}, first.domain,
                id=first.id, scale=self.scale)
        if self._totals:
            result.totals = global_sum(on_edges, self._totals, scale=self.scale)
        return result
