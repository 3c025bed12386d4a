"""Repeated edge-to-vertex updates of a state table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeframe.functions.vec import V
from edgeframe.operators.assign import Expr
from edgeframe.operators.gather import Gather, Skew, gather_many
from edgeframe.operators.reduce import Domain, normalise, scatter_sum
from edgeframe.session import discard, written, written_path


def edge_interpolate(edges: DataFrame, vertices: DataFrame, columns: Sequence[str],
                     alpha: str | Column, *, src: str = "src", dst: str = "dst",
                     id: str = "id", suffix: str = "_f", skew: Skew = "auto") -> DataFrame:
    """``edges`` plus ``(1-alpha)·src + alpha·dst`` of each column, as ``<column>_f``.

    Two joins in all, however many columns.
    """
    both = gather_many(edges, [
        Gather(vertices, src, {f"_s_{c}": c for c in columns}, id=id),
        Gather(vertices, dst, {f"_d_{c}": c for c in columns}, id=id)], skew=skew)
    a = V.of(alpha)
    outs = [((1.0 - a) * V.of(f"_s_{c}") + a * V.of(f"_d_{c}")).column.alias(f"{c}{suffix}")
            for c in columns]
    return both.select(*edges.columns, *outs)


def edge_divergence(edges: DataFrame, key: str, fluxes: Mapping[str, Expr], areas: DataFrame, *,
                    id: str = "id", area: str = "area", domain: Domain = None,
                    scale: int | None = None) -> DataFrame:
    """``(id, fluxes…)``: minus the sum of each flux by row, divided by the row's area.

    The rows are those of ``areas`` unless ``domain`` says otherwise.
    """
    sums = scatter_sum(edges, key, fluxes, areas if domain is None else domain, id=id,
                       scale=scale)
    return normalise(sums, areas, [c for c in sums.columns if c != "id"], area, id=id)


def weighted_update(state: DataFrame, deltas: Sequence[tuple[float, DataFrame]],
                    columns: Sequence[str], *, id: str = "id") -> DataFrame:
    """``state + Σ w·delta`` column by column; a row without a delta keeps its value.

    The terms add in the given order, so the result does not depend on partitioning.
    Deltas that come from a row sum are already partitioned by id.
    """
    out = state
    total = {c: None for c in columns}
    for k, (w, delta) in enumerate(deltas):
        side = delta.select(F.col(id).alias(f"_id{k}"),
                            *[F.col(c).alias(f"_d{k}_{c}") for c in columns])
        out = out.join(side, out[id] == side[f"_id{k}"], "left")
        for c in columns:
            term = F.lit(float(w)) * F.coalesce(F.col(f"_d{k}_{c}"), F.lit(0.0))
            total[c] = term if total[c] is None else total[c] + term
    return out.select(*[
        (F.col(c) + total[c]).alias(c) if total.get(c) is not None else F.col(c)
        for c in state.columns])


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, *,
            checkpoint_every: int = 1, name: str = "state",
            on_step: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """``step`` applied ``n`` times.

    A step reads its state more than once, so an unbroken plan doubles with every
    step.  The state is therefore stored in the shared folder every
    ``checkpoint_every`` steps; a lost executor costs no more than those steps.
    ``on_step`` is called with every stored step and its state, e.g. to snapshot it.
    A stored state is deleted once the next one is stored, so ``on_step`` copies what it
    wants to keep; only the last one before step ``n`` stays.
    """
    if n < 0 or checkpoint_every < 1:
        raise ValueError("steps must not be negative, checkpoints at least one step apart")
    spark, last = state.sparkSession, None
    for k in range(1, n + 1):
        state = step(state)
        if k % checkpoint_every == 0 and k == n and on_step is not None:
            on_step(k, state)       # the result itself: not stored here, the caller reads it
        elif k % checkpoint_every == 0 and k < n:
            path = written_path(spark, f"{name}-{k}")
            state = written(state, name, path)
            if on_step is not None:
                on_step(k, state)
            if last is not None:
                discard(spark, last)
            last = path
    return state
