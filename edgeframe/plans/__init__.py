"""Plans put together from the operators: edge programs, the mesh job, the query suite."""

from .mesh_job import grid_mesh, mesh_job
from .program import EdgeProgram, ProgramResult
from .staged import Edges, Result, Tensor, Total, Vertices, run

__all__ = ["EdgeProgram", "Edges", "ProgramResult", "Result", "Tensor", "Total", "Vertices",
           "all_queries", "grid_mesh", "mesh_job", "run"]


def all_queries():
    """Every registered query by name."""
    from . import checks, flows, meshes, positions, stages, sums, vectors

    merged = {}
    for module in (vectors, sums, stages, positions, meshes, flows, checks):
        for name, q in module.queries.queries.items():
            if name in merged:
                raise ValueError(f"query {name!r} is registered twice")
            merged[name] = q
    return merged
