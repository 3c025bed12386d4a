"""Table operators: assignment, gather, sums, offsets, mesh geometry, flow, checks."""

from .assign import add_in_place, assign, assign_copy, edge_map
from .check import (
    check_schema,
    compare_close,
    compare_eps,
    compare_exact,
    compare_ranges,
    input_faults,
    require_inputs,
    validate_inputs,
)
from .flow import edge_divergence, edge_interpolate, iterate, weighted_update
from .gather import Gather, check_index, duplicate_ids, gather, gather_many, hot_values
from .layout import EdgeLayout, gather_stored, open_edges, store_edges
from .offsets import (
    coo_to_csr_offsets,
    csr_to_coo,
    edge_position,
    global_position,
    offset_pointer,
    position_owner,
    running_sum,
    segment_running_sum,
    segment_sum,
)
from .reduce import (
    component_arrays,
    count_by_row,
    edge_map_reduce,
    global_array_sum,
    global_sum,
    infer_num_rows,
    normalise,
    scatter_array_sum,
    scatter_combine,
    scatter_sum,
    spmm,
    spmv,
)

__all__ = [
    "EdgeLayout", "Gather", "add_in_place", "assign", "assign_copy", "check_index", "check_schema",
    "compare_close", "compare_eps", "compare_exact", "compare_ranges", "component_arrays",
    "coo_to_csr_offsets", "count_by_row",
    "csr_to_coo", "duplicate_ids", "edge_divergence", "edge_interpolate", "edge_map",
    "edge_map_reduce", "edge_position", "gather", "gather_many", "gather_stored", "global_array_sum",
    "global_position", "global_sum", "hot_values", "infer_num_rows", "input_faults", "iterate", "normalise",
    "offset_pointer", "open_edges", "position_owner", "require_inputs", "running_sum", "scatter_array_sum", "scatter_combine", "scatter_sum",
    "segment_running_sum", "segment_sum", "spmm", "spmv", "store_edges", "validate_inputs",
    "weighted_update",
]
