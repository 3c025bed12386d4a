"""Tables in and out, and generated tables."""

from .generate import random_coo, random_csr, zeros
from .rows import read_offsets, read_rows, store_rows
from .snapshots import Snapshots
from .tensors import (
    collect_tensor,
    partition_by,
    read_tensor,
    restore,
    snapshot,
    write_tensor,
)

__all__ = [
    "Snapshots", "collect_tensor", "partition_by", "random_coo", "random_csr", "read_offsets",
    "read_rows", "read_tensor", "restore", "snapshot", "store_rows", "write_tensor", "zeros",
]
