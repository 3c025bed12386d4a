"""Column-level functions: fixed-size vectors and their element-wise operators."""

from .arrays import (
    array_broadcast,
    array_component,
    array_flatten,
    array_map,
    array_norm,
    array_repeat_value,
)
from .mix import mixed_index, mixed_unit
from .vec import UnsupportedOperation, V, where

__all__ = [
    "UnsupportedOperation",
    "V",
    "array_broadcast",
    "array_component",
    "array_flatten",
    "array_map",
    "array_norm",
    "array_repeat_value",
    "mixed_index",
    "mixed_unit",
    "where",
]
