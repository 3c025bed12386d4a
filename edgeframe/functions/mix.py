"""Repeatable pseudo-random numbers from a row id.

``rand(seed)`` depends on how rows are partitioned; these depend on the id, the seed
and the stream number only, and use plain BIGINT arithmetic that any SQL engine can
repeat.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
ROUNDS = ((48271, 11), (69621, 7), (39373, 13))


def _mixed(id_: Column, seed: int, stream: int) -> Column:
    p = F.lit(PRIME).cast("bigint")
    id_ = id_.cast("bigint")
    # Ids a multiple of PRIME apart start elsewhere, by a step that differs per stream.
    wrap = F.call_function("div", id_, p) * F.lit(7919 * (stream + 1)).cast("bigint")
    x = (id_ % p + wrap + F.lit(seed * 1_000_003 + stream * 7_919 + 1)) % p
    for factor, shift in ROUNDS:
        x = x * F.lit(factor).cast("bigint") % p
        x = x.bitwiseXOR(F.shiftright(x, shift)) % p
    return x


def mixed_index(id_: Column, n: int, seed: int, stream: int) -> Column:
    """An index in ``[0, n)``; two draws are joined so that n may exceed 2^31."""
    if n <= 0:
        raise ValueError("the index range must not be empty")
    low = _mixed(id_, seed, 2 * stream)
    if n <= PRIME:
        return low % F.lit(n).cast("bigint")
    high = _mixed(id_, seed, 2 * stream + 1)
    return (high * F.lit(PRIME).cast("bigint") + low) % F.lit(n).cast("bigint")


def mixed_unit(id_: Column, seed: int, stream: int) -> Column:
    """A value in ``[0, 1)``."""
    return _mixed(id_, seed, 2 * stream) / F.lit(float(PRIME))
