"""Row offsets, edge positions and running sums.

Nothing here puts an unbounded group into one task.  Running sums work on blocks of
positions and sums of blocks; global positions come from a range-partitioned sort;
the rows that own a block's positions are found within the block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeframe.functions.vec import V
from edgeframe.operators.assign import Expr, expand
from edgeframe.operators.reduce import addend, count_by_row, scatter_sum
from edgeframe.session import leaf_bytes, sized_shuffles, written

BLOCK = 1 << 14             # positions per block: the most rows one window spans
ROWS_PER_TASK = 4_000_000   # rows one task generates when ranges are expanded
COARSE_BITS = 10            # 2^10 blocks to a coarse piece when long ranges are cut
LOCAL_BITS = 33             # low bits of monotonically_increasing_id: row within task


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _block(pos: Column, size: int) -> Column:
    return F.call_function("div", pos, _long(size))


# ---- running sums ----------------------------------------------------------------


def running_sum(df: DataFrame, pos: str, sums: Mapping[str, Expr], *, by: Sequence[str] = (),
                inclusive: bool = False, scale: int | None = None, block: int = BLOCK,
                limit: int | None = None) -> DataFrame:
    """``df`` plus running sums in the order of ``pos``, restarting for each ``by``.

    ``pos`` is a non-negative BIGINT, unique within ``by``; gaps are allowed.  A window
    never spans more than ``block`` positions: the totals of blocks are summed the same
    way one level up, until one block holds all.  ``limit`` bounds ``pos`` from above;
    it is measured when not given.
    """
    flat = expand(sums)
    if limit is None:
        top = df.agg(F.max(pos)).first()[0]
        limit = 1 if top is None else top + 1
    values = {f"_v_{n}": c if scale is None else addend(c, scale).cast("decimal(19,0)")
              for n, c in flat.items()}
    out = _running(df.withColumns(values), pos, list(values), list(by), inclusive, block, limit)

    def finished(c: Column) -> Column:
        return c if scale is None else c.cast("double") / F.lit(10.0 ** scale)

    results = [finished(F.col(f"_r_{v}")).alias(n) for n, v in zip(flat, values)]
    return out.select(*[c for c in df.columns if c not in flat], *results)


def _running(df: DataFrame, pos: str, values: list[str], by: list[str], inclusive: bool,
             block: int, limit: int, level: int = 0) -> DataFrame:
    b, last = f"_b{level}", 0 if inclusive else -1
    blocked = df.withColumn(b, _block(F.col(pos), block))
    w = Window.partitionBy(*by, b).orderBy(pos).rowsBetween(Window.unboundedPreceding, last)
    local = blocked.withColumns({f"_r_{v}": F.coalesce(F.sum(v).over(w), F.lit(0))
                                 for v in values})
    if limit <= block:
        return local.drop(b)
    totals = blocked.groupBy(*by, b).agg(*[F.sum(v).alias(v) for v in values])
    if by:
        # Most groups lie within one block and need no carry from earlier blocks.
        wide = (totals.groupBy(*by).agg(F.min(b).alias("_lo"), F.max(b).alias("_hi"))
                .where("_lo < _hi").select(*by))
        totals = totals.join(wide, by, "left_semi")
    before = _running(totals, b, values, by, False, block, -(-limit // block), level + 1)
    carry = before.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, b]],
                          *[F.col(f"_r_{v}").alias(f"_k_{v}") for v in values])
    met = local.join(carry, [F.col(c) == F.col(f"_k_{c}") for c in [*by, b]], "left")
    return met.select(*df.columns, *[
        (F.col(f"_r_{v}") + F.coalesce(F.col(f"_k_{v}"), F.lit(0))).alias(f"_r_{v}")
        for v in values])


def segment_running_sum(edges: DataFrame, key: str, pos: str, sums: Mapping[str, Expr], *,
                        scale: int | None = None, block: int = BLOCK,
                        limit: int | None = None) -> DataFrame:
    """Exclusive running sums that restart at each ``key``; one key may own any share."""
    return running_sum(edges, pos, sums, by=[key], scale=scale, block=block, limit=limit)


# ---- positions -------------------------------------------------------------------


def global_position(df: DataFrame, order_by: Sequence[str], pos: str = "pos", *,
                    name: str = "position") -> DataFrame:
    """``df`` plus each row's position (from 0) in the order of ``order_by``.

    Rows are sorted by ranges and stored with their number within the range; the sizes
    of the ranges, one small row each, then give every range its start.  Equal rows
    would fall into one range, so the number of the input task (which a task that is
    run again keeps) splits them; their order among each other is free.
    """
    order = [*order_by, "_split"]
    split = df.withColumn("_split", F.spark_partition_id())
    with sized_shuffles(df.sparkSession, leaf_bytes(df)):       # adaptive execution may merge
        ranged = split.repartitionByRange(*order).sortWithinPartitions(*order)
        stored = written(ranged.select(
            *df.columns,
            F.spark_partition_id().alias("_range"),
            F.monotonically_increasing_id().bitwiseAND(_long((1 << LOCAL_BITS) - 1)).alias("_at"),
        ), name)
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sizes.select("_range",
                          F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    # One row per range, as many as the sort has partitions.
    return stored.join(F.broadcast(starts), "_range").select(
        *df.columns, (F.col("_start") + F.col("_at")).alias(pos))


def edge_position(edges: DataFrame, key: str, tiebreak: Sequence[str],
                  pos: str = "pos") -> DataFrame:
    """Edges with their position in row order: by ``key``, then by ``tiebreak``."""
    return global_position(edges, [key, *tiebreak], pos)


# ---- offsets ---------------------------------------------------------------------


def coo_to_csr_offsets(edges: DataFrame, key: str, n: int, *, block: int = BLOCK) -> DataFrame:
    """``(row, start, end)`` for rows 0 … n-1; empty rows have ``start = end``.

    The positions are those of ``edge_position``: edges in row order.
    """
    counts = count_by_row(edges, key, n, name="_n").withColumnRenamed("id", "row")
    kept = counts.withColumn("_c", F.col("_n"))
    starts = running_sum(kept, "row", {"start": V([F.col("_c")], "bigint")},
                         block=block, limit=max(n, 1))
    return starts.select("row", F.col("start").cast("bigint").alias("start"),
                         (F.col("start") + F.col("_n")).cast("bigint").alias("end"))


def offset_pointer(offsets: DataFrame, n: int) -> DataFrame:
    """The n+1 offsets ``(row, offset)``; the last is the number of edges."""
    total = offsets.agg(_long(n).alias("row"), F.coalesce(F.max("end"), F.lit(0)).alias("offset"))
    return offsets.select("row", F.col("start").alias("offset")).unionByName(total)


def _cut(ranges: DataFrame, size: int) -> DataFrame:
    """Ranges ``(row, _lo, _hi)`` cut at multiples of ``size``."""
    k = F.explode(F.sequence(_block(F.col("_lo"), size), _block(F.col("_hi") - 1, size)))
    return ranges.select("row", "_lo", "_hi", k.alias("_k")).select(
        "row", F.greatest("_lo", F.col("_k") * size).alias("_lo"),
        F.least("_hi", (F.col("_k") + 1) * size).alias("_hi"))


def _pieces(offsets: DataFrame, block: int) -> DataFrame:
    """Non-empty ranges cut at block borders: ``(row, _b, _lo, _hi)``.

    Cut coarsely first, so that no array of borders grows long even for a row that owns
    most positions.
    """
    ranges = offsets.where(F.col("end") > F.col("start")).select(
        "row", F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    return _cut(_cut(ranges, block << COARSE_BITS), block).select(
        "row", _block(F.col("_lo"), block).alias("_b"), "_lo", "_hi")


def csr_to_coo(offsets: DataFrame, *, nnz: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(row, pos)`` for every edge position of every row.

    Ranges are cut into blocks and the blocks spread over tasks before they are
    expanded, so that a row owning most positions does not expand in one task.  ``nnz``,
    the number of positions, sets the number of tasks; it is measured when not given.
    """
    spark = offsets.sparkSession
    if nnz is None:
        nnz = offsets.agg(F.max("end")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-nnz // ROWS_PER_TASK))
    return (_pieces(offsets, block).repartition(tasks, "_b", "row")
            .select("row", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("pos")))


def position_owner(positions: DataFrame, offsets: DataFrame, pos: str = "pos", *,
                   block: int = BLOCK) -> DataFrame:
    """``positions`` plus the ``row`` whose range holds them; unowned positions drop out.

    Within a block of positions, the owner is the last range that began.  No range
    join: ranges and positions meet by block and are read in order once.  ``pos`` is
    unique, so a block holds a bounded number of both.
    """
    if "row" in positions.columns:
        raise ValueError("positions already have a row column")
    begun = _pieces(offsets, block).select(
        "_b", F.col("_lo").alias("_p"), F.lit(0).alias("_kind"),
        F.struct("row", "_hi").alias("_owner"))
    asked = positions.select(_block(F.col(pos), block).alias("_b"), F.col(pos).alias("_p"),
                             F.lit(1).alias("_kind"), F.struct(*positions.columns).alias("_own"))
    w = Window.partitionBy("_b").orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(begun, allowMissingColumns=True)
    owned = met.withColumn("_owner", F.last("_owner", ignorenulls=True).over(w))
    return (owned.where((F.col("_kind") == 1) & (F.col("_p") < F.col("_owner._hi")))
            .select("_own.*", F.col("_owner.row").alias("row")))


def segment_sum(values: DataFrame, offsets: DataFrame, sums: Mapping[str, Expr],
                pos: str = "pos", *, n: int | None = None, scale: int | None = None,
                block: int = BLOCK) -> DataFrame:
    """``(id, sums…)`` over the positions of each row's range; empty ranges give 0.

    With the number of rows ``n`` the offsets are read once, not again for their rows.
    """
    owned = position_owner(values, offsets, pos, block=block)
    return scatter_sum(owned, "row", sums, offsets if n is None else n, id="row", scale=scale)
