"""Sums by row and over the whole table.

A row sum keeps every row of its domain: rows without an edge get 0.  The domain is
united with the edges before the one shuffle of the aggregation (each side is
pre-aggregated first), instead of being joined to its result afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeframe.functions.vec import V
from edgeframe.operators.assign import Expr, expand
from edgeframe.operators.check import require_inputs
from edgeframe.operators.gather import Gather, gather, gather_many

Domain = int | DataFrame | None
LOW_BITS = 20
SLICE = 16      # components of a wide array summed by one aggregation


def addend(c: Column, scale: int | None) -> Column:
    """A number to be summed, as a whole number of ``10^-scale`` when a scale is given.

    Floating sums depend on the order of addition, hence on the partitioning; whole
    numbers do not.  NaN, infinities and numbers beyond BIGINT raise.
    """
    if scale is None:
        return c
    return F.rint(c.cast("double") * F.lit(10.0 ** scale)).cast("bigint")


def total(c: Column, scale: int | None) -> Column:
    """The sum of addends, 0 over none.

    With a scale the high and low bits are summed apart, both as BIGINT: exact for sums
    up to 2^83 units over 2^43 rows, without decimal arithmetic per row.  A larger sum
    raises.
    """
    if scale is None:
        return F.coalesce(F.sum(c), F.lit(0))
    high = F.coalesce(F.sum(F.shiftright(c, LOW_BITS)), F.lit(0)).cast("decimal(20,0)")
    low = F.coalesce(F.sum(c.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint"))), F.lit(0))
    units = high * F.lit(1 << LOW_BITS) + low
    return units.cast("double") / F.lit(10.0 ** scale)


def _domain(edges: DataFrame, domain: int | DataFrame, id: str) -> DataFrame:
    if isinstance(domain, DataFrame):
        return domain.select(F.col(id).cast("bigint").alias("id"))
    if domain < 0:
        raise ValueError("the row count must not be negative")
    return edges.sparkSession.range(domain).select("id")


def scatter_sum(edges: DataFrame, key: str, sums: Mapping[str, Expr], domain: Domain = None, *,
                id: str = "id", scale: int | None = None, on_null: str = "raise") -> DataFrame:
    """``(id, sums…)``: the sums over the edges of each row.

    ``domain`` is the number of rows, or a table whose ``id`` column lists them; every
    row of it appears once and edges outside it do not count.  Without a domain only
    rows that have edges appear.  Vector sums expand to ``name_i``.  An edge without a row
    (null) fails the query; ``on_null="drop"`` leaves it out.
    """
    return scatter_combine([(edges, key, sums)], domain, id=id, scale=scale, on_null=on_null)


def _keyed(edges: DataFrame, key: str, on_null: str) -> tuple[DataFrame, Column]:
    """Edges and their row id as BIGINT."""
    row = F.col(key).cast("bigint")
    if on_null == "drop":
        return edges.where(F.col(key).isNotNull()), row
    if on_null != "raise":
        raise ValueError("on_null is 'raise' or 'drop'")
    return edges, F.coalesce(row, F.raise_error(F.lit(f"{key} is null")).cast("bigint"))


def _placed(edges: DataFrame, key: str, on_null: str) -> tuple[DataFrame, Column]:
    """``_keyed`` with the row id as a plain column: edges that a join has just placed by
    ``key`` are summed where they lie."""
    if on_null != "raise":
        return _keyed(edges, key, on_null)
    # Naming the task makes the check one that Spark neither moves below a join nor infers
    # for the other side of it.
    message = F.concat(F.lit(f"{key} is null, in task "), F.spark_partition_id().cast("string"))
    return edges.where(F.when(F.col(key).isNotNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean"))), F.col(key).cast("bigint")


def scatter_combine(parts: Sequence[tuple[DataFrame, str, Mapping[str, Expr]]],
                    domain: Domain = None, *, id: str = "id", scale: int | None = None,
                    on_null: str = "raise") -> DataFrame:
    """Row sums over several edge tables at once, e.g. inner and boundary edges.

    Sums of the same name add up; a table that lacks a name adds nothing to it.  All
    tables share one shuffle.
    """
    flats = [expand(sums) for _, _, sums in parts]
    names = list(dict.fromkeys(n for flat in flats for n in flat))
    if not names or "id" in names:
        raise ValueError("give at least one sum, and none named 'id'")
    pieces = []
    for (edges, key, _), flat in zip(parts, flats):
        edges, row = (_placed if domain is None else _keyed)(edges, key, on_null)
        pieces.append(edges.select(row.alias("id"),
                                   *[addend(flat[n], scale).alias(n) for n in flat]))
    aggs = [total(F.col(n), scale).alias(n) for n in names]
    if domain is None:
        return _union(pieces).groupBy("id").agg(*aggs)
    rows = _domain(parts[0][0], domain, id)
    if isinstance(domain, int):
        pieces = [p.where((F.col("id") >= 0) & (F.col("id") < domain)) for p in pieces]
        return _union([*pieces, rows]).groupBy("id").agg(*aggs)
    pieces = [p.withColumn("_row", F.lit(False)) for p in pieces]
    rows = rows.withColumn("_row", F.lit(True))
    return (_union([*pieces, rows]).groupBy("id").agg(F.max("_row").alias("_row"), *aggs)
            .where("_row").drop("_row"))


def _union(pieces: Sequence[DataFrame]) -> DataFrame:
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def global_sum(df: DataFrame, sums: Mapping[str, Expr], *, scale: int | None = None) -> DataFrame:
    """One row: the sums over all rows, 0 over none."""
    flat = expand(sums)
    addends = df.select(*[addend(c, scale).alias(n) for n, c in flat.items()])
    return addends.agg(*[total(F.col(n), scale).alias(n) for n in flat])


def global_array_sum(df: DataFrame, col: str, key: str | None = None, *,
                     scale: int | None = None) -> DataFrame:
    """Component-wise sums of a wide array column, as rows ``([key], pos, v)``."""
    keys = [] if key is None else [key]
    # In slices, like ``scatter_array_sum``; arrays may differ in length.
    cut = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(col) - 1, F.lit(SLICE))
                                 .cast("int")),
                      lambda k: F.slice(F.col(col), k * SLICE + 1, F.lit(SLICE)))
    names = [f"_x{i}" for i in range(SLICE)]
    parts = (df.where(F.size(col) > 0).select(*keys, F.posexplode(cut).alias("_slice", "_part"))
             .select(*keys, "_slice", F.size("_part").alias("_n"), *[
                 addend(F.get("_part", F.lit(i)).cast("double"), scale).alias(n)
                 for i, n in enumerate(names)]))
    summed = parts.groupBy(*keys, "_slice").agg(
        F.max("_n").alias("_n"), *[total(F.col(n), scale).alias(n) for n in names])
    long = summed.select(*keys, "_slice", F.posexplode(
        F.slice(F.array(*names), F.lit(1), F.col("_n"))).alias("_i", "v"))
    return long.select(*keys, (F.col("_slice") * SLICE + F.col("_i")).alias("pos"), "v")


def scatter_array_sum(edges: DataFrame, key: str, col: str | Column, dim: int,
                      domain: Domain = None, *, id: str = "id", scale: int | None = None,
                      on_null: str = "raise") -> DataFrame:
    """Row sums of a wide array column, as rows ``(id, pos, v)``; see ``scatter_sum``.

    Every row of the domain has ``dim`` components, 0 where there are no edges.  The
    arrays are summed in slices: one aggregation of all components is too large for code
    generation, one row per component three times slower.  One shuffle, pre-aggregated.
    """
    arr = F.col(col) if isinstance(col, str) else col
    slices = -(-dim // SLICE)
    cut = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)),
                      lambda k: F.slice(F.col("_arr"), k * SLICE + 1, F.lit(SLICE)))
    names = [f"_x{i}" for i in range(min(SLICE, dim))]
    whole = F.when(F.size(arr) == dim, arr).when(arr.isNotNull(), F.raise_error(F.concat(
        F.lit(f"an array of {dim} components is needed, not of "), F.size(arr).cast("string"))))
    keyed, row = _keyed(edges, key, on_null)
    parts = (keyed.select(row.alias("id"), whole.alias("_arr"))
             .select("id", F.posexplode(cut).alias("_slice", "_part"))
             .select("id", "_slice", F.lit(False).alias("_row"), *[
                 addend(F.get("_part", F.lit(i)).cast("double"), scale).alias(n)
                 for i, n in enumerate(names)]))
    sums = [total(F.col(n), scale).alias(n) for n in names]
    if domain is None:
        summed = parts.groupBy("id", "_slice").agg(*sums)
    else:
        rows = _domain(edges, domain, id).select(
            "id", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"),
            F.lit(True).alias("_row"))
        summed = (parts.unionByName(rows, allowMissingColumns=True).groupBy("id", "_slice")
                  .agg(F.max("_row").alias("_row"), *sums).where("_row"))
    long = summed.select("id", "_slice", F.posexplode(F.array(*names)).alias("_i", "v"))
    pos = F.col("_slice") * SLICE + F.col("_i")
    return long.select("id", pos.alias("pos"), "v").where(F.col("pos") < dim)


def component_arrays(long: DataFrame) -> DataFrame:
    """``(id, pos, v)`` to one array per id."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return long.groupBy("id").agg(F.transform(pairs, lambda p: p["v"]).alias("v"))


def count_by_row(edges: DataFrame, key: str, domain: Domain = None, *,
                 id: str = "id", name: str = "n") -> DataFrame:
    """Edges per row, 0 for rows without one."""
    return scatter_sum(edges, key, {name: V([F.lit(1).cast("bigint")], "bigint")}, domain, id=id)


def infer_num_rows(edges: DataFrame, key: str) -> int:
    """Largest row id plus 1; an empty table has no row count and raises."""
    top = edges.agg((F.max(key) + 1).cast("bigint").alias("n")).first()["n"]
    if top is None:
        raise ValueError("cannot infer the row count of an empty edge table")
    return top


def spmv(coo: DataFrame, x: DataFrame, *, row: str = "row", col: str = "col",
         value: str = "value", x_value: str = "x", x_id: str = "id",
         domain: Domain = None, id: str = "id", scale: int | None = None) -> DataFrame:
    """``y = A·x`` as ``(id, y)``."""
    return spmm(coo, x, {"y": x_value}, row=row, col=col, value=value, x_id=x_id,
                domain=domain, id=id, scale=scale)


def spmm(coo: DataFrame, x: DataFrame, columns: Mapping[str, str], *, row: str = "row",
         col: str = "col", value: str = "value", x_id: str = "id", domain: Domain = None,
         id: str = "id", scale: int | None = None) -> DataFrame:
    """``Y = A·X`` for several columns of X (output name → column) in one pass."""
    taken = {f"_x_{n}": c for n, c in columns.items()}
    on_edges = gather(coo.select(row, col, value), x, col, taken, id=x_id)
    sums = {n: V.of(value) * V.of(f"_x_{n}") for n in columns}
    return scatter_sum(on_edges, row, sums, domain, id=id, scale=scale)


def edge_map_reduce(edges: DataFrame, gathers: Sequence[Gather], *,
                    reduce: Mapping[str, Expr], key: str | None = None, domain: Domain = None,
                    id: str = "id", scale: int | None = None,
                    on_missing: str = "raise", validate: bool = False) -> DataFrame:
    """Gather, map and sum in one plan: by row with a ``key``, over everything without.

    ``validate`` runs ``require_inputs`` first.
    """
    if validate:
        require_inputs(edges, gathers, keys=[] if key is None else [key])
    on_edges = gather_many(edges, gathers, on_missing=on_missing)
    if key is None:
        return global_sum(on_edges, reduce, scale=scale)
    return scatter_sum(on_edges, key, reduce, domain, id=id, scale=scale)


def normalise(sums: DataFrame, weights: DataFrame, columns: Sequence[str], weight: str, *,
              id: str = "id", negate: bool = True, on_missing: str = "raise") -> DataFrame:
    """Each sum divided by its row's weight (0 for a zero weight), negated by default.

    A row without a weight fails the query; ``on_missing="drop"`` leaves it out instead.
    """
    if on_missing not in ("raise", "drop"):
        raise ValueError("on_missing is 'raise' or 'drop'")
    side = weights.select(F.col(id).alias("_wid"), F.col(weight).cast("double").alias("_w"))
    how = "inner" if on_missing == "drop" else "left"
    joined = sums.join(side, sums["id"] == side["_wid"], how)
    if how == "left":
        joined = joined.withColumn("_w", F.when(F.col("_wid").isNotNull(), F.col("_w")).otherwise(
            F.raise_error(F.lit("a row has no weight")).cast("double")))
    outs = []
    for c in columns:
        v = V.of(c)
        outs.append(((-v if negate else v) / V.of("_w")).column.alias(c))
    return joined.select("id", *outs)
