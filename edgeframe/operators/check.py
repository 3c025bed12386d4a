"""Validation of inputs and comparison of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.operators.gather import Gather, check_index, duplicate_ids
from edgeframe.session import written

REL_FLOOR = 1e-15   # added to |a| in relative differences


def _paired(a: DataFrame, b: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Both tables side by side by id; rows of only one side keep nulls on the other."""
    left = a.select(F.col(on).alias("_ia"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    right = b.select(F.col(on).alias("_ib"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    return left.join(right, F.col("_ia") == F.col("_ib"), "full_outer")


def _one_sided() -> Column:
    return F.col("_ia").isNull() | F.col("_ib").isNull()


def _is_array(a: DataFrame, b: DataFrame, c: str) -> bool:
    kinds = {isinstance(t.schema[c].dataType, T.ArrayType) for t in (a, b)}
    if len(kinds) > 1:
        raise TypeError(f"{c} is an array on one side only")
    return kinds.pop()


def _components(c: str) -> Column:
    """Array of (x, y): the components of two arrays as DOUBLE.

    Null where a side is missing or null, or the lengths differ.
    """
    x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
    return F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda p, q: F.struct(
        p.cast("double").alias("x"), q.cast("double").alias("y"))))


def _per_column(agg: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One aggregated row to one row per compared column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in columns])
    return agg.select(F.explode(rows).alias("_r")).select("_r.*")


def _gaps(x: Column, y: Column, rtol: float, atol: float) -> tuple[Column, Column, Column]:
    """Absolute and relative difference of two numbers, and whether they are close."""
    gap = F.abs(x - y)
    # `<` on a finite difference only: Spark orders NaN above infinity.
    near = (gap < F.lit(float("inf"))) & (gap <= F.lit(atol) + F.lit(rtol) * F.abs(y))
    close = F.coalesce(((x == y) & ~F.isnan(x)) | near, F.lit(False))
    return gap, gap / (F.abs(x) + F.lit(REL_FLOOR)), close


def compare_close(a: DataFrame, b: DataFrame, on: str, columns: Sequence[str], *,
                  rtol: float = 1e-10, atol: float = 1e-10) -> DataFrame:
    """Per column: largest and mean absolute and relative difference, and ``all_close``.

    Array columns are compared component by component; arrays of different length have no
    difference and fail.  Close means ``|a-b| ≤ atol + rtol·|b|``; NaN is close to nothing.
    Rows without a partner are counted and fail.
    """
    arrays = {c: _is_array(a, b, c) for c in columns}
    pairs = _paired(a, b, on, columns)
    # Differences of scalars are columns of their own, so each is computed once a row.
    pairs = pairs.withColumns({f"_{side}_{c}": F.col(f"_{side}_{c}").cast("double")
                               for c in columns if not arrays[c] for side in "ab"})
    pairs = pairs.withColumns({f"_{n}_{c}": v for c in columns if not arrays[c] for n, v in zip(
        ("gap", "rel", "close"), _gaps(F.col(f"_a_{c}"), F.col(f"_b_{c}"), rtol, atol))})
    aggs = []
    for c in columns:
        if arrays[c]:
            parts = F.transform(_components(c), lambda p: F.struct(*[
                v.alias(n) for n, v in zip(("gap", "rel", "close"),
                                           _gaps(p["x"], p["y"], rtol, atol))]))

            def most(n: str) -> Column:
                return F.max(F.array_max(F.transform(parts, lambda p: p[n])))

            def added(n: str) -> Column:
                return F.sum(F.aggregate(parts, F.lit(0.0),
                                         lambda s, p: s + F.coalesce(p[n], F.lit(0.0))))

            n = F.sum(F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + F.when(
                p["gap"].isNotNull(), 1).otherwise(0).cast("bigint")))
            close = F.forall(parts, lambda p: p["close"])
        else:
            def most(n: str, c: str = c) -> Column:
                return F.max(f"_{n}_{c}")

            def added(n: str, c: str = c) -> Column:
                return F.sum(f"_{n}_{c}")

            n, close = F.count(f"_gap_{c}"), F.col(f"_close_{c}")
        aggs += [
            F.coalesce(most("gap"), F.lit(0.0)).alias(f"max_abs__{c}"),
            F.when(n > 0, added("gap") / n).otherwise(0.0).alias(f"mean_abs__{c}"),
            F.coalesce(most("rel"), F.lit(0.0)).alias(f"max_rel__{c}"),
            F.when(n > 0, added("rel") / n).otherwise(0.0).alias(f"mean_rel__{c}"),
            F.count_if(_one_sided()).alias(f"unmatched__{c}"),
            F.coalesce(F.bool_and(F.coalesce(close, F.lit(False))), F.lit(True))
            .alias(f"all_close__{c}"),
        ]
    return _per_column(pairs.agg(*aggs), columns, (
        "max_abs", "mean_abs", "max_rel", "mean_rel", "unmatched", "all_close"))


def compare_exact(a: DataFrame, b: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Per column: same type, row counts, mismatches, their share, largest difference.

    Arrays match as wholes; their largest difference is over components."""
    pairs = _paired(a, b, on, columns)
    aggs = []
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        same_type = a.schema[c].dataType == b.schema[c].dataType
        rows_a, rows_b = F.count("_ia"), F.count("_ib")
        wrong = F.count_if(~F.coalesce(x == y, F.lit(False)))
        aggs += [
            F.lit(same_type).alias(f"same_type__{c}"),
            rows_a.alias(f"rows_a__{c}"), rows_b.alias(f"rows_b__{c}"),
            wrong.alias(f"mismatches__{c}"),
            F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(
                wrong / F.count(F.lit(1))).alias(f"fraction__{c}"),
            F.coalesce(F.max(F.array_max(F.transform(F.zip_with(x, y, lambda p, q: p - q), F.abs))
                             if _is_array(a, b, c) else F.abs(x - y)), F.lit(0))
            .cast("double").alias(f"max_abs__{c}"),
        ]
    return _per_column(pairs.agg(*aggs), columns, (
        "same_type", "rows_a", "rows_b", "mismatches", "fraction", "max_abs"))


def compare_eps(a: DataFrame, b: DataFrame, on: str, columns: Sequence[str], *,
                eps: float = 1e-5) -> DataFrame:
    """Per column: passed, number of rows off by more than ``eps``, and the first of them.

    A row of arrays is off if a component is, or if their lengths differ."""
    pairs = _paired(a, b, on, columns)
    aggs = []
    row = F.coalesce(F.col("_ia"), F.col("_ib"))
    for c in columns:
        is_array = _is_array(a, b, c)
        kind = "array<double>" if is_array else "double"
        x, y = F.col(f"_a_{c}").cast(kind), F.col(f"_b_{c}").cast(kind)
        within = F.forall(_components(c), lambda p: F.coalesce(
            F.abs(p["x"] - p["y"]) <= F.lit(eps), F.lit(False))) if is_array \
            else F.abs(x - y) <= F.lit(eps)
        fails = ~F.coalesce(within, F.lit(False))
        first = F.min(F.when(fails, F.struct(row.alias("id"), x.alias("a"), y.alias("b"))))
        aggs += [
            (F.count_if(fails) == 0).alias(f"passed__{c}"),
            F.count_if(fails).alias(f"failing__{c}"),
            first["id"].alias(f"first_id__{c}"),
            first["a"].alias(f"first_a__{c}"), first["b"].alias(f"first_b__{c}"),
        ]
    return _per_column(pairs.agg(*aggs), columns, (
        "passed", "failing", "first_id", "first_a", "first_b"))


def range_digests(table: DataFrame, on: str, columns: Sequence[str], size: int) -> DataFrame:
    """``(range, rows, nulls, digest)``: per ``size`` consecutive ids the number of rows, of
    those with a null, and a sum of row hashes, which does not depend on their order."""
    own = F.xxhash64(F.col(on), *[F.col(c) for c in columns]).cast("decimal(20,0)")
    null = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in (on, *columns)])
    return table.groupBy(_range_of(on, size).alias("range")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(null).alias("nulls"),
        F.sum(own).alias("digest"))


def _range_of(on: str, size: int) -> Column:
    return F.floor(F.col(on) / F.lit(size)).cast("bigint")


def differing_ranges(a: DataFrame, b: DataFrame, on: str, columns: Sequence[str], *,
                     fine: int = 1 << 10, coarse: int = 1 << 20) -> DataFrame:
    """Stored ``(range)``: the ranges of ``fine`` ids in which the tables differ.

    Digests of coarse ranges come from those of fine ranges; only coarse ranges that
    differ are opened.  Rows of an id that is null are range null.
    """
    if coarse % fine:
        raise ValueError("a coarse range holds whole fine ranges")
    sides = [written(range_digests(t, on, columns, fine), "digests") for t in (a, b)]
    step = coarse // fine
    tops = [s.groupBy(_range_of("range", step).alias("top")).agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "digest")]) for s in sides]
    open_tops = _unequal(*tops, "top")
    below = [s.join(open_tops, _range_of("range", step).eqNullSafe(F.col("top")), "left_semi")
             for s in sides]
    return written(_unequal(*below, "range"), "ranges")


def _unequal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose rows and digests are not the same on both sides, or that hold nulls, which
    equal nothing."""
    met = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")),
                            "full_outer")
    same = (F.col("a.rows").eqNullSafe(F.col("b.rows")) & (F.col("a.nulls") == 0)
            & F.col("a.digest").eqNullSafe(F.col("b.digest")))
    return met.where(~same).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key))


def compare_ranges(a: DataFrame, b: DataFrame, on: str, columns: Sequence[str], *,
                   fine: int = 1 << 10, coarse: int = 1 << 20) -> DataFrame:
    """The result of ``compare_exact`` for tables that are nearly equal: rows are joined only
    in ranges of ids whose digests differ, so equal tables cost one aggregation each.

    Ids are integers, unique on either side.  Two ranges whose 64-bit row hashes add up to
    the same number though they differ would be taken as equal.
    """
    for t in (a, b):
        check_schema(t, [], [on])
    rows = a.agg(F.count(on)).first()[0]
    ranges = differing_ranges(a, b, on, columns, fine=fine, coarse=coarse)
    if any(a.schema[c].dataType != b.schema[c].dataType for c in columns):
        return compare_exact(a, b, on, columns)
    parts = [t.join(ranges, _range_of(on, fine).eqNullSafe(F.col("range")), "left_semi")
             for t in (a, b)]
    found = compare_exact(*parts, on, columns)
    # Rows outside these ranges are on both sides and equal.
    equal = F.lit(rows).cast("bigint") - F.col("rows_a")
    pairs = F.when(F.col("fraction") > 0, F.rint(F.col("mismatches") / F.col("fraction"))).otherwise(
        F.lit(0.0)) + equal
    return found.select(
        "column", "same_type", (F.col("rows_a") + equal).alias("rows_a"),
        (F.col("rows_b") + equal).alias("rows_b"), "mismatches",
        F.when(F.col("mismatches") == 0, 0.0).otherwise(F.col("mismatches") / pairs)
        .alias("fraction"), "max_abs")


def check_schema(df: DataFrame, values: Sequence[str], indices: Sequence[str]) -> str:
    """The one value type of ``values``; raises on mixed values or non-integer indices."""
    kinds = {}
    for c in values:
        t = df.schema[c].dataType
        kinds[c] = (t.elementType if isinstance(t, T.ArrayType) else t).simpleString()
    if len(set(kinds.values())) > 1:
        raise TypeError(f"value columns differ in type: {kinds}")
    for c in indices:
        if df.schema[c].dataType.simpleString() not in ("bigint", "int"):
            raise TypeError(f"index column {c} is {df.schema[c].dataType.simpleString()}")
    return next(iter(kinds.values()), "double")


def validate_inputs(edges: DataFrame, *, values: Mapping[str, int] | None = None,
                    indices: Sequence[str] = ()) -> DataFrame:
    """``(check, violations)`` in one pass over the edges; the schema is checked first.

    ``values`` maps a value column to its vector length (1 for a scalar).
    """
    values = dict(values or {})
    check_schema(edges, list(values), indices)
    checks = {"empty_edges": (F.count(F.lit(1)) == 0).cast("bigint")}
    for c, dim in values.items():
        is_array = isinstance(edges.schema[c].dataType, T.ArrayType)
        size = F.size(c) if is_array else F.lit(1)
        bad = F.col(c).isNull() | (size != dim)
        checks[f"bad_value:{c}"] = F.count_if(bad)
    for c in indices:
        checks[f"null_index:{c}"] = F.count_if(F.col(c).isNull())
        checks[f"negative_index:{c}"] = F.count_if(F.col(c) < 0)
    one = edges.agg(F.array(*[
        F.struct(F.lit(k).alias("check"), v.cast("bigint").alias("violations"))
        for k, v in checks.items()]).alias("_all"))
    return one.select(F.explode("_all").alias("_r")).select("_r.*")


def input_faults(edges: DataFrame, gathers: Sequence[Gather], *,
                 keys: Sequence[str] = ()) -> DataFrame:
    """``(check, violations)`` of all that a job over ``edges`` reads: null and negative
    indices and rows, edges that name no vertex, vertex ids that several rows hold.

    One pass over the edges for the columns, one counted by value for each index.
    """
    indices = list(dict.fromkeys([*[g.idx for g in gathers], *keys]))
    found = validate_inputs(edges, indices=indices).where(F.col("check") != "empty_edges")
    sides = {(id(g.table), g.idx, g.id): g for g in gathers}
    for g in sides.values():
        lost = check_index(edges, g.idx, vertices=g.table, id=g.id)
        twice = duplicate_ids(g.table, g.id).agg(F.count(F.lit(1)).alias("n"))
        found = found.union(lost.select(F.lit(f"dangling_index:{g.idx}"), "dangling_ids")).union(
            twice.select(F.lit(f"duplicate_vertex:{g.idx}:{g.id}"), "n"))
    return found


def require_inputs(edges: DataFrame, gathers: Sequence[Gather], *,
                   keys: Sequence[str] = ()) -> None:
    """Raises ``ValueError`` with every kind of fault that ``input_faults`` counts."""
    faults = input_faults(edges, gathers, keys=keys).where("violations > 0").collect()
    if faults:
        raise ValueError("inputs are not valid: " + ", ".join(
            f"{r['check']} {r['violations']}" for r in sorted(faults)))
