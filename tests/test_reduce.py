import math

import pytest
from pyspark.sql import functions as F

from edgeframe import (
    Gather, V, add_in_place, assign, assign_copy, count_by_row, component_arrays, edge_map, edge_map_reduce,
    global_array_sum, global_sum, infer_num_rows, normalise, random_coo, scatter_array_sum, scatter_combine,
    scatter_sum, spmm, spmv,
)


def by_id(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(
        [(0, 1.5, 1), (0, 2.5, 2), (2, -4.0, 3), (2, 4.0, 0), (7, 1.0, 1), (-1, 9.0, 1)],
        "row long, v double, c long")


def test_empty_rows_are_zero_and_outside_rows_do_not_count(spark, edges):
    want = {0: (4.0,), 1: (0.0,), 2: (0.0,), 3: (0.0,)}
    assert by_id(scatter_sum(edges, "row", {"s": V.of("v")}, 4)) == want
    assert by_id(scatter_sum(edges, "row", {"s": V.of("v")}, 4, scale=2)) == want
    domain = spark.createDataFrame([(0,), (5,)], "r int")
    assert by_id(scatter_sum(edges, "row", {"s": V.of("v")}, domain, id="r")) == {0: (4.0,), 5: (0.0,)}
    assert by_id(scatter_sum(edges, "row", {"s": V.of("v")})) == {
        0: (4.0,), 2: (0.0,), 7: (1.0,), -1: (9.0,)}
    assert by_id(scatter_sum(edges.limit(0), "row", {"s": V.of("v")}, 2)) == {0: (0.0,), 1: (0.0,)}


def test_one_shuffle_for_all_sums_of_a_key(edges):
    out = scatter_sum(edges, "row", {"a": V.of("v", "c"), "b": V.of("v") * V.of("v")}, 4, scale=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert out.columns == ["id", "a_0", "a_1", "b"]
    assert by_id(out)[2] == (0.0, 3.0, 32.0)


def test_scaled_sums_do_not_depend_on_order(spark):
    df = spark.range(5000).select(F.lit(0).cast("long").alias("k"),
                                  (F.col("id") * 0.01 - 12.34).alias("v"))
    sums = {scatter_sum(d, "k", {"s": V.of("v")}, scale=2).first()["s"]
            for d in (df, df.orderBy(F.desc("id")), df.repartition(7))}
    assert sums == {sum(i - 1234 for i in range(5000)) / 100}
    huge = spark.range(8).select(F.lit(9.0e14).alias("v"))
    assert global_sum(huge, {"s": V.of("v")}, scale=4).first()["s"] == 7.2e15
    with pytest.raises(Exception):
        global_sum(huge.select(F.lit(float("nan")).alias("v")), {"s": V.of("v")}, scale=2).collect()


def test_combine_edge_tables(spark, edges):
    more = spark.createDataFrame([(1, 10.0), (0, 1.0)], "cell long, w double")
    out = scatter_combine([(edges, "row", {"a": V.of("v"), "b": V.of("c")}),
                           (more, "cell", {"a": V.of("w")})], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert by_id(out) == {0: (5.0, 3), 1: (10.0, 0), 2: (0.0, 3)}


def test_sums_need_names(edges):
    for sums in ({}, {"id": V.of("v")}):
        with pytest.raises(ValueError):
            scatter_sum(edges, "row", sums, 2)
    with pytest.raises(ValueError):
        scatter_sum(edges, "row", {"s": V.of("v")}, -1)


def test_global_sums(spark, edges):
    assert tuple(global_sum(edges, {"t": V.of("v", "c")}).first()) == (14.0, 8.0)
    assert tuple(global_sum(edges.limit(0), {"t": V.of("v", "c")}, scale=2).first()) == (0.0, 0.0)
    wide = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])],
                                 "k string, v array<double>")
    out = {(r["k"], r["pos"]): r["v"] for r in global_array_sum(wide, "v", "k").collect()}
    assert out == {("a", 0): 4.0, ("a", 1): 6.0, ("b", 0): 5.0, ("b", 1): 6.0}
    assert {r["pos"]: r["v"] for r in global_array_sum(wide, "v", scale=1).collect()} == {0: 9.0, 1: 12.0}


def test_wide_row_sums(spark):
    edges = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (9, [5.0, 6.0])],
                                  "k long, v array<double>")
    for scale in (None, 2):
        long = scatter_array_sum(edges, "k", "v", 2, 3, scale=scale)
        assert by_id(component_arrays(long)) == {0: ([0.0, 0.0],), 1: ([4.0, 6.0],), 2: ([0.0, 0.0],)}
    assert by_id(component_arrays(scatter_array_sum(edges, "k", "v", 2))) == {
        1: ([4.0, 6.0],), 9: ([5.0, 6.0],)}


def test_arrays_wider_than_a_slice(spark):
    edges = spark.range(12).select((F.col("id") % 2).alias("k"), F.transform(
        F.sequence(F.lit(0), F.lit(36)), lambda i: i * F.col("id")).alias("v"))
    out = by_id(component_arrays(scatter_array_sum(edges, "k", "v", 37, 3)))
    assert out == {0: ([30.0 * i for i in range(37)],), 1: ([36.0 * i for i in range(37)],),
                   2: ([0.0] * 37,)}


def test_counts_and_row_number(edges):
    assert by_id(count_by_row(edges, "row", 3)) == {0: (2,), 1: (0,), 2: (2,)}
    assert infer_num_rows(edges, "row") == 8
    with pytest.raises(ValueError):
        infer_num_rows(edges.limit(0), "row")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matrix_products_match_a_loop(spark, seed):
    n, m = 13, 9
    coo = random_coo(spark, n, m, 150, {"value": 1}, seed=seed, selectors=1)
    x = spark.range(m).select("id", (F.col("id") + 1.0).alias("x"), (F.col("id") * -2.0).alias("z"))
    want = {r: [0.0, 0.0] for r in range(n)}
    for r in coo.collect():
        want[r["row"]][0] += r["value"] * (r["col_1"] + 1.0)
        want[r["row"]][1] += r["value"] * (r["col_1"] * -2.0)
    y = by_id(spmv(coo, x, col="col_1", domain=n))
    yz = by_id(spmm(coo, x, {"y": "x", "z": "z"}, col="col_1", domain=n))
    assert set(y) == set(want)
    for r, (a, b) in want.items():
        assert math.isclose(y[r][0], a, abs_tol=1e-9)
        assert math.isclose(yz[r][0], a, abs_tol=1e-9) and math.isclose(yz[r][1], b, abs_tol=1e-9)
    total = edge_map_reduce(coo, [Gather(x, "col_1", {"xe": "x"})],
                            reduce={"t": V.of("xe") * V.of("value")}).first()["t"]
    assert math.isclose(total, sum(a for a, _ in want.values()), abs_tol=1e-9)


def test_normalise_divides_safely(spark):
    sums = spark.createDataFrame([(0, 4.0), (1, 6.0)], "id long, s double")
    weights = spark.createDataFrame([(0, 2), (1, 0)], "id long, w int")
    assert by_id(normalise(sums, weights, ["s"], "w")) == {0: (-2.0,), 1: (0.0,)}
    assert by_id(normalise(sums, weights, ["s"], "w", negate=False)) == {0: (2.0,), 1: (0.0,)}


def test_assignment_is_sequential(spark):
    df = spark.createDataFrame([(1.0, 2)], "a double, b int")
    df = assign(df, "a", V.of("a") + 1)
    df = add_in_place(df, "b", V.of("a"))
    df = assign_copy(df, "b", V.of("b") * 2)
    df = assign(df, "c", V.of("a", "b"))
    assert df.dtypes == [("a", "double"), ("b", "int"), ("c_0", "double"), ("c_1", "double")]
    assert tuple(df.first()) == (2.0, 8, 2.0, 8.0)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        add_in_place(df, "missing", V.of("a"))
    with pytest.raises(ValueError):
        edge_map(df, {"x_0": V.of("a"), "x": V.of("a", "b")})
    assert edge_map(df, {"x": lambda d: V.of("a"), "y": F.col("b") + 1}, ["b"]).columns == ["b", "x", "y"]


def test_an_edge_without_a_row_raises_or_is_left_out(spark):
    edges = spark.createDataFrame([(1, 2.0, [1.0]), (None, 5.0, [3.0])],
                                  "row long, v double, w array<double>")
    for domain in (None, 2):
        for of in (lambda **on: scatter_sum(edges, "row", {"s": V.of("v")}, domain, **on),
                   lambda **on: scatter_array_sum(edges, "row", "w", 1, domain, **on)):
            with pytest.raises(Exception, match="row is null"):
                of().collect()
            assert of(on_null="drop").where("id = 1").count() == 1
    with pytest.raises(ValueError):
        scatter_sum(edges, "row", {"s": V.of("v")}, on_null="keep")
