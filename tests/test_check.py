import math

import pytest
from pyspark.sql import functions as F

from edgeframe import check_schema, compare_close, compare_eps, compare_exact, validate_inputs
from edgeframe.functions import V
from edgeframe.operators import Gather, edge_map_reduce, input_faults
from edgeframe.plans import EdgeProgram

NAN = float("nan")


def table(spark, rows, schema="id long, v double"):
    return spark.createDataFrame(rows, schema)


def test_close(spark):
    a = table(spark, [(0, 1.0), (1, 0.0), (2, 100.0)])
    b = table(spark, [(0, 1.0), (1, 0.5), (2, 101.0)])
    r = compare_close(a, b, "id", ["v"]).first()
    assert (r["column"], r["max_abs"], r["mean_abs"], r["all_close"], r["unmatched"]) == (
        "v", 1.0, 0.5, False, 0)
    assert math.isclose(r["max_rel"], 0.5 / 1e-15)
    assert compare_close(a, b, "id", ["v"], atol=1.0).first()["all_close"]
    assert compare_close(a, b, "id", ["v"], rtol=1.0, atol=0.0).first()["all_close"]
    assert compare_close(a, a, "id", ["v"]).first()["all_close"]


def test_close_with_nan_infinity_missing_rows_and_nothing(spark):
    nan, inf = table(spark, [(0, NAN)]), table(spark, [(0, float("inf"))])
    assert not compare_close(nan, nan, "id", ["v"]).first()["all_close"]
    assert compare_close(inf, inf, "id", ["v"]).first()["all_close"]
    one, two = table(spark, [(0, 1.0)]), table(spark, [(0, 1.0), (1, 1.0)])
    for pair in ((one, two), (two, one)):
        r = compare_close(*pair, "id", ["v"]).first()
        assert r["unmatched"] == 1 and not r["all_close"]
    none = one.limit(0)
    assert compare_close(none, none, "id", ["v"]).first()["all_close"]


def test_exact(spark):
    a = table(spark, [(0, 5), (1, 6), (2, 7), (3, 8)], "id long, v long")
    b = table(spark, [(0, 5), (1, 9), (2, 7), (3, 8)], "id long, v long")
    r = compare_exact(a, b, "id", ["v"]).first()
    assert (r["same_type"], r["rows_a"], r["rows_b"], r["mismatches"], r["fraction"], r["max_abs"]) == (
        True, 4, 4, 1, 0.25, 3.0)
    c = b.select("id", F.col("v").cast("int").alias("v"))
    assert not compare_exact(a, c, "id", ["v"]).first()["same_type"]
    assert compare_exact(a.limit(0), b.limit(0), "id", ["v"]).first()["fraction"] == 0.0


def test_eps_reports_the_first_failing_row(spark):
    a = table(spark, [(i, float(i)) for i in range(10)])
    b = a.select("id", F.when(F.col("id").isin(7, 4), F.col("v") + 1e-3).otherwise(F.col("v")).alias("v"))
    r = compare_eps(a, b, "id", ["v"]).first()
    assert (r["passed"], r["failing"], r["first_id"], r["first_a"]) == (False, 2, 4, 4.0)
    r = compare_eps(a, b, "id", ["v"], eps=1e-2).first()
    assert r["passed"] and r["first_id"] is None


def test_inputs(spark):
    edges = spark.createDataFrame([(1, [1.0, 2.0]), (-1, [1.0]), (None, None)], "i long, v array<double>")
    got = {r["check"]: r["violations"] for r in validate_inputs(
        edges, values={"v": 2}, indices=["i"]).collect()}
    assert got == {"empty_edges": 0, "bad_value:v": 2, "null_index:i": 1, "negative_index:i": 1}
    empty = validate_inputs(edges.limit(0), values={"v": 2}, indices=["i"]).collect()
    assert {r["check"]: r["violations"] for r in empty}["empty_edges"] == 1
    with pytest.raises(TypeError):
        validate_inputs(edges, indices=["v"])
    mixed = spark.createDataFrame([(1.0, 2)], "a double, b long")
    with pytest.raises(TypeError):
        check_schema(mixed, ["a", "b"], [])


def test_arrays_are_compared_by_component(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0])], "id long, v array<double>")
    b = spark.createDataFrame([(1, [1.0, 2.5]), (2, [3.0, 4.0]), (3, [5.0, 6.0]), (4, [0.0])],
                              "id long, v array<double>")
    c = compare_close(a, b, "id", ["v"]).first()
    assert (c.max_abs, c.mean_abs, c.unmatched, c.all_close) == (0.5, 0.125, 1, False)
    assert compare_close(a, a, "id", ["v"]).first().all_close
    assert compare_exact(a, b, "id", ["v"]).first().mismatches == 3
    e = compare_eps(a, b, "id", ["v"]).first()
    assert (e.failing, e.first_id, e.first_a, e.first_b) == (3, 1, [1.0, 2.0], [1.0, 2.5])


@pytest.mark.parametrize("fine,coarse", [(1, 4), (4, 16), (1 << 10, 1 << 20)])
def test_ranges_give_what_comparing_all_rows_gives(spark, fine, coarse):
    from edgeframe.operators import compare_exact, compare_ranges

    a = spark.createDataFrame([(k, k * 2.0, None if k == 30 else k, [k]) for k in range(-5, 60)]
                              + [(None, 1.0, 1, [1])], "id bigint, x double, y bigint, z array<bigint>")
    b = spark.createDataFrame([(k, k * 2.0 + (k == 17), None if k == 30 else k, [k, 1] if k == 40 else [k])
                               for k in range(-4, 62)], "id bigint, x double, y bigint, z array<bigint>")
    for left, right in ((a, b), (a, a.where("id <> 8")), (b, b), (a.limit(0), b), (b, b.limit(0))):
        want = compare_exact(left, right, "id", ["x", "y", "z"])
        got = compare_ranges(left, right, "id", ["x", "y", "z"], fine=fine, coarse=coarse)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_equal_tables_have_no_ranges(spark):
    from edgeframe.operators.check import differing_ranges

    a = spark.range(5000).selectExpr("id", "id % 7 AS x")
    assert differing_ranges(a, a.repartition(3), "id", ["x"], fine=16, coarse=64).count() == 0
    b = a.selectExpr("id", "IF(id = 4001, 0, x) AS x")
    assert [r["range"] for r in differing_ranges(a, b, "id", ["x"], fine=16, coarse=64).collect()] \
        == [4001 // 16]


def test_inputs_of_a_job(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (None, 1, 1.0), (1, 9, 1.0), (1, None, 1.0), (0, -1, 3.0)],
                                  "r bigint, c bigint, w double")
    vertices = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 7.0)], "id bigint, x double")
    take = [Gather(vertices, "c", {"x": "x"}), Gather(vertices, "c", {"y": "x"})]
    found = {r["check"]: r["violations"] for r in input_faults(edges, take, keys=["r"]).collect()}
    assert found == {"null_index:c": 1, "negative_index:c": 1, "null_index:r": 1,
                     "negative_index:r": 0, "dangling_index:c": 2, "duplicate_vertex:c:id": 1}
    with pytest.raises(ValueError, match="dangling_index:c 2, duplicate_vertex:c:id 1"):
        edge_map_reduce(edges, take, reduce={"y": V.of("x")}, key="r", validate=True)

    class Job(EdgeProgram):
        def forward(self):
            x = self.selector("c")(self.vertices(vertices, "x"))
            self.output("y", self.reducer("r")(x * self.edge("w")))

    with pytest.raises(ValueError, match="null_index:r 1"):
        Job(edges).run(validate=True)
    vertices = vertices.where("x > 5")
    assert [tuple(r) for r in Job(edges.where("c = 1 and r = 0")).run(
        validate=True).rows["r"].collect()] == [(0, 12.0)]
