import math

import pytest
from pyspark.sql import functions as F

from edgeframe.functions import (
    UnsupportedOperation, V, array_broadcast, array_component, array_map, array_norm,
    array_repeat_value, where,
)

NAN, INF = float("nan"), float("inf")


def values(spark, rows, outputs, schema="a double, b double"):
    df = spark.createDataFrame(rows, schema)
    cols = [c for name, v in outputs.items() for c in v.columns(name)]
    return [tuple(r) for r in df.select(*cols).collect()]


def test_arithmetic_and_scalars_on_both_sides(spark):
    a, b = V.of("a"), V.of("b")
    [row] = values(spark, [(6.0, 4.0)], {
        "s": a + b, "d": a - b, "m": a * b, "q": a / b, "n": -a, "ls": 2 - a, "lm": 2 * a,
        "lq": 3 / a, "rp": 2 ** b, "p": a ** 2, "c": a + F.col("b")})
    assert row == (10.0, 2.0, 24.0, 1.5, -6.0, -4.0, 12.0, 0.5, 16.0, 36.0, 10.0)


def test_vectors_cycle_over_the_longer_one(spark):
    pair, six = V.of("a", "b"), V.of(*[F.lit(float(i)) for i in range(6)])
    [row] = values(spark, [(10.0, 20.0)], {"s": pair + six, "d": six - pair})
    assert row[:6] == (10.0, 21.0, 12.0, 23.0, 14.0, 25.0)
    assert row[6:] == (-10.0, -19.0, -8.0, -17.0, -6.0, -15.0)


def test_zero_divisors(spark):
    a, b = V.of("a"), V.of("b")
    pair = V.of("a", "a")
    rows = values(spark, [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (3.0, 2.0)], {
        "same": a / b, "left": 1 / b, "mixed": pair / b, "ieee": a.ieee_div(b)})
    assert [r[0] for r in rows] == [0.0, 0.0, 0.0, 0.0, 1.5]
    assert [r[1] for r in rows] == [0.0, 0.0, 0.0, 0.0, 0.5]
    assert rows[0][2:] == (INF, INF, INF)
    assert rows[1][4] == -INF
    assert math.isnan(rows[2][4])
    assert rows[3][4] == -INF
    assert rows[4][2:] == (1.5, 1.5, 1.5)
    [by_scalar] = values(spark, [(5.0, 0.0)], {"q": a / 0})
    assert by_scalar == (INF,)


def test_sign_and_masks_with_nan_and_zeros(spark):
    a, b = V.of("a"), V.of("b")
    rows = values(spark, [(NAN, 0.0), (0.0, NAN), (-0.0, 0.0), (-3.0, 2.0), (5.0, 2.0), (NAN, NAN)],
                  {"s": a.sign(), "lt": a < b, "gt": a > b})
    assert rows == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (-1.0, 1.0, 0.0),
                    (1.0, 0.0, 1.0), (0.0, 0.0, 0.0)]
    assert math.copysign(1, rows[2][0]) == 1


def test_where_takes_nan_as_true_and_cycles(spark):
    rows = values(spark, [(NAN, 1.0), (0.0, 1.0), (2.0, 1.0)], {
        "w": where(V.of("a"), V.of("b", F.lit(7.0)), -1), "s": where(V.of("a"), 1, 2)})
    assert rows == [(1.0, 7.0, 1.0), (-1.0, -1.0, 2.0), (1.0, 7.0, 1.0)]


def test_norm_exp_abs_pow_of_vectors(spark):
    v = V.of("a", "b")
    [row] = values(spark, [(3.0, -4.0)], {"n": v.norm(), "a": abs(v), "p": v ** 2,
                                          "e": (v * 0).exp()})
    assert row == (5.0, 3.0, 4.0, 9.0, 16.0, 1.0, 1.0)


def test_bigint_keeps_its_type_and_truncates(spark):
    a = V.of("a", dtype="bigint")
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, 0)], "a long, b long")
    out = df.select(*(a + 2.9).columns("plus"), *(a / V.of("b", dtype="bigint")).columns("q"),
                    *(a ** 2).columns("p"), *a.sign().columns("s"))
    assert out.dtypes == [("plus", "bigint"), ("q", "bigint"), ("p", "bigint"), ("s", "bigint")]
    assert [tuple(r) for r in out.collect()] == [(9, 3, 49, 1), (-5, -3, 49, -1), (9, 0, 49, 1)]


def test_float_is_not_widened_by_scalars(spark):
    out = spark.createDataFrame([(0.1,)], "a float").select(
        *(V.of("a", dtype="float") * 0.1 + 1).columns("x"),
        *(V.of("a", dtype="float") ** 2).columns("y"))
    assert [t for _, t in out.dtypes] == ["float", "float"]


def test_closed_set(spark):
    v = V.of(F.lit(1.0), F.lit(2.0))
    with pytest.raises(TypeError):
        v + V.of(F.lit(1), dtype="bigint")
    with pytest.raises(TypeError):
        v + "text"
    with pytest.raises(ValueError):
        v.sqrt()
    with pytest.raises(UnsupportedOperation):
        v == v
    with pytest.raises(UnsupportedOperation):
        bool(v)
    with pytest.raises(UnsupportedOperation):
        v["x"]
    with pytest.raises(ValueError):
        v.reshape(3)
    with pytest.raises(ValueError):
        V.of("a", dtype="decimal")


def test_indexing_and_fill(spark):
    v = V.of("a", "b", F.lit(9.0))
    [row] = values(spark, [(1.0, 2.0)], {"i": v[1], "j": v[:, 2], "c": v[0].clone(),
                                         "f": V.fill(4, 2), "r": v.reshape(1, 3).flatten()})
    assert row == (2.0, 9.0, 1.0, 4.0, 4.0, 1.0, 2.0, 9.0)


def test_array_forms(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, 0.0],)], "v array<double>")
    row = df.select(
        array_norm(F.col("v")).alias("n"), array_component(F.col("v"), 1).alias("c"),
        array_map(F.col("v"), lambda x: x + 1).alias("m"),
        array_broadcast(F.col("v"), F.array(F.lit(1.0), F.lit(10.0)), lambda a, b: a * b,
                        (4, 2)).alias("b"),
        array_broadcast(F.col("v"), F.col("v"), lambda a, b: a + b, (4, 4)).alias("e"),
        array_repeat_value(2, 3).alias("f"),
        V.from_array("v", 4).array().alias("back"),
    ).first()
    assert row["n"] == 5.0 and row["c"] == 4.0
    assert row["m"] == [4.0, 5.0, 1.0, 1.0]
    assert row["b"] == [3.0, 40.0, 0.0, 0.0]
    assert row["e"] == [6.0, 8.0, 0.0, 0.0]
    assert row["f"] == [2.0, 2.0, 2.0] and row["back"] == [3.0, 4.0, 0.0, 0.0]


def test_an_array_of_another_length_raises(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "a array<double>")
    assert [tuple(r) for r in rows.select(*V.from_array("a", 2).columns("v")).collect()] == [
        (1.0, 2.0), (None, None)]
    with pytest.raises(Exception, match="2 components"):
        spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>").select(
            *V.from_array("a", 2).columns("v")).collect()
