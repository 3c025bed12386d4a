"""Queries on vector expressions: projections of one table, no shuffle."""

from pyspark.sql import functions as F

from edgeframe.functions import V, array_broadcast, array_flatten, array_norm, where
from edgeframe.operators import add_in_place, assign, assign_copy, edge_map
from edgeframe.plans.registry import Registry, table
from edgeframe.sources import read_tensor, write_tensor
from edgeframe.session import written_path

queries = Registry()
KEYS = ["l_orderkey", "l_linenumber"]


def rounded(v: V, digits: int = 6) -> V:
    return V([F.round(c, digits) for c in v.items], v.dtype)


@queries.query("""
SELECT l_orderkey, l_linenumber,
  l_quantity + l_linenumber AS add_0, l_discount + l_tax AS add_1,
  l_quantity - l_linenumber AS sub_0, l_discount - l_tax AS sub_1,
  l_quantity * l_linenumber AS mul_0, l_discount * l_tax AS mul_1,
  -l_quantity AS neg_0, -l_discount AS neg_1,
  abs(l_quantity - 25) AS abs_0, abs(l_discount - 0.05::DOUBLE) AS abs_1,
  2 - l_quantity AS left_0, 2 - l_discount AS left_1,
  l_quantity * 7.5::DOUBLE AS filled_0, l_discount * 7.5::DOUBLE AS filled_1,
  CAST(l_linenumber + 2 AS BIGINT) AS mixed,
  CAST(CAST(l_extendedprice AS FLOAT) * 0.1::FLOAT AS DOUBLE) AS single
FROM lineitem
""")
def vec_arith(spark, d):
    a, b = V.of("l_quantity", "l_discount"), V.of("l_linenumber", "l_tax")
    whole = V.of("l_linenumber", dtype="bigint")
    return edge_map(table(spark, d, "lineitem"), {
        "add": a + b, "sub": a - b, "mul": a * b, "neg": -a,
        "abs": abs(a - V.of(F.lit(25), F.lit(0.05))),
        "left": 2 - a,
        "filled": a * V.fill(7.5, 2),
        "mixed": whole + 2.7,
        "single": (V.of("l_extendedprice", dtype="float") * 0.1).cast("double"),
    }, KEYS)


@queries.query("""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity / l_discount END AS q_0,
  CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice / (l_linenumber - 1) END AS q_1,
  CASE WHEN l_discount = 0 THEN 0 ELSE 3 / l_discount END AS s
FROM lineitem
""")
def safe_div(spark, d):
    top = V.of("l_quantity", "l_extendedprice")
    bottom = V.of("l_discount", F.col("l_linenumber") - 1)
    return edge_map(table(spark, d, "lineitem"),
                    {"q": top / bottom, "s": 3 / V.of("l_discount")}, KEYS)


_IEEE = """CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) AND {x} > 0 THEN '+inf'
  WHEN isinf({x}) THEN '-inf' ELSE 'finite' END"""


@queries.query(f"""
SELECT l_orderkey, l_linenumber,
  {_IEEE.format(x='q0')} AS kind_0, {_IEEE.format(x='q1')} AS kind_1,
  CASE WHEN isfinite(q0) THEN round(q0, 6) ELSE 0 END AS value_0,
  CASE WHEN isfinite(q1) THEN round(q1, 6) ELSE 0 END AS value_1
FROM (SELECT l_orderkey, l_linenumber, (l_tax - 0.04::DOUBLE) / l_discount AS q0,
             l_tax / l_discount AS q1 FROM lineitem)
""")
def ieee_div(spark, d):
    q = V.of(F.col("l_tax") - 0.04, "l_tax").ieee_div(V.of("l_discount"))
    edges = assign(table(spark, d, "lineitem"), "q", q)
    inf = F.lit(float("inf"))
    outs = []
    for i in range(2):
        x = F.col(f"q_{i}")
        outs.append(F.when(F.isnan(x), "nan").when(x == inf, "+inf").when(x == -inf, "-inf")
                    .otherwise("finite").alias(f"kind_{i}"))
        outs.append(F.when(F.isnan(x) | (F.abs(x) == inf), 0.0).otherwise(F.round(x, 6))
                    .alias(f"value_{i}"))
    return edges.select(*KEYS, *outs)


@queries.query("""
SELECT l_orderkey, l_linenumber,
  round(pow(l_quantity, 0.5), 6) AS root_0, round(pow(l_tax + 1, 0.5), 6) AS root_1,
  round(pow(l_quantity, l_discount), 6) AS mixed_0, round(pow(l_tax + 1, l_tax), 6) AS mixed_1,
  round(pow(2, l_linenumber), 6) AS two,
  round(exp(-l_discount), 6) AS e_0, round(exp(l_tax), 6) AS e_1,
  round(0.5 * pow(l_quantity, 2) * l_tax, 6) AS poly
FROM lineitem
""")
def pow_exp(spark, d):
    a, b = V.of("l_quantity", F.col("l_tax") + 1), V.of("l_discount", "l_tax")
    return edge_map(table(spark, d, "lineitem"), {
        "root": rounded(a ** 0.5),
        "mixed": rounded(a ** b),
        "two": rounded(2 ** V.of("l_linenumber")),
        "e": rounded((b * V.of(F.lit(-1.0), F.lit(1.0))).exp()),
        "poly": rounded(0.5 * V.of("l_quantity") ** 2 * V.of("l_tax")),
    }, KEYS)


@queries.query("""
SELECT l_orderkey, l_linenumber,
  CAST(sign(l_quantity - 25) AS DOUBLE) AS sgn,
  CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0.0::DOUBLE WHEN l_tax > 0 THEN 1 ELSE 0 END AS sgn_nan,
  CASE WHEN l_discount < 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS less_0,
  CASE WHEN l_tax < 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS less_1,
  CASE WHEN l_discount > l_tax THEN 1.0::DOUBLE ELSE 0 END AS more,
  CASE WHEN l_discount > l_tax THEN l_quantity ELSE l_extendedprice END AS pick_0,
  CASE WHEN l_discount > l_tax THEN l_linenumber ELSE l_extendedprice END AS pick_1,
  CASE WHEN l_discount < 0.05::DOUBLE THEN l_quantity ELSE -1.5::DOUBLE END AS pick_s
FROM lineitem
""")
def sign_masks_where(spark, d):
    quantity, price = V.of("l_quantity"), V.of("l_extendedprice")
    discount, tax = V.of("l_discount"), V.of("l_tax")
    both = V.of("l_discount", "l_tax")
    return edge_map(table(spark, d, "lineitem"), {
        "sgn": (quantity - 25).sign(),
        "sgn_nan": tax.ieee_div(discount).sign(),
        "less": both < 0.05,
        "more": discount > tax,
        "pick": where(discount > tax, V.of("l_quantity", "l_linenumber"), price),
        "pick_s": where(discount < 0.05, quantity, -1.5),
    }, KEYS)


@queries.query("""
SELECT l_orderkey, l_linenumber, l_quantity AS first, l_tax AS third,
  l_quantity AS copied, l_extendedprice * 2 + 1 AS l_extendedprice,
  l_extendedprice * 2 + 1 - l_discount AS after, 9.0::DOUBLE AS nine_0, 9.0::DOUBLE AS nine_1
FROM lineitem
""")
def assign_in_place(spark, d):
    values = V.of("l_quantity", "l_discount", "l_tax").reshape(3, 1).flatten()
    df = table(spark, d, "lineitem").select(
        *KEYS, "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        *values[0].clone().columns("first"), *values[:, 2].columns("third"),
        F.lit(0.0).alias("copied"))
    df = assign_copy(df, "copied", V.of("first"))
    df = assign(df, "l_extendedprice", V.of("l_extendedprice") * 2)
    df = add_in_place(df, "l_extendedprice", V.fill(1.0))
    df = assign(df, "after", V.of("l_extendedprice") - V.of("l_discount"))
    df = assign(df, "nine", V.fill(9, 2))
    return df.drop("l_quantity", "l_discount", "l_tax")


@queries.query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding,
         lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
  CAST(embedding[1] AS DOUBLE) AS v0, CAST(embedding[64] AS DOUBLE) AS v63
FROM embeddings
""")
def embedding_norm(spark, d):
    v = V.from_array("embedding", 64)
    return table(spark, d, "embeddings").select(
        "vec_id", rounded(v.norm()).column.alias("norm"), *v[0].columns("v0"),
        *v[63].columns("v63"))


@queries.query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(range(64),
         lambda i: pow(CAST(embedding[i + 1] AS DOUBLE) - [0.5, 0.25][i % 2 + 1], 2)))), 6) AS norm,
  CAST(len(embedding) AS INTEGER) AS size
FROM embeddings
""")
def embedding_broadcast(spark, d):
    """The array form: a pair cycles over 64 components."""
    wide = F.col("embedding").cast("array<double>")
    pair = F.array(F.lit(0.5), F.lit(0.25))
    moved = array_broadcast(wide, pair, lambda a, b: a - b, (64, 2))
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(array_norm(moved), 6).alias("norm"),
        F.size(array_flatten(F.array(moved))).alias("size"))


@queries.query("""
SELECT vec_id AS id, round(list_sum(list_transform(embedding,
  lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings
""")
def tensor_roundtrip(spark, d):
    """Read a named tensor as double, store it, and read it back."""
    v = read_tensor(spark, d, "embeddings", "double", id="vec_id", values={"v": "embedding"},
                    suffix=".parquet")
    path = written_path(spark, "tensors")
    write_tensor(v, path, "v")
    again = read_tensor(spark, path, "v", "double")
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    return again.select("id", F.round(total, 6).alias("total"))
