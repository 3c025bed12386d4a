"""Queries of several stages, of several edge tables, and with all outputs of one traversal."""

from pyspark.sql import functions as F

from edgeframe.plans.registry import Registry, table
from edgeframe.plans.staged import Edges, Total, Vertices, run
from edgeframe.plans.sums import _H, _SIX, _TWO, SCALE, per_order

queries = Registry()


def _units(expr: str) -> str:
    return f"sum(CAST(round_even(({expr}) * 1e4, 0) AS BIGINT)) / 1e4::DOUBLE"


@queries.query(f"""
WITH parts AS (SELECT p_partkey, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE q / n END * p_size AS w
  FROM part LEFT JOIN (SELECT l_partkey AS k, sum(l_quantity) AS q, count(*)::DOUBLE AS n
    FROM lineitem GROUP BY 1) ON k = p_partkey)
SELECT o_orderkey AS id, coalesce(y, 0) AS y, coalesce(dev, 0) AS dev FROM orders LEFT JOIN (
  SELECT l_orderkey AS k, {_units("w * l_discount")} AS y, {_units("abs(w - l_quantity)")} AS dev
  FROM lineitem JOIN parts ON p_partkey = l_partkey GROUP BY 1) ON k = o_orderkey""")
def program_two_stage(spark, d):
    """The mean quantity of each part, weighed by a column of the part, back on its
    lineitems, and summed by order."""
    parts = Vertices("part", table(spark, d, "part"), "p_partkey")
    orders = Vertices("orders", table(spark, d, "orders"), "o_orderkey")
    lines = Edges("lineitem", table(spark, d, "lineitem"))
    quantity = lines.value("l_quantity")
    by_part = lines.sum("l_partkey", parts)
    mean = by_part(quantity) / by_part(lines.fill(1.0))
    weight = lines.gather("l_partkey")(mean * parts.value("p_size"))
    by_order = lines.sum("l_orderkey", orders)
    return run({"y": by_order(weight * lines.value("l_discount")),
                "dev": by_order(abs(weight - quantity))}, scale=SCALE).rows["orders"]


@queries.query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, coalesce(t, 0) AS t FROM orders LEFT JOIN (
    SELECT l_orderkey AS k, {_units("p_retailprice * l_quantity")} AS t
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON k = o_orderkey),
c AS (SELECT c_custkey, c_nationkey, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM customer LEFT JOIN (
    SELECT o_custkey AS k, {_units("t")} AS s, count(*)::DOUBLE AS n FROM o GROUP BY 1) ON k = c_custkey)
SELECT n_nationkey::BIGINT AS id, coalesce(spent, 0) AS spent, coalesce(mean, 0) AS mean
FROM nation LEFT JOIN (SELECT c_nationkey AS k, {_units("s")} AS spent,
  {_units("CASE WHEN n = 0 THEN 0 ELSE s / n END")} AS mean FROM c GROUP BY 1) ON k = n_nationkey""")
def program_two_tables(spark, d):
    """Lineitems summed to orders, orders as edges to customers, customers to nations."""
    read = {n: table(spark, d, n) for n in ("lineitem", "part", "orders", "customer", "nation")}
    parts = Vertices("part", read["part"], "p_partkey")
    orders = Vertices("orders", read["orders"], "o_orderkey")
    customers = Vertices("customer", read["customer"], "c_custkey")
    nations = Vertices("nation", read["nation"], "n_nationkey")
    lines, bought, lives = (Edges(n, read[n]) for n in ("lineitem", "orders", "customer"))
    price = lines.gather("l_partkey")(parts.value("p_retailprice"))
    worth = lines.sum("l_orderkey", orders)(price * lines.value("l_quantity"))
    by_customer = bought.sum("o_custkey", customers)
    spent = by_customer(bought.gather("o_orderkey")(worth))
    mean = spent / by_customer(bought.fill(1.0))
    at_home, by_nation = lives.gather("c_custkey"), lives.sum("c_nationkey", nations)
    return run({"spent": by_nation(at_home(spent)), "mean": by_nation(at_home(mean))},
               scale=SCALE).rows["nation"]


def _total(expr: str, name: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(28, 4))) AS DOUBLE) AS {name}"


@queries.query(f"""
WITH r AS ({per_order({"r1_0": f"{_H[0]} + l_quantity", "r1_1": f"{_H[1]} + l_discount",
                       "r2": f"{_H[1]} + 1"}, _TWO)}),
t AS (SELECT {_total(f"({_H[0]} + l_quantity) * l_discount", "t_0")},
  {_total(f"({_H[1]} + l_discount) * l_discount", "t_1")} FROM {_TWO})
SELECT l_orderkey, l_linenumber, {_H[0]} + l_quantity AS y1_0, {_H[1]} + l_discount AS y1_1,
  {", ".join(f"{_H[i % 2]} + {c} AS y2_{i}" for i, c in enumerate(_SIX))}, r1_0, r1_1, r2, t_0, t_1
FROM {_TWO} JOIN r ON r.id = l_orderkey, t""")
def map_and_reduce_all(spark, d):
    """Two maps, three row sums and two totals from one traversal of the lineitems; every
    lineitem with the sums of its order and the totals."""
    parts = Vertices("part", table(spark, d, "part"), "p_partkey")
    orders = Vertices("orders", table(spark, d, "orders"), "o_orderkey")
    lines = Edges("lineitem", table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    x = parts.value("p_retailprice", "p_size")
    r = lines.gather("l_partkey")(x) + lines.gather("l_suppkey")(0.5 * x)
    y1 = r + lines.value("l_quantity", "l_discount")
    y2 = r + lines.value(*_SIX[:5], F.lit(1.0))
    by_order = lines.sum("l_orderkey", orders)
    done = run({"y1": y1, "y2": y2, "r1": by_order(y1), "r2": by_order(y2[5]),
                "t": Total(y1 * lines.value("l_discount"))}, scale=SCALE, once=True)
    totals = done.totals.first()
    return done.maps["lineitem"].join(
        done.rows["orders"], F.col("l_orderkey") == F.col("id")).drop("id").select(
            "*", *[F.lit(totals[c]).alias(c) for c in ("t_0", "t_1")])
