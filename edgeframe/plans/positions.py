"""Queries on row offsets, edge positions and running sums."""

from pyspark.sql import functions as F

from edgeframe.functions import V
from edgeframe.functions.mix import PRIME
from edgeframe.operators import (
    Gather,
    coo_to_csr_offsets,
    csr_to_coo,
    edge_position,
    gather_many,
    offset_pointer,
    position_owner,
    running_sum,
    segment_running_sum,
    segment_sum,
    spmv,
)
from edgeframe.plans.registry import EDGE_ORDER, EDGE_ORDER_SQL, Registry, row_count, table
from edgeframe.plans.sums import mix_sql
from edgeframe.session import written_path
from edgeframe.sources import random_csr, read_rows, store_rows

queries = Registry()
SCALE = 4

OFFSETS_SQL = """
d AS (SELECT unnest(range((SELECT max(o_orderkey) + 1 FROM orders))) AS r),
c AS (SELECT r, count(l_orderkey) AS n FROM d LEFT JOIN lineitem ON l_orderkey = r GROUP BY 1),
o AS (SELECT r, CAST(sum(n) OVER (ORDER BY r) - n AS BIGINT) AS s,
             CAST(sum(n) OVER (ORDER BY r) AS BIGINT) AS e FROM c)"""


def offsets(spark, d):
    return coo_to_csr_offsets(table(spark, d, "lineitem"), "l_orderkey",
                              row_count(spark, d, "orders", "o_orderkey"))


def placed(spark, d, *columns):
    keep = list(dict.fromkeys(["l_orderkey", *EDGE_ORDER, *columns]))
    return edge_position(table(spark, d, "lineitem").select(*keep), "l_orderkey", EDGE_ORDER)


@queries.query("SELECT CAST(max(l_orderkey) + 1 AS BIGINT) AS n FROM lineitem")
def infer_num_rows(spark, d):
    return table(spark, d, "lineitem").agg(
        (F.max("l_orderkey") + 1).cast("bigint").alias("n"))


@queries.query(f"""WITH {OFFSETS_SQL} SELECT r AS "row", s AS "start", e AS "end" FROM o""")
def csr_offsets(spark, d):
    return offsets(spark, d)


@queries.query(f"""WITH {OFFSETS_SQL} SELECT r AS "row", s AS "offset" FROM o
UNION ALL SELECT max(r) + 1, max(e) FROM o""")
def csr_pointer(spark, d):
    return offset_pointer(offsets(spark, d), row_count(spark, d, "orders", "o_orderkey"))


@queries.query("""
SELECT l_orderkey AS "row", CAST(row_number() OVER (ORDER BY l_orderkey) - 1 AS BIGINT) AS pos
FROM lineitem""", "csr_to_coo")
def csr_to_coo_query(spark, d):
    return csr_to_coo(offsets(spark, d), nnz=table(spark, d, "lineitem").count())


@queries.query(f"""
SELECT {EDGE_ORDER_SQL}, CAST(row_number() OVER (ORDER BY {EDGE_ORDER_SQL}) - 1 AS BIGINT) AS pos
FROM lineitem""", "edge_position")
def edge_position_query(spark, d):
    return placed(spark, d)


@queries.query("""
SELECT l_orderkey, l_orderkey AS "row",
  CAST(row_number() OVER (ORDER BY l_orderkey) - 1 AS BIGINT) AS pos FROM lineitem""",
    "position_owner")
def position_owner_query(spark, d):
    return position_owner(placed(spark, d).select("l_orderkey", "pos"), offsets(spark, d))


@queries.query(f"""
WITH {OFFSETS_SQL} SELECT r AS id, CAST(coalesce(a, 0) AS DOUBLE) AS a,
  CAST(coalesce(b, 0) AS DOUBLE) AS b FROM o LEFT JOIN (
  SELECT l_orderkey AS k, sum(CAST(l_extendedprice * l_discount AS DECIMAL(28, 4))) AS a,
    sum(CAST(l_quantity * l_tax AS DECIMAL(28, 4))) AS b FROM lineitem GROUP BY 1) ON k = r""",
    "segment_sum")
def segment_sum_query(spark, d):
    values = placed(spark, d, "l_discount", "l_tax").select(
        "pos", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    n = row_count(spark, d, "orders", "o_orderkey")
    starts = coo_to_csr_offsets(table(spark, d, "lineitem"), "l_orderkey", n)
    return segment_sum(values, starts, {
        "a": V.of("l_extendedprice") * V.of("l_discount"),
        "b": V.of("l_quantity") * V.of("l_tax")}, n=n, scale=SCALE)


@queries.query(f"""
SELECT {EDGE_ORDER_SQL},
  CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(28, 4))) OVER w, 0) AS DOUBLE) AS price_before,
  CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(28, 4))) OVER w, 0) AS DOUBLE) AS quantity_before
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {EDGE_ORDER_SQL}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "segment_running_sum")
def segment_running_sum_query(spark, d):
    return segment_running_sum(placed(spark, d), "l_orderkey", "pos", {
        "price_before": V.of("l_extendedprice"), "quantity_before": V.of("l_quantity")},
        scale=SCALE).drop("pos")


@queries.query("""
SELECT o_orderkey AS id, CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) OVER (ORDER BY o_orderkey)
  AS DOUBLE) AS running FROM orders""", "running_sum")
def running_sum_query(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return running_sum(orders, "id", {"running": V.of("o_totalprice")}, inclusive=True,
                       scale=2).select("id", "running")


@queries.query(f"""
WITH p AS (SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS rows,
                  (SELECT count(*) FROM lineitem) AS nnz),
cuts AS (SELECT row_number() OVER (ORDER BY c, i) AS r, c FROM (
  SELECT i, {mix_sql('i', 29, 0)} % ((SELECT nnz FROM p) + 1) AS c
  FROM (SELECT unnest(range((SELECT rows FROM p) - 1)) AS i))),
bounds AS (SELECT max(r) AS r, c FROM (SELECT r, c FROM cuts UNION ALL SELECT 0, 0) GROUP BY c),
e AS (SELECT i, {mix_sql('i', 29, 2)} % (SELECT max(p_partkey) + 1 FROM part) AS col,
  {mix_sql('i', 29, 4)} / {PRIME}::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE AS v
  FROM (SELECT unnest(range((SELECT nnz FROM p))) AS i)),
y AS (SELECT r, sum(CAST(round_even(v * p_retailprice * 1e4, 0) AS BIGINT)) AS y
  FROM e ASOF JOIN bounds ON e.i >= bounds.c JOIN part ON col = p_partkey GROUP BY r)
SELECT o_orderkey AS id, coalesce(CAST(y AS DOUBLE) / 1e4, 0) AS y
FROM orders LEFT JOIN y ON r = o_orderkey""", "random_csr")
def random_csr_query(spark, d):
    """A random system of a row per order and an edge per lineitem, applied to the parts."""
    nnz = table(spark, d, "lineitem").count()
    starts, edges = random_csr(spark, row_count(spark, d, "orders", "o_orderkey"),
                               row_count(spark, d, "part", "p_partkey"), nnz)
    coo = edges.join(csr_to_coo(starts, nnz=nnz), "pos")
    return spmv(coo, table(spark, d, "part"), value="v", x_value="p_retailprice",
                x_id="p_partkey", domain=table(spark, d, "orders"), id="o_orderkey", scale=SCALE)


@queries.query(f"""
SELECT {EDGE_ORDER_SQL}, p_retailprice AS price, s_acctbal AS balance,
  CAST(row_number() OVER (ORDER BY {EDGE_ORDER_SQL}) - 1 AS BIGINT) AS pos
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def edge_position_gathered(spark, d):
    """Positions of edges that already took values from two vertex tables."""
    edges = gather_many(table(spark, d, "lineitem").select("l_orderkey", *EDGE_ORDER), [
        Gather(table(spark, d, "part"), "l_partkey", {"price": "p_retailprice"}, id="p_partkey"),
        Gather(table(spark, d, "supplier"), "l_suppkey", {"balance": "s_acctbal"},
               id="s_suppkey")])
    return edge_position(edges, "l_orderkey", EDGE_ORDER)


SLICES = 4


@queries.query(f"""
SELECT {EDGE_ORDER_SQL}, CAST(row_number() OVER (ORDER BY {EDGE_ORDER_SQL}) - 1 AS BIGINT) AS pos,
  CAST(l_orderkey * {SLICES} // (SELECT max(o_orderkey) + 1 FROM orders) AS INTEGER) AS slice
FROM lineitem""", "read_rows")
def read_rows_query(spark, d):
    """All lineitems, stored in row order and read back in slices of rows with their positions."""
    path, n = written_path(spark, "rows"), row_count(spark, d, "orders", "o_orderkey")
    store_rows(table(spark, d, "lineitem").select("l_orderkey", *EDGE_ORDER), path, "l_orderkey",
               EDGE_ORDER)
    first, *rest = [read_rows(spark, path, -(-k * n // SLICES), -(-(k + 1) * n // SLICES), "pos")
                    .withColumn("slice", F.lit(k)) for k in range(SLICES)]
    for r in rest:
        first = first.union(r)
    return first
