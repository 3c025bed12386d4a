"""Queries that gather, map and sum: lineitems are edges, parts vertices, orders rows."""

from pyspark.sql import functions as F

from edgeframe.functions import V, array_map
from edgeframe.functions.mix import PRIME, ROUNDS
from edgeframe.operators import (
    Gather,
    check_index,
    count_by_row,
    edge_map,
    edge_map_reduce,
    gather,
    gather_many,
    gather_stored,
    global_array_sum,
    global_sum,
    input_faults,
    scatter_array_sum,
    scatter_combine,
    scatter_sum,
    spmm,
    spmv,
    store_edges,
    validate_inputs,
    weighted_update,
)
from edgeframe.operators.gather import hot_keys
from edgeframe.plans.program import EdgeProgram
from edgeframe.plans.registry import Registry, row_count, table
from edgeframe.session import written_path
from edgeframe.sources import collect_tensor, random_coo, zeros

queries = Registry()
SCALE = 4


def per_order(sums: dict[str, str], source: str = "lineitem JOIN part ON l_partkey = p_partkey",
              where: str = "") -> str:
    inner = ", ".join(f"sum(CAST({e} AS DECIMAL(28, 4))) AS {n}" for n, e in sums.items())
    outer = ", ".join(f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}" for n in sums)
    return f"""SELECT o_orderkey AS id, {outer} FROM orders LEFT JOIN (
  SELECT l_orderkey AS k, {inner} FROM {source} {where} GROUP BY 1) ON k = o_orderkey"""


@queries.query(per_order({"y": "p_retailprice * l_quantity"}), "spmv")
def spmv_orders(spark, d):
    return spmv(table(spark, d, "lineitem"), table(spark, d, "part"), row="l_orderkey",
                col="l_partkey", value="l_quantity", x_value="p_retailprice", x_id="p_partkey",
                domain=table(spark, d, "orders"), id="o_orderkey", scale=SCALE)


@queries.query(per_order({"price": "p_retailprice * l_quantity",
                          "size": "p_size * l_quantity"}), "spmm")
def spmm_orders(spark, d):
    return spmm(table(spark, d, "lineitem"), table(spark, d, "part"),
                {"price": "p_retailprice", "size": "p_size"}, row="l_orderkey", col="l_partkey",
                value="l_quantity", x_id="p_partkey", domain=table(spark, d, "orders"),
                id="o_orderkey", scale=SCALE)


def two_ends(spark, d):
    """Lineitems with price and size of the parts that part key and supplier key name."""
    return gather_many(table(spark, d, "lineitem"), end_gathers(spark, d))


def end_gathers(spark, d):
    part = table(spark, d, "part")
    return [Gather(part, "l_partkey", {"a_0": "p_retailprice", "a_1": "p_size"}, id="p_partkey"),
            Gather(part, "l_suppkey", {"b_0": "p_retailprice", "b_1": "p_size"}, id="p_partkey")]


_SIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "1"]
_TWO = "lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey"
_R = ["(a.p_retailprice + b.p_retailprice)", "CAST(a.p_size + b.p_size AS DOUBLE)"]


_TWO_MAPS = f"""
SELECT l_orderkey, l_linenumber, {_R[0]} + l_quantity AS by_pair_0, {_R[1]} + l_discount AS by_pair_1,
  {", ".join(f"{_R[i % 2]} + {c} AS by_six_{i}" for i, c in enumerate(_SIX))}
FROM {_TWO}"""


def two_maps(ends):
    r = V.of("a_0", "a_1") + V.of("b_0", "b_1")
    six = V.of(*_SIX[:5], F.lit(1.0))
    return edge_map(ends, {"by_pair": r + V.of("l_quantity", "l_discount"), "by_six": r + six},
                    ["l_orderkey", "l_linenumber"])


@queries.query(_TWO_MAPS)
def two_selectors_map(spark, d):
    return two_maps(two_ends(spark, d))


@queries.query(_TWO_MAPS)
def two_selectors_grid(spark, d):
    """The maps of ``two_selectors_map`` on lineitems stored in blocks of a grid of part keys
    and supplier keys."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", *_SIX[:5])
    layout = store_edges(lines, written_path(spark, "grid"), by=["l_partkey", "l_suppkey"])
    return two_maps(gather_stored(layout, end_gathers(spark, d)))


@queries.query(per_order({"r1": "0.5 * pow(p_size, 2) * l_quantity",
                          "r2": "0.5 * pow(p_size, 2) * l_tax"}))
def multi_reducer(spark, d):
    half_square = 0.5 * V.of("size") ** 2
    return edge_map_reduce(
        table(spark, d, "lineitem"),
        [Gather(table(spark, d, "part"), "l_partkey", {"size": "p_size"}, id="p_partkey")],
        reduce={"r1": half_square * V.of("l_quantity"), "r2": half_square * V.of("l_tax")},
        key="l_orderkey", domain=table(spark, d, "orders"), id="o_orderkey", scale=SCALE)


class PartPull(EdgeProgram):
    """Two gathers of one vertex tensor, a map of 2 and of 6, sums by row and in total."""

    def __init__(self, spark, d):
        super().__init__(table(spark, d, "lineitem"), keep=["l_orderkey", "l_linenumber"],
                         scale=SCALE)
        self.part, self.orders = table(spark, d, "part"), table(spark, d, "orders")

    def spread(self, r, *columns):
        return r + self.edge(*columns)

    def forward(self):
        x = self.vertices(self.part, "p_retailprice", "p_size", id="p_partkey")
        half = x.map(lambda v: 0.5 * v)
        r = self.selector("l_partkey")(x) + self.selector("l_suppkey")(half)
        y1 = self.spread(r, "l_quantity", "l_discount")
        y2 = self.spread(r, *_SIX[:5], F.lit(1.0))
        by_order = self.reducer("l_orderkey", self.orders, id="o_orderkey")
        self.output("y1", y1)
        self.output("y2", y2)
        self.output("r1", by_order(y1))
        self.output("r2", by_order(y2[5]))
        self.output("t", self.total(y1 * self.edge("l_discount")))


_H = ["(a.p_retailprice + 0.5::DOUBLE * b.p_retailprice)", "(a.p_size + 0.5::DOUBLE * b.p_size)"]


@queries.query(f"""
SELECT l_orderkey, l_linenumber, {_H[0]} + l_quantity AS y1_0, {_H[1]} + l_discount AS y1_1,
  {", ".join(f"{_H[i % 2]} + {c} AS y2_{i}" for i, c in enumerate(_SIX))}
FROM {_TWO}""")
def map_and_reduce_map(spark, d):
    return PartPull(spark, d).run().maps


@queries.query(per_order({"r1_0": f"{_H[0]} + l_quantity", "r1_1": f"{_H[1]} + l_discount",
                          "r2": f"{_H[1]} + 1"}, _TWO))
def map_and_reduce_red(spark, d):
    return PartPull(spark, d).run().rows["l_orderkey"]


def _exact(expr: str, name: str) -> str:
    return f"CAST(CAST(coalesce(sum(CAST({expr} AS DECIMAL(28, 4))), 0) AS VARCHAR) AS DOUBLE) AS {name}"


@queries.query(f"""
SELECT {_exact(f"({_H[0]} + l_quantity) * l_discount", "t_0")},
       {_exact(f"({_H[1]} + l_discount) * l_discount", "t_1")} FROM {_TWO}""")
def map_and_total(spark, d):
    return PartPull(spark, d).run().totals


@queries.query(f"""SELECT {_exact("p_retailprice * l_quantity", "total")}
FROM lineitem JOIN part ON l_partkey = p_partkey""", "global_sum")
def global_sum_query(spark, d):
    return edge_map_reduce(
        table(spark, d, "lineitem"),
        [Gather(table(spark, d, "part"), "l_partkey", {"price": "p_retailprice"}, id="p_partkey")],
        reduce={"total": V.of("price") * V.of("l_quantity")}, scale=SCALE)


@queries.query("SELECT " + ", ".join(_exact(f"l_quantity * {c}", f"t_{i}")
                                     for i, c in enumerate(_SIX)) + " FROM lineitem")
def global_sum_vec(spark, d):
    six = V.of(*_SIX[:5], F.lit(1.0))
    return global_sum(table(spark, d, "lineitem"), {"t": V.of("l_quantity") * six}, scale=SCALE)


@queries.query("""
SELECT label, CAST(i AS INTEGER) AS pos,
  CAST(sum(CAST(round_even(CAST(x AS DOUBLE) * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS v
FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)
GROUP BY 1, 2""")
def embedding_label_sums(spark, d):
    return global_array_sum(table(spark, d, "embeddings"), "embedding", "label", scale=6)


@queries.query("""
SELECT p_partkey AS id, CAST(i AS INTEGER) AS pos, CAST(coalesce(s, 0) AS DOUBLE) / 1e4 AS v
FROM (SELECT p_partkey, unnest(range(64)) AS i FROM part) LEFT JOIN (
  SELECT k, j, sum(CAST(round_even(CAST(x AS DOUBLE) * l_quantity * 1e4, 0) AS BIGINT)) AS s
  FROM (SELECT l_partkey AS k, l_quantity, unnest(embedding) AS x, unnest(range(64)) AS j
        FROM lineitem JOIN embeddings ON l_suppkey = vec_id)
  GROUP BY 1, 2) ON k = p_partkey AND j = i""")
def wide_gather_scatter(spark, d):
    """Vectors of 64 gathered by supplier key, scaled per edge and summed by part."""
    edges = gather(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"),
                   table(spark, d, "embeddings"), "l_suppkey", {"vec": "embedding"}, id="vec_id",
                   near="l_partkey")
    scaled = array_map(F.col("vec"), lambda x: x.cast("double") * F.col("l_quantity"))
    return scatter_array_sum(edges, "l_partkey", scaled, 64, table(spark, d, "part"),
                             id="p_partkey", scale=SCALE)


@queries.query(per_order({"y": "(0.5 * p_retailprice + p_size) * l_quantity"},
                         where="WHERE l_returnflag = 'R'"))
def subset_gather_scatter(spark, d):
    """A computed vertex value, gathered by a subset of the edges, summed into all rows."""
    returned = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
    mixed = (0.5 * V.of("p_retailprice") + V.of("p_size")).column
    edges = gather(returned, table(spark, d, "part"), "l_partkey", {"x": mixed}, id="p_partkey")
    return scatter_sum(edges, "l_orderkey", {"y": V.of("x") * V.of("l_quantity")},
                       table(spark, d, "orders"), id="o_orderkey", scale=SCALE)


@queries.query("""
SELECT o_orderkey AS id, CAST(coalesce(c, 0) AS BIGINT) AS n FROM orders LEFT JOIN
  (SELECT l_orderkey AS k, count(*) AS c FROM lineitem GROUP BY 1) ON k = o_orderkey""",
    "count_by_row")
def count_by_row_query(spark, d):
    return count_by_row(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"),
                        id="o_orderkey")


_SHIFTED = "(l_partkey + 10 - 20 * (l_linenumber % 2))"


@queries.query(f"""
SELECT 'part' AS name, CAST(count(*) FILTER (l_partkey IS NULL) AS BIGINT) AS null_ids,
  CAST(count(*) FILTER (l_partkey < 0) AS BIGINT) AS negative_ids,
  CAST(count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) AS BIGINT) AS dangling_ids
FROM lineitem
UNION ALL
SELECT 'supplier', 0, count(*) FILTER ({_SHIFTED} < 0),
  count(*) FILTER ({_SHIFTED} NOT IN (SELECT s_suppkey FROM supplier)) FROM lineitem
UNION ALL
SELECT 'size', 0, count(*) FILTER ({_SHIFTED} < 0),
  count(*) FILTER ({_SHIFTED} < 0 OR {_SHIFTED} > (SELECT max(p_partkey) FROM part)) FROM lineitem
""", "check_index")
def check_index_query(spark, d):
    part = table(spark, d, "part")
    edges = table(spark, d, "lineitem").withColumn(
        "shifted", F.col("l_partkey") + 10 - 20 * (F.col("l_linenumber") % 2))
    results = {
        "part": check_index(edges, "l_partkey", vertices=part, id="p_partkey"),
        "supplier": check_index(edges, "shifted", vertices=table(spark, d, "supplier"),
                                id="s_suppkey"),
        "size": check_index(edges, "shifted", row_count(spark, d, "part", "p_partkey")),
    }
    first, *rest = [r.select(F.lit(n).alias("name"), "*") for n, r in results.items()]
    for r in rest:
        first = first.unionByName(r)
    return first


@queries.query("""
SELECT 'empty_edges' AS "check", CAST(count(*) = 0 AS BIGINT) AS violations FROM embeddings
UNION ALL SELECT 'bad_value:embedding',
  count(*) FILTER (embedding IS NULL OR len(embedding) <> 63) FROM embeddings
UNION ALL SELECT 'null_index:vec_id', count(*) FILTER (vec_id IS NULL) FROM embeddings
UNION ALL SELECT 'negative_index:vec_id', count(*) FILTER (vec_id < 0) FROM embeddings
""", "validate_inputs")
def validate_inputs_query(spark, d):
    """The vectors have 64 components; asking for 63 counts every row."""
    return validate_inputs(table(spark, d, "embeddings"), values={"embedding": 63},
                           indices=["vec_id"])


_LOST = """SELECT '{check}:{idx}' AS "check", count(*) AS violations
  FROM lineitem WHERE {where}"""


@queries.query(" UNION ALL ".join(
    _LOST.format(check=check, idx=idx, where=where.format(idx=idx))
    for idx in ("l_partkey", "l_suppkey", "l_orderkey")
    for check, where in (("null_index", "{idx} IS NULL"), ("negative_index", "{idx} < 0"))) + """
UNION ALL SELECT 'dangling_index:l_partkey', count(*) FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'duplicate_vertex:l_partkey:p_partkey', count(*) FROM (
  SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'dangling_index:l_suppkey', count(*) FROM lineitem
  WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'duplicate_vertex:l_suppkey:s_suppkey', count(*) FROM (
  SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 GROUP BY 1 HAVING count(*) > 1)""",
    "input_faults")
def input_faults_query(spark, d):
    """What a job over lineitems would lose without the suppliers that owe money."""
    paid = table(spark, d, "supplier").where("s_acctbal > 0")
    return input_faults(table(spark, d, "lineitem"), [
        Gather(table(spark, d, "part"), "l_partkey", {"price": "p_retailprice"}, id="p_partkey"),
        Gather(paid, "l_suppkey", {"balance": "s_acctbal"}, id="s_suppkey")],
        keys=["l_orderkey"])


@queries.query("""
SELECT n_nationkey::BIGINT AS id, coalesce(b, 0) AS balance FROM nation LEFT JOIN (
  SELECT c_nationkey AS k, CAST(sum(CAST(c_acctbal AS DECIMAL(28, 2))) AS DOUBLE) AS b
  FROM customer GROUP BY 1) ON k = n_nationkey""", "collect_tensor")
def collect_tensor_query(spark, d):
    """Balances by nation, one row for each of the nations, to the driver and back."""
    sums = scatter_sum(table(spark, d, "customer"), "c_nationkey", {"balance": V.of("c_acctbal")},
                       table(spark, d, "nation"), id="n_nationkey", scale=2)
    return spark.createDataFrame(collect_tensor(sums), sums.schema)


def mix_sql(id_: str, seed: int, stream: int) -> str:
    x = (f"(({id_}) % {PRIME} + (({id_}) // {PRIME}) * {7919 * (stream + 1)}"
         f" + {seed * 1_000_003 + stream * 7_919 + 1}) % {PRIME}")
    for factor, shift in ROUNDS:
        x = f"(({x}) * {factor} % {PRIME})"
        x = f"(xor({x}, {x} >> {shift}) % {PRIME})"
    return x


@queries.query(f"""
WITH e AS (SELECT {mix_sql('i', 17, 0)} % (SELECT max(o_orderkey) + 1 FROM orders) AS r,
    {mix_sql('i', 17, 2)} % (SELECT max(p_partkey) + 1 FROM part) AS c,
    {mix_sql('i', 17, 4)} / {PRIME}::DOUBLE AS v
  FROM (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS i))
SELECT o_orderkey AS id, CAST(coalesce(y, 0) AS DOUBLE) AS y FROM orders LEFT JOIN (
  SELECT r, sum(CAST(round_even(v * p_retailprice * 1e4, 0) AS BIGINT)) / 1e4::DOUBLE AS y
  FROM e JOIN part ON c = p_partkey GROUP BY 1) ON r = o_orderkey
""", "random_coo")
def random_coo_query(spark, d):
    """A random system as large as the lineitems, applied to the parts."""
    coo = random_coo(spark, row_count(spark, d, "orders", "o_orderkey"),
                     row_count(spark, d, "part", "p_partkey"),
                     table(spark, d, "lineitem").count(), {"value": 1}, selectors=1)
    return spmv(coo, table(spark, d, "part"), col="col_1", x_value="p_retailprice",
                x_id="p_partkey", domain=table(spark, d, "orders"), id="o_orderkey", scale=SCALE)


@queries.query(per_order({"v_0": "l_quantity", "v_1": "l_tax * l_quantity"}), "zeros")
def zeros_query(spark, d):
    """Accumulators that start at zero for each order id, after one update."""
    start = zeros(spark, row_count(spark, d, "orders", "o_orderkey"), 2)
    change = scatter_sum(table(spark, d, "lineitem"), "l_orderkey", {
        "v_0": V.of("l_quantity"), "v_1": V.of("l_tax") * V.of("l_quantity")}, scale=SCALE)
    return weighted_update(start, [(1.0, change)], ["v_0", "v_1"])


_FEW = "(l_partkey - 40 * (l_linenumber % 3))"


@queries.query(f"""
SELECT o_orderkey AS id, CAST(coalesce(y, 0) AS DOUBLE) AS y, CAST(coalesce(n, 0) AS BIGINT) AS n,
  CAST(coalesce(a, 0) - coalesce(n, 0) AS BIGINT) AS dropped
FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS a, count(p_partkey) AS n,
    sum(CAST(p_retailprice * l_quantity AS DECIMAL(28, 4))) AS y
  FROM lineitem LEFT JOIN part ON p_partkey = CASE WHEN l_linenumber = 4 THEN NULL ELSE {_FEW} END
  GROUP BY 1) ON k = o_orderkey""")
def gather_drop_invalid(spark, d):
    """Some part keys are null or name no part: kept and dropped edges of each order."""
    orders = table(spark, d, "orders")
    edges = table(spark, d, "lineitem").withColumn("few", F.when(
        F.col("l_linenumber") != 4, F.col("l_partkey") - 40 * (F.col("l_linenumber") % 3)))
    kept = gather(edges, table(spark, d, "part"), "few", {"price": "p_retailprice"},
                  id="p_partkey", on_missing="drop")
    sums = scatter_combine([
        (kept, "l_orderkey", {"y": V.of("price") * V.of("l_quantity"), "n": V.of(F.lit(1.0))}),
        (edges, "l_orderkey", {"a": V.of(F.lit(1.0))})], orders, id="o_orderkey", scale=SCALE)
    return sums.select("id", "y", F.col("n").cast("bigint").alias("n"),
                       (F.col("a") - F.col("n")).cast("bigint").alias("dropped"))


@queries.query(per_order({"y": "p_retailprice * l_quantity"}, """(SELECT *,
  CASE WHEN l_linenumber <= 2 THEN 3 ELSE l_partkey END AS k FROM lineitem)
  JOIN part ON k = p_partkey"""))
def gather_skewed(spark, d):
    """A third of the edges and more share one index value, which is spread over tasks."""
    edges = table(spark, d, "lineitem").withColumn(
        "k", F.when(F.col("l_linenumber") <= 2, F.lit(3)).otherwise(F.col("l_partkey")))
    hot = {"k": hot_keys(edges, "k", share=0.05, fraction=1.0)}
    met = gather(edges, table(spark, d, "part"), "k", {"price": "p_retailprice"},
                 id="p_partkey", skew=hot)
    return scatter_sum(met, "l_orderkey", {"y": V.of("price") * V.of("l_quantity")},
                       table(spark, d, "orders"), id="o_orderkey", scale=SCALE)
