"""Edge-flow queries: lineitems join parts (part key) to parts (supplier key)."""

import functools

from pyspark.sql import functions as F

from edgeframe.functions import V
from edgeframe.operators import (
    Gather,
    edge_divergence,
    edge_interpolate,
    gather_many,
    gather_stored,
    hot_values,
    iterate,
    normalise,
    scatter_combine,
    scatter_sum,
    store_edges,
    weighted_update,
)
from edgeframe.plans.registry import Registry, table
from edgeframe.session import written_path
from edgeframe.sources import Snapshots, partition_by, restore, snapshot

queries = Registry()
SCALE = 4


@queries.query("""
SELECT l_orderkey, l_linenumber,
  (1 - l_discount) * a.p_retailprice + l_discount * b.p_retailprice AS p_retailprice_f,
  (1 - l_discount) * a.p_size + l_discount * b.p_size AS p_size_f
FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey""",
    "edge_interpolate")
def edge_interpolate_query(spark, d):
    faces = edge_interpolate(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                           "l_discount"),
        table(spark, d, "part"), ["p_retailprice", "p_size"], "l_discount",
        src="l_partkey", dst="l_suppkey", id="p_partkey")
    return faces.select("l_orderkey", "l_linenumber", "p_retailprice_f", "p_size_f")


_FLUX = """SELECT l_partkey AS k, sum(CAST(l_quantity * l_discount AS DECIMAL(28, 4))) AS a,
  sum(CAST(l_extendedprice AS DECIMAL(28, 4))) AS b FROM lineitem GROUP BY 1"""


@queries.query(f"""
SELECT p_partkey AS id, -CAST(coalesce(a, 0) AS DOUBLE) / p_size + 0.0 AS a,
  -CAST(coalesce(b, 0) AS DOUBLE) / p_size + 0.0 AS b
FROM part LEFT JOIN ({_FLUX}) ON k = p_partkey""", "edge_divergence")
def edge_divergence_query(spark, d):
    out = divergence(spark, d)
    return out.select("id", (F.col("a") + 0.0).alias("a"), (F.col("b") + 0.0).alias("b"))


def divergence(spark, d):
    return edge_divergence(table(spark, d, "lineitem"), "l_partkey", {
        "a": V.of("l_quantity") * V.of("l_discount"), "b": V.of("l_extendedprice")},
        table(spark, d, "part"), id="p_partkey", area="p_size", scale=SCALE)


@queries.query("""
WITH t AS (
  SELECT l_partkey AS k, CAST(l_quantity * l_discount AS DECIMAL(28, 4)) AS a,
    CAST(l_quantity AS DECIMAL(28, 4)) AS b FROM lineitem
  UNION ALL SELECT l_suppkey, CAST(l_quantity * l_tax AS DECIMAL(28, 4)), 0 FROM lineitem
  WHERE l_returnflag = 'R'),
s AS (SELECT k, sum(a) AS a, sum(b) AS b FROM t GROUP BY 1)
SELECT p_partkey AS id, -CAST(coalesce(a, 0) AS DOUBLE) / p_size + 0.0 AS a,
  -CAST(coalesce(b, 0) AS DOUBLE) / p_size + 0.0 AS b
FROM part LEFT JOIN s ON k = p_partkey""")
def combine_normalise(spark, d):
    edges, part = table(spark, d, "lineitem"), table(spark, d, "part")
    boundary = edges.where(F.col("l_returnflag") == "R")
    sums = scatter_combine([
        (edges, "l_partkey", {"a": V.of("l_quantity") * V.of("l_discount"),
                              "b": V.of("l_quantity")}),
        (boundary, "l_suppkey", {"a": V.of("l_quantity") * V.of("l_tax")}),
    ], part, id="p_partkey", scale=SCALE)
    out = normalise(sums, part.withColumnRenamed("p_partkey", "id"), ["a", "b"], "p_size")
    return out.select("id", (F.col("a") + 0.0).alias("a"), (F.col("b") + 0.0).alias("b"))


@queries.query(f"""
SELECT p_partkey AS id,
  a0 + (0.5::DOUBLE * (-coalesce(CAST(a AS DOUBLE), 0) / p_size)
        + 0.25::DOUBLE * (coalesce(CAST(n AS DOUBLE), 0) / p_size)) AS a,
  b0 + (0.5::DOUBLE * (-coalesce(CAST(b AS DOUBLE), 0) / p_size)
        + 0.25::DOUBLE * (coalesce(CAST(m AS DOUBLE), 0) / p_size)) AS b
FROM (SELECT *, p_retailprice AS a0, p_size * 2.0::DOUBLE AS b0 FROM part)
LEFT JOIN ({_FLUX}) ON k = p_partkey
LEFT JOIN (SELECT l_suppkey AS k2, sum(CAST(l_quantity AS DECIMAL(28, 4))) AS n,
  sum(CAST(l_tax AS DECIMAL(28, 4))) AS m FROM lineitem GROUP BY 1) ON k2 = p_partkey""",
    "weighted_update")
def weighted_update_query(spark, d):
    part = table(spark, d, "part")
    state = part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"),
                        (F.col("p_size") * 2.0).alias("b"))
    inflow = scatter_sum(table(spark, d, "lineitem"), "l_suppkey",
                         {"a": V.of("l_quantity"), "b": V.of("l_tax")}, part, id="p_partkey",
                         scale=SCALE)
    second = normalise(inflow, part.withColumnRenamed("p_partkey", "id"), ["a", "b"], "p_size",
                       negate=False)
    return weighted_update(state, [(0.5, divergence(spark, d)), (0.25, second)], ["a", "b"])


STEPS = 3


def _steps_sql() -> str:
    ctes = ["h0 AS (SELECT p_partkey AS id, p_retailprice AS h FROM part)"]
    for k in range(1, STEPS + 1):
        prev = f"h{k - 1}"
        ctes.append(f"""d{k} AS (SELECT l_partkey AS id,
  sum(CAST(round_even(0.001::DOUBLE * l_quantity * (b.h - a.h) * 1e4, 0) AS BIGINT)) AS s
  FROM lineitem JOIN {prev} a ON l_partkey = a.id JOIN {prev} b ON l_suppkey = b.id GROUP BY 1)""")
        ctes.append(f"""h{k} AS (SELECT id, h + 0.1::DOUBLE * coalesce(CAST(s AS DOUBLE) / 1e4, 0) AS h
  FROM {prev} LEFT JOIN d{k} USING (id))""")
    return f"WITH {', '.join(ctes)}"


PULL_EDGES = ["l_partkey", "l_suppkey", "l_quantity"]


def pull_step(spark, d, layout=None):
    """The prices of the parts, and a step that moves each towards its neighbours'."""
    start = table(spark, d, "part").select(F.col("p_partkey").alias("id"),
                                           F.col("p_retailprice").alias("h"))
    if layout is None:
        edges = table(spark, d, "lineitem").select(*PULL_EDGES)
        hot = hot_values(edges, PULL_EDGES[:2])     # the edges stay the same
        take = functools.partial(gather_many, edges, skew=hot)
    else:
        take = functools.partial(gather_stored, layout)

    def step(state):
        # The key of the sum last: the edges are summed where its gather has put them.
        ends = take([Gather(state, "l_suppkey", {"h_dst": "h"}),
                     Gather(state, "l_partkey", {"h_src": "h"})])
        pull = 0.001 * V.of("l_quantity") * (V.of("h_dst") - V.of("h_src"))
        change = scatter_sum(ends, "l_partkey", {"h": pull}, scale=SCALE)
        return weighted_update(state, [(0.1, change)], ["h"])

    return start, step


@queries.query(f"{_steps_sql()} SELECT id, h FROM h{STEPS}")
def iterate_k(spark, d):
    """Each part moves towards the parts its edges lead to, three times over."""
    start, step = pull_step(spark, d)
    return iterate(start, step, STEPS, checkpoint_every=1)


@queries.query(f"{_steps_sql()} SELECT id, h FROM h{STEPS}")
def iterate_bucketed(spark, d):
    """The steps of ``iterate_k`` on edges stored by part key: every step moves prices and
    sums only."""
    layout = store_edges(table(spark, d, "lineitem").select(*PULL_EDGES),
                         written_path(spark, "edges"), by="l_partkey", indices=["l_suppkey"])
    start, step = pull_step(spark, d, layout)
    return iterate(start, step, STEPS, checkpoint_every=1)


@queries.query("""
SELECT o_orderkey AS id, o_totalprice AS h, o_totalprice * 2 AS h2, p_size
FROM orders LEFT JOIN part ON p_partkey = o_orderkey""")
def snapshot_roundtrip(spark, d):
    """Save two state tables of one step, restore them, and bring them together."""
    orders = partition_by(table(spark, d, "orders"), "o_orderkey", ranges=True)
    state = {"orders": orders.select(F.col("o_orderkey").alias("id"),
                                     F.col("o_totalprice").alias("h")),
             "part": table(spark, d, "part").select("p_partkey", "p_size")}
    path = written_path(spark, "snapshots")
    snapshot(state, path, 10)
    back = restore(spark, path, 10, list(state))
    return back["orders"].join(back["part"], F.col("id") == F.col("p_partkey"), "left").select(
        "id", "h", (F.col("h") * 2).alias("h2"), "p_size")


_KEPT = "o_orderkey % 11 <> {k}"
_PRICE = "o_totalprice + CASE WHEN o_orderkey % 5 < {k} THEN {k} ELSE 0 END"


@queries.query(" UNION ALL ".join(f"""SELECT {k} AS step, o_orderkey AS id, {_PRICE.format(k=k)} AS h,
  p_size FROM orders LEFT JOIN part ON p_partkey = o_orderkey AND p_partkey % 4 <> {k}
  WHERE {_KEPT.format(k=k)}""" for k in range(4)))
def snapshot_delta(spark, d):
    """Two tables of four steps, of which every one changes, drops and brings back rows:
    each step restored from a base and deltas."""
    orders, part = table(spark, d, "orders"), table(spark, d, "part")
    log = Snapshots(spark, written_path(spark, "log"), {"orders": "id", "part": "p_partkey"},
                    deltas=2)
    for k in range(4):
        log.commit(k, {
            "orders": orders.where(_KEPT.format(k=k)).select(
                F.col("o_orderkey").alias("id"), F.expr(_PRICE.format(k=k)).alias("h")),
            "part": part.where(f"p_partkey % 4 <> {k}").select("p_partkey", "p_size")})
    steps = []
    for k in log.steps():
        back = log.restore(k)
        steps.append(back["orders"].join(back["part"], F.col("id") == F.col("p_partkey"), "left")
                     .select(F.lit(k).alias("step"), "id", "h", "p_size"))
    return functools.reduce(lambda a, b: a.union(b), steps)


@queries.query(_steps_sql() + " UNION ALL ".join(
    f" SELECT {k} AS step, id, h FROM h{k}" for k in range(1, STEPS + 1)))
def iterate_snapshots(spark, d):
    """The states of all steps, the last one included, saved as they are reached."""
    start, step = pull_step(spark, d)
    path = written_path(spark, "steps")
    iterate(start, step, STEPS, on_step=lambda k, state: snapshot({"h": state}, path, k))
    first, *rest = [restore(spark, path, k, ["h"])["h"].select(F.lit(k).alias("step"), "id", "h")
                    for k in range(1, STEPS + 1)]
    for r in rest:
        first = first.union(r)
    return first
