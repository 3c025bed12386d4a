"""Comparison queries: the orders against a changed copy of themselves."""

from pyspark.sql import functions as F

from edgeframe.operators import compare_close, compare_eps, compare_exact, compare_ranges
from edgeframe.plans.registry import Registry, table

queries = Registry()
CHEAP, DEAR = 20_000, 400_000


def copies(spark, d):
    """Orders but the cheapest, and a copy without the dearest in which finished orders cost
    0.25 more and have another customer."""
    a = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.round("o_totalprice").alias("price"),
        (F.col("o_custkey") + 1).alias("cust"), "o_orderstatus")
    changed = F.col("o_orderstatus") == "F"
    b = a.select("id", F.when(changed, F.col("price") + 0.25).otherwise(F.col("price"))
                 .alias("price"),
                 F.when(changed, F.col("cust") + 3).otherwise(F.col("cust")).alias("cust"))
    return (a.where(F.col("price") >= CHEAP).drop("o_orderstatus"),
            b.where(F.col("price") < DEAR))


_PAIRS = f"""WITH s AS (SELECT o_orderkey AS id, round(o_totalprice) AS a,
  round(o_totalprice) + CASE WHEN o_orderstatus = 'F' THEN 0.25::DOUBLE ELSE 0 END AS b,
  o_custkey + 1 AS c, o_custkey + 1 + CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END AS e FROM orders),
l AS (SELECT id, a, c FROM s WHERE a >= {CHEAP}), r AS (SELECT id, b, e FROM s WHERE b < {DEAR}),
t AS (SELECT coalesce(l.id, r.id) AS id, l.id AS ia, r.id AS ib, a, b, c, e
  FROM l FULL JOIN r ON l.id = r.id)"""


def _close_sql(name: str, x: str, y: str) -> str:
    return f"""SELECT '{name}' AS "column", max(abs({x} - {y})) AS max_abs,
  round(avg(abs({x} - {y})), 9) AS mean_abs,
  round(max(abs({x} - {y}) / (abs({x}) + 1e-15)), 9) AS max_rel,
  round(avg(abs({x} - {y}) / (abs({x}) + 1e-15)), 9) AS mean_rel,
  count(*) FILTER (ia IS NULL OR ib IS NULL) AS unmatched,
  CAST(bool_and(coalesce(abs({x} - {y}) <= 1e-10 + 1e-10 * abs({y}), false)) AS INTEGER)
    AS all_close FROM t"""


@queries.query(f"{_PAIRS} {_close_sql('price', 'a', 'b')} UNION ALL {_close_sql('cust', 'c', 'e')}",
               "compare_close")
def compare_close_query(spark, d):
    return _rounded(compare_close(*copies(spark, d), "id", ["price", "cust"]))


def _rounded(out):
    return out.select("column", "max_abs", *[F.round(c, 9).alias(c) for c in (
        "mean_abs", "max_rel", "mean_rel")], "unmatched",
        F.col("all_close").cast("int").alias("all_close"))


@queries.query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (vec_id % 3 - 1) * 0.5::DOUBLE AS s
  FROM embeddings),
t AS (SELECT x, x + s AS y FROM e WHERE vec_id % 5 <> 4)
SELECT 'embedding' AS "column", max(abs(x - y)) AS max_abs, round(avg(abs(x - y)), 9) AS mean_abs,
  (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 4) AS unmatched, 0 AS all_close FROM t""")
def compare_vectors(spark, d):
    """The vectors against a copy that lacks a fifth of them and is shifted by -0.5, 0 or 0.5."""
    a = table(spark, d, "embeddings")
    shift = (F.col("vec_id") % 3 - 1) * F.lit(0.5)
    b = a.where(F.col("vec_id") % 5 != 4).select("vec_id", F.transform(
        "embedding", lambda x: x.cast("double") + shift).alias("embedding"))
    return _rounded(compare_close(a, b, "vec_id", ["embedding"])).drop("max_rel", "mean_rel")


_EXACT = _PAIRS + """
SELECT 'cust' AS "column", 1 AS same_type, count(ia) AS rows_a, count(ib) AS rows_b,
  count(*) FILTER (NOT coalesce(c = e, false)) AS mismatches,
  CAST(count(*) FILTER (NOT coalesce(c = e, false)) AS DOUBLE) / count(*) AS fraction,
  CAST(max(abs(c - e)) AS DOUBLE) AS max_abs FROM t
UNION ALL
SELECT 'id', 1, count(ia), count(ib), count(*) FILTER (NOT coalesce(ia = ib, false)),
  CAST(count(*) FILTER (NOT coalesce(ia = ib, false)) AS DOUBLE) / count(*), 0 FROM t"""


@queries.query(_EXACT, "compare_exact")
def compare_exact_query(spark, d):
    a, b = copies(spark, d)
    out = compare_exact(a, b, "id", ["cust", "id"])
    return out.withColumn("same_type", F.col("same_type").cast("int"))


@queries.query(_EXACT, "compare_ranges")
def compare_ranges_query(spark, d):
    """The same by digests of ranges of 64 and 1,024 ids."""
    a, b = copies(spark, d)
    out = compare_ranges(a, b, "id", ["cust", "id"], fine=64, coarse=1024)
    return out.withColumn("same_type", F.col("same_type").cast("int"))


def _eps_sql(name: str, x: str, y: str) -> str:
    off = f"NOT coalesce(abs({x} - {y}) <= 1e-5, false)"
    return f"""SELECT '{name}' AS "column", CAST(count(*) FILTER ({off}) = 0 AS INTEGER) AS passed,
  count(*) FILTER ({off}) AS failing, min(id) FILTER ({off}) AS first_id,
  CAST((SELECT {x} FROM t WHERE {off} ORDER BY id LIMIT 1) AS DOUBLE) AS first_a,
  CAST((SELECT {y} FROM t WHERE {off} ORDER BY id LIMIT 1) AS DOUBLE) AS first_b FROM t"""


@queries.query(f"{_PAIRS} {_eps_sql('price', 'a', 'b')} UNION ALL {_eps_sql('cust', 'c', 'e')}",
               "compare_eps")
def compare_eps_query(spark, d):
    a, b = copies(spark, d)
    out = compare_eps(a, b, "id", ["price", "cust"], eps=1e-5)
    return out.withColumn("passed", F.col("passed").cast("int"))
