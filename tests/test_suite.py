"""Every registered query against its SQL, whole tables, on the smallest data."""

import math
import os

import pytest

import __spark_entry__ as entry
from edgeframe.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR"}

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    q = all_queries()[name]
    df = q.build(spark, SF)
    rows = df.collect()
    cur = con.execute(q.sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    kinds = dict(df.dtypes)
    assert {c[0]: str(c[1]) for c in cur.description} == {n: TYPES[kinds[n]] for n in names}
    assert comparable(rows, df.columns) == comparable(cur.fetchall(), names)
    assert all(not (isinstance(v, float) and math.isnan(v)) for r in rows for v in r)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "y"]
