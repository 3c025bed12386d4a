import importlib

import pytest
from pyspark.sql import functions as F

from edgeframe import Gather, check_index, duplicate_ids, gather, gather_many

g = importlib.import_module("edgeframe.operators.gather")


@pytest.fixture
def vertices(spark):
    return spark.range(10).select("id", (F.col("id") * 1.5).alias("x"), (-F.col("id")).alias("y"))


@pytest.fixture
def edges(spark):
    """A third of the edges and more share index 3."""
    return spark.range(600).select(
        F.col("id").alias("e"),
        F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 10).cast("long").alias("i"),
        (F.col("id") % 7).alias("j"))


def expected(edges):
    return sorted((r["e"], r["i"], r["j"], r["i"] * 1.5, -r["j"]) for r in edges.collect())


def test_two_selectors_keep_the_edges(edges, vertices):
    out = gather_many(edges, [Gather(vertices, "i", {"xi": "x"}), Gather(vertices, "j", {"yj": "y"})])
    assert out.columns == ["e", "i", "j", "xi", "yj"]
    assert sorted(tuple(r) for r in out.collect()) == expected(edges)


def test_columns_of_one_selector_share_a_join(edges, vertices):
    out = gather_many(edges, [Gather(vertices, "i", ["x"]), Gather(vertices, "i", ["y"]),
                              Gather(vertices, "i", {"z": F.col("x") + F.col("y")})])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    assert out.where(F.col("z") != F.col("x") + F.col("y")).count() == 0


def test_hot_values_are_spread_and_nothing_is_lost(spark, edges, vertices, monkeypatch):
    monkeypatch.setattr(g, "SMALL_EDGES", 0)
    monkeypatch.setattr(g, "SAMPLE", 1.0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert g.hot_keys(edges, "i", share=0.3) == {3: 0.6}
        assert g.hot_keys(edges.limit(0), "i") == {}
        assert g.hot_keys(edges.select(F.lit(None).cast("long").alias("i")), "i") == {}
        out = gather_many(edges, [Gather(vertices, "i", {"xi": "x"}),
                                  Gather(vertices, "j", {"yj": "y"})])
        assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in out.collect()) == expected(edges)
        hot = g.hot_values(edges, ["i"])
        assert list(hot) == ["i"] and 3 in hot["i"]
        known = gather_many(edges, [Gather(vertices, "i", {"xi": "x"}),
                                    Gather(vertices, "j", {"yj": "y"})], skew=hot)
        assert "_salt" in known._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in known.collect()) == expected(edges)
        plain = gather_many(edges, [Gather(vertices, "i", ["x"])], skew="off")
        assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_vertices_are_broadcast_without_a_shuffle(edges, vertices, spark, tmp_path):
    vertices.write.parquet(str(tmp_path / "v"))
    out = gather(edges, spark.read.parquet(str(tmp_path / "v")), "i", ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_names_must_be_new(edges, vertices):
    with pytest.raises(ValueError):
        gather(edges, vertices, "i", {"e": "x"})
    with pytest.raises(ValueError):
        gather_many(edges, [Gather(vertices, "i", ["x"]), Gather(vertices, "j", ["x"])])
    with pytest.raises(ValueError):
        gather(edges, vertices, "i", ["x"], skew="maybe")


def test_gather_from_the_edges_own_table(spark):
    nodes = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "id long, next long")
    out = gather(nodes, nodes, "next", {"after": "next"})
    assert sorted(tuple(r) for r in out.collect()) == [(0, 2, 2), (1, 0, 2), (2, 2, 2)]


def test_check_index_counts_edges(spark):
    edges = spark.createDataFrame([(0,), (1,), (5,), (5,), (-1,), (None,)], "i long")
    vertices = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    assert tuple(check_index(edges, "i", vertices=vertices).first()) == (1, 1, 3)
    assert tuple(check_index(edges, "i", 3).first()) == (1, 1, 3)
    assert tuple(check_index(edges.limit(0), "i", vertices=vertices).first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        check_index(edges, "i")


def test_duplicate_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (1,)], "id long")
    assert [tuple(r) for r in duplicate_ids(df).collect()] == [(1, 2)]


def test_an_edge_without_a_vertex_raises_or_is_left_out(spark, edges, vertices):
    assert gather(edges, vertices, "i", {"xi": "x"}, on_missing="raise").count() == 600
    lost = edges.withColumn("i", F.when(F.col("e") == 5, 99).when(F.col("e") != 7, F.col("i")))
    assert gather(lost, vertices, "i", {"xi": "x"}, on_missing="drop").count() == 598
    with pytest.raises(Exception, match="names no vertex"):
        gather(lost, vertices, "i", {"xi": "x"}).collect()
    for hot in ({}, {"i": {3: 0.6}}):
        one = g._attach(lost, vertices.select(F.col("id").alias("_gather_id"), F.col("x").alias("xi")),
                        "i", hot.get("i", {}), "raise")
        with pytest.raises(Exception, match="names no vertex"):
            one.collect()
        good = g._attach(edges, vertices.select(F.col("id").alias("_gather_id"), F.col("x").alias("xi")),
                         "i", hot.get("i", {}), "raise")
        assert sorted((r["e"], r["xi"]) for r in good.collect()) == sorted(
            (r["e"], r["i"] * 1.5) for r in edges.collect())
    with pytest.raises(ValueError):
        gather(edges, vertices, "i", ["x"], on_missing="keep")


def test_repeated_vertex_ids_can_fail(spark):
    vertices = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "id long, x double")
    two = spark.createDataFrame([(2,)], "i long")
    assert gather(two, vertices.where("id = 2"), "i", ["x"], unique="check").first().x == 4.0
    with pytest.raises(Exception, match="several vertices"):
        gather(two, vertices, "i", ["x"], unique="check").collect()


def test_near_moves_a_vertex_once_per_block(spark, vertices, monkeypatch):
    """Rows of one ``near`` value come out of one task, whatever is hot, null or repeated."""
    edges = spark.range(0, 900, 1, 6).select(
        F.col("id").alias("e"),
        F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id") % 10).cast("long").alias("i"),
        F.when(F.col("id") % 50 > 0, F.col("id") % 97).alias("row"))
    edges = edges.union(edges.where("e < 5"))
    plain = gather(edges, vertices, "i", {"xi": "x"})
    for small in (1 << 40, -1):
        monkeypatch.setattr(g, "SMALL_LISTS", small)
        monkeypatch.setattr(g, "SAMPLE", 1.0)
        near = gather(edges, vertices, "i", {"xi": "x"}, near="row")
        assert ("_salt" in near._jdf.queryExecution().analyzed().toString()) == (small < 0)
        assert near.schema == plain.schema
        assert sorted(map(str, near.collect())) == sorted(map(str, plain.collect()))
        places = near.select("row", F.spark_partition_id().alias("p")).distinct()
        assert places.count() == edges.select("row").distinct().count()
    alone = edges.select("i")
    assert gather(alone, vertices, "i", {"xi": "x"}, near="i").count() == 905


def test_near_treats_edges_without_a_vertex_like_gather(spark, vertices):
    lost = spark.createDataFrame([(1, 3, 0), (2, 77, 0), (3, None, 1)], "e long, i long, row long")
    kept = gather(lost, vertices, "i", {"xi": "x"}, near="row", on_missing="drop")
    assert [tuple(r) for r in kept.collect()] == [(1, 3, 0, 4.5)]
    with pytest.raises(Exception, match="names no vertex"):
        gather(lost, vertices, "i", {"xi": "x"}, near="row").collect()
    with pytest.raises(ValueError, match="already exist"):
        gather(lost, vertices, "i", {"row": "x"}, near="row")


def test_wide_vectors_move_by_blocks_of_rows(spark, tmp_path):
    """wide_gather_scatter: the vectors go to the rows' blocks, not with every edge."""
    from edgeframe.plans import all_queries

    spark.range(40).select((F.col("id") % 4).alias("l_partkey"), (F.col("id") % 3).alias(
        "l_suppkey"), F.lit(2.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast(
        "float"), 64).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = all_queries()["wide_gather_scatter"].build(spark, str(tmp_path))
    assert "collect_list" in out._jdf.queryExecution().optimizedPlan().toString()
    sums = {k: sum(2.0 * (i % 3) for i in range(40) if i % 4 == k) for k in range(5)}
    assert sorted(map(tuple, out.collect())) == sorted(
        (k, j, sums[k]) for k in range(5) for j in range(64))
