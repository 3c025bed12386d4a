import pytest
from pyspark.sql import functions as F

from edgeframe import (
    collect_tensor, partition_by, random_coo, random_csr, read_tensor, restore, snapshot,
    write_tensor, zeros,
)
from edgeframe.functions import mixed_index, mixed_unit
from edgeframe.session import (
    PARTITION_BYTES, leaf_bytes, shared_root, size_shuffles, stored_tables, written,
)


def test_tensor_roundtrip_with_types(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 5), (0, [3, 4], 6)], "id long, v array<int>, w int")
    write_tensor(df, str(tmp_path), "t")
    back = read_tensor(spark, str(tmp_path), "t", "double")
    assert back.dtypes == [("id", "bigint"), ("v", "array<double>"), ("w", "double")]
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(0, [3.0, 4.0], 6.0),
                                                                (1, [1.0, 2.0], 5.0)]
    one = read_tensor(spark, str(tmp_path), "t", values={"x": "w"})
    assert one.columns == ["id", "x"]
    assert "v" not in one._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    with pytest.raises(ValueError):
        read_tensor(spark, str(tmp_path), "t", id="nope")


def test_collect_keeps_order_and_refuses_large(spark):
    df = spark.range(20).select((19 - F.col("id")).alias("id"))
    assert list(collect_tensor(df)["id"]) == list(range(20))
    with pytest.raises(ValueError):
        collect_tensor(df, limit=19)


def test_zeros(spark):
    df = zeros(spark, 3, 2)
    assert df.columns == ["id", "v_0", "v_1"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(i, 0.0, 0.0) for i in range(3)]
    assert dict(zeros(spark, 1, dtype="bigint").dtypes)["v"] == "bigint"


def test_random_coo_depends_on_seed_only(spark):
    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    a = random_coo(spark, 11, 7, 200)
    assert a.columns == ["edge_id", "row", "col_1", "col_2", "pair_0", "pair_1",
                         *[f"six_{i}" for i in range(6)]]
    assert rows(a) == rows(random_coo(spark, 11, 7, 200).repartition(3))
    assert rows(a) != rows(random_coo(spark, 11, 7, 200, seed=53))
    top = a.agg(F.min("row"), F.max("row"), F.min("col_1"), F.max("col_2"),
                F.countDistinct("row"), F.max("pair_0")).first()
    assert top[0] >= 0 and top[1] < 11 and top[2] >= 0 and top[3] < 7
    assert top[4] == 11 and top[5] < 1.0


def test_random_numbers_spread_evenly_and_pass_2_31(spark):
    counts = spark.range(20000).select(mixed_index(F.col("id"), 10, 1, 0).alias("k")).groupBy(
        "k").count().collect()
    assert len(counts) == 10 and all(1800 < r["count"] < 2200 for r in counts)
    big = spark.range(1000).select(mixed_index(F.col("id"), 1 << 40, 1, 0).alias("k"))
    assert big.agg(F.max("k")).first()[0] > 1 << 32
    assert big.distinct().count() == 1000
    far = spark.range(2147483647 * 3, 2147483647 * 3 + 50).select(
        mixed_unit(F.col("id"), 1, 3).alias("u")).distinct().count()
    assert far > 30


def test_random_csr_offsets_cover_everything(spark):
    offsets, edges = random_csr(spark, 40, 9, 100)
    rows = [tuple(r) for r in offsets.orderBy("row").collect()]
    assert [r[0] for r in rows] == list(range(40))
    assert rows[0][1] == 0 and rows[-1][2] == 100
    assert all(a[2] == b[1] and a[1] <= a[2] for a, b in zip(rows, rows[1:]))
    assert edges.count() == 100 and edges.agg(F.max("col")).first()[0] < 9
    assert [tuple(r) for r in random_csr(spark, 1, 9, 5)[0].collect()] == [(0, 0, 5)]


def test_snapshot_and_restore(spark, tmp_path):
    state = {"h": spark.range(5).withColumn("v", F.lit(1.0)), "u": spark.range(3)}
    snapshot(state, str(tmp_path), 10)
    snapshot({"h": spark.range(6).withColumn("v", F.lit(2.0))}, str(tmp_path), 20)
    back = restore(spark, str(tmp_path), 10, ["h", "u"])
    assert back["h"].count() == 5 and back["u"].count() == 3
    assert restore(spark, str(tmp_path), 20, ["h"])["h"].agg(F.sum("v")).first()[0] == 12.0


def test_partition_by(spark):
    df = spark.range(100).withColumn("k", F.lit(1))
    assert partition_by(df, n=5).rdd.getNumPartitions() == 5
    assert partition_by(df, "id", 4, ranges=True).rdd.getNumPartitions() == 4
    sizes = partition_by(df, n=4).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and all(20 <= r["count"] <= 30 for r in sizes)
    with pytest.raises(ValueError):
        partition_by(df)


def test_written_tables_go_to_the_shared_folder(spark):
    df = written(spark.range(4), "t")
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) in df.inputFiles()[0]
    assert df.count() == 4


def test_shuffles_are_sized_by_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffles(spark, 1) == 4
        assert size_shuffles(spark, 10 * PARTITION_BYTES + 1) == 11
        assert spark.conf.get(key) == "11"
        ten = spark.range(10)
        twice = ten.join(spark.range(5).withColumnRenamed("id", "b"), F.col("id") == F.col("b"))
        assert leaf_bytes(twice) == 15 * 8      # not the product
    finally:
        spark.conf.unset(key)


def test_stored_tables_are_deleted_by_their_owner(spark):
    import os

    from edgeframe.operators import edge_position
    edges = spark.range(40).selectExpr("id % 5 AS k", "id")
    with stored_tables(spark) as paths:
        assert edge_position(edges, "k", ["id"]).count() == 40
        assert paths and all(os.path.exists(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)
