import itertools

import pytest
from pyspark.sql import functions as F

from edgeframe import (
    V, coo_to_csr_offsets, csr_to_coo, edge_position, global_position, offset_pointer,
    position_owner, running_sum, scatter_sum, segment_running_sum, segment_sum,
)


@pytest.fixture(scope="module")
def edges(spark):
    """Row 4 owns more than a third; rows 0, 5 and 9 are empty."""
    rows = [r for r in (1, 2, 3, 6, 7, 8) for _ in range(5)] + [4] * 40
    data = [(r, (i * 37) % 101, float(i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row long, t long, v double").repartition(5).cache()


def test_positions_follow_row_then_tiebreak(edges):
    out = edge_position(edges, "row", ["t"]).collect()
    want = sorted((r["row"], r["t"]) for r in edges.collect())
    assert [(r["row"], r["t"]) for r in sorted(out, key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in out) == list(range(len(want)))


def test_copies_get_different_positions(spark):
    df = spark.range(90).select((F.col("id") % 3 == 0).cast("int").alias("k")).repartition(6)
    out = global_position(df, ["k"]).collect()
    assert sorted(r["pos"] for r in out) == list(range(90))
    assert all(r["k"] == (r["pos"] >= 60) for r in out)


def test_position_of_nothing(spark):
    assert global_position(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize("block", [1 << 14, 4, 2])
def test_offsets_count_the_rows_before(edges, block):
    out = {r["row"]: (r["start"], r["end"])
           for r in coo_to_csr_offsets(edges, "row", 10, block=block).collect()}
    counts = [sum(r["row"] == k for r in edges.collect()) for k in range(10)]
    ends = list(itertools.accumulate(counts))
    assert out == {k: (ends[k] - counts[k], ends[k]) for k in range(10)}
    offsets = coo_to_csr_offsets(edges, "row", 10, block=block)
    pointer = {r["row"]: r["offset"] for r in offset_pointer(offsets, 10).collect()}
    assert [pointer[k] for k in range(11)] == [0, *ends]


@pytest.mark.parametrize("block", [1 << 14, 7, 2])
def test_ranges_expand_and_find_their_owners(spark, edges, block):
    offsets = coo_to_csr_offsets(edges, "row", 10)
    want = sorted((r["pos"], r["row"]) for r in edge_position(edges, "row", ["t"]).collect())
    coo = csr_to_coo(offsets, block=block)
    assert sorted((r["pos"], r["row"]) for r in coo.collect()) == want
    asked = coo.select("pos").unionByName(spark.createDataFrame([(500,)], "pos long"))
    owned = position_owner(asked, offsets, block=block)
    assert sorted((r["pos"], r["row"]) for r in owned.collect()) == want


@pytest.mark.parametrize("block", [1 << 14, 5])
def test_segment_sum_equals_keyed_sum(edges, block):
    offsets = coo_to_csr_offsets(edges, "row", 10)
    values = edge_position(edges, "row", ["t"]).select("pos", "v")
    a = segment_sum(values, offsets, {"s": V.of("v")}, block=block).collect()
    b = scatter_sum(edges, "row", {"s": V.of("v")}, 10).collect()
    c = segment_sum(values, offsets, {"s": V.of("v")}, n=10, block=block).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, c))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("block", [1 << 14, 8, 2])
def test_running_sums_restart_at_each_key(edges, block):
    placed = edge_position(edges, "row", ["t"])
    out = segment_running_sum(placed, "row", "pos", {"before": V.of("v")}, block=block)
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r["pos"]):
        assert r["before"] == seen.get(r["row"], 0.0)
        seen[r["row"]] = r["before"] + r["v"]
    assert len(seen) == 7


@pytest.mark.parametrize("block", [1 << 14, 3])
@pytest.mark.parametrize("scale", [None, 2])
def test_running_sum_over_sparse_positions(spark, block, scale):
    df = spark.range(40).select((F.col("id") * F.col("id")).alias("p"), (F.col("id") * 0.5).alias("v"))
    out = running_sum(df, "p", {"r": V.of("v")}, inclusive=True, block=block, scale=scale)
    got = [r["r"] for r in sorted(out.collect(), key=lambda r: r["p"])]
    assert got == list(itertools.accumulate(i * 0.5 for i in range(40)))


def test_no_window_spans_more_than_a_block(edges):
    offsets = coo_to_csr_offsets(edges, "row", 10, block=2)
    plan = offsets._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
