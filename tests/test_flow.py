import math
import os

import pytest
from pyspark.sql import functions as F

from edgeframe import (
    Gather, V, compare_close, edge_divergence, edge_interpolate, gather_many, iterate,
    restore, scatter_sum, snapshot, weighted_update,
)
from edgeframe.session import discard, written_path


@pytest.fixture
def ring(spark):
    """Six vertices in a ring, edges in both directions."""
    edges = spark.range(12).select(
        F.col("id").alias("e"), (F.col("id") % 6).alias("src"),
        F.when(F.col("id") < 6, (F.col("id") + 1) % 6).otherwise((F.col("id") + 5) % 6).alias("dst"),
        F.lit(0.25).alias("alpha"))
    state = spark.range(6).select("id", (F.col("id") * 1.0).alias("h"), F.lit(2.0).alias("area"))
    return edges, state


def test_interpolate(ring):
    edges, state = ring
    out = edge_interpolate(edges, state, ["h"], "alpha")
    assert out.columns == ["e", "src", "dst", "alpha", "h_f"]
    for r in out.collect():
        assert r["h_f"] == 0.75 * r["src"] + 0.25 * r["dst"]


def test_divergence(ring):
    edges, state = ring
    out = edge_divergence(edges, "dst", {"f": V.of("src")}, state)
    got = {r["id"]: r["f"] for r in out.collect()}
    assert got == {i: -((i - 1) % 6 + (i + 1) % 6) / 2.0 for i in range(6)}


def test_weighted_update_keeps_rows_without_a_delta(spark):
    state = spark.createDataFrame([(0, 1.0, 5), (1, 2.0, 6)], "id long, h double, tag int")
    d1 = spark.createDataFrame([(0, 10.0)], "id long, h double")
    d2 = spark.createDataFrame([(0, 1.0), (1, 4.0)], "id long, h double")
    out = weighted_update(state, [(0.5, d1), (0.25, d2)], ["h"])
    assert sorted(map(tuple, out.collect())) == [(0, 6.25, 5), (1, 3.0, 6)]
    assert weighted_update(state, [], ["h"]).columns == state.columns


def diffuse(edges):
    def step(state):
        ends = gather_many(edges, [Gather(state, "src", {"hs": "h"}), Gather(state, "dst", {"hd": "h"})])
        change = scatter_sum(ends, "src", {"h": V.of("hd") - V.of("hs")})
        return weighted_update(state, [(0.1, change)], ["h"])
    return step


def test_iterate_matches_a_loop_and_any_checkpointing(ring):
    edges, state = ring
    h = [float(i) for i in range(6)]
    for _ in range(5):
        h = [h[i] + 0.1 * ((h[(i + 1) % 6] - h[i]) + (h[(i - 1) % 6] - h[i])) for i in range(6)]
    runs = [iterate(state, diffuse(edges), 5, checkpoint_every=k) for k in (1, 2)]
    for run in runs:
        got = {r["id"]: r["h"] for r in run.collect()}
        assert all(math.isclose(got[i], h[i], abs_tol=1e-12) for i in range(6))
    assert compare_close(*runs, "id", ["h"]).first()["all_close"]
    assert iterate(state, diffuse(edges), 0) is state
    with pytest.raises(ValueError):
        iterate(state, diffuse(edges), 1, checkpoint_every=0)


def test_stored_steps_can_be_snapshot(spark, ring, tmp_path):
    edges, state = ring
    iterate(state, diffuse(edges), 5, checkpoint_every=2,
            on_step=lambda k, s: snapshot({"h": s}, str(tmp_path), k))
    back = restore(spark, str(tmp_path), 4, ["h"])["h"]
    want = iterate(state, diffuse(edges), 4)
    assert compare_close(back, want, "id", ["h"]).first()["all_close"]


def test_only_the_last_stored_state_stays(spark, ring):
    edges, state = ring
    out = iterate(state, diffuse(edges), 5, name="kept")
    folder = os.path.dirname(written_path(spark, "x"))
    assert [n for n in os.listdir(folder) if n.startswith("kept-")][0].startswith("kept-4-")
    assert len([n for n in os.listdir(folder) if n.startswith("kept-")]) == 1
    assert out.count() == 6
    with pytest.raises(ValueError):
        discard(spark, "/somewhere/else")


def test_checkpoints_cut_the_plan(ring):
    edges, state = ring
    sizes = [len(iterate(state, diffuse(edges), n)._jdf.queryExecution().optimizedPlan().toString())
             for n in (2, 5)]
    assert sizes[1] < sizes[0] * 1.1


def test_edges_are_summed_where_the_last_gather_put_them(spark):
    """A sum by the index of the join before it moves no edges; null rows still fail, null
    vertex ids do not, and rows a join drops are not looked at."""
    edges = spark.createDataFrame([(k % 5, k % 3, float(k)) for k in range(60)],
                                  "row long, col long, w double")
    state = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, 5.0), (None, 6.0)],
                                  "id long, h double")
    lost = edges.union(spark.createDataFrame([(None, 1, 1.0)], edges.schema))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def summed(e, on_missing="raise"):
            met = gather_many(e, [Gather(state, "col", {"c": "h"}), Gather(state, "row", {"r": "h"})],
                              on_missing=on_missing)
            return scatter_sum(met, "row", {"s": V.of("w") * V.of("c") * V.of("r")}, scale=2)

        out = summed(edges)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 4    # two gathers, both sides
        want = {r: sum(k * (k % 3 + 1.0) * (r + 1) for k in range(60) if k % 5 == r)
                for r in range(5)}
        assert {r["id"]: r["s"] for r in out.collect()} == want
        assert {r["id"]: r["s"] for r in summed(lost, "drop").collect()} == want
        direct = scatter_sum(lost, "row", {"s": V.of("w")})
        with pytest.raises(Exception, match="row is null"):
            direct.collect()
        with pytest.raises(Exception, match="row is null"):
            state.join(direct, "id", "left").collect()
        kept = scatter_sum(lost, "row", {"s": V.of("w")}, on_null="drop").collect()
        assert sorted(r["id"] for r in kept) == [0, 1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["iterate_k", "iterate_snapshots"])
def test_a_step_moves_the_edges_twice(spark, tmp_path, name):
    from edgeframe.plans import flows

    spark.createDataFrame([(k % 4, k % 3, 1.0) for k in range(24)], "l_partkey long, "
                          "l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 10.0 * k) for k in range(4)], "p_partkey long, p_retailprice "
                          "double").write.parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start, step = flows.pull_step(spark, str(tmp_path))
        plan = step(start)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 5    # edges twice, prices thrice
        out = flows.queries.queries[name].build(spark, str(tmp_path))
        assert out.count() == (4 if name == "iterate_k" else 12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
