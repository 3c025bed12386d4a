"""Programs of several stages against loops, and what they refuse before any job."""

import random

import pytest
from pyspark.sql import functions as F

from edgeframe.plans.staged import Edges, Total, Vertices, run


@pytest.fixture(scope="module")
def data(spark):
    g = random.Random(4)
    edges = [(k, g.randrange(6), g.randrange(9), g.randrange(9), g.randrange(10) / 4) for k in range(60)]
    points = [(k, k / 2, 9 - k) for k in range(9)]
    return (spark.createDataFrame(edges, "edge bigint, row bigint, a bigint, b bigint, w double"),
            spark.createDataFrame(points, "id bigint, x double, y int"), edges, points)


def program(spark, data):
    edges = Edges("edges", data[0], ["edge"])
    points, rows = Vertices("points", data[1]), Vertices("rows", spark.range(7))
    w = edges.value("w")
    degree = edges.sum("a", points)(edges.fill(1.0))
    mean = edges.sum("a", points)(w) / degree                   # safe: 0 without edges
    on = edges.gather("a")(mean) - edges.gather("b")(points.value("x", "y")).norm()
    by_row = edges.sum("row", rows)(on)
    again = edges.gather("row")(by_row * 2)                     # a third stage
    return {"on": on, "degree": degree, "by_row": by_row, "last": edges.sum("b", points)(again + w),
            "t": Total(on * w), "n": Total(edges.fill(1.0))}


def loop(data):
    _, _, edges, points = data
    at = {p[0]: p for p in points}
    degree = {p: 0 for p in at}
    total = {p: 0.0 for p in at}
    for _, _, a, _, w in edges:
        degree[a] += 1
        total[a] += w
    on, by_row, last = {}, {r: 0.0 for r in range(7)}, {p: 0.0 for p in at}
    for k, r, a, b, w in edges:
        on[k] = total[a] / degree[a] - (at[b][1] ** 2 + at[b][2] ** 2) ** 0.5
        by_row[r] += on[k]
    for k, r, a, b, w in edges:
        last[b] += 2 * by_row[r] + w
    return on, degree, by_row, last, sum(on[e[0]] * e[4] for e in edges)


@pytest.mark.parametrize("once", [False, True])
def test_against_a_loop(spark, data, once):
    on, degree, by_row, last, t = loop(data)
    got = run(program(spark, data), once=once)
    assert [len(s) for s in got.stages] == [2, 1, 1]
    assert {r.edge: r.on for r in got.maps["edges"].collect()} == pytest.approx(on)
    points = got.rows["points"].collect()
    assert {r.id: r.degree for r in points} == degree
    assert {r.id: r["last"] for r in points} == pytest.approx(last)
    assert {r.id: r.by_row for r in got.rows["rows"].collect()} == pytest.approx(by_row)
    row = got.totals.first()
    assert row.t == pytest.approx(t) and row.n == 60


def test_one_join_per_table_and_index(spark, data):
    edges, points = Edges("edges", data[0]), Vertices("points", data[1])
    x, y = points.value("x"), points.value("y")
    both = edges.gather("a")(x) * edges.gather("a")(y) + edges.gather("a")(x * 2)
    rows = Vertices("rows", spark.range(7))
    out = run({"s": edges.sum("row", rows)(both), "m": edges.sum("row", rows)(both * 2)})
    plan = out.rows["rows"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2      # the gather, and the rows with their sums
    assert plan.count("Aggregate") == 1


def test_once_reads_the_edges_once(spark, data, tmp_path):
    path = str(tmp_path / "edges")
    data[0].write.parquet(path)
    edges = Edges("edges", spark.read.parquet(path), ["edge"])
    rows = Vertices("rows", spark.range(7))
    w = edges.value("w")
    out = run({"m": w * 2, "s": edges.sum("row", rows)(w), "t": Total(w)}, once=True)
    for df in (out.maps["edges"], out.rows["rows"], out.totals):
        assert not any(f.startswith(f"file:{path}") or path in f for f in df.inputFiles())
    assert out.totals.first().t == sum(e[4] for e in data[2])


def test_faults_are_found_before_any_job(spark, data):
    edges, points = Edges("edges", data[0]), Vertices("points", data[1])
    other = Edges("other", data[0])
    with pytest.raises(ValueError, match="do not meet"):
        edges.value("w") + points.value("x")
    with pytest.raises(ValueError, match="do not meet"):
        edges.value("w") + other.value("w")
    with pytest.raises(ValueError, match="no column"):
        edges.gather("nowhere")
    with pytest.raises(TypeError, match="not an index"):
        edges.gather("w")
    with pytest.raises(TypeError, match="vertex value"):
        edges.gather("a")(edges.value("w"))
    with pytest.raises(ValueError, match="takes a value of edges"):
        edges.sum("row", points)(other.value("w"))
    with pytest.raises(TypeError, match="value types differ"):
        edges.value("w") * edges.value("a", dtype="bigint")
    with pytest.raises(TypeError, match="not an id"):
        Vertices("points", data[1], "x")
    with pytest.raises(TypeError, match="total over edges"):
        run({"t": Total(points.value("x"))})
    with pytest.raises(ValueError, match="an output"):
        run({})


def test_empty_edges(spark, data):
    edges = Edges("edges", data[0].limit(0), ["edge"])
    rows = Vertices("rows", spark.range(3))
    out = run({"s": edges.sum("row", rows)(edges.value("w")), "m": edges.value("w"),
               "t": Total(edges.value("w"))}, once=True, scale=2)
    assert [r.s for r in out.rows["rows"].collect()] == [0.0] * 3
    assert out.maps["edges"].count() == 0 and out.totals.first().t == 0.0
