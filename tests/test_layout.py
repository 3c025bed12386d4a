import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from edgeframe.functions import V
from edgeframe.operators import Gather, gather_stored, open_edges, scatter_sum, store_edges

g = random.Random(4)
# A third of the edges leaves vertex 0.
EDGES = [(i, 0 if g.random() < 0.33 else g.randrange(60), g.randrange(60), i % 7 + 0.5)
         for i in range(3000)]
VALUES = {i: float(i * i % 17) for i in range(60)}


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame(EDGES, "e bigint, src bigint, dst bigint, w double"),
            spark.createDataFrame(list(VALUES.items()), "id bigint, h double"))


def ends(vertices):
    return [Gather(vertices, "src", {"a": "h"}), Gather(vertices, "dst", {"b": "h"})]


def exchanged_edges(df):
    """Do rows of the edges go through a shuffle before they are added up?"""
    seen = []

    def walk(node, below):
        name = node.nodeName()
        if name == "InputAdapter" or name.startswith("WholeStageCodegen"):
            return walk(node.children().head(), below)
        if name.startswith("Scan") or name.startswith("FileScan"):
            if "w" in node.schema().fieldNames():
                seen.append(below)
            return
        # Above the first sum there are sums only.
        inside = False if "Aggregate" in name else below or name == "Exchange"
        for k in range(node.children().size()):
            walk(node.children().apply(k), inside)

    walk(df._jdf.queryExecution().executedPlan(), False)
    assert seen
    return any(seen)


@pytest.mark.parametrize("by,parts", [("src", 9), (["src", "dst"], 9), ("dst", 1)])
def test_gathers_and_sums(spark, tables, tmp_path, by, parts):
    edges, vertices = tables
    store_edges(edges, str(tmp_path / "l"), by=by, indices=["src", "dst"], parts=parts, sample=1.0)
    layout = open_edges(spark, str(tmp_path / "l"))
    got = gather_stored(layout, ends(vertices))
    assert sorted((r.e, r.src, r.dst, r.w, r.a, r.b) for r in got.collect()) == [
        (e, s, d, w, VALUES[s], VALUES[d]) for e, s, d, w in EDGES]
    sums = scatter_sum(got, "src", {"y": V.of("w") * (V.of("b") - V.of("a"))}, 61, scale=4)
    want = defaultdict(float)
    for _, s, d, w in EDGES:
        want[s] += w * (VALUES[d] - VALUES[s])
    assert {r.id: r.y for r in sums.collect()} == {i: want[i] for i in range(61)}


def test_edges_stay(spark, tables, tmp_path):
    edges, vertices = tables
    layout = store_edges(edges, str(tmp_path / "l"), by=["src", "dst"], parts=9, sample=1.0)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                           "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = gather_stored(layout, ends(vertices))
        y = scatter_sum(got, "src", {"y": V.of("w") * V.of("b")}, scale=4)
        assert not exchanged_edges(y)
        plain = edges.join(vertices, F.col("src") == F.col("id"))
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_hot_rows_spread(spark, tables, tmp_path):
    edges, _ = tables
    for k, by in enumerate((["src"], ["src", "dst"])):
        layout = store_edges(edges, str(tmp_path / f"l{k}"), by=by, parts=16, sample=1.0)
        of_hot = Counter(r["_part"] for r in layout.edges.where("src = 0").collect())
        assert max(of_hot.values()) < sum(of_hot.values()) / 3
        # A vertex that is not hot has its edges in one part, or in one row of the grid.
        spread = layout.halos["src"].where("_halo_id <> 0").groupBy("_halo_id").count()
        assert spread.agg(F.max("count")).first()[0] <= (1 if k == 0 else 4)


def test_odd_edges(spark, tables, tmp_path):
    _, vertices = tables
    rows = [(1, None, 2, 1.0), (2, 3, 99, 1.0), (3, 4, 5, None), (3, 4, 5, None)]
    edges = spark.createDataFrame(rows, "e bigint, src bigint, dst bigint, w double")
    layout = store_edges(edges, str(tmp_path / "l"), by=["src", "dst"], parts=4)
    assert [r.e for r in gather_stored(layout, ends(vertices), on_missing="drop").collect()] == [3, 3]
    with pytest.raises(Exception, match="names no vertex"):
        gather_stored(layout, ends(vertices)).collect()
    with pytest.raises(ValueError, match="no halo"):
        gather_stored(layout, [Gather(vertices, "e", {"a": "h"})])
    with pytest.raises(ValueError, match="already exist"):
        gather_stored(layout, [Gather(vertices, "src", {"w": "h"})])
    with pytest.raises(ValueError, match="one or two"):
        store_edges(edges, str(tmp_path / "m"), by=["src", "dst", "e"])
    empty = store_edges(edges.limit(0), str(tmp_path / "n"), by="src", parts=2)
    assert gather_stored(empty, [Gather(vertices, "src", {"a": "h"})]).count() == 0
